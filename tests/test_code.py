"""Code text, statements and what is read from them, with the expected rows spelled out."""

import pytest
from pyspark.sql import functions as F

from rulewright.operators import code as C
from rulewright.operators import declarations as D
from rulewright.operators import lines as L
from rulewright.operators import metrics as M

TEXT = r"""package a;
/* class X { */ class A /* { */ extends B {
  String s = "a { \" } /* "; char c = '{'; // }
  /* void no() {
  } */ int[] a = {1, {2, 3}};
  @Override
  @Names({"x", "y"})
  public Map<String, List<int[]>> f(
      final int a, @N(1) Map<K, V> m)
      throws E {
    for (int i = 0; i < 3; i++) { if (x) y(); else { z(() -> { q(); }); } }
    try { } catch (E e) { }
  }
  enum S { P, Q }
}"""
ODD = """x
*/ y { /*
 "*/ z }
 '\\'' /*/
 {*/ }"""


@pytest.fixture(scope="module")
def lines(spark):
    return L.explode_lines(spark.createDataFrame([(1, TEXT), (2, ODD), (3, "")], "file_id bigint, text string"), "file_id", "text")


def lines_of(spark, text):
    return L.explode_lines(spark.createDataFrame([(1, text)], "file_id bigint, text string"), "file_id", "text")


@pytest.mark.parametrize("size", [None, 1, 2])
def test_code_text(lines, size):
    got = {(r.file_id, r.line_no): r.code for r in C.code_text(lines, size).collect()}
    assert got[1, 2] == "                class A         extends B {"
    assert got[1, 3] == "  String s = \"            \"; char c = ' ';     "
    assert [got[1, i].strip() for i in (4, 5, 7)] == ["", "int[] a = {1, {2, 3}};", '@Names({" ", " "})']
    assert [got[2, i].strip() for i in range(1, 6)] == ["x", "*/ y {", "z }", "'  '", "}"]
    assert all(len(got[r.file_id, r.line_no]) == len(r.line) for r in lines.collect())


@pytest.mark.parametrize("size", [None, 1, 3])
def test_statements(lines, size):
    rows = C.statements(lines, size).orderBy("file_id", "stmt_no").collect()
    got = [(r.start_line, r.line_no, r.term, r.depth, r.end_line, r.nesting, r.empty) for r in rows if r.file_id == 1]
    assert got == [
        (1, 1, ";", 0, None, 0, False), (2, 2, "{", 0, 15, 0, False), (3, 3, ";", 1, None, 0, False), (3, 3, ";", 1, None, 0, False),
        (5, 5, ";", 1, None, 0, False), (8, 10, "{", 1, 13, 0, False), (11, 11, "{", 2, 11, 0, False), (11, 11, ";", 3, None, 1, False),
        (11, 11, "{", 3, 11, 1, False), (11, 11, "{", 4, 11, 2, False), (11, 11, ";", 5, None, 2, False), (11, 11, ";", 4, None, 2, False),
        (12, 12, "{", 2, 12, 0, True), (12, 12, "{", 2, 12, 0, True), (14, 14, "{", 1, 14, 0, False), (14, 14, "}", 2, None, 0, False)]
    texts = {r.stmt_no: r.text for r in rows if r.file_id == 1}
    assert texts[6] == "for (int i = 0; i < 3; i++)" and texts[4] == "int[] a = (1, (2, 3))"
    assert texts[5].endswith("public Map<String, List<int[]>> f( final int a, @N(1) Map<K, V> m) throws E")


def test_declarations(lines):
    st = C.statements(lines)
    methods = [(r.class_name, r.name, r.parameter_types, r.parameter_names, r.return_type, r.modifiers, r.start_line, r.end_line)
               for r in D.extract_methods(st).collect()]
    assert methods == [("A", "f", ["int", "Map<K, V>"], ["a", "m"], "Map<String, List<int[]>>", ["public"], 8, 13)]
    types = {r.name: (r.kind, r.start_line, r.end_line, r.annotations) for r in D.extract_types(st, lines).collect()}
    assert types == {"A": ("class", 2, 15, []), "S": ("enum", 14, 14, [])}
    assert {r.name for r in D.type_names(lines).collect()} == {"A", "S"}
    fields = {(r.name, r.type_name, r.has_initializer, r.is_enum_constant) for r in D.extract_fields(st).collect()}
    assert fields == {("s", "String", True, False), ("c", "char", True, False), ("a", "int[]", True, False), ("P", "S", True, True), ("Q", "S", True, True)}


HEADERS = """class C<T> {
  Map<String, Integer> f(Map<String, List<A>> m, int... rest) { return null; }
  @Override public void g(@Nullable String s) { }
  <T extends B> T h(T t) { return t; }
  private static final <K, V>
      Map<K, V> three(
          K k) throws X, Y
  {
    return a < b && c > d(e) ? x : new HashMap<K, V>();
  }
  C(int a) { this(a, 1); }
  @A(x = @B({1, 2}))
  abstract int[] last();
  private int a = f(1, 2), b[], c = x < y ? g(p, q) : 0;
  Map<String, Integer> m = new HashMap<String, Integer>(), n;
  enum E { ONE(1),
    TWO(2), THREE; int v; }
}"""


def test_ordinary_headers(spark):
    st = C.statements(lines_of(spark, HEADERS))
    got = {r.name: (r.return_type, r.parameter_types, r.start_line, r.end_line) for r in D.extract_methods(st).collect()}
    assert got == {
        "f": ("Map<String, Integer>", ["Map<String, List<A>>", "int..."], 2, 2), "g": ("void", ["String"], 3, 3), "h": ("T", ["T"], 4, 4),
        "three": ("Map<K, V>", ["K"], 5, 10), "<init>C(int)": ("void", ["int"], 11, 11), "last": ("int[]", [], 13, 13)}
    fields = {(r.class_name, r.name, r.type_name, r.has_initializer, r.declaration_line) for r in D.extract_fields(st).collect()}
    assert fields == {("C", "a", "int", True, 14), ("C", "b", "int", False, 14), ("C", "c", "int", True, 14), ("C", "m", "Map<String, Integer>", True, 15),
                      ("C", "n", "Map<String, Integer>", False, 15), ("E", "ONE", "E", True, 16), ("E", "TWO", "E", True, 17), ("E", "THREE", "E", True, 17),
                      ("E", "v", "int", False, 17)}


def test_literals_open_no_blocks(spark):
    lines = lines_of(spark, 'class A {\n  void f() {\n    g("{");\n  }\n}')
    ends = {r.line_no: r.end_line for r in L.block_ends(lines).collect()}
    assert ends == {1: 5, 2: 4}
    assert [(r.start_line, r.end_line) for r in D.extract_methods(C.statements(lines)).collect()] == [(2, 4)]


def test_words_in_comments_and_literals_decide_nothing(spark):
    text = 'class A {\n  void f(List<?> a) {\n    // if this or that && more\n    s = "if (a && b || c) while ?";\n    /* for case */ run(\'?\');\n  }\n}'
    ms = M.method_statements(C.parse(lines_of(spark, text)))
    assert [tuple(r)[2:] for r in M.method_metrics(ms).collect()] == [(1, 0, 5, 0)]


def test_calls_keep_their_literals(spark):
    lines = lines_of(spark, '  x.run("a, (b)", 2); Map<K, V> f(int a) {\n  return go("\\"", y); // no(1)')
    got = [(r.line_no, r.receiver, r.method_name, r.arguments) for r in D.extract_calls(lines).orderBy("line_no", "call_no").collect()]
    assert got[0] == (1, "x", "run", ['"a, (b)"', "2"]) and got[-1] == (2, None, "go", ['"\\""', "y"]) and all(g[2] != "no" for g in got)


def test_unknown_names_get_null(spark):
    st = C.statements(lines_of(spark, "package p;\nclass A { void f() { }\n int f(int a) { } }"))
    lines = lines_of(spark, "package p;\nclass A { void f() { }\n int f(int a) { } }")
    types, methods = D.extract_types(st, lines), D.extract_methods(st)
    asked = spark.createDataFrame([(1, "p", "A", "f"), (1, "p", "A", "g"), (1, "p", "B", "f"), (1, None, "p.A", "f")], "file_id bigint, package string, name string, method_name string")
    got = {(r.name, r.method_name): (r.found_file, r.return_type) for r in D.find_method(methods, types, asked).collect()}
    assert got == {("A", "f"): (1, "void"), ("A", "g"): (1, None), ("B", "f"): (None, None), ("p.A", "f"): (1, "void")}


def test_rewrites_leave_literals_alone(spark):
    df = spark.createDataFrame([(t,) for t in ["a(\"x\") + b // a", "b", "\"a\"", "'a' a \"\\\"a\" /* a */ a"]], "t string")
    up = C.outside_literals(F.col("t"), lambda c: F.replace(c, F.lit("a"), F.lit("AA")))
    assert [r[0] for r in df.select(up).collect()] == ["AA(\"x\") + b // a", "b", "\"a\"", "'a' AA \"\\\"a\" /* a */ AA"]
