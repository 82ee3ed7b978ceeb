"""Small hand-written inputs with the expected rows spelled out."""

import pytest
from pyspark.sql import functions as F

from rulewright.functions import text as T
from rulewright.operators import code as C
from rulewright.operators import declarations as D
from rulewright.operators import file_rules as X
from rulewright.operators import findings as P
from rulewright.operators import fixes as A
from rulewright.operators import graph as G
from rulewright.operators import line_rules as R
from rulewright.operators import lines as L
from rulewright.operators import metrics as M


@pytest.fixture(scope="module")
def lines_of(spark):
    def make(*texts):
        df = spark.createDataFrame(list(enumerate(texts, 1)), "file_id bigint, text string")
        return L.explode_lines(df, "file_id", "text")
    return make


def texts(df):
    return [r.line for r in df.orderBy("file_id", "line_no").collect()]


SIZES = """class Sizes {
    boolean a = list.size() == 0;
    boolean b = list.size() > 0;
    boolean c = list.size() >= 1;
    boolean d = 0 == list.size();
    boolean e = 0 < list.size();
    boolean f = list.size() != 0;
    boolean g = 0 != list.size();
    boolean h = list.size() >= 10;
    String s = "list.size() == 0";
}"""


def test_size_checks(lines_of):
    got = texts(R.rewrite(lines_of(SIZES), "R20"))
    assert [t.split(" = ")[1] for t in got[1:8]] == [
        "list.isEmpty();", "!list.isEmpty();", "!list.isEmpty();", "list.isEmpty();", "!list.isEmpty();", "!list.isEmpty();",
        "!list.isEmpty();"]
    assert got[8:] == SIZES.split("\n")[8:]


@pytest.mark.parametrize("rule, before, after", [
    ("R2", "if (flag == true) {", "if (flag) {"),
    ("R2", "if (flag == false) {", "if (!flag) {"),
    ("R2", "if (true != list.isEmpty()) {", "if (!list.isEmpty()) {"),
    ("R2", "x = a != false;", "x = a;"),
    ("R7", 'if (code == "A") {', 'if (code.equals("A")) {'),
    ("R7", "if (a == b) {", "if (a == b) {"),
    ("R22", 'String password = "x";', 'String password = System.getenv("SECURE_CREDENTIAL");'),
    ("R23", "Statement s = c.createStatement();", 'Statement s = c.prepareStatement("SELECT * FROM table WHERE id = ?");'),
    ("R23", 's.execute("a = " + id + "");', 's.execute("a = ?");'),
    ("R24", "new File(a + File.separator);", "new File(new File(a + File.separator).getCanonicalFile());"),
    ("R26", 'if (name.equals("x")) {', 'if ("x".equals(name)) {'),
    ("R27", "  if (n > 0) { return true; } else { return false; }", "  return n > 0;"),
    ("R27", "return ok ? true : false;", "return ok;"),
    ("R33", 'String url = "jdbc:db://h/x"; username = "root"', 'String url = "${DB_URL}"; username = "${DB_USERNAME}"'),
    ("R34", 'String api_key = "abc"; int x;', 'String api_key = System.getenv("API_KEY_PASSWORD"); int x;'),
    ("R34", 'String token = "abc";', 'String token = "abc";'),
])
def test_rewrites(lines_of, rule, before, after):
    assert texts(R.rewrite(lines_of(before), rule)) == [after]


def test_redaction_covers_tokens(spark):
    df = spark.createDataFrame([('a token = "x1" and pwd = \'y\' or z = "my secret" b = "c"',)], "t string")
    assert df.select(R.redact_assignments(F.col("t"))).first()[0] == 'a token = "***" and pwd = \'***\' or z = "***" b = "c"'


def test_case_conversion(spark):
    names = ["mName", "my_func1", "MAX_SIZE", "Bad", "ok", "_x", "__", "URL", "a__b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select("n", T.to_camel_case(F.col("n")), T.to_pascal_case(F.col("n"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {
        "mName": ("mname", "MName"), "my_func1": ("myFunc1", "MyFunc1"), "MAX_SIZE": ("maxSize", "MaxSize"), "Bad": ("bad", "Bad"),
        "ok": ("ok", "Ok"), "_x": ("X", "X"), "__": ("", ""), "URL": ("URL", "URL"), "a__b": ("aB", "AB")}


CLASS = """package org.depot.stock;

import java.time.Instant;
import java.util.Set;
import java.util.Deque;

@Deprecated
public class Shelf {
    private static final int ROWS = 12;
    private long weight, spare;

    public Shelf(Instant opened) {
    }

    protected long store(Set boxes) {
        log.debug("stored", boxes);
        weight += boxes.size();
        return weight;
    }

    public static void sweep(Shelf[] shelves) {
        Shelf first = new Shelf(null);
        first.clear(ROWS, "dust");
    }

    public interface Mover extends Lifter, Closeable {
        int move(long distance);
    }

    public enum Side {
        LEFT, RIGHT
    }
}"""


@pytest.fixture(scope="module")
def parsed(lines_of):
    lines = lines_of(CLASS)
    return lines, C.parse(lines)


def test_declarations(parsed):
    lines, st = parsed[0], parsed[1].done()
    types = {r.name: r for r in D.extract_types(st, lines).collect()}
    assert types["Shelf"].qualified_name == "org.depot.stock.Shelf" and types["Shelf"].annotations == ["Deprecated"]
    assert (types["Shelf"].start_line, types["Shelf"].end_line) == (8, 33)
    assert types["Mover"].is_abstract and types["Mover"].interfaces == ["Lifter", "Closeable"] and not types["Side"].is_abstract
    methods = {r.name: r for r in D.extract_methods(st).collect()}
    assert set(methods) == {"<init>Shelf(Instant)", "store", "sweep", "move"}
    assert methods["sweep"].parameter_types == ["Shelf[]"] and methods["sweep"].modifiers == ["public", "static"]
    assert methods["store"].end_line == 19 and methods["store"].return_type == "long"
    assert methods["<init>Shelf(Instant)"].return_type == "void" and methods["move"].class_name == "Mover"
    fields = {(r.class_name, r.name, r.type_name, r.has_initializer) for r in D.extract_fields(st).collect()}
    assert fields == {("Shelf", "ROWS", "int", True), ("Shelf", "weight", "long", False), ("Shelf", "spare", "long", False),
                      ("Side", "LEFT", "Side", True), ("Side", "RIGHT", "Side", True)}
    calls = {(r.method_name, r.receiver, tuple(r.arguments), r.line_no) for r in D.extract_calls(lines).collect()}
    assert {("clear", "first", ("ROWS", '"dust"'), 23), ("debug", "log", ('"stored"', "boxes"), 16)} <= calls


def test_unused_symbols(parsed):
    lines, blocks = parsed
    st, ml = blocks.done(), M.method_statements(blocks)
    assert [r.path for r in X.unused_imports(lines).collect()] == ["java.util.Deque"]
    assert [r.name for r in M.unused_fields(st).collect()] == ["spare"]
    assert {(r.method, r.parameter) for r in M.unused_parameters(st, ml).collect()} == {
        ("<init>Shelf(Instant)", "opened"), ("sweep", "shelves")}
    assert M.unused_variables(ml).count() == 0
    assert [r.line_no for r in X.empty_methods(lines, st).collect()] == [12]


WALKER = """public class Walker {
    public long twice(long v) {
        return v + v;
    }

    public long halvings(long v) {
        if (v < 2) return 0;
        return 1 + halvings(v / 2);
    }

    private int deep(int n) {
        while (n > 0) {
            if (n % 2 == 0 && n > 3) {
                for (int i = 0; i < n; i++) {
                    n--;
                }
            } else {
                n = n > 5 ? 1 : 2;
            }
        }
        return n;
    }
}"""


def test_metrics(lines_of):
    lines = lines_of(WALKER)
    ms = M.method_statements(C.parse(lines))
    got = {r.method_line: (r.cyclomatic, r.cognitive, r.line_count, r.max_nesting) for r in M.method_metrics(ms).collect()}
    # deep: while 1, if 2, for 3, ?: 3
    assert got == {2: (1, 0, 3, 0), 6: (2, 1, 4, 0), 11: (6, 9, 12, 3)}
    strict = {r.method_line: r.cyclomatic for r in M.cyclomatic(ms, strict=True).collect()}
    assert strict[2] == 2 and strict[6] == 5
    totals = M.file_metrics(lines, M.method_metrics(ms)).first()
    assert tuple(totals)[1:] == (9, 6, 3)
    assert [(r.line_no, r.callee) for r in X.recursion_candidates(lines).collect()] == [(8, "halvings")]


def test_catch_blocks_and_exceptions(lines_of):
    text = """class AException extends Exception {
    private int code;
    private final int kept;
    void f() {
        try {
            run();
        } catch (IOException e) {
            ignore();
        } catch (Exception ex) {
            throw ex;
        }
    }
}
class B {
    private int free;
}"""
    st = L.structure(lines_of(text))
    assert [(r.line_no, r.exception) for r in X.swallowed_exceptions(st).collect()] == [(7, "e")]
    got = texts(X.freeze_exception_fields(st))
    assert got[1] == "    private final int code;" and got[2] == "    private final int kept;" and got[14] == "    private int free;"


def test_urls_and_literals(lines_of):
    text = """import a.B;
public class U {
    String host = "http://h";
    String x = "duplicate one"; String y = "duplicate one";
    String link = host + "/api/" + id;
    int n = 42 + 7;
}"""
    lines = lines_of(text)
    got = texts(X.build_urls(lines))
    assert got[1] == X.URI_IMPORT and got[3:6] == [
        '    String host = UriComponentsBuilder.fromHttpUrl("/api/")', '        .queryParam("id", id)', "        .build().toUriString();"]
    assert got[7].endswith("// Fixed: URL construction made safe")
    named = texts(X.name_duplicate_literals(lines))
    assert named[2] == '    private static final String STR_DUPLICATE_ONE = "duplicate one";'
    assert named[4] == "    String x = STR_DUPLICATE_ONE; String y = STR_DUPLICATE_ONE;"
    alike = "public class A {\n" + "\n".join(f'  f("a long beginning that is the same {w}");' for w in ["one", "two"] * 2) + "\n}"
    constants = [r.constant for r in X.duplicate_literals(lines_of(alike)).collect()]
    assert len(set(constants)) == 2 and all(c.startswith("STR_A_LONG_BEGINNING_THAT_IS_THE_S_") for c in constants)
    renamed = texts(X.name_duplicate_literals(lines_of(alike)))
    assert len(set(renamed[1:3])) == 2 and renamed[3] == renamed[5] != renamed[4] == renamed[6]
    magic = texts(X.name_magic_numbers(lines))
    assert magic[2:4] == ["    private static final int MAGIC_NUMBER_42 = 42;", "    private static final int MAGIC_NUMBER_7 = 7;"]
    assert magic[7] == "    int n = MAGIC_NUMBER_42 + MAGIC_NUMBER_7;"


def test_line_edits(lines_of):
    assert texts(X.return_directly(lines_of("f() {\n  int v = g(1);\n  return v;\n}"))) == ["f() {", "  return g(1);", "}"]
    assert texts(X.strip_comments(lines_of("a\n/* b\nc\nd */\n// e\nf"))) == ["a", "f"]
    assert texts(X.get_instead_of_contains_key(lines_of("if (m.containsKey(k)) {\nx = m.get(k);"))) == ["if (m.get(k) != null) {", "x = m.get(k);"]
    assert texts(X.remove_unused_locals(lines_of("int a = 1;\nint b = 2;\nuse(b);"))) == ["int b = 2;", "use(b);"]
    assert [(r.variable, r.n_lines) for r in X.concat_in_loops(lines_of('for (;;) {\ns += "x";\n}\ns += "y";')).collect()] == [("s", 1)]
    fixed = R.fill_empty_catch(F.col("text"))
    whole = L.assemble(lines_of("try { } catch (E e)\n{\n}")).select(fixed).first()[0]
    assert whole.startswith("try { } catch (E e)\n{\n            // TODO") and whole.endswith("\n        }")


def test_first_code_block(spark):
    rows = ["Here:\n```java\npublic class Test {\n}\n```\n", "No code here", "```java\nnever closed", "```\nx\n```",
            "```java\na\n```java\nb\n``` \n```java\nc\n```", "```java\n```"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(A.first_code_block(F.col("t"))).collect()] == ["public class Test {\n}", "", "", "", "b", ""]


def test_acceptance(spark):
    old = spark.createDataFrame([(i, "x") for i in range(6)], "file_id bigint, text string")
    new = spark.createDataFrame([(0, "public class Test { void f() {} }"), (1, "}{"), (2, "  "), (3, "x"), (4, "f(a);"), (5, "g();")],
                                "file_id bigint, text string")
    verdicts = spark.createDataFrame([(4, True), (5, False)], "file_id bigint, passed boolean")
    got = {r.file_id: (r.accepted, r.reason, r.form) for r in A.accept_fixes(old, new, verdicts).collect()}
    assert got == {0: (True, None, "unit"), 1: (False, "unbalanced", "fragment"), 2: (False, "empty", "fragment"),
                   3: (False, "unchanged", "fragment"), 4: (True, None, "fragment"), 5: (False, "tests failed", "fragment")}


def test_prompt_sections(spark):
    finding = spark.createDataFrame([(1, "java:S3776", None, 7, "F.java")], "finding_id bigint, rule string, message string, file_id bigint, path string")
    empty = spark.createDataFrame([], "file_id bigint, x string")
    got = A.render_prompts(finding, spark.createDataFrame([(7, 3)], "file_id bigint, method_count bigint"),
                           empty.withColumnRenamed("x", "method_details"), empty.withColumnRenamed("x", "dependencies"),
                           empty.withColumnRenamed("x", "text")).first().prompt
    at = [got.index(s) for s in A.SECTIONS]
    assert at == sorted(at) and "- Message: No message provided" in got and "- method_count: 3" in got


def test_impact_with_a_cycle(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (4, 3), (9, 8)], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(1,), (77,)], "file_id bigint")
    got = {(r.seed, r.file_id, r.kind) for r in G.impact(edges, seeds).collect()}
    assert got == {(1, 2, "direct"), (1, 3, "transitive"), (1, 4, "transitive")}


def test_wildcards(spark):
    uses = spark.createDataFrame([(1, "org.lib1"), (2, "org.lib1"), (5, "org.none")], "src bigint, prefix string")
    classes = spark.createDataFrame([("org.lib1.A", 1), ("org.lib10.B", 3), ("org.lib2.C", 4)], "class_name string, file_id bigint")
    fan = lambda b: {(r.file_id, r.n_files) for r in G.wildcard_fanout(uses, G.wildcard_members(uses, classes, b)).collect()}
    assert fan("raw") == {(1, 1), (2, 2)} and fan("dot") == {(2, 1)}
    one = spark.createDataFrame([(2,)], "file_id bigint")
    pairs = G.wildcard_dependencies(uses, G.wildcard_members(uses, classes), one).collect()
    assert {(r.src, r.dst) for r in pairs} == {(2, 1), (2, 3)}


def test_hot_file_is_spread(spark):
    rows = [(i, "r", "m", "p:Hot.java", 1, i % 7, "OPEN", "INFO") for i in range(500)] + [(900, "r", "m", "p:Cold.java", 2, 1, "OPEN", "INFO")]
    fe = spark.createDataFrame(rows, "finding_id bigint, rule string, message string, component string, file_id bigint, line int, status string, severity string")
    got = P.group_by_file(fe, group_rows=50).collect()
    hot = [r for r in got if r.path == "Hot.java"]
    assert len(hot) == 10 and sum(len(r["items"]) for r in hot) == 500 and {r.n_findings for r in hot} == {500}
    assert sorted(i.finding_id for r in hot for i in r["items"]) == list(range(500))


def test_usage_index(lines_of):
    got = {(r.name, r.block): (r.usage_lines, r.is_modified) for r in M.usage_index(lines_of("int a = 1;\nf(a);\na++;\nb == a;"), 2).collect()}
    assert got["a", 0] == ([1, 2], True) and got["a", 1] == ([3, 4], True) and got["b", 1] == ([4], False)


def test_infer_keeps_errors_per_row(spark):
    def fn(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no")
        return [p + "!" for p in prompts]
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "finding_id bigint, prompt string").coalesce(1)
    assert {tuple(r) for r in A.batch_infer(df, fn).collect()} == {(1, "a!", None), (2, None, "no"), (3, "c!", None)}
