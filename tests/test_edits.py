"""Edit table, conflicts, gate by lines and the rule faults that were mended, with the expected lines spelled out."""

import pytest
from pyspark.sql import functions as F

from rulewright.operators import edits as E
from rulewright.operators import file_rules as X
from rulewright.operators import fixes as A
from rulewright.operators import line_rules as R
from rulewright.operators import lines as L
from rulewright.plans import flows
from rulewright.sources.sinks import changed_lines

UNIT = """package a;
public final class U {
    private boolean ready;
    private int idle;
    int my_func(java.util.List list) {
        if (ready == true) { list.clear(); }
        boolean none = list.size() == 0;
        int spare = 1;
        int out = my_func(null);
        return out;
    }
}"""
FINDING = "finding_id bigint, rule string, message string, component string, file_id bigint, line int, status string, severity string"


def lines_of(spark, *texts):
    return L.explode_lines(spark.createDataFrame(list(enumerate(texts, 1)), "file_id bigint, text string"), "file_id", "text")


def findings_of(spark, *rows):
    return spark.createDataFrame([(i, f"java:{rule}", message, f"p:src/F{file}.java", file, line, "OPEN", "INFO")
                                  for i, rule, message, file, line in rows], FINDING)


def texts(df):
    return [r.line for r in df.orderBy("file_id", "line_no").collect()]


def test_several_rules_in_one_file(spark):
    lines = lines_of(spark, UNIT, UNIT, "class Open {")
    asked = findings_of(
        spark, (1, "S1118", "m", 1, 2), (2, "S1125", "m", 1, 6), (3, "S1155", "m", 1, 7), (4, "S1481", "m", 1, 8), (5, "S100", "Rename this 'my_func'", 1, 5),
        (6, "S1488", "m", 1, 9), (7, "S1118", "m", 1, 3), (8, "S1068", "m", 1, 4), (9, "S1125", "m", 1, 7), (10, "S9999", "m", 1, 1), (11, "S1118", "m", 3, 1),
        (12, "S1118", "m", 99, 1))
    files, report = flows.fix_findings(asked, lines, "p", allow=[f"java:{r}" for r in "S1118 S1125 S1155 S1481 S100 S1488 S1068 S9999".split()])
    got = {r.finding_id: (r.success, r.reason) for r in report.collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (True, None), 4: (True, None), 5: (True, None), 6: (False, "conflict"), 7: (True, None), 8: (True, None),
                   9: (False, "no rewrite"), 10: (False, "no handler"), 11: (False, "no rewrite")}
    assert texts(files) == """package a;
public final class U {
    private U() {
        // Private constructor to prevent instantiation
        throw new UnsupportedOperationException("Utility class");
    }

    private boolean ready;
    int myFunc(java.util.List list) {
        if (ready) { list.clear(); }
        boolean none = list.isEmpty();
        int out = myFunc(null);
        return out;
    }
}""".split("\n")


def test_a_finding_is_carried_out_whole_or_not_at_all(spark):
    edits = spark.createDataFrame([
        (1, 1, 5, 0, "replace", "a"), (2, 1, 5, 0, "replace", "b"), (2, 1, 6, 0, "delete", None), (3, 1, 5, 0, "replace", "a"), (4, 1, 6, 0, "replace", "c"),
        (5, 1, 5, 1, "insert", "x"), (6, 1, 5, 1, "insert", "x")], "finding_id bigint, file_id bigint, line_no int, sub bigint, op string, text string")
    done = E.resolve(edits)
    assert {r.finding_id for r in done.where("ok").collect()} == {1, 3, 5, 6}
    lines = spark.createDataFrame([(1, i, f"l{i}") for i in range(4, 8)], "file_id bigint, line_no int, line string")
    assert texts(E.merge(lines, done)) == ["l4", "a", "x", "l6", "l7"]


def test_model_tier(spark):
    lines = lines_of(spark, UNIT, UNIT, UNIT)
    asked = findings_of(spark, (1, "S1125", "m", 1, 6), (2, "S1118", "bad", 2, 1), (3, "S1125", "good", 2, 1), (4, "S1125", "good", 2, 2), (5, "S1125", "unbalanced", 3, 1))
    calls = []

    def model(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no")
        return ["```java\nclass N {" + ("" if "unbalanced" in p else "}") + "\n```" for p in prompts]

    out, report = flows.fix_findings(asked.where("rule <> 'java:S1118'").unionByName(asked.where("finding_id = 2").withColumn("component", F.lit("p:src/F.py"))),
                                     lines, "p", fn=model)
    got = {r.finding_id: (r.tier, r.success, r.reason) for r in report.collect()}
    assert got == {1: ("rule", True, None), 2: ("model", False, "no"), 3: ("model", True, None), 4: ("model", False, "superseded"), 5: ("model", False, "unbalanced")}
    assert {(r.file_id, r.n) for r in out.groupBy("file_id").agg(F.count("*").alias("n")).collect()} == {(1, 12), (2, 1)} and not calls


@pytest.mark.parametrize("rule, before, after", [
    ("R2", 'String s = "x == true";', 'String s = "x == true";'),
    ("R2", 'if (f("a, b == true") == true) { // y == true', 'if (f("a, b == true")) { // y == true'),
    ("R22", "if (key == other) run(); int n = 3;", "if (key == other) run(); int n = 3;"),
    ("R22", 'String user = "a"; String password = "b";', 'String user = "a"; String password = System.getenv("SECURE_CREDENTIAL");'),
    ("R22", 'if (secret != "x") { t = "y"; }', 'if (secret != "x") { t = "y"; }'),
])
def test_rewrites(spark, rule, before, after):
    assert texts(R.rewrite(lines_of(spark, before), rule)) == [after]


def test_database_comments(spark):
    rows = R.database_comment_rows(lines_of(spark, 'u = "jdbc:x"; password = "p"\nint a;\nuser = "q"')).orderBy("line_no", "sub").collect()
    assert [(r.line_no, r.sub, "URL" in r.line) for r in rows] == [(1, -9, True), (1, -8, False), (3, -9, False)]


def test_numbers_of_all_kinds(spark):
    text = "public class A {\n  float f = 2.5f; long g = 5000000000L; double d = 1e3, h = 2.5;\n  int i = 7 + x1 - 0;\n}"
    assert texts(X.name_magic_numbers(lines_of(spark, text))) == [
        "public class A {", "    private static final float MAGIC_NUMBER_2_5F = 2.5f;", "    private static final long MAGIC_NUMBER_5000000000L = 5000000000L;",
        "    private static final double MAGIC_NUMBER_1E3 = 1e3;", "    private static final double MAGIC_NUMBER_2_5 = 2.5;", "    private static final int MAGIC_NUMBER_7 = 7;",
        "  float f = MAGIC_NUMBER_2_5F; long g = MAGIC_NUMBER_5000000000L; double d = MAGIC_NUMBER_1E3, h = MAGIC_NUMBER_2_5;", "  int i = MAGIC_NUMBER_7 + x1 - 0;", "}"]


@pytest.mark.parametrize("text, ok", [("", True), ("a", True), ("(\n[\n{\n}\n]\n)", True), (")(", False), ("(\n", False), ("{ }\n}\n{", False), ("([)]", True)])
def test_balance_by_lines(spark, text, ok):
    lines = lines_of(spark, text)
    for size in (None, 1, 2):
        got = [r.balanced for r in A.balanced_files(lines, size).collect()]
        assert got == ([ok] if any(c in "(){}[]" for c in text) else [])


def test_acceptance_by_lines(spark):
    old = lines_of(spark, *["x"] * 6)
    new = lines_of(spark, "\npublic class Test { void f() {} }", "}{", "  \n", "x", "f(a);", "g();")
    verdicts = spark.createDataFrame([(5, True), (6, False)], "file_id bigint, passed boolean")
    got = {r.file_id: (r.accepted, r.reason, r.form) for r in A.accept_lines(old, new, verdicts).collect()}
    assert got == {1: (True, None, "unit"), 2: (False, "unbalanced", "fragment"), 3: (False, "empty", "fragment"),
                   4: (False, "unchanged", "fragment"), 5: (True, None, "fragment"), 6: (False, "tests failed", "fragment")}
    assert {r.file_id for r in changed_lines(old, new).collect()} == {1, 2, 3, 5, 6}


def test_failing_prompts_are_found_by_halving(spark):
    calls = []

    def fn(prompts):
        calls.append(len(prompts))
        if "bad" in prompts:
            raise ValueError("no")
        return [p + "!" for p in prompts]

    df = spark.createDataFrame([(f"id{i}", "bad" if i == 37 else "p") for i in range(64)], "finding_id string, prompt string").coalesce(1)
    got = {r.finding_id: (r.response, r.error) for r in A.batch_infer(df, fn).collect()}
    assert got["id37"] == (None, "no") and sum(v == ("p!", None) for v in got.values()) == 63
