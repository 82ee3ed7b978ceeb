"""Block-wise scans against plain Python, with blocks far smaller than the files."""

import random

import pytest
from pyspark.sql import functions as F

from rulewright.operators import lines as L
from rulewright.operators.scan import Last, Total, Upcoming, scan

TEXTS = ["a {", "}", "} else {", "x;", "{ y; }", "}}", "for (;;) {", "/* c", "c */", "class XException {", "} catch (E e) { }"]


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(7)
    rows = [(f, i + 1, rnd.choice(TEXTS)) for f, n in ((1, 40), (2, 1), (3, 3), (4, 17)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "file_id bigint, line_no int, line string")


def by_file(rows):
    out = {}
    for f, n, t in rows:
        out.setdefault(f, []).append((n, t))
    return out


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_specs(corpus, size):
    rows, df = corpus
    v = F.when(F.col("line").contains("}"), F.col("line_no"))
    got = scan(df, ["file_id"], ["line_no"], size, total=Total(F.length("line")), last=Last(v), before=Last(v, current=False),
               after=Upcoming(v), at=Upcoming(v, current=True))
    got = {(r.file_id, r.line_no): (r.total, r.last, r.before, r.after, r.at) for r in got.collect()}
    for f, ls in by_file(rows).items():
        hits = [n for n, t in ls if "}" in t]
        for n, _ in ls:
            want = (sum(len(t) for m, t in ls if m <= n), max([h for h in hits if h <= n], default=None),
                    max([h for h in hits if h < n], default=None), min([h for h in hits if h > n], default=None),
                    min([h for h in hits if h >= n], default=None))
            assert got[f, n] == want


@pytest.mark.parametrize("size", [2, 5, 1000])
def test_structure(corpus, size):
    rows, df = corpus
    got = {(r.file_id, r.line_no): (r.end_line, r.parent_line) for r in L.structure(df, size).collect()}
    assert len(got) == len(rows)
    for f, ls in by_file(rows).items():
        stack, parents, ends = [], {}, {}
        for n, t in ls:  # a real stack; a negative depth starts an empty one
            lead = len(t.split("{")[0]) - len(t.split("{")[0].replace("}", ""))
            for _ in range(lead):
                if stack:
                    ends[stack.pop()[0]] = n
                else:
                    pass
            parents[n] = stack[-1][0] if stack else None
            same = []
            for ch in t[len(t.split("{")[0]):]:
                if ch == "{":
                    same.append((n,))
                elif ch == "}":
                    if same:
                        same.pop()
                    elif stack:
                        ends[stack.pop()[0]] = n
            if "{" in t and not same and "}" in t:
                ends[n] = n
            stack += same
        depth, low = 0, 0
        for n, t in ls:  # compare while the file has never closed more than it opened
            depth += t.count("{") - t.count("}")
            low = min(low, depth, depth - t.count("{"))
            if low < 0:
                break
            assert got[f, n][1] == parents[n], (f, n, t)
            if "{" in t:
                end = got[f, n][0]
                assert end == ends.get(n), (f, n, t)


@pytest.mark.parametrize("size", [2, 1000])
def test_windows_do_not_depend_on_block_size(corpus, size):
    _, df = corpus
    for fn in (L.with_next, L.comment_state, L.loop_regions, L.nearest_decl, L.class_anchor, L.block_depth,
               lambda d, block_size=None: L.lookback(d, F.col("line").contains("class "), 9, True, block_size)):
        want = sorted(map(tuple, fn(df).collect()), key=repr)
        assert sorted(map(tuple, fn(df, block_size=size).collect()), key=repr) == want


@pytest.mark.parametrize("size", [2, 1000])
def test_many_rows_behind_one_anchor(spark, size):
    lines = spark.createDataFrame([(1, n, f"l{n}") for n in range(1, 12)], "file_id bigint, line_no int, line string")
    extra = spark.createDataFrame([(1, 3, 1 * L.SUB_STEP * k, f"c{k}") for k in range(1, 10)] + [(1, 7, -1, "before7")],
                                  "file_id bigint, line_no int, sub bigint, line string")
    anchors = spark.createDataFrame([(1, 3)], "file_id bigint, anchor int")
    got = [r.line for r in L.insert_after(lines, extra, anchors, size).orderBy("line_no").collect()]
    assert got == ["l1", "l2", "l3", *[f"c{k}" for k in range(1, 10)], "l4", "l5", "l6", "before7", *[f"l{n}" for n in range(7, 12)]]


def test_null_keys_belong_to_no_group(spark):
    df = spark.createDataFrame([(None, 1, "x"), (1, 1, "y")], "file_id bigint, line_no int, line string")
    assert [r.line for r in L.with_next(df).collect()] == ["y"]


def test_parts_follow_the_lines(spark):
    """A task's share of a chain of scans doesn't grow with the corpus, and AQE doesn't merge the parts."""
    from rulewright.operators import code as C
    from rulewright.operators.scan import extent

    lines = spark.range(4000).selectExpr("id AS file_id", "1 AS line_no", "'int a;' AS line")
    assert extent(lines, task_lines=1000) == (True, 4) and extent(lines.selectExpr("file_id", "2 AS line_no"), size=1) == (False, 2)
    assert extent(lines.limit(0)) == (True, 2)
    blocks = C.line_blocks(lines)
    assert blocks.whole and blocks.rows.rdd.getNumPartitions() == blocks.tasks == 2


def test_statements_are_cut_once(spark):
    """Reports of several kinds of declarations don't cut the corpus into statements once per kind."""
    from rulewright.operators import code as C, declarations as D, metrics as M

    text = "class A {\n int f, g = 1;\n void m(int a, int b) {\n  int x, y;\n  use(b, y);\n  if (y > 0) { return; }\n }\n}\nenum E {\n ONE, TWO\n}"
    lines = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(text.split("\n"))], "file_id bigint, line_no int, line string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    parsed = C.parse(lines)
    ms = M.method_statements(parsed)
    reports = {"m6": M.unused_fields(parsed.done()), "m7": M.unused_variables(ms), "m8": M.unused_parameters(parsed.done(), ms), "d4": D.extract_fields(parsed.done())}
    for name, df in reports.items():
        assert plan(df).count("Scan ExistingRDD") == 1, name
    few = M.declarations(parsed, decisions=True)
    summary = M.symbol_summary(few, few.where("method_line IS NOT NULL"))
    assert "Scan ExistingRDD" not in plan(summary) and "Window" not in plan(summary)
    assert [r.name for r in reports["m6"].collect()] == ["f"]
    assert [r.name for r in reports["m7"].collect()] == ["x"]
    assert [(r.method, r.parameter) for r in reports["m8"].collect()] == [("m", "a")]
    assert {(r.name, r.is_enum_constant) for r in reports["d4"].collect()} == {("f", False), ("g", False), ("ONE", True), ("TWO", True)}
    assert {(r.kind, r.name) for r in summary.collect()} == {
        ("field", "f"), ("field", "g"), ("field", "ONE"), ("field", "TWO"), ("method", "m#int#int"), ("parameter", "a"), ("parameter", "b"),
        ("variable", "x"), ("variable", "y")}
    assert [r.cyclomatic for r in M.cyclomatic(few.where("method_line IS NOT NULL")).collect()] == [r.cyclomatic for r in M.cyclomatic(ms).collect()] == [2]


def test_prompts_cut_the_findings_files_once(spark):
    from rulewright.plans import flows

    lines = spark.createDataFrame([(1, 1, "class A {"), (1, 2, " int f() { return 1; }"), (1, 3, "}"), (2, 1, "class B { }")], "file_id bigint, line_no int, line string")
    findings = spark.createDataFrame([(7, 1, "r", "m", "p:A.java"), (8, 3, "r", "m", "p:C.java")], "finding_id bigint, file_id bigint, rule string, message string, component string")
    prompts, text = flows.prompts(findings, lines)
    assert [r.file_id for r in text.collect()] == [1]  # files without findings are not put together
    got = {r.finding_id: r.prompt for r in prompts.collect()}
    assert "- A.f:\n  cyclomatic: 1" in got[7] and "class A {\n int f() { return 1; }\n}" in got[7] and "METHOD DETAILS:\n\n" in got[8]
