"""Chains over statements and block structure stay in parts of a counted size; Spark's own parts grow with the corpus."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rulewright.operators import code as C
from rulewright.operators import file_rules as X
from rulewright.operators import lines as L
from rulewright.operators import metrics as M
from rulewright.sources.derived import code_lines

SF = "/root/testdata/sf0.001"
TEXTS = ["a {", "}", "} else {", "x;", "/* c", "c */", "try {", "} catch (E e) {", "log(e);", "  "]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["r16_swallowed_exceptions", "r16_log_swallowed_exceptions", "r12_empty_methods", "d3_methods", "m1_cyclomatic",
                                  "m1_cyclomatic_strict", "m2_cognitive"])
def test_every_exchange_has_counted_parts(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "REPARTITION_BY_NUM" in text and "ENSURE_REQUIREMENTS" not in text and "lineitem" not in text


def test_line_table_is_built_in_counted_parts(spark):
    text = plan(code_lines(spark, SF, counted=True))
    assert "REPARTITION_BY_NUM" in text and "ENSURE_REQUIREMENTS" not in text


@pytest.mark.parametrize("size", [1, 3, 8, 1000, None])
def test_interior_counts(spark, size):
    rnd = random.Random(11)
    files = {f: [rnd.choice(TEXTS) for _ in range(n)] for f, n in ((1, 60), (2, 1), (3, 4), (4, 25))}
    df = spark.createDataFrame([(f, i + 1, t) for f, ts in files.items() for i, t in enumerate(ts)], "file_id bigint, line_no int, line string")
    st = L.structure_blocks(df, size) if size else L.structure(df)
    conds = {"n_all": F.col("line_no") > 0, "n_log": F.col("line").contains("log")}
    got = sorted((r.file_id, r.line_no, r.line, r.end_line, r.n_all, r.n_log) for r in X.interior_counts(st, F.col("line").contains("{"), **conds).collect())
    want = []
    for r in L.structure(df).where("end_line > line_no").collect():
        inside = files[r.file_id][r.line_no:r.end_line - 1]
        if "{" in r.line:
            want.append((r.file_id, r.line_no, r.line, r.end_line, len(inside), sum("log" in t for t in inside)))
    assert want and got == sorted(want)


def test_counted_renumbering(spark):
    df = spark.createDataFrame([(f, n, f"{f}.{n}") for f in range(5) for n in range(1, 7)], "file_id bigint, line_no int, line string")
    extra = df.where("line_no = 3").select("file_id", "line_no", F.lit(1).alias("sub"), F.lit("new").alias("line"))
    got = sorted(map(tuple, L.insert_after(df, extra, whole=True, tasks=3).collect()))
    assert got == sorted(map(tuple, L.insert_after(df, extra).collect())) and len(got) == 35


def test_looking_ahead_sorts_no_second_time(spark):
    """Lines, pieces, statements, their events by level and by number: one sort each, the methods need none."""
    text = plan(M.in_methods(C.parse(code_lines(spark, SF, counted=True))))
    assert "DESC" not in text.split("Window [row_number()")[0] and text.split("Initial Plan")[0].count("Sort [") == 6  # the sixth is that of the order lines


def test_method_headers_are_matched_once(spark):
    """The scan for methods and the choice of declarations share one column."""
    lines = spark.createDataFrame([(1, 1, "class A {"), (1, 2, "int f() {"), (1, 3, "}"), (1, 4, "}")], "file_id bigint, line_no int, line string")
    assert [r.is_method for r in M.in_methods(C.parse(lines)).orderBy("stmt_no").collect()] == [False, True]
    assert "is_method" not in M.declarations(C.parse(lines)).columns + M.method_statements(C.parse(lines)).columns
