"""Physical plans: what must and must not be in them."""

import pytest

import __spark_entry__ as entry
from rulewright.operators import code as C
from rulewright.operators import lines as L
from rulewright.sources.derived import code_lines

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d8_wildcard_halves", "d8_wildcard_fanout", "r11_url_concatenations", "m8_unused_parameters",
                                  "r8_name_duplicate_literals", "p12_finding_lines", "s3_first_nonempty_source"])
def test_no_nested_loops(spark, name):
    p = plan(entry.queries()[name](spark, SF))
    assert "NestedLoop" not in p and "CartesianProduct" not in p


def test_rule_scan_needs_no_shuffle_of_its_own(spark):
    p = plan(entry.queries()["r0_all_rules"](spark, SF))
    assert p.count("Exchange") == 1  # the one that builds the line table


def test_scan_shares_its_exchange(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p, chain = plan(L.with_next(code_lines(spark, SF))), plan(C.statements(code_lines(spark, SF)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in p and p.count("FileScan") == 1
    # Files of one block: one exchange for the table's own line numbers and one by file, whatever the number of scans.
    assert chain.count("FileScan") == 1 and chain.count("Exchange hashpartitioning") == 2 and "Join" not in chain


def test_columns_are_pruned(spark):
    p = plan(entry.queries()["r32_documents_by_source"](spark, SF))
    assert "ReadSchema: struct<text:string,source:string>" in p


def test_inference_runs_once(spark):
    assert plan(entry.queries()["e3_fix_complex"](spark, SF)).count("MapInPandas") == 1


def test_sample_is_top_k(spark):
    assert "TakeOrderedAndProject" in plan(entry.queries()["p4_sample_cap"](spark, SF))


def test_digest_limits_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["p11_digest"](spark, SF))
