"""Queries that read the line table several times read it as written, and build it from the order lines once."""

import pytest

import __spark_entry__ as entry
from rulewright.plans import declaration_queries, flow_queries, metric_queries
from rulewright.sources.derived import code_lines, written_lines

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["m5_complexity_record", "e3_fix_complex", "a1_render_prompts", "m7_unused_variables", "m1_cyclomatic", "d3_methods", "d7_import_edges"])
def test_order_lines_are_not_in_the_plan(spark, name):
    assert "lineitem" not in plan(entry.queries()[name](spark, SF))


def test_written_lines_are_the_lines(spark):
    old, new = code_lines(spark, SF), written_lines(spark, SF)
    assert new.schema.simpleString() == old.schema.simpleString()
    assert old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty()


@pytest.mark.parametrize("module, name", [(metric_queries, "m5_complexity_record"), (flow_queries, "e3_fix_complex"), (declaration_queries, "d7_import_edges")])
def test_lines_are_built_once(spark, monkeypatch, module, name):
    calls = []
    monkeypatch.setattr(module, "written_lines", lambda *a: calls.append(a) or written_lines(*a))
    entry.queries()[name](spark, SF)
    assert len(calls) == 1


def test_resolving_types_reads_written_lines(spark):
    assert "lineitem" not in plan(entry.queries()["d12_resolve_types"](spark, SF))


def test_finding_methods_reads_written_declarations(spark):
    """Types, the names asked for and methods come from one cutting of the statements."""
    text = plan(entry.queries()["d11_find_method"](spark, SF))
    assert "Window" not in text and "lineitem" not in text
