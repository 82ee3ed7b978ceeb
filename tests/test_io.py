"""Sources and sinks on temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from rulewright.operators import lines as L
from rulewright.sources import readers, sinks


def test_read_sources(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "X.java").write_text("class X {\n}\n", encoding="utf-8")
    (tmp_path / "Y.java").write_text("é", encoding="utf-8")
    (tmp_path / "Z.py").write_text("no", encoding="utf-8")
    got = {r.path: r.text for r in readers.read_sources(spark, str(tmp_path)).collect()}
    assert got == {"a/b/X.java": "class X {\n}\n", "Y.java": "é"}


def test_unreadable_files_are_listed(spark, tmp_path):
    (tmp_path / "Good.java").write_text("class Gut { } // é\n", encoding="utf-8")
    (tmp_path / "Bad.java").write_bytes(b"class B { } // \xe9\n")
    (tmp_path / "Empty.java").write_bytes(b"")
    first = readers.source_manifest(spark, str(tmp_path))
    got = {r.path: (r.status, r.reason, r.text, r.size) for r in first.collect()}
    assert got == {"Good.java": ("ok", None, "class Gut { } // é\n", 20), "Bad.java": ("skipped", "not UTF-8", None, 17)}
    first.write.parquet(str(tmp_path / "manifest"))
    kept = spark.read.parquet(str(tmp_path / "manifest"))
    assert readers.changed_sources(readers.source_manifest(spark, str(tmp_path)), kept).isEmpty()
    (tmp_path / "Good.java").write_text("class Gut { }\n", encoding="utf-8")
    (tmp_path / "New.java").write_text("x", encoding="utf-8")
    assert {r.path for r in readers.changed_sources(readers.source_manifest(spark, str(tmp_path)), kept).collect()} == {"Good.java", "New.java"}


def test_read_findings(spark, tmp_path):
    pages = [{"issues": [{"key": "1", "rule": "r", "line": 3, "extra": 1}], "total": 3},
             {"hotspots": [{"key": "2", "rule": "s"}, {"key": "1", "rule": "r"}], "paging": {"total": 3}}, {"errors": []}]
    for i, p in enumerate(pages):
        (tmp_path / f"{i}.json").write_text(json.dumps(p, indent=1))
    rows = readers.read_findings(spark, str(tmp_path))
    assert {(r.key, r.rule, r.line, r.total) for r in rows.collect()} == {("1", "r", 3, 3), ("2", "s", None, 3), ("1", "r", None, 3)}
    assert readers.merge_pages(rows).count() == 2
    assert tuple(readers.page_completeness(rows).first()) == (2, 3, False)


def test_write_changed(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "file_id bigint, text string")
    new = old.withColumn("text", F.when(F.col("file_id") == 2, "B").otherwise(F.col("text")))
    sinks.write_changed(old, new, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, "B")]


@pytest.mark.parametrize("text", ["", "a", "a\n", "\n\n", "a\nb\n\nc"])
def test_lines_round_trip(spark, text):
    df = spark.createDataFrame([(1, text)], "file_id bigint, text string")
    lines = L.explode_lines(df, "file_id", "text")
    assert [r.line for r in lines.orderBy("line_no").collect()] == text.split("\n")
    assert L.assemble(lines).first().text == text
