"""Secret scans with an incremental blob ledger.

Every version of every file is addressed by the SHA-256 of its content. The ledger, three tables in the shared
folder, remembers which (blob, rule version) pairs were scanned and what was found. A scan takes the pairs that the
ledger lacks, reads one copy of each such blob, and joins the findings back to all paths that hold the blob.

Defined cases: a null text is the empty text; copies are scanned once; repeated rows each get the findings; an empty
table adds nothing; other columns are ignored. Spans count code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulewright.llm.common import scratch, settled

# Kind, pattern (leftmost, non-overlapping), group that is measured, its least length.
BASE_RULES = [
    ("assign", "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
     "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
    ("access", "(AKIA[A-Z0-9]+)", 1, 16),
    ("hex", "([0-9a-f]{32,})", 1, 32),  # whole runs of 32 or more: the same as all runs, short ones dropped
]


@dataclass(frozen=True)
class Ledger:
    """Paths of the ledger's tables: scanned(blob, version) and found(blob, version, kind, kind_no, start, end)."""
    scanned: str
    found: str


def create_ledger(spark: SparkSession, path: str | None = None) -> Ledger:
    path = path or scratch(spark)
    ledger = Ledger(f"{path}/scanned", f"{path}/found")
    spark.createDataFrame([], "blob binary, version string").write.parquet(ledger.scanned)
    spark.createDataFrame([], "blob binary, version string, kind string, kind_no int, start long, end long").write.parquet(ledger.found)
    return ledger


def matches(blobs: DataFrame, text: Column, no: int, kind: str, pattern: str, group: int, least: int) -> DataFrame:
    """Spans of one rule: the pieces between matches give the places. Only rows with a match pass the first test."""
    hit = blobs.where(text.rlike(pattern)).select(
        "blob", "version", F.posexplode(F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                                                     F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                                                     F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))))
    flat = hit.select("blob", "version", "pos", F.length("col.gap").alias("gap"), F.length("col.m").alias("len"), F.length("col.v").alias("v"))
    before = Window.partitionBy("blob", "version").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("gap") + F.coalesce(F.sum(F.col("gap") + F.col("len")).over(before), F.lit(0))
    return flat.withColumn("start", start.cast("long")).where(F.col("v") >= least).select(
        "blob", "version", F.lit(kind).alias("kind"), F.lit(no).alias("kind_no"), "start", (F.col("start") + F.col("len")).cast("long").alias("end"))


def scan(paths: DataFrame, ledger: Ledger, version: str = "base-1", rules: list = BASE_RULES, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Scan what the ledger hasn't seen under this rule version, extend the ledger, and return
    ``(id, blob, spans array<struct<start,kind_no,kind,end>>)`` for every row of ``paths``."""
    spark = paths.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    blob = F.unhex(F.sha2("body", 256)).alias("blob")
    src = paths.select(F.col(key).alias("id"), body.alias("body"))
    tree = settled(src.select("id", blob))
    asked = settled(tree.select("blob").distinct())
    unseen = settled(asked.withColumn("version", F.lit(version)).join(spark.read.parquet(ledger.scanned), ["blob", "version"], "left_anti"))
    # One copy of each blob that has any match (most texts have none), then those that are unseen. The blob is computed
    # from the text again: a row number would have to come out the same in both readings, which only a file scan does.
    hits = src.where(F.concat(*(F.when(F.col("body").rlike(r[1]), "1").otherwise("") for r in rules)) != "")
    one = hits.select(blob, "body").groupBy("blob").agg(F.first("body").alias("body"))
    todo = settled(one.join(unseen, "blob").select("blob", "version", "body"))
    found = None
    for no, (kind, pattern, group, least) in enumerate(rules):
        one = matches(todo, F.col("body"), no, kind, pattern, group, least)
        found = one if found is None else found.union(one)
    found.write.mode("append").parquet(ledger.found)
    # Findings first, then the mark: a scan that dies in between is repeated, and its findings count once (distinct).
    unseen.write.mode("append").parquet(ledger.scanned)
    of = spark.read.parquet(ledger.found).where(F.col("version") == version).join(asked, "blob", "left_semi")
    spans = of.distinct().groupBy("blob").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind_no", "kind", "end"))).alias("spans"))
    return tree.join(settled(spans), "blob", "left").select("id", "blob", "spans")


def joined(spans: Column) -> Column:
    return F.coalesce(F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))), F.lit(""))


def count_kind(spans: Column, kind: str) -> Column:
    return F.greatest(F.lit(0), F.size(F.filter(spans, lambda s: s["kind"] == kind))).cast("long")
