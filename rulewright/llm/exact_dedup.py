"""Exact dedup against a persistent digest index.

The index is a table of ``(digest, keep_id, keep_row, load)`` bucketed and sorted by digest. A load groups its rows by
the SHA-256 of the whole text (partial counts before the shuffle, so a group of copies costs one row per task),
removes known digests by a sort-merge anti-join with the index and appends the rest under the load's name.

Defined cases: a null text equals the empty text; a null id loses against any other; among repeated rows (same id,
same text) one stays; a text that an earlier load brought isn't kept again, whatever its id; an empty table appends
nothing; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.llm.common import scratch, settled

BUCKETS, BUCKET_ROWS = 32, 2_000_000  # least number of buckets; rows of a new index that one more bucket is made for


def create_index(spark: SparkSession, name: str | None = None, key_type: str = "bigint", rows: int = 0) -> str:
    """Make an empty index in the shared folder for about ``rows`` digests and return its table name."""
    name, buckets = name or f"digest_index_{uuid.uuid4().hex}", max(BUCKETS, rows // BUCKET_ROWS)
    spark.createDataFrame([], f"digest binary, keep_id {key_type}, keep_row bigint, load string").write.bucketBy(
        buckets, "digest").sortBy("digest").option("path", scratch(spark)).saveAsTable(name)
    return name


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """``(id, row, digest, load)`` per row, written once under a new load name: 50 bytes a row, whatever the texts."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    return settled(docs.select(F.col(key).alias("id"), number.alias("row"),
                               F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
                               F.lit(uuid.uuid4().hex).alias("load")))


def append(index: str, load: DataFrame) -> None:
    """Append the digests of ``load`` (from ``digests``) that the index doesn't have; of equal texts the row with
    the largest id stands for them. Running it again with the same load appends nothing."""
    spark = load.sparkSession
    # written first: else the anti-join would move below the grouping, and all copies of a text to one task
    groups = settled(load.groupBy("digest").agg(F.max(F.struct("id", "row", "load")).alias("keep")))
    buckets = int(detail(spark, index, "Num Buckets"))
    known = spark.table(index).select("digest")
    new = groups.join(known.hint("merge"), "digest", "left_anti")
    new.select("digest", F.col("keep.id").alias("keep_id"), F.col("keep.row").alias("keep_row"), F.col("keep.load").alias("load")).repartition(
        buckets, "digest").write.mode("append").bucketBy(buckets, "digest").sortBy("digest").option(
        "path", detail(spark, index, "Location")).saveAsTable(index)


def detail(spark: SparkSession, index: str, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {index}").where(F.col("col_name") == name).head(1)
    return rows[0]["data_type"]


def resolve(index: str, load: DataFrame) -> DataFrame:
    """``(id, row, digest, keep_id, kept, group_size)`` for every row of ``load``; group_size counts the load's rows
    with that text. Hot digests are joined between plain scans, where AQE splits them."""
    spark = load.sparkSession
    sizes = load.groupBy("digest").agg(F.count("*").alias("group_size"))
    keep = settled(spark.table(index).withColumnRenamed("load", "keep_load").join(sizes, "digest"))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row")) & (F.col("load") == F.col("keep_load"))
    return load.join(keep, "digest").select("id", "row", "digest", "keep_id", kept.alias("kept"), "group_size")


def dedup(docs: DataFrame, index: str | None = None, key: str = "doc_id", text: str = "text",
          row: str | None = None) -> DataFrame:
    """Deduplicate ``docs`` against ``index`` (a new one if None), append what is new, and say for each row what
    became of it."""
    load = digests(docs, key, text, row)
    index = index or create_index(docs.sparkSession, key_type=docs.schema[key].dataType.simpleString(), rows=load.count())
    append(index, load)
    return resolve(index, load)
