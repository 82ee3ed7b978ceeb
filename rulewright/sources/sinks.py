"""Sinks (S6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.operators.fixes import file_digests


def changed_files(old: DataFrame, new: DataFrame, key: str = "file_id") -> DataFrame:
    """Files whose text differs from the old one, with the new text."""
    before = old.select(key, F.col("text").alias("_old"))
    return new.join(before, key).where(~F.col("text").eqNullSafe(F.col("_old"))).drop("_old")


def write_changed(old: DataFrame, new: DataFrame, path: str, key: str = "file_id",
                  partition_by: list[str] | None = None) -> None:
    """Write only the changed files, to a new place and never over the input."""
    writer = changed_files(old, new, key).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def changed_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """S6 for line tables: the new lines of files that differ from the old ones. Files are compared by digest."""
    same = file_digests(new).join(file_digests(old).withColumnRenamed("digest", "_old"), "file_id").where(F.col("digest") == F.col("_old"))
    return new.join(same.select("file_id"), "file_id", "left_anti")
