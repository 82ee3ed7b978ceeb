"""Readers for source trees and exported findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ISSUE = ("struct<key:string,rule:string,message:string,component:string,status:string,severity:string,"
         "line:int,start_column:int,end_column:int>")
PAGE_SCHEMA = f"issues array<{ISSUE}>, hotspots array<{ISSUE}>, total bigint, paging struct<total:bigint>"


def read_sources(spark: SparkSession, root: str, glob: str = "*.java") -> DataFrame:
    """Every matching file below ``root`` as (path, text), path relative to the root.

    Files that cannot be read are skipped.
    """
    found = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
             .option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
             .text(root, wholetext=True))
    base = root.rstrip("/") + "/"
    return found.select(F.substring_index(F.col("_metadata.file_path"), base, -1).alias("path"),
                        F.col("value").alias("text"))


def source_manifest(spark: SparkSession, root: str, glob: str = "*.java") -> DataFrame:
    """One row per matching file below ``root``, readable or not: (path, size, modified, digest, status, reason, text).

    ``digest`` is the SHA-256 of the bytes. A file that isn't UTF-8 has status ``skipped`` with its reason and no
    text, so it doesn't vanish; all others are ``ok``. Files of no bytes have no row: Spark's readers leave them out. Keep the table to see later which files are new or changed.
    """
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root))
    base, body = root.rstrip("/") + "/", F.col("content").cast("string")
    valid = F.is_valid_utf8(body)
    return found.select(
        F.substring_index("path", base, -1).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        F.sha2("content", 256).alias("digest"), F.when(valid, "ok").otherwise("skipped").alias("status"),
        F.when(~valid, "not UTF-8").alias("reason"), F.when(valid, body).alias("text"))


def changed_sources(manifest: DataFrame, earlier: DataFrame) -> DataFrame:
    """The files of a manifest that an earlier one lacks or has with another digest."""
    return manifest.join(earlier.select("path", "digest"), ["path", "digest"], "left_anti")


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings from exported JSON pages, one document per file."""
    pages = spark.read.schema(PAGE_SCHEMA).option("multiLine", True).json(path)
    return _page_rows(pages.withColumn("page_no", F.lit(None).cast("bigint")))


def parse_pages(df: DataFrame, json_col: str, page_col: str = "page_no") -> DataFrame:
    """The same for a column that holds page documents."""
    doc = F.from_json(F.col(json_col), PAGE_SCHEMA)
    return _page_rows(df.select(page_col, doc.alias("d")).select(F.col(page_col).alias("page_no"), "d.*"))


def _page_rows(pages: DataFrame) -> DataFrame:
    """A page carries ``issues`` and ``total``, or ``hotspots`` and ``paging.total``; else nothing."""
    issues = F.col("issues")
    total = F.when(issues.isNotNull(), F.coalesce("total", F.lit(0))).otherwise(F.coalesce("paging.total", F.lit(0)))
    return pages.select("page_no", total.cast("bigint").alias("total"),
                        F.explode(F.coalesce(issues, F.col("hotspots"))).alias("f")).select("page_no", "total", "f.*")


def merge_pages(rows: DataFrame, key: str = "key") -> DataFrame:
    """All pages together, a finding that several pages carry once (the first page's row)."""
    rest = [c for c in rows.columns if c not in (key, "page_no", "total")]
    return rows.groupBy(key).agg(F.min("page_no").alias("page_no"),
                                 *[F.min_by(c, "page_no").alias(c) for c in rest])


def page_completeness(rows: DataFrame, key: Column | str = "key") -> DataFrame:
    """Distinct findings collected against the largest total any page announced."""
    out = rows.agg(F.countDistinct(key).alias("collected"), F.coalesce(F.max("total"), F.lit(0)).alias("total"))
    return out.withColumn("complete", F.col("collected") >= F.col("total"))
