"""Helpers shared by the training-data operators: shared scratch tables, row numbers, words, components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHORT_LIST = 500_000  # names of some 50 bytes each that are broadcast at most
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name below the folder that all executors share: ``spark.checkpoint.dir`` where the
    cluster names one, else the warehouse (local sessions and tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/rulewright-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage is cut, lost executors cost nothing
    that was finished, and later joins see plain scans, which AQE can split."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


def kept(docs: DataFrame, decided: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that ``decided(id, digest, stays)`` drops.

    Rows are named by what is in them, key and text digest, and never by a row number: a second reading of ``docs``
    may deal its rows out differently. Of a name's decisions, ``stays`` holds as often as it says so: if some rows of
    a name stay and others don't, one row stays. Names that aren't decided on stay. Only the names that drop a row
    are joined, so what is sent is small where little is dropped, and a name is shared by repeated rows only."""
    few = settled(decided.groupBy("id", "digest").agg(F.max("stays").alias("some"), F.min("stays").alias("every")).where("NOT every"))
    digest = fresh(docs, "digest_")
    marked = docs.withColumn(digest, text_digest(text))
    same = lambda d: marked[key].eqNullSafe(d["id"]) & (marked[digest] == d["digest"])
    partly = settled(few.where("some"))
    # A short list goes to every task, a longer one is joined by name, which sends the texts as well.
    few, partly = (F.broadcast(x) if x.count() <= SHORT_LIST else x for x in (few, partly))
    rest = marked.join(few, same(few), "left_anti").drop(digest)
    one = marked.join(partly, same(partly), "left_semi").groupBy(key, digest).agg(F.first(F.struct(*docs.columns)).alias("row_"))
    return rest.unionByName(one.select("row_.*"))


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")), F.lit(0)) % n


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about ``size`` bytes, so that a huge text needs no huge list."""
    start = 0
    while start < len(data):
        space = SPACE.search(data, start + size)
        end = space.start() if space else len(data)
        yield data[start:end].split()
        start = end


def shingle_blocks(data: bytes, width: int) -> Iterator[list[bytes]]:
    """All shingles of ``width`` words, repeats included, space-joined, in lists. A text of fewer words is one
    shingle; a text without words has none."""
    carry: list[bytes] = []
    some = False
    for words in word_blocks(data):
        words = carry + words
        if len(words) >= width:
            some = True
            yield list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
            carry = words[len(words) - width + 1:]
        else:
            carry = words
    if carry and not some:
        yield [b" ".join(carry)]


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)`` as ``(node, component)``, the component being its smallest node.

    Alternates the large-star and small-star steps, which needs about log(nodes) rounds. Each round is written to
    the shared folder; the driver sees a row count and a checksum. Hubs are joined from written tables, so AQE
    can split them."""
    edges = settled(links.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settled(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = settled(large.where("a <> b").distinct())  # a > b from here on
        least = settled(down.groupBy("a").agg(F.min("b").alias("m")))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
        edges = settled(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    star = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.union(star.select("component", "component").distinct())
