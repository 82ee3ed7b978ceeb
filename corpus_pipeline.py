"""A training-data pipeline: language ID, exact dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of documents. ``run`` writes each stage's rows to the shared folder and reads them for the next.

Defined cases, for every stage: ``docs`` may be any frame, not only a file scan: rows are told apart by doc_id and text,
never by their place; a null doc_id is a value like any other and loses against one that isn't null; a null text counts
as empty; of repeated rows (equal doc_id and text) the dedup stages keep one and the others keep or drop all; an empty
table gives an empty table; further columns, whatever their names, are handed on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.llm import decontam, exact_dedup, langid, packing, simhash
from rulewright.llm.common import fresh, kept, settled, table, text_digest
from rulewright.llm.queries import TOKENIZER

LANGUAGES: list[str] | None = None  # languages to keep; None: all that the model has learned
LEAST_SCORE = 0.05  # cosine below which a text is in none of them


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose predicted language is wanted and whose cosine with it is ``LEAST_SCORE`` or more; texts
    without a letter go. The model is learned from all labelled rows. The rows ride through the prediction whole, so
    nothing is joined."""
    found = langid.predict(docs, langid.train(docs), carry=F.struct(*docs.columns))
    wanted = F.col("lang_pred") != langid.UNKNOWN
    if LANGUAGES is not None:
        wanted = wanted & F.col("lang_pred").isin(LANGUAGES)
    return found.where(wanted & (F.col("score") >= LEAST_SCORE)).select("carry.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    found = exact_dedup.dedup(docs)
    return kept(docs, found.select("id", "digest", F.col("kept").alias("stays")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component (3-word shingles, at most 2 bits) the row with the smallest doc_id stays, then that
    with the smallest text digest."""
    name = fresh(docs, "name_")
    named = docs.withColumn(name, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), text_digest().alias("digest"), F.monotonically_increasing_id().alias("row")))
    found = simhash.near_dedup(named, budget=2, width=3, key=name)  # its first step writes the names down
    return kept(docs, found.select("id.id", "id.digest", (F.col("id") == F.col("component_id")).alias("stays")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles go."""
    name = fresh(docs, "name_")
    named = docs.withColumn(name, F.struct(F.col("doc_id").alias("id"), text_digest().alias("digest")))
    found = decontam.contained(named, table(spark, sf_dir, "benchmark"), key=name)
    return kept(docs, found.select("id.id", "id.digest", F.lit(False).alias("stays")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4,096 tokens; a row per piece."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER)).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash", near), ("decontamination", decontaminate), ("packing", pack)]

ORACLE_SQL = None  # XXH64 fingerprints, random letter vectors and token ids have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir))
    return docs
