"""Sharding by sampled splitters: shards of near equal bytes, as ranges of the key (hash of the text, id).

A size-weighted sample of keys gives quantile boundaries; the records are range-partitioned between them and ranges
that turn out overfull are subdivided by a sample of their own. Exact byte totals of the ranges then place every
record, so the sample decides how the work is dealt out, not the result: record r, with B bytes before it in key
order, goes to shard floor((B + size / 2) * shards / total).

Equal texts are neighbours in key order: a group stays together unless it is larger than what is left of its shard.
Defined cases: a null text has size ``overhead``; a null id sorts first; rows that agree in id and text are
interchangeable and share a range; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm.common import settled

SAMPLE_PER_RANGE = 25
ROWS_PER_RANGE = 250_000
MAX_RANGES = 4096  # bounds the boundaries that go with the plan; ranges grow beyond that, in rows, never the sample


def records(docs: DataFrame, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """One narrow row per document; the texts take no part in any shuffle."""
    body = F.coalesce(F.col(text), F.lit(""))
    return settled(docs.select(F.col(key).alias("id"), (F.octet_length(body) + overhead).cast("long").alias("size"),
                               F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("h")))


def _key() -> Column:
    return F.struct("h", "id")


def _sample(recs: DataFrame, rate: float, salt: int) -> list:
    """Keys drawn with a probability of size * rate, by a hash of the key."""
    u = F.pmod(F.xxhash64(F.lit(salt), "h", "id"), F.lit(1 << 30)) / (1 << 30)
    return [(r["h"], r["id"]) for r in recs.where(u < F.col("size") * rate).select("h", "id").collect()]


def _order(k: tuple) -> tuple:
    return (k[0], k[1] is not None, k[1] if k[1] is not None else 0)


def _quantiles(keys: list, parts: int) -> list:
    keys = sorted(set(keys), key=_order)
    return [keys[i * len(keys) // parts] for i in range(1, parts)] if len(keys) >= parts else keys


def _range(bounds: list, id_type: str) -> Column:
    """Number of boundaries at or below the key, by a search in two steps."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    lit = [F.struct(F.lit(h).alias("h"), F.lit(i).cast(id_type).alias("id")) for h, i in bounds]
    coarse = F.size(F.filter(F.array(*lit[::step]), lambda b: b <= _key()))
    fine = F.size(F.filter(F.slice(F.array(*lit), F.greatest(coarse - 1, F.lit(0)) * step + 1, step), lambda b: b <= _key()))
    return F.greatest(coarse - 1, F.lit(0)) * step + fine


def boundaries(recs: DataFrame, shards: int) -> list:
    """Splitters of about equal bytes. The sample holds SAMPLE_PER_RANGE keys a range, at most about 100,000."""
    id_type = recs.schema["id"].dataType.simpleString()
    rows, total = recs.agg(F.count("*"), F.sum("size")).head()
    if not rows:
        return []
    ranges = min(MAX_RANGES, max(8 * shards, math.ceil(rows / ROWS_PER_RANGE)))
    bounds = _quantiles(_sample(recs, ranges * SAMPLE_PER_RANGE / total, 0), ranges)
    for salt in range(1, 9):
        part = recs.withColumn("range", _range(bounds, id_type))
        full = part.groupBy("range").agg(F.sum("size").alias("bytes"), F.min(_key()).alias("lo"), F.max(_key()).alias("hi")).where(
            (F.col("bytes") > 2 * total / ranges) & (F.col("lo") < F.col("hi"))).collect()
        more = set()
        if full:
            drawn = _sample(part.where(F.col("range").isin([r["range"] for r in full])), ranges * SAMPLE_PER_RANGE / total, salt)
            for r in full:
                own = [k for k in drawn if _order(r["lo"]) < _order(k) <= _order(r["hi"])]
                more |= set(_quantiles(own, math.ceil(r["bytes"] * ranges / total))) - set(bounds)
        if not more:
            return bounds
        bounds = sorted({*bounds, *more}, key=_order)
    return bounds


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row; slots count from 0 in each shard."""
    recs = records(docs, key, text, overhead)
    id_type = recs.schema["id"].dataType.simpleString()
    part = recs.withColumn("range", _range(boundaries(recs, shards), id_type))
    # One row per range, as many as there are boundaries: their running totals need no distributed sort.
    sums = part.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    w = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = settled(sums.select("range", F.coalesce(F.sum("bytes").over(w), F.lit(0)).alias("bytes0"),
                                 F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"),
                                 F.sum("bytes").over(Window.partitionBy()).alias("total")))
    inside = Window.partitionBy("range").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = part.withColumn("b", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn(
        "r", F.row_number().over(Window.partitionBy("range").orderBy("h", "id")) - 1).join(starts, "range")
    middle = 2 * (F.col("bytes0") + F.col("b")) + F.col("size")
    place = F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / (2 * F.col("total"))).cast("int"))
    placed = settled(ranked.select("id", "size", "text_crc32", place.alias("shard"), (F.col("n0") + F.col("r")).alias("rank")))
    first = placed.groupBy("shard").agg(F.min("rank").alias("rank0"))  # at most `shards` rows
    return placed.join(first, "shard").select("id", "size", "text_crc32", "shard", (F.col("rank") - F.col("rank0")).alias("slot"))
