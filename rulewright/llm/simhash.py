"""SimHash near-dedup by a self-join of a binary trie.

Fingerprints of 64 bits are the leaves of a binary trie. Two nodes are traversed together, from (root, root) down;
the bits in which their prefixes differ are summed and a pair is dropped as soon as the sum exceeds the budget. The
upper trie is a table of nodes and its traversal a join per four levels; below nodes of at most ``leaf_size``
fingerprints the traversal goes on in numpy, one pair of such nodes at a time. A fingerprint has at most 2,080 others
within two bits, so links stay in proportion to distinct fingerprints; documents with equal fingerprints are one
leaf.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and is linked like any other; a text of
fewer words than a shingle is one shingle; null ids belong to a component but never name it unless all are null;
repeated rows are repeated in the result; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import components, settled, shingle_blocks

STEP = 4  # trie levels per join
LEAF = 512


def fingerprint(data: bytes | None, width: int = 3) -> int:
    """Bit i is set if it is set in over half the shingles' XXH64 (seed 42); A-Z lower-cased, repeats counted."""
    ones, total = np.zeros(64, np.int64), 0
    for shingles in shingle_blocks((data or b"").lower(), width):
        h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        total += len(shingles)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)`` per row; fp is the fingerprint as a signed long."""
    id_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py(), width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"id {id_type}, fp long")


def _mask(depth: int) -> int:
    m = ((1 << 64) - 1) ^ ((1 << (64 - depth)) - 1)
    return m - (1 << 64) if m >> 63 else m


def leaves(fps: DataFrame, leaf_size: int = LEAF) -> DataFrame:
    """``(prefix, depth, fps)``: the trie's blocks of at most ``leaf_size`` distinct fingerprints."""
    n = fps.count()
    depth = min(64, STEP * math.ceil(max(0.0, math.log2(max(1, n) / (leaf_size / 4))) / STEP))
    out = None
    while True:
        at = fps.withColumn("prefix", F.col("fp").bitwiseAND(F.lit(_mask(depth))))
        heavy = settled(at.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > leaf_size).select("prefix"))
        done = heavy.isEmpty() or depth == 64
        light = at if done else at.join(heavy, "prefix", "left_anti")
        rows = light.groupBy("prefix").agg(F.sort_array(F.collect_list("fp")).alias("fps")).withColumn("depth", F.lit(depth))
        out = rows if out is None else out.unionByName(rows)
        if done:
            return settled(out.select("prefix", "depth", "fps"))
        fps, depth = at.join(heavy, "prefix", "left_semi").select("fp"), min(64, depth + STEP)


def node_pairs(blocks: DataFrame, budget: int) -> DataFrame:
    """``(a, da, b, db)``: pairs of leaf blocks, each once, whose known bits differ in at most ``budget`` places."""
    mask = F.element_at(F.array(*(F.lit(_mask(d)) for d in range(65))), F.least("da", "db") + 1)
    leaf = blocks.select("prefix", "depth")
    deepest = leaf.agg(F.max("depth")).head()[0] or 0
    step = leaf.select("prefix", "depth", F.col("prefix").alias("c"), F.col("depth").alias("dc"), F.lit(True).alias("leaf"))
    level, inner = leaf, []
    for d in range(deepest, 0, -STEP):  # parents of everything at depth d, and what was there as a leaf
        here = level.where(F.col("depth") == d).distinct()
        up = F.col("prefix").bitwiseAND(F.lit(_mask(d - STEP)))
        inner.append(here.select(up.alias("prefix"), F.lit(d - STEP).alias("depth"), F.col("prefix").alias("c"), F.lit(d).alias("dc")))
        level = settled(here.select(up.alias("prefix"), F.lit(d - STEP).alias("depth")).distinct()).union(leaf)
    for rows in inner:
        step = step.union(rows.withColumn("leaf", F.lit(False)))
    step = settled(step.select("prefix", "depth", "c", "dc"))
    spark = blocks.sparkSession
    pairs = spark.createDataFrame([(0, 0, 0, 0)], "a long, da int, b long, db int")
    for _ in range(0, deepest, STEP):
        left = step.select(F.col("prefix").alias("a"), F.col("depth").alias("da"), F.col("c").alias("a2"), F.col("dc").alias("da2"))
        right = step.select(F.col("prefix").alias("b"), F.col("depth").alias("db"), F.col("c").alias("b2"), F.col("dc").alias("db2"))
        same = (F.col("a") == F.col("b")) & (F.col("da") == F.col("db"))
        down = pairs.join(left, ["a", "da"]).join(right, ["b", "db"]).where(~same | (F.col("a2") <= F.col("b2")))
        pairs = down.select(F.col("a2").alias("a"), F.col("da2").alias("da"), F.col("b2").alias("b"), F.col("db2").alias("db"))
        pairs = settled(pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(mask)) <= budget))
    return pairs


def close_pairs(a: np.ndarray, b: np.ndarray, depth: int, budget: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``budget`` bits of two sorted arrays, whose first ``depth`` bits are alike within each array:
    both tries descended together, one bit at a time, until the ranges are small."""
    al, ah, bl, bh = (np.array([x]) for x in (0, len(a), 0, len(b)))
    top = np.uint64(_mask(depth) & ((1 << 64) - 1))
    diff = np.array([int(np.bitwise_count((a[0] ^ b[0]) & top))])
    for level in range(depth, 64):
        if ((ah - al) * (bh - bl)).sum() <= 8 * len(al):
            break
        bit, high = np.uint64(1 << (63 - level)), np.uint64(_mask(level) & ((1 << 64) - 1))
        am = np.searchsorted(a, (a[al] & high) | bit)
        bm = np.searchsorted(b, (b[bl] & high) | bit)
        am, bm = np.clip(am, al, ah), np.clip(bm, bl, bh)
        x = [np.concatenate(p) for p in ((al, al, am, am), (am, am, ah, ah), (bl, bm, bl, bm), (bm, bh, bm, bh))]
        diff = np.concatenate((diff, diff + 1, diff + 1, diff))
        ok = (diff <= budget) & (x[0] < x[1]) & (x[2] < x[3])
        if same:
            ok &= x[0] <= x[2]
        (al, ah, bl, bh), diff = (v[ok] for v in x), diff[ok]
        if not len(al):
            break
    nb = bh - bl
    counts = (ah - al) * nb
    of = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    i, j = al[of] + at // nb[of], bl[of] + at % nb[of]
    ok = np.bitwise_count(a[i] ^ b[j]) <= budget
    if same:
        ok &= i < j
    return a[i[ok]], b[j[ok]]


def links(fps: DataFrame, budget: int, leaf_size: int = LEAF) -> DataFrame:
    """``(a, b)``: every pair of different fingerprints within ``budget`` bits. ``fps(fp)`` holds distinct ones."""
    blocks = leaves(fps, leaf_size)
    pairs = node_pairs(blocks, budget)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = (np.sort(batch.column(c)[r].values.to_numpy(zero_copy_only=False).view(np.uint64)) for c in (2, 3))
                depth = min(batch.column(0)[r].as_py(), batch.column(1)[r].as_py())
                x, y = close_pairs(a, b, depth, budget, batch.column(4)[r].as_py())
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    left = blocks.select(F.col("prefix").alias("a"), F.col("depth").alias("da"), F.col("fps").alias("fa"))
    right = blocks.select(F.col("prefix").alias("b"), F.col("depth").alias("db"), F.col("fps").alias("fb"))
    same = (F.col("a") == F.col("b")) & (F.col("da") == F.col("db"))
    work = pairs.join(left, ["a", "da"]).join(right, ["b", "db"]).select("da", "db", "fa", "fb", same.alias("same"))
    return work.mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, budget: int = 2, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, fp, component_id)`` per row; component_id is the smallest id reachable by links."""
    marks = settled(fingerprints(docs, key, text, width))
    nodes = settled(marks.groupBy("fp").agg(F.min("id").alias("least")))
    parts = components(links(nodes.select("fp"), budget)).select(F.col("node").alias("fp"), "component")
    of = settled(nodes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    names = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return marks.join(settled(of.join(names, "component").select("fp", "component_id")), "fp").select("id", "fp", "component_id")


def hex16(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
