"""Benchmark decontamination: short test items inside long documents by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles (8-15, 16-31, ...). For each partition a document is seen through
overlapping windows four times the partition's lower size, at steps of twice that size, so an item's passage always
lies inside a window of comparable size and the Jaccard bound between the two (0.8 / 4.2 at worst) doesn't depend on
the document's length. 64 MinHash values with one row per band then miss such a window with a probability under
0.000002. Items of under 8 shingles form a partition of their own in which every shingle is a key. Candidates are
verified by exact containment of the item's distinct shingles in the whole document.

Item keys and shingles are broadcast only as bit maps of a fixed greatest size (MAX_BITS); a document sends on its
keys and shingles that hit the maps, and plain joins do the rest, so more items mean more rows, not a larger broadcast.

Words are runs of letters and digits, lower-cased; a text of fewer words than a shingle is one shingle. Defined cases:
an item or text without words (null, empty) matches nothing; null ids are carried through; repeated rows and items give
repeated pairs; empty tables give no pairs; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import settled

WIDTH = 5
PERMUTATIONS = 64
TINY = 8  # items of fewer shingles use all of them as keys
MAX_BITS = 1 << 27
WORD = re.compile(r"[^\W_]+")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(42).integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(words: list[str], cache: dict, width: int = WIDTH) -> np.ndarray:
    """A hash per shingle, in order, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    x = np.zeros(n, np.uint64)
    for i in range(min(width, len(h))):
        x = x * _MULTIPLY + h[i:i + n]
    return _mixed(x)


def minima(h: np.ndarray, block: int) -> np.ndarray:
    """MinHash values of each block of shingles: a row per block, a column per permutation."""
    out = []
    for lo in range(0, len(h), 256 * block):
        part = h[lo:lo + 256 * block, None] * _SEEDS
        out.append(np.minimum.reduceat(part, np.arange(0, len(part), block), axis=0))
    return np.concatenate(out) if out else np.zeros((0, PERMUTATIONS), np.uint64)


def keys_of(values: np.ndarray, size_class: int) -> np.ndarray:
    """Band keys of rows of MinHash values; permutation and size class are part of a key."""
    salt = _mixed(np.arange(PERMUTATIONS, dtype=np.uint64) + np.uint64(1000 * size_class + 1))
    return _mixed(values ^ salt)


def window_keys(h: np.ndarray, classes: list[int]) -> np.ndarray:
    """All keys of a document: per size class, those of every window."""
    if not classes or not len(h):
        return np.zeros(0, np.uint64)
    at, out = classes[0] + 1, []
    step = minima(h, 1 << at)  # minima of one step of the smallest class, then of ever larger steps
    for c in classes:
        while at < c + 1:
            step = np.minimum.reduceat(step, np.arange(0, len(step), 2), axis=0)
            at += 1
        windows = np.minimum(step[:-1], step[1:]) if len(step) > 1 else step
        out.append(np.unique(keys_of(windows, c)))
    return np.concatenate(out)


def prepare_items(items: DataFrame, key: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``(iid, item_id, n, size_class, shingles, keys)`` per item, written once; size_class -1 for tiny items."""
    id_type = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for b in batches:
            cols = {"n": [], "size_class": [], "shingles": [], "hashes": [], "keys": []}
            for t in b.column(1).to_pylist():
                words = WORD.findall((t or "").lower())
                pick = list(dict.fromkeys(" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))) if words else []
                h = np.unique(shingle_hashes(words, cache, width))
                c = int(np.log2(len(pick))) if len(pick) >= TINY else -1
                cols["n"].append(len(pick))
                cols["size_class"].append(c)
                cols["shingles"].append(pick)
                cols["hashes"].append(h.view(np.int64).tolist())
                cols["keys"].append(keys_of((h[:, None] * _SEEDS).min(axis=0), c).view(np.int64).tolist() if c >= 0 else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols["n"], pa.int32()), pa.array(cols["size_class"], pa.int32()),
                                              pa.array(cols["shingles"], pa.list_(pa.string())), pa.array(cols["hashes"], pa.list_(pa.int64())),
                                              pa.array(cols["keys"], pa.list_(pa.int64()))], ["item_id", *cols])

    ddl = f"item_id {id_type}, n int, size_class int, shingles array<string>, hashes array<long>, keys array<long>"
    out = items.select(F.col(key).alias("item_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, ddl)
    return settled(out.where("n > 0").withColumn("iid", F.monotonically_increasing_id()))


def bit_map(hashes: DataFrame, column: str) -> np.ndarray:
    """A bit per hash, 1,024 bits for each at most MAX_BITS in all, gathered as 64-bit words with their bits or-ed on
    the executors; what reaches the driver is at most MAX_BITS / 64 rows."""
    n = max(1, hashes.count())
    bits = min(MAX_BITS, max(1 << 16, 1 << (1024 * n - 1).bit_length()))
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = hashes.select(F.shiftright(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint64)


def in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(64 * len(bits) - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def probe(docs: DataFrame, items: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``(rid, id, keys, shingles)`` of documents with any hit, written once."""
    spark = docs.sparkSession
    id_type = docs.schema[key].dataType.simpleString()
    classes = sorted(r[0] for r in items.where("size_class >= 0").select("size_class").distinct().collect())  # at most 31
    maps = spark.sparkContext.broadcast((bit_map(items.select(F.explode("keys").alias("h")), "h"),
                                         bit_map(items.select(F.explode("hashes").alias("h")), "h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, (key_bits, shingle_bits) = _Hashes(), maps.value
        for b in batches:
            rows = []
            for r, t in enumerate(b.column(1)):
                words = WORD.findall((t.as_py() or "").lower())
                h = shingle_hashes(words, cache, width)
                hits = np.flatnonzero(in_map(shingle_bits, h)) if len(h) else h
                if not len(hits):
                    continue  # no item shingle at all: no key can lead to a verified pair
                k = window_keys(h, classes)
                rows.append((r, k[in_map(key_bits, k)].view(np.int64), list({" ".join(words[i:i + width]) for i in hits})))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                                              pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["id", "keys", "shingles"])

    out = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, keys array<long>, shingles array<string>")
    return settled(out.withColumn("rid", F.monotonically_increasing_id()))


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = WIDTH, key: str = "doc_id", item_key: str = "item_id",
              text: str = "text") -> DataFrame:
    """``(id, item_id, n_shingles, n_shared, containment)``: pairs of which the document holds at least ``threshold``
    of the item's distinct shingles."""
    items = prepare_items(items, item_key, "text", width)
    found = probe(docs, items, key, text, width)
    doc_shingles = found.select("rid", F.explode("shingles").alias("s"))
    item_shingles = items.select("iid", "size_class", F.explode("shingles").alias("s"))
    by_key = found.select("rid", F.explode("keys").alias("k")).join(items.select("iid", F.explode("keys").alias("k")), "k").select("rid", "iid")
    tiny = doc_shingles.join(item_shingles.where("size_class = -1"), "s").select("rid", "iid")
    candidates = by_key.union(tiny).distinct()
    # Only candidate pairs are counted: a sentence common to many documents and items makes no pair by itself.
    shared = settled(candidates).join(doc_shingles, "rid").join(item_shingles.select("iid", "s"), ["iid", "s"]).groupBy("rid", "iid").agg(
        F.count("*").alias("n_shared"))
    pairs = shared.join(items.select("iid", "item_id", "n"), "iid")
    pairs = pairs.where(F.col("n_shared") >= threshold * F.col("n")).join(found.select("rid", "id"), "rid")
    return pairs.select("id", "item_id", F.col("n").cast("long").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))
