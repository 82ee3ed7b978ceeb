"""Best-fit packing of documents into token sequences by linear grouping.

Lengths are at most the capacity, so a histogram of lengths (4,096 numbers, whatever the corpus) is all that the plan
needs. The plan rounds large lengths up within groups of equal cardinality, fills sequences by configurations of the
few rounded sizes (the best subset-sum for the largest size left, used as often as the supplies last), puts actual
documents in the places of rounded ones, and then places small documents, longest first, where they fit best. It is a
list of runs: the r-th pieces of a length, for r in a range, go to consecutive sequences at one offset. Pieces find
their run by (length, rank); ranks are counted in salted buckets, so a length that a third of all pieces share is
not one task's work.

Defined cases: a null text is empty; every document ends in ``end_id``, an empty one has only that; only documents
longer than the capacity are cut; repeated rows are separate documents; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import bisect
import functools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm.common import settled

CAPACITY = 4096
GROUPS = 400
SMALL = 128  # lengths below are placed last, by best fit
# Byte-level vocabularies write a byte without a visible Latin-1 character as one from U+0100 on, in order.
BYTES = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
BUCKETS = 64  # per length, and one more for each million pieces


class WordIds(dict):
    """Word -> its token ids as native uint32 bytes, remembered up to a bound. The tokenizer drops white space
    before it merges, so a text's ids are those of its words in order. Only blanks and line ends separate words here;
    the tokenizer treats other white space by its own rule.

    A new word of ASCII or Latin-1 letters, with one punctuation mark at most behind it, is one pre-token (and the
    mark another), so it goes to the tokenizer's model at once; any other word takes the whole encoder."""

    def __init__(self, tokenizer_path: str, bound: int = 400_000):
        from tokenizers import Tokenizer
        self.tokenizer, self.bound = Tokenizer.from_file(tokenizer_path), bound
        self.marks = {"": b""} | {ch: self.whole(ch) for ch in ".,;:!?"}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, words: set[str]) -> None:
        """Remember the ids of ``words``."""
        model, marks = self.tokenizer.model.tokenize, self.marks
        for w in words:
            core, mark = (w[:-1], w[-1:]) if w[-1:] in marks else (w, "")
            if core.isalpha() and (core.isascii() or max(core) < "\u0100"):
                core = core.lower()
                ids = self.get(core)
                if ids is None:
                    text = core if core.isascii() else core.encode().decode("latin-1").translate(BYTES)
                    ids = self[core] = array("I", [t.id for t in model(text)]).tobytes()
                self[w] = ids + marks[mark]
            else:
                self[w] = self.whole(w)

    def encode(self, text: str) -> bytes:
        """The ids of a text."""
        words = text.replace("\n", " ").split(" ")
        ids = list(map(self.get, words))
        if None in ids:
            new = {w for w, x in zip(words, ids) if x is None}
            if len(self) + 2 * len(new) > self.bound:
                self.clear()
                new = set(words)
            self.learn(new)
            ids = map(self.__getitem__, words)
        return b"".join(ids)


@functools.cache
def word_ids(tokenizer_path: str) -> WordIds:
    """One per Python worker, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(tokenizer_path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32)`` per piece, written once."""
    id_type = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer_path)
        for b in batches:
            rows, cols = [], ([], [], [], [])
            for r, t in enumerate(b.column(1)):
                data = ids.encode(t.as_py() or "") + end
                for p, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at:at + 4 * capacity]
                    rows.append(r)
                    for c, v in zip(cols, (p, at // 4, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                                             ["id", "piece", "start", "length", "ids_crc32"])

    return settled(docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"id {id_type}, piece int, start long, length long, ids_crc32 long"))


# The plan: plain Python on a histogram of at most `capacity` numbers -------------------------------------------

def _groups(hist: dict[int, int], small: int, groups: int) -> list[list[list[int]]]:
    """Large lengths, longest first, in groups of equal cardinality: lists of runs [length, first rank, count]."""
    large = [(n, hist[n]) for n in sorted(hist, reverse=True) if n >= small]
    total, out, used = sum(c for _, c in large), [], 0
    for length, count in large:
        rank = 0
        while count:
            at = min(groups - 1, used * groups // total)
            room = -(-(at + 1) * total // groups) - used if at < groups - 1 else count
            take = min(count, max(1, room))
            if len(out) <= at or not out:
                out += [[] for _ in range(at + 1 - len(out))]
            out[at].append([length, rank, take])
            rank, count, used = rank + take, count - take, used + take
    return [g for g in out if g]


def _configuration(sizes: list[int], left: list[int], first: int, capacity: int) -> dict[int, int]:
    """Group -> number of places, with one at ``first`` and the largest sum of rounded sizes that fits."""
    room, reach, steps = capacity - sizes[first], 1, []
    full = (1 << (room + 1)) - 1
    for g in range(first, len(sizes)):
        supply, k = left[g] - (g == first), 1
        while supply > 0 and k * sizes[g] <= room:
            k = min(k, supply)
            new = (reach | reach << k * sizes[g]) & full
            if new != reach:
                steps.append((g, k, reach))
                reach = new
            supply, k = supply - k, k * 2
        if reach >> room:
            break
    at, out = reach.bit_length() - 1, {first: 1}
    for g, k, before in reversed(steps):
        if not before >> at & 1:
            out[g] = out.get(g, 0) + k
            at -= k * sizes[g]
    return out


def plan(hist: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) and the number of sequences."""
    hist = {n: c for n, c in hist.items() if c}
    runs, gaps, bins = [], {}, 0
    queues = _groups(hist, small, groups)
    sizes = [q[0][0] for q in queues]  # the longest of a group: what its members are rounded up to
    left = [sum(r[2] for r in q) for q in queues]
    first = 0
    while first < len(queues):
        if not left[first]:
            first += 1
            continue
        config = _configuration(sizes, left, first, capacity)
        times = min(left[g] // k for g, k in config.items())
        spans = [(bins, times, 0)]
        for g, k in config.items():
            left[g] -= k * times
            for _ in range(k):  # substitute: the next `times` documents of the group, which may be of several lengths
                new, queue = [], queues[g]
                for at, count, fill in spans:
                    while count:
                        run = queue[0]
                        take = min(count, run[2])
                        runs.append((run[0], run[1], take, at, fill))
                        new.append((at, take, fill + run[0]))
                        run[1], run[2], at, count = run[1] + take, run[2] - take, at + take, count - take
                        if not run[2]:
                            queue.pop(0)
                spans = new
        bins += times
        for at, count, fill in spans:
            if fill < capacity:
                gaps.setdefault(capacity - fill, []).append((at, count))
    order = sorted(gaps)
    for length in sorted((n for n in hist if n < small), reverse=True):
        count, rank = hist[length], 0
        while count:
            i = bisect.bisect_left(order, length)
            if i < len(order):  # best fit: the smallest gap that holds it
                gap = order[i]
                at, there = gaps[gap].pop()
                take = min(count, there)
                if there > take:
                    gaps[gap].append((at + take, there - take))
                if not gaps[gap]:
                    del gaps[gap], order[i]
                parts = [(at, take, capacity - gap)]
            else:
                each = capacity // length
                take, parts = (count // each, [(bins, count // each, k * length) for k in range(each)]) if count >= each else (
                    1, [(bins, 1, k * length) for k in range(count)])
                bins += take
                at = parts[-1][0]
            for _, n, fill in parts:
                runs.append((length, rank, n, at, fill))
                rank, count = rank + n, count - n
            gap = capacity - parts[-1][2] - length
            if gap:
                if gap not in gaps:
                    bisect.insort(order, gap)
                gaps.setdefault(gap, []).append((at, take))
    return runs, bins


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, key: str = "doc_id", text: str = "text", groups: int = GROUPS) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)`` per piece."""
    rows = pieces(docs, tokenizer_path, capacity, end_id, key, text)
    buckets = max(BUCKETS, rows.count() // 1_000_000)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = settled(rows.groupBy("length", "bucket").agg(F.count("*").alias("n")))  # at most capacity x buckets rows
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = settled(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(hist, capacity, groups)
    runs = np.array(sorted(runs), np.int64).reshape(-1, 5)
    at_run = docs.sparkSession.sparkContext.broadcast(runs)  # bounded by capacity, not by rows: see plan
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    id_type = rows.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = at_run.value
        low = np.cumsum(r[:, 2]) - r[:, 2]  # the place of a run among all pieces in order of (length, rank)
        lengths, first = np.unique(r[:, 0], return_index=True)
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            i = np.searchsorted(low, low[first[np.searchsorted(lengths, length)]] + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(r[i, 3] + rank - r[i, 1]), pa.array(r[i, 4])],
                                             ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
