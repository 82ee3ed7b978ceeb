"""Hard negatives: for every anchor and each of its nearest rows of the same label, the best rows of other labels
whose score lies in a window below the positive's.

Scores are exact inner products of scaled integer vectors. Rows are dealt into blocks, anchors and candidates meet
block by block, and a tile of scores is one Strassen product on int64 (odd sides are padded with zeros; additions wrap
modulo 2^64, so intermediate sums can't spoil a result that fits). Each tile keeps a short heap per anchor and heaps
of all tiles merge: first the positives, then, with their scores known, one window heap per positive. No task
holds more than one tile, and what leaves a tile is bounded by the heap sizes.

Defined cases: rows with a null id, label or vector, or with a null, NaN or infinite component take no part; shorter
vectors are padded with zeros and an empty vector scores 0; repeated rows are rows of their own, so a copy of an
anchor may be its positive; ties go to the smaller id; an anchor without positives, or a positive with an empty
window, gives no row; an empty table gives no rows; other columns are ignored. Where int64 could overflow, the tile is
computed with integers of any size; a score that is returned must fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm.common import settled

ANCHOR_ROWS, CANDIDATE_ROWS = 2048, 1024  # expected rows of a block; a tile of scores is 16 MB
LEAF = 16  # sides up to this are multiplied directly


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` by seven products of half the size, recursively."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        return strassen(_even(a), _even(b))[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * m, 2 * n), p1.dtype)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out


def _even(x: np.ndarray) -> np.ndarray:
    out = np.zeros((x.shape[0] + x.shape[0] % 2, x.shape[1] + x.shape[1] % 2), x.dtype)
    out[:x.shape[0], :x.shape[1]] = x
    return out


def _matrix(lists: pa.ChunkedArray, dim: int) -> np.ndarray:
    lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def tile_scores(anchors: pa.Table, rows: pa.Table) -> np.ndarray:
    dim = max(max((len(x) for x in t["vector"]), default=0) for t in (anchors, rows))
    a, b = _matrix(anchors["vector"], dim), _matrix(rows["vector"], dim)
    most = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if dim * most(a) * most(b) >= 1 << 63:
        a, b = a.astype(object), b.astype(object)
    return strassen(a, np.ascontiguousarray(b.T))


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The first ``k`` allowed columns of every row, best score first, ties by column: (rows, columns) per place."""
    least = -(1 << 63) if scores.dtype == np.int64 else min(scores.min(initial=0), 0) - 1
    left, out = np.where(allowed, scores, least), []
    for _ in range(min(k, scores.shape[1])):
        col = left.argmax(axis=1)
        row = np.flatnonzero(left[np.arange(len(left)), col] > least)
        if not len(row):
            break
        out.append((row, col[row]))
        left[row, col[row]] = least
    return out


def _sides(tile: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """Anchors, candidates in order of id, and whether their labels are equal."""
    is_anchor = tile["side"].to_numpy()
    anchors = tile.filter(pa.array(is_anchor))
    rows = tile.filter(pa.array(~is_anchor)).sort_by([("id", "ascending"), ("row", "ascending")])
    _, code = np.unique(np.array(anchors["label"].to_pylist() + rows["label"].to_pylist(), object).astype(str), return_inverse=True)
    return anchors, rows, code[:len(anchors), None] == code[None, len(anchors):]


def _positive_heaps(k: int, schema: pa.Schema):
    def run(tile: pa.Table) -> pa.Table:
        anchors, rows, same = _sides(tile)
        if not len(anchors) or not len(rows):
            return schema.empty_table()
        scores = tile_scores(anchors, rows)
        other = anchors["row"].to_numpy()[:, None] != rows["row"].to_numpy()[None, :]
        heaps = best(scores, same & other, k)
        a, c = (np.concatenate([h[i] for h in heaps] or [np.zeros(0, int)]) for i in (0, 1))
        return pa.table([anchors["row"].take(a), rows["id"].take(c), rows["row"].take(c), pa.array(scores[a, c].tolist(), pa.int64())], schema=schema)
    return run


def _window_heaps(k: int, low: int, high: int, schema: pa.Schema):
    def run(tile: pa.Table) -> pa.Table:
        anchors, rows, same = _sides(tile)
        if not len(anchors) or not len(rows):
            return schema.empty_table()
        scores = tile_scores(anchors, rows)
        ids, heap = rows["id"], anchors["positives"].to_pylist()
        out: list[list] = [[], [], [], [], []]
        for no in range(max(map(len, heap))):
            own = np.array([i for i, h in enumerate(heap) if no < len(h)])
            score = [heap[i][no]["score"] for i in own]
            kind = np.int64 if scores.dtype == np.int64 else object
            least = np.array([-(-low * s // 100) for s in score], kind)[:, None]
            most = np.array([high * s // 100 for s in score], kind)[:, None]
            part = scores[own]
            for a, c in best(part, ~same[own] & (part >= least) & (part <= most), k):
                out[0] += anchors["row"].take(own[a]).to_pylist()
                out[1] += [no] * len(a)
                out[2] += ids.take(c).to_pylist()
                out[3] += rows["row"].take(c).to_pylist()
                out[4] += part[a, c].tolist()
        return pa.table([pa.array(x, t) for x, t in zip(out, schema.types)], schema=schema)
    return run


def merged(heaps: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best ``k`` of all tiles' heaps per key, numbered from 1. Every task cuts its own rows to ``k`` per key before they are sent."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row"))
    return heaps.withColumn("rank", place).where(F.col("rank") <= k)


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))


def mine(vectors: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5,
         negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows that ``anchor`` names.

    ``window`` is in hundredths of the positive's score, both ends included."""
    id_type = pa.int32() if vectors.schema[key].dataType.simpleString() == "int" else pa.int64()
    rows = settled(vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & usable(F.col(vector))).select(
        F.col(key).alias("id"), F.col(label).alias("label"), scaled(F.col(vector), scale).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.monotonically_increasing_id().alias("row")))
    count = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).head()
    down, across = max(1, -(-count["a"] // ANCHOR_ROWS)), max(1, -(-count["n"] // CANDIDATE_ROWS))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    heap = "array<struct<id:bigint,score:bigint>>"
    base = ["id", "row", "label", "vector"]
    candidates = rows.select(*base, block(across).alias("j"), every(down).alias("i"), F.lit(False).alias("side"), F.lit(None).cast(heap).alias("positives"))
    own = rows.where("anchor").select(*base, block(down).alias("i"))

    def tiles(anchors: DataFrame) -> DataFrame:
        placed = anchors.select(*base, "i", every(across).alias("j"), F.lit(True).alias("side"), "positives")
        return candidates.unionByName(placed).groupBy("i", "j")

    found = pa.schema([("anchor", pa.int64()), ("id", id_type), ("row", pa.int64()), ("score", pa.int64())])
    kind = "int" if id_type == pa.int32() else "bigint"
    near = tiles(own.withColumn("positives", F.lit(None).cast(heap))).applyInArrow(
        _positive_heaps(positives, found), f"anchor bigint, id {kind}, row bigint, score bigint")
    pos = settled(merged(near, ["anchor"], positives))
    per_anchor = pos.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("h"))
    asked = own.join(per_anchor, "row").withColumn("positives", F.transform("h", lambda p: F.struct(p["id"].cast("bigint").alias("id"), p["score"].alias("score")))).drop("h")
    held = pa.schema([("anchor", pa.int64()), ("no", pa.int32()), ("id", id_type), ("row", pa.int64()), ("score", pa.int64())])
    heaps = tiles(settled(asked)).applyInArrow(
        _window_heaps(negatives, *window, held), f"anchor bigint, no int, id {kind}, row bigint, score bigint")
    neg = merged(heaps, ["anchor", "no"], negatives)
    named = pos.select("anchor", (F.col("rank") - 1).alias("no"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(
        own.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return neg.join(named, ["anchor", "no"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
                                                    "positive_score", F.col("score").alias("negative_score"))
