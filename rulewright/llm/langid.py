"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, permuted
(rotated) by their place; a text's vector bundles (adds) those of its trigrams; a language's prototype bundles its
training texts. A text gets the language whose prototype has the largest cosine with it.

Because bundling is a sum, training needs only counts of trigrams per language: they are summed over all training
texts by a shuffle of at most (languages x 2^18) rows, and each prototype is one row of ``dim`` floats. Prototypes are
the only thing collected (8 KB a language).

Letters are folded to lower case; a-z and 37 classes of other letters have symbols of their own, all else is one
symbol (white space, digits, marks), runs of which count once. Defined cases: a text that is null or without letters
is ``und`` with score 0, as is every text when nothing can be learned; ties go to the first language in order; a
negative cosine is score 0; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = 64
DIM = 1024
UNKNOWN = "und"


@functools.cache
def letter_table() -> np.ndarray:
    """Code point -> symbol: 0 none, 1-26 a-z, 27-63 other letters."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if not 0xD800 <= cp < 0xE000 and (ch := chr(cp)).isalpha():
            low = ch.lower()[0]
            out[cp] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 37
    return out


@functools.cache
def letter_vectors(dim: int) -> np.ndarray:
    return np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (SYMBOLS, dim))


def trigrams(text: str | None) -> np.ndarray:
    """Trigram codes of a text, in order, with one blank symbol at each end; empty without letters."""
    s = letter_table()[np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)].astype(np.int64)
    if not s.any():
        return np.zeros(0, np.int64)
    s = np.concatenate(([0], s, [0]))
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def trigram_vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    v = letter_vectors(dim)
    return np.roll(v, 2, 1)[codes // SYMBOLS ** 2] * np.roll(v, 1, 1)[codes // SYMBOLS % SYMBOLS] * v[codes % SYMBOLS]


class _Vectors:
    """Rows of trigram vectors, made when first asked for; at most ``bound`` are held."""

    def __init__(self, dim: int, bound: int = 16_000):
        self.dim, self.bound, self.at, self.n = dim, bound, np.full(SYMBOLS ** 3, -1, np.int32), 0
        self.rows = np.zeros((bound, dim), np.float32)  # takes memory as rows are written

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        new = codes[self.at[codes] < 0]
        if self.n + len(new) > self.bound:
            self.at[:], self.n, new = -1, 0, codes
        if len(new) > self.bound:  # more at once than may be held
            return sum(counts[i:i + 1024].astype(np.float32) @ trigram_vectors(codes[i:i + 1024], self.dim).astype(np.float32) for i in range(0, len(codes), 1024))
        self.rows[self.n:self.n + len(new)] = trigram_vectors(new, self.dim)
        self.at[new] = np.arange(self.n, self.n + len(new))
        self.n += len(new)
        return counts.astype(np.float32) @ self.rows[self.at[codes]]


def train(docs: DataFrame, label: str = "lang", text: str = "text", dim: int = DIM) -> DataFrame:
    """``(lang, prototype array<float>)`` from all rows with a label."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        send = lambda lang: (c := np.flatnonzero(sums[lang]), pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(c), pa.string()), pa.array(c.astype(np.int32)), pa.array(sums[lang][c])], ["lang", "code", "n"]))[1]
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1)):
                codes = trigrams(t.as_py())
                if lang not in sums:
                    if len(sums) >= 32:  # 2 MB each
                        yield send(first := next(iter(sums)))
                        del sums[first]
                    sums[lang] = np.zeros(SYMBOLS ** 3, np.int64)
                sums[lang] += np.bincount(codes, minlength=SYMBOLS ** 3) if len(codes) > 50_000 else 0
                if len(codes) <= 50_000:
                    np.add.at(sums[lang], codes, 1)
        for lang in sums:
            yield send(lang)

    counts = docs.where(F.col(label).isNotNull()).select(F.col(label).alias("lang"), F.col(text).alias("text")).mapInArrow(
        count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of any languages in any order -> one partial prototype per language and task."""
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, codes, n = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(), b.column(2).to_numpy()
            for i in range(0, len(codes), 4096):
                v = trigram_vectors(codes[i:i + 4096].astype(np.int64), dim).astype(np.float64) * n[i:i + 4096, None]
                for lang in set(langs[i:i + 4096]):
                    sums[lang] = sums.get(lang, 0) + v[langs[i:i + 4096] == lang].sum(axis=0)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim, pa.string()), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], ["lang", "at", "v"])

    parts = counts.mapInArrow(project, "lang string, at int, v double").groupBy("lang", "at").agg(F.sum("v").alias("v"))
    return parts.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("prototype"))  # dim values each


def predict(docs: DataFrame, prototypes: DataFrame, key: str = "doc_id", text: str = "text", dim: int = DIM, carry: Column | None = None) -> DataFrame:
    """``(id, carry, lang_pred, score)`` for every row; only the text is looked at. ``carry`` may be of any type."""
    id_type = docs.schema[key].dataType.simpleString()
    model = sorted((r["lang"], r["prototype"]) for r in prototypes.collect())
    langs = [m[0] for m in model]
    matrix = np.array([m[1] for m in model], np.float64).reshape(len(model), dim)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = (matrix / np.where(norms > 0, norms, 1)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _Vectors(dim)
        for b in batches:
            pred, score = [], []
            for t in b.column(2):
                codes = trigrams(t.as_py())
                if not len(codes) or not langs:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                v = vectors.bundle(*np.unique(codes, return_counts=True))
                cos = unit @ v / max(float(np.linalg.norm(v)), 1e-12)
                best = int(np.argmax(cos))
                pred.append(langs[best])
                score.append(float(min(1.0, max(0.0, cos[best]))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["id", "carry", "lang_pred", "score"])

    carry = F.lit(False) if carry is None else carry
    carry_type = docs.select(carry).schema[0].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), carry.alias("carry"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"id {id_type}, carry {carry_type}, lang_pred string, score double")
