"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax over all words of the corpus.

P(word | context) = P(class | context) * P(symbol | class, context) * P(word | symbol, context). The symbols are the most
frequent words, the end of a text and one symbol for all other words, sorted by frequency into classes. The other words
are the leaves of a binary tree, placed there by their hash: classes within classes, each a softmax over its two halves
(:func:`log_leaf`). The tree has as many leaves as there are such words, up to ``LEAVES``; words that share a leaf are told
apart by their counts, (c + 1) / (N + V) with the leaf's own N and V. Unseen words have 1 / (N' + V' + 1) of the other words
instead. So the probabilities of all words, unseen ones together, sum to one. All softmaxes are over sums of weights picked
by hashed features: a bias, the previous word, the word before it (a skip feature) and the pair of both; the classes and
symbols see these as symbols, the tree as words. The tree's biases are the corpus shares of the two halves.

Counts: every training token of the corpus is counted (partial counts in the tasks, then a shuffle). Training: in each
round every task takes Adagrad steps over its documents from the broadcast weights; the changes are averaged over the
tasks that touched a weight row, in two shuffles, and the next round starts from the average. Scoring: one pass
computes the model's part in numpy, for classes and symbols one entry per distinct context and symbol of a batch; counts of the ``HOT`` most frequent words are broadcast (bounded by HOT), all other
words are looked up by a join on the word, which therefore has no hot key.

Defined cases: a null text is empty and consists of its end; a null id counts as fold 0; repeated rows repeat; with an
empty training set all counts are 0 and the weights stay at their start; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import settled, word_blocks

CLASSES = WORDS = 16
SYMBOLS = CLASSES * WORDS
CLASS_ROWS, WORD_ROWS = 1 << 12, 1 << 14  # 2^16 at most: rows are sorted as 16-bit numbers
LEAVES = 1 << 20  # of the tree at most: what is broadcast of it is bounded
TREE_BITS = 18
TREE = 1 << TREE_BITS  # weights of the tree's features
HOT = 200_000
ROUNDS = 2
CHUNK = 1 << 18  # tokens per batch
BLOCK = 1 << 14  # weights per shuffled block
FEATURES = 4
END = b""


def tokens(data: bytes | None) -> Iterator[list[bytes]]:
    """A-Z lower-cased words, in lists; the end follows as a token of its own."""
    yield from word_blocks((data or b"").lower())
    yield [END]


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(token, c)`` over all rows, written once; the end of a text is the empty token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        send = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])
        for b in batches:
            for t in b.column(0):
                for words in tokens(t.as_py()):
                    seen.update(words)
                if len(seen) > 200_000:
                    yield send()
                    seen.clear()
        if seen:
            yield send()

    parts = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "token binary, c long")
    return settled(parts.groupBy("token").agg(F.sum("c").alias("c")))


@dataclass
class Vocabulary:
    """The HOT most frequent words with their counts; the first ones that are symbols of the model have their
    symbol, the others have ``other`` and a leaf, as all words that aren't here."""
    words: list[bytes]
    counts: np.ndarray
    symbol: np.ndarray
    other: int
    end: int
    symbol_counts: np.ndarray
    total: int  # N
    distinct: int  # V
    other_total: int  # N'
    other_distinct: int  # V'
    mass: np.ndarray  # N + V of each leaf

    @property
    def units(self) -> np.ndarray:
        """A number for each of ``words``: its symbol or, behind the symbols, its leaf."""
        leaves = np.fromiter(map(zlib.crc32, self.words), np.int64, len(self.words)) % len(self.mass)
        return np.where(self.symbol != self.other, self.symbol, SYMBOLS + leaves)

    @property
    def tree_bias(self) -> np.ndarray:
        """Log odds of the right half of each node; the root is node 1, the halves of node i are 2 i and 2 i + 1."""
        out, m = np.zeros(len(self.mass), np.float32), np.maximum(self.mass, 1e-3)
        while len(m) > 1:
            out[len(m) // 2:len(m)] = np.log(m[1::2] / m[::2])
            m = m[::2] + m[1::2]
        return out


def vocabulary(counts: DataFrame, hot: int = HOT) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    # How many words have about so many counts: a few hundred rows, from which the least count of a hot word follows.
    level = F.floor(F.log2("c") * 16)
    levels = sorted((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect())
    least, room = None, hot
    for at, n in reversed(levels):
        if n > room:
            break
        least, room = at, room - n
    # The first words and the end are among them however many words share a level; a cap below the number of symbols holds
    # unless no level fits it. Other words are looked up by a join, and have leaves in the model.
    first = [counts.orderBy(F.desc("c"), "token").limit(SYMBOLS)] if hot >= SYMBOLS or least is None else []
    found = {(c, t) for some in (counts.where(level >= least if least is not None else F.lit(False)), *first, counts.where(F.length("token") == 0))
             for c, t in zip(*(x.to_pylist() for x in some.select("c", "token").toArrow().columns))}  # at most `hot` and SYMBOLS + 1 rows
    rows = sorted(found, key=lambda x: (-x[0], x[1]))
    if END not in (t for _, t in rows):
        rows.append((0, END))
    chosen = [t for _, t in rows[:SYMBOLS - 2]]
    if END not in chosen:
        chosen = [*chosen[:SYMBOLS - 3], END]
    by = dict((t, c) for c, t in rows)
    own = [(by[t], t) for t in chosen]
    other_total = total - sum(c for c, _ in own)
    ranked = sorted([*own, (other_total, None)], key=lambda x: (-x[0], x[1] is None, x[1] or b""))
    place = {t: i for i, (_, t) in enumerate(ranked)}
    symbol_counts = np.zeros(SYMBOLS)
    symbol_counts[:len(ranked)] = [c for c, _ in ranked]
    words = [t for _, t in rows]
    other_distinct = distinct - sum(c > 0 for c, _ in own)
    leaves = min(LEAVES, 1 << max(1, (other_distinct - 1).bit_length()))
    mass = np.zeros(leaves)
    by_leaf = counts.groupBy((F.crc32("token") % leaves).alias("leaf")).agg((F.sum("c") + F.count("*")).alias("n")).toArrow()  # at most LEAVES rows
    mass[by_leaf.column("leaf").to_numpy()] += by_leaf.column("n").to_numpy()
    for c, t in own:
        mass[zlib.crc32(t) % leaves] -= c + 1 if c else 0
    return Vocabulary(words, np.array([c for c, _ in rows], np.float64), np.array([place.get(t, place[None]) for t in words]), place[None], place[END],
                      symbol_counts, total, distinct, other_total, other_distinct, mass)


@dataclass
class Model:
    class_rows: np.ndarray  # CLASS_ROWS x CLASSES
    word_rows: np.ndarray  # WORD_ROWS x WORDS
    tree: np.ndarray = field(default_factory=lambda: np.zeros((TREE, 1), np.float32))

    def tables(self) -> tuple[np.ndarray, ...]:
        return self.class_rows, self.word_rows, self.tree


def initial(symbol_counts: np.ndarray) -> Model:
    """Biases as in the unigram model, all else zero."""
    m = Model(np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((WORD_ROWS, WORDS), np.float32))
    share = symbol_counts.reshape(CLASSES, WORDS) + 0.01
    m.class_rows[0] = np.log(share.sum(axis=1) / share.sum())
    m.word_rows[:CLASSES] = np.log(share / share.sum(axis=1, keepdims=True))
    return m


def _hash(*parts) -> np.ndarray:
    x = np.zeros(1, np.uint64)
    for p in parts:
        x = (x + np.asarray(p).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
    return x


def feature_rows(one: np.ndarray, two: np.ndarray, cls: np.ndarray) -> tuple[list, list]:
    """Row numbers of each feature in the two weight tables. Biases have rows of their own."""
    class_at, word_at = [np.zeros(len(one), np.int64)], [cls.astype(np.int64)]
    for f, context in ((1, (one,)), (2, (two,)), (3, (one, two))):
        class_at.append((_hash(f, *context) % np.uint64(CLASS_ROWS - 1)).astype(np.int64) + 1)
        word_at.append((_hash(f, *context, cls) % np.uint64(WORD_ROWS - CLASSES)).astype(np.int64) + CLASSES)
    return class_at, word_at


def _softmax(rows: np.ndarray, at: list) -> np.ndarray:
    z = rows[at[0]]
    for a in at[1:]:
        z = z + rows[a]
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def log_probability(model: Model, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log10 P(symbol | previous, the one before) for each row; the two are symbols as well."""
    cls = word // WORDS
    class_at, word_at = feature_rows(one, two, cls)
    i = np.arange(len(word))
    pc = _softmax(model.class_rows, class_at)[i, cls]
    pw = _softmax(model.word_rows, word_at)[i, word % WORDS]
    return np.log10(np.maximum(pc, 1e-30)).astype(np.float64) + np.log10(np.maximum(pw, 1e-30))


def _tree_path(model: Model, bias: np.ndarray, one: np.ndarray, two: np.ndarray, leaf: np.ndarray) -> Iterator[tuple]:
    """For each node on the way from the root to the leaves: the weights picked, the log odds of the right half and whether the way goes there."""
    depth, weights = len(bias).bit_length() - 1, model.tree[:, 0]
    contexts = [_hash(f, *context).astype(np.uint32) for f, context in ((1, (one,)), (2, (two,)), (3, (one, two)))]
    for d in range(depth):
        node = (leaf >> (depth - d)) + (1 << d)
        mixed, z, at = node.astype(np.uint32) * np.uint32(0x9E3779B1), bias[node], []
        for c in contexts:
            at.append(((c ^ mixed) * np.uint32(0x85EBCA6B) >> np.uint32(32 - TREE_BITS)).astype(np.int64))
            z = z + weights[at[-1]]
        yield at, np.clip(z, -30, 30), ((leaf >> (depth - 1 - d)) & 1).astype(np.float32)


def log_leaf(model: Model, bias: np.ndarray, one: np.ndarray, two: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """log10 P(leaf | another word than the symbols', previous, the one before) for each row."""
    p = np.ones(len(leaf))
    for _, z, right in _tree_path(model, bias, one, two, leaf):
        p /= 1 + np.exp((1 - 2 * right) * z)
    return np.log10(p)


def _step(rows: np.ndarray, squares: np.ndarray, at: list, gradient: np.ndarray, rate: float) -> None:
    for a in at:
        order = np.argsort(a.astype(np.uint16), kind="stable")  # numbers of so few bits are sorted by counting
        s = a[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        g, r = np.add.reduceat(gradient[order], first, axis=0), s[first]
        squares[r] += g * g
        rows[r] -= rate * g / np.sqrt(squares[r] + 1e-6)


def learn(model: Model, squares: tuple, one, two, word, weight, rate: float) -> None:
    """One Adagrad step of classes and symbols on distinct (context, symbol) rows with their counts."""
    cls, i, n = word // WORDS, np.arange(len(word)), weight.sum()
    class_at, word_at = feature_rows(one, two, cls)
    for rows, sq, at, target in ((model.class_rows, squares[0], class_at, cls), (model.word_rows, squares[1], word_at, word % WORDS)):
        g = _softmax(rows, at)
        g[i, target] -= 1
        g *= (weight / n * 1000)[:, None].astype(np.float32)
        _step(rows, sq, at, g, rate)


def learn_tree(model: Model, squares: np.ndarray, bias: np.ndarray, one, two, leaf, n: int, rate: float) -> None:
    """One Adagrad step of the tree on the other words among ``n``."""
    sums, weight = np.zeros(TREE, np.float32), np.float32(1000 / n)
    for at, z, right in _tree_path(model, bias, one, two, leaf):
        gradient = (1 / (1 + np.exp(-z)) - right) * weight
        for a in at:
            np.add.at(sums, a, gradient)
    squares[:, 0] += sums * sums
    model.tree[:, 0] -= np.float32(rate) * sums / np.sqrt(squares[:, 0] + np.float32(1e-6))


class Reader:
    """Texts to arrays of token numbers: the place in ``vocab.words``, or -1, and the unit (:attr:`Vocabulary.units`)."""

    def __init__(self, vocab: Vocabulary, symbols_only: bool = False):
        """``symbols_only``: know just the words that are symbols of the model, which is all that training needs."""
        self.vocab = vocab
        self.at = {w: i for i, w in enumerate(vocab.words) if not symbols_only or vocab.symbol[i] != vocab.other}
        self.units = np.append(vocab.units, -1).astype(np.int32)

    def read(self, data: bytes | None, rare: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers and units of a text; ``rare`` gets its words that aren't hot, in order."""
        out, units, get = [], [], self.at.get
        for words in tokens(data):
            x = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
            out.append(x)
            units.append(u := self.units[x])
            if len(x) and x.min() < 0:
                away = np.flatnonzero(x < 0)
                some = [words[i] for i in away]
                u[away] = np.fromiter(map(zlib.crc32, some), np.int64, len(some)) % len(self.vocab.mass) + SYMBOLS
                if rare is not None:
                    rare += some
        return np.concatenate(out), np.concatenate(units)


def contexts(units: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The previous unit and the one before, of concatenated texts that each end in ``end``. A text starts as if
    after two ends."""
    one = np.concatenate(([end], units[:-1]))
    two = np.concatenate(([end], one[:-1]))
    return one, np.where(one == end, end, two)


def _distinct(one, two, word, inverse: bool = False):
    return np.unique((one * SYMBOLS + two) * SYMBOLS + word, return_counts=not inverse, return_inverse=inverse)


def _split(code: np.ndarray):
    return code // SYMBOLS ** 2, code // SYMBOLS % SYMBOLS, code % SYMBOLS


def _parts(units: np.ndarray, vocab: Vocabulary) -> tuple[tuple, np.ndarray, tuple]:
    """Of concatenated texts: (one, two, symbol) of all tokens; the places of those with a leaf and their (one, two, leaf)."""
    symbols = np.where(units < SYMBOLS, units, vocab.other).astype(np.int64)
    at = np.flatnonzero(units >= SYMBOLS)
    one, two = contexts(units, vocab.end)
    return (*contexts(symbols, vocab.end), symbols), at, (one[at], two[at], units[at] - SYMBOLS)


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, rate: float = 0.1, text: str = "text") -> Model:
    """Rounds of local steps and averaging over all rows of ``docs``."""
    sc = docs.sparkSession.sparkContext
    model = initial(vocab.symbol_counts)
    words = sc.broadcast(vocab)
    source = docs.select(F.spark_partition_id().alias("part"), F.col(text).cast("binary").alias("text"))
    fan = max(1, int(docs.rdd.getNumPartitions() ** 0.5))
    widths = [x.shape[1] for x in model.tables()]
    for round_no in range(rounds):
        start = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            old, reader, bias, part = start.value, None, None, 0
            own = Model(*(x.copy() for x in old.tables()))
            squares = tuple(np.zeros_like(x) for x in own.tables())
            held, n, some = [], 0, False

            def flush():
                units = np.concatenate(held)
                symbols, _, leaves = _parts(units, words.value)
                code, weight = _distinct(*symbols)
                learn(own, squares[:2], *_split(code), weight.astype(np.float32), rate / (1 + round_no))
                learn_tree(own, squares[2], bias, *leaves, len(units), rate / (1 + round_no))

            for b in batches:
                if reader is None:
                    reader, bias = Reader(words.value, symbols_only=True), words.value.tree_bias
                for t in b.column(1):
                    _, x = reader.read(t.as_py())
                    held.append(x)
                    n += len(x)
                    if n >= CHUNK // 4:
                        flush()
                        held, n, some = [], 0, True
                if b.num_rows:
                    part = b.column(0)[0].as_py()
            if held:
                flush()
                some = True
            if some:
                for which, (new, before) in enumerate(zip(own.tables(), old.tables())):
                    step = BLOCK // new.shape[1]
                    for lo in range(0, len(new), step):
                        change = (new[lo:lo + step] - before[lo:lo + step]).astype(np.float16)
                        yield pa.RecordBatch.from_pydict({"which": [which], "lo": [lo], "part": [part], "change": [change.tobytes()]}, schema=pa.schema([
                            ("which", pa.int32()), ("lo", pa.int32()), ("part", pa.int32()), ("change", pa.binary())]))

        def add(group):
            """Sums of a block's changes, in the order of the partitions, and for each weight row the tasks that touched it."""
            group = group.sort_values("part")
            if "touched" not in group:
                change = [np.frombuffer(x, np.float16).reshape(-1, widths[group["which"].iloc[0]]) for x in group["change"]]
                group = group.assign(change=[x.astype(np.float32).tobytes() for x in change], touched=[(x != 0).any(axis=1).astype(np.float32).tobytes() for x in change])
            sums = [np.sum([np.frombuffer(x, np.float32) for x in group[c]], axis=0, dtype=np.float64).astype(np.float32).tobytes() for c in ("change", "touched")]
            return group.iloc[:1].assign(change=[sums[0]], touched=[sums[1]])

        ddl = "which int, lo int, part int, change binary"
        parts = source.mapInArrow(run, ddl)
        some = parts.groupBy("which", "lo", (F.col("part") % fan).alias("slot")).applyInPandas(add, f"{ddl}, touched binary")
        for r in some.groupBy("which", "lo").applyInPandas(add, f"{ddl}, touched binary").collect():  # one row per block of the model
            rows = model.tables()[r["which"]]
            change = np.frombuffer(r["change"], np.float32).reshape(-1, rows.shape[1])
            rows[r["lo"]:r["lo"] + len(change)] += change / np.maximum(np.frombuffer(r["touched"], np.float32), 1)[:, None]
    return model


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Model, key: str = "doc_id", text: str = "text", carry=None) -> DataFrame:
    """``(id, carry, n_tokens, n_known, base_score, score)`` for every row."""
    sc = docs.sparkSession.sparkContext
    words, weights = sc.broadcast(vocab), sc.broadcast(model)
    id_type = docs.schema[key].dataType.simpleString()
    names = ["id", "carry", "n_tokens", "n_known", "hot_log", "model_log", "other_log", "n_other", "rare", "tf", "rare_leaf"]
    types = [None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, vocab, model, bias = None, words.value, weights.value, words.value.tree_bias
        leaf_log = np.log10(np.maximum(vocab.mass, 1))
        logs, known = np.append(np.log10(vocab.counts + 1), 0.0), np.append(vocab.counts > 0, False)
        for b in batches:
            reader = reader or Reader(vocab)
            cols, held, away, n = {k: [] for k in names[2:]}, [], [], 0

            def flush():
                if not held:
                    return
                symbols, at, leaves = _parts(np.concatenate(held), vocab)
                code, inverse = _distinct(*symbols, inverse=True)
                each = np.concatenate([log_probability(model, *_split(code[i:i + CHUNK])) for i in range(0, len(code), CHUNK)])[inverse]
                in_tree = np.zeros(len(each))
                for i in range(0, len(at), CHUNK // 8):
                    one, two, leaf = (x[i:i + CHUNK // 8] for x in leaves)
                    in_tree[at[i:i + CHUNK // 8]] = log_leaf(model, bias, one, two, leaf) - leaf_log[leaf]
                ends = np.cumsum([len(x) for x in held])
                # A word that isn't hot may be unseen, which its lookup tells, so what the tree gives it is handed on by itself.
                for end, x, (where, words) in zip(ends, held, away):
                    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
                    number = np.fromiter(map(place.get, words), np.int64, len(words))
                    cols["rare"].append(list(place))
                    cols["tf"].append(np.bincount(number, minlength=len(place)))
                    cols["rare_leaf"].append(np.bincount(number, in_tree[where + end - len(x)], len(place)))
                    in_tree[where + end - len(x)] = 0
                each += in_tree
                cols["model_log"] += np.add.reduceat(each, np.concatenate(([0], ends[:-1]))).tolist()

            for t in b.column(2):
                x, units = reader.read(t.as_py(), rare := [])
                other = units >= SYMBOLS
                away.append((np.flatnonzero(x < 0), rare))
                for k, v in (("n_tokens", len(x)), ("n_known", int(known[x].sum())), ("hot_log", float(logs[x].sum())), ("other_log", float(logs[x[other]].sum())),
                             ("n_other", int(other.sum()))):
                    cols[k].append(v)
                held.append(units)
                n += len(x)
                if n >= CHUNK:
                    flush()
                    held, away, n = [], [], 0
            flush()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(cols[k], t) for k, t in zip(names[2:], types[2:]))], names)

    carry = F.lit(False) if carry is None else carry
    source = docs.select(F.col(key).alias("id"), carry.alias("carry"), F.col(text).cast("binary").alias("text"))
    parts = settled(source.mapInArrow(run, f"id {id_type}, carry boolean, n_tokens long, n_known long, hot_log double, model_log double, other_log double, "
                                           "n_other long, rare array<binary>, tf array<long>, rare_leaf array<double>").withColumn("row", F.monotonically_increasing_id()))
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "tf", "rare_leaf")).alias("x")).select("row", F.col("x.rare").alias("token"), "x.tf", "x.rare_leaf")
    looked_up = rare.join(counts, "token").groupBy("row").agg(
        F.sum("tf").alias("rare_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum("rare_leaf").alias("leaf_log"))
    out = parts.drop("rare", "tf", "rare_leaf").join(looked_up, "row", "left")
    found, known = F.coalesce("rare_log", F.lit(0.0)), F.col("n_known") + F.coalesce("rare_known", F.lit(0))
    base = F.col("hot_log") + found - F.col("n_tokens") * F.log10(F.lit(float(vocab.total + vocab.distinct + 1)))
    mass, unseen = float(vocab.other_total + vocab.other_distinct), F.col("n_tokens") - known
    full = (F.col("model_log") + F.col("other_log") + found + F.coalesce("leaf_log", F.lit(0.0)) - F.col("n_other") * F.log10(F.lit(mass + 1))
            + (F.col("n_other") - unseen) * F.log10(F.lit(max(mass, 1.0))))
    return out.select("id", "carry", "n_tokens", known.alias("n_known"), base.alias("base_score"), full.alias("score"))
