"""The Merkle manifest against a plain recursive one."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rulewright.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, digest string, tree string, idx int, n int, path string, key int, root string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(leaves, arity):
    """The root and, per leaf, the digests beside its way up as (before, after)."""
    ways, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for w, way in enumerate(ways):
            g = at[w] // arity * arity
            way.append(("".join(nodes[g:at[w]]), "".join(nodes[at[w] + 1:g + arity])))
            at[w] //= arity
        nodes = [sha("".join(nodes[i:i + arity])) for i in range(0, len(nodes), arity)]
    return nodes[0], ways


def brute(rows, arity):
    """Sorted (doc_id, leaf, subroot, root, proof) of rows in the order of FIELDS."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: (sorted(groups[g], key=lambda x: x[:3])) for g in names}
    subs = {g: tree_of([x[2] for x in built[g]], arity) for g in names}
    root, ways = tree_of([subs[g][0] for g in names], arity) if names else (None, [])
    out = []
    for g, above in zip(names, ways):
        for x, way in zip(built[g], subs[g][1]):
            out.append((x[3][0], x[2], subs[g][0], root, sha("".join(b + a for b, a in way + above))))
    return sorted(out, key=repr)


def found(df):
    rows = df.select("key", *(merkle.hexed(F.col(c)) for c in ("leaf", "subroot", "root")), merkle.proof(F.col("path"))).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def rows_of(df):
    return [tuple(r) for r in df.select(*FIELDS).collect()]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    rows = [(i, "T" * r.randrange(4) + "\u00e9", r.choice(["en", "de", None, "fr"]), r.choice([None, "s"]), r.choice([None, 3]), *["x", "y", 1, 2, "p", 4, "r"]) for i in range(150)]
    rows += [(7, None, "en", None, None, *[None] * 7)] * 3 + [(None, "", "", "", 0, *[None] * 7)] * 2 + [(900, "one", "zz", "s", 1, *[None] * 7), (901, "word " * 300_000, "\uffee", "s", 1, *[None] * 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_tree(docs, arity):
    assert found(merkle.manifest(docs, FIELDS, "lang", "doc_id", arity)) == brute(rows_of(docs), arity)


def test_partitioning_does_not_matter(docs):
    one = found(merkle.manifest(docs.coalesce(1), FIELDS, "lang", "doc_id"))
    assert one == found(merkle.manifest(docs.repartition(16, "source"), FIELDS, "lang", "doc_id"))


def test_tampering_shows(docs):
    changed = {"text": F.lower("text")}
    out = merkle.manifest(docs, FIELDS, "lang", "doc_id", 8, changed)
    seen = out.select("leaf", "changed_leaf", (merkle.fold(F.col("changed_leaf"), F.col("path")) == merkle.hexed(F.col("root"))).alias("ok"),
                      (merkle.fold(F.col("leaf"), F.col("path")) == merkle.hexed(F.col("root"))).alias("own")).collect()
    assert all(r.own for r in seen) and all(r.ok == (r.leaf == r.changed_leaf) for r in seen)
    assert {r.ok for r in seen} == {True, False}


def test_small_tables(spark, docs):
    assert found(merkle.manifest(docs.limit(0), FIELDS, "lang", "doc_id")) == []
    one = docs.where("doc_id = 900")
    assert found(merkle.manifest(one, FIELDS, "lang", "doc_id")) == brute(rows_of(one), 8)
    assert found(merkle.manifest(one, FIELDS, "lang", "doc_id"))[0][4] == sha("")
