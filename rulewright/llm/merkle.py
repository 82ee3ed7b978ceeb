"""Merkle manifest of a dataset: a tree of digests per group, and one tree over the groups' roots.

A leaf is the SHA-256 of a row's fields. Within a group the leaves are numbered in key order; every run of ``arity``
consecutive nodes becomes the digest of their digests (hexadecimal text), until one node is left, the group's root.
The group roots in order of the group name, null first, make one more tree.

Every level is a self-join: a node asks for its siblings by their computed numbers (XOR with one in a binary tree,
slot offsets round the run otherwise), an equijoin on ``(tree, number)`` finds their digests, and the rows at slot
zero emit the parents. So no task sees more than one run at a time, however many rows a group has. Proofs go the
other way, from the roots down, so that what lies above a run is stored once for the run and not once for a row.

Defined cases: a null field is ``-`` and differs from an empty one (``0:``); the null group is a group of its own and
comes first; a null key comes first in its group; rows with equal keys are ordered by their digest, so that repeated
rows are leaves of their own; a lone leaf is its group's root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm.common import settled

IN_TASK = (1 << 33) - 1  # the part of monotonically_increasing_id that counts within a task
SIBLINGS = "array<struct<before:binary,after:binary>>"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hexed(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def record(*fields: Column) -> Column:
    """What a leaf hashes: every field as ``-`` if null, else as its length in UTF-8 bytes, a colon and its value."""
    return F.concat(*(F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-"))
                      for f in (c.cast("string") for c in fields)))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Add ``idx`` (from 0, in ``order`` within ``tree``) and ``n`` (rows of the tree) and write the result.

    The rows are dealt out by ranges of (tree, order), so a huge tree is spread over many tasks; a task numbers its
    own rows, and a table of one row per tree and task says where they start."""
    dealt = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    mine = F.monotonically_increasing_id()
    dealt = settled(dealt.withColumn("_at", mine).withColumns(
        {"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(IN_TASK)}))
    parts = settled(dealt.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows")))
    over = Window.partitionBy(tree)  # one row per task that holds the tree
    before = F.sum("_rows").over(over.orderBy("_part")) - F.col("_rows")
    starts = settled(parts.withColumns({"_start": before, "n": F.sum("_rows").over(over)}).select(
        tree, "_part", "_first", "_start", "n"))
    return dealt.join(starts, [tree, "_part"]).withColumn("idx", F.col("_at") - F.col("_first") + F.col("_start")).drop(
        "_at", "_part", "_first", "_start")


def siblings(arity: int) -> Column:
    """The numbers of a node's run, its own among them."""
    idx = F.col("idx")
    if arity == 2:
        return F.array(idx, idx.bitwiseXOR(F.lit(1)))
    slot = idx % arity
    return F.transform(F.sequence(F.lit(0), F.lit(arity - 1)), lambda d: idx - slot + (slot + d) % arity)


def levels(nodes: DataFrame, arity: int) -> list[tuple[DataFrame, DataFrame | None]]:
    """From the leaves ``(tree, idx, n, digest)`` up. One pair per height: the trees' roots that stand there
    ``(tree, digest)``, and the other nodes ``(tree, idx, before, after)`` with their siblings' digests (None at the top)."""
    out = []
    height = nodes.agg(F.max("n")).head()[0] or 0
    while height:
        roots = nodes.where("n = 1").select("tree", "digest")
        if height == 1:
            out.append((roots, None))
            break
        asked = nodes.where("n > 1").select("tree", "idx", "n", F.explode(siblings(arity)).alias("want")).where("want < n")
        found = asked.join(nodes.select("tree", F.col("idx").alias("want"), "digest"), ["tree", "want"])
        run = F.sort_array(F.collect_list(F.struct("want", "digest")))
        one = found.groupBy("tree", "idx").agg(F.first("n").alias("n"), run.alias("run"))
        text = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: hexed(x["digest"])), "")
        level = settled(one.select(
            "tree", "idx", "n", F.unhex(text(lambda x: x["want"] < F.col("idx"))).alias("before"),
            F.unhex(text(lambda x: x["want"] > F.col("idx"))).alias("after"),
            F.when(F.col("idx") % arity == 0, digest(text(lambda x: F.lit(True)))).alias("parent")))
        out.append((roots, level.select("tree", "idx", "before", "after")))
        height = -(-height // arity)
        nodes = level.where("parent IS NOT NULL").select(
            "tree", F.expr(f"idx div {arity}").alias("idx"), F.ceil(F.col("n") / arity).cast("long").alias("n"),
            F.col("parent").alias("digest"))
    return out


def paths(built: list[tuple[DataFrame, DataFrame | None]], tops: DataFrame, arity: int) -> DataFrame:
    """The siblings on the way from every leaf to the top: ``(tree, idx, path, *more)``, nearest first.

    ``tops`` is ``(tree, path, *more)``: what lies above each tree's root, and columns to hand down."""
    more = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for roots, level in reversed(built):
        at = roots.select("tree").join(tops, "tree").withColumn("idx", F.lit(0).cast("long"))
        if level is not None:
            own = F.array(F.struct("before", "after"))
            below = level.withColumn("up", F.expr(f"idx div {arity}")).join(
                above.select("tree", F.col("idx").alias("up"), F.col("path").alias("_path"), *more), ["tree", "up"])
            at = at.select("tree", "idx", "path", *more).unionByName(
                below.select("tree", "idx", F.concat(own, F.col("_path")).alias("path"), *more))
        above = at
    return above


def manifest(docs: DataFrame, fields: list[str], tree: str, key: str, arity: int = 8, changed: dict[str, Column] | None = None) -> DataFrame:
    """The manifest of ``docs``: per row ``(key, leaf, changed_leaf, subroot, root, path)``, digests as binary.

    ``changed`` names columns whose present value differs from the manifest's; ``changed_leaf`` is the leaf they give
    and ``fold`` of it along ``path`` says whether a verifier would notice."""
    changed = changed or {}
    now = [changed.get(f, F.col(f)) for f in fields]
    # null first, then by the name's bytes
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    leaf = docs.select(F.col(key).alias("key"), name.alias("tree"), digest(record(*(F.col(f) for f in fields))).alias("digest"),
                       digest(record(*now)).alias("changed_leaf"), F.monotonically_increasing_id().alias("row"))
    # written first: the texts are hashed once, and repeated rows are told apart by a number that stays
    leaves = settled(numbered(settled(leaf), "tree", ["key", "digest", "row"]))
    built = levels(leaves.select("tree", "idx", "n", "digest"), arity)
    if not built:
        return leaves.select("key", F.col("digest").alias("leaf"), "changed_leaf", F.col("digest").alias("subroot"), F.col("digest").alias("root"),
                             F.array().cast(SIBLINGS).alias("path"))
    subroots = built[0][0]
    for roots, _ in built[1:]:
        subroots = subroots.unionByName(roots)
    names = settled(numbered(subroots.select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest"), "all", ["name"]))
    wood = levels(names.select(F.col("all").alias("tree"), "idx", "n", "digest"), arity)
    root = wood[-1][0].select("tree", F.col("digest").alias("root"), F.array().cast(SIBLINGS).alias("path"))
    over = paths(wood, root, arity).join(names.select(F.col("all").alias("tree"), "idx", "name", "digest"), ["tree", "idx"])
    tops = settled(over.select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root"))
    return leaves.join(paths(built, tops, arity), ["tree", "idx"]).select(
        "key", F.col("digest").alias("leaf"), "changed_leaf", "subroot", "root", "path")


def proof(path: Column) -> Column:
    """SHA-256 over the path's siblings, level by level, left to right, as hexadecimal text."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(hexed(s["before"]), hexed(s["after"]))), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root (hexadecimal) that a leaf and the recorded siblings give."""
    return F.aggregate(path, hexed(leaf), lambda now, s: F.sha2(F.concat(hexed(s["before"]), now, hexed(s["after"])), 256))
