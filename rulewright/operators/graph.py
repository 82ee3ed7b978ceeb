"""Dependency graph.

An edge (src, dst) says that ``src`` depends on ``dst``. Wildcard imports are kept in two halves -
file to package prefix, prefix to member file - because the pairs of a popular package grow with
the product of its users and its members. Walking both halves gives the same dependents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.sources.scratch import ensure_checkpoint_dir


def class_map(types: DataFrame) -> DataFrame:
    """The file of each class; of several, the one with the largest id."""
    return types.groupBy(F.col("qualified_name").alias("class_name")).agg(F.max("file_id").alias("file_id"))


def find_class_file(classes: DataFrame, names: DataFrame) -> DataFrame:
    """The file of each named class, null when unknown."""
    return names.select("class_name").distinct().join(classes, "class_name", "left")


def import_edges(imports: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges of exact imports, without self edges."""
    wanted = imports.where(~F.col("is_wildcard")).select(F.col("file_id").alias("src"), F.col("path").alias("class_name"))
    target = classes.select("class_name", F.col("file_id").alias("dst"))
    return wanted.distinct().join(target, "class_name").where("src <> dst").select("src", "dst").distinct()


def wildcard_uses(imports: DataFrame) -> DataFrame:
    """D8, first half: which file imports everything below which prefix."""
    return imports.where("is_wildcard").select(
        F.col("file_id").alias("src"), F.expr("substring(path, 1, length(path) - 2)").alias("prefix")).distinct()


def wildcard_members(uses: DataFrame, classes: DataFrame, boundary: str = "raw") -> DataFrame:
    """D8, second half: the files that have a class whose name starts with an imported prefix.

    ``raw`` compares text only (``lib1`` also covers ``lib10``); ``dot`` needs a dot after the prefix.
    Each class name is cut at every prefix length in use, so the match is an equality join and not a
    comparison of all pairs.
    """
    tail = "." if boundary == "dot" else ""
    wanted = uses.select(F.concat(F.col("prefix"), F.lit(tail)).alias("_key"), "prefix").distinct()
    lengths = wanted.agg(F.collect_set(F.length("_key")).alias("lengths")).scalar()
    cut = (classes.withColumn("_len", F.explode(F.coalesce(lengths, F.array().cast("array<int>"))))
           .where(F.length("class_name") >= F.col("_len"))
           .select(F.col("file_id").alias("dst"), F.expr("substring(class_name, 1, _len)").alias("_key")).distinct())
    return cut.join(wanted, "_key").select("prefix", "dst").distinct()


def wildcard_fanout(uses: DataFrame, members: DataFrame) -> DataFrame:
    """Per file and prefix, how many other files it depends on - without listing the pairs."""
    sizes = members.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    self_use = members.select("prefix", F.col("dst").alias("src"), F.lit(1).alias("_self"))
    return (uses.join(sizes, "prefix").join(self_use, ["prefix", "src"], "left")
            .select(F.col("src").alias("file_id"), "prefix", (F.col("n") - F.coalesce("_self", F.lit(0))).alias("n_files"))
            .where("n_files > 0"))


def wildcard_dependencies(uses: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """Expanded edges of the given files (file_id), without self edges."""
    asked = uses.join(files.select(F.col("file_id").alias("src")), "src", "left_semi")
    return asked.join(members, "prefix").where("src <> dst").select("src", "dst").distinct()


def dependencies(edges: DataFrame, files: DataFrame) -> DataFrame:
    """What the given files depend on."""
    return edges.join(files.select(F.col("file_id").alias("src")).distinct(), "src", "left_semi").select("src", "dst")


def dependents(edges: DataFrame, files: DataFrame) -> DataFrame:
    """What depends on the given files."""
    asked = files.select(F.col("file_id").alias("dst")).distinct()
    return edges.join(asked, "dst", "left_semi").select(F.col("dst").alias("file_id"), F.col("src").alias("used_by"))


def degrees(edges: DataFrame) -> DataFrame:
    """Number of dependencies and dependents of every file."""
    ends = edges.select(F.col("src").alias("file_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("file_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("file_id").agg(F.sum("o").alias("n_dependencies"), F.sum("i").alias("n_dependents"))


COMPACT_ROUNDS = 16  # the reached set is written anew this often, so that its plan stays short


def impact(edges: DataFrame, seeds: DataFrame, package_hops: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Everything that a change of each seed file reaches, as (seed, file_id, kind).

    ``direct`` are the dependents of the seed, ``transitive`` all further files reached; the seed
    itself never counts and unknown seeds give no rows. Works in rounds: dependents of the last
    round's files, minus what is already known, checkpointed each round, until a round finds
    nothing. ``package_hops`` = (uses, members) walks wildcard imports as well.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    back = edges.select(F.col("dst").alias("file_id"), F.col("src").alias("next"))
    if package_hops:
        uses, members = (half.checkpoint() for half in package_hops)

    def step(frontier: DataFrame) -> DataFrame:
        found = frontier.join(back, "file_id").select("seed", F.col("next").alias("file_id"))
        if package_hops:
            prefixes = frontier.join(members.withColumnRenamed("dst", "file_id"), "file_id").select("seed", "prefix").distinct()
            found = found.unionByName(prefixes.join(uses, "prefix").select("seed", F.col("src").alias("file_id")))
        return found.where("seed <> file_id").distinct()

    back = back.checkpoint()
    frontier = step(seeds.select(F.col("file_id").alias("seed"), "file_id").distinct()).checkpoint()
    reached = frontier.withColumn("kind", F.lit("direct"))
    rounds = 0
    while not frontier.isEmpty():
        frontier = step(frontier).join(reached, ["seed", "file_id"], "left_anti").checkpoint()
        reached = reached.unionByName(frontier.withColumn("kind", F.lit("transitive")))
        rounds += 1
        if rounds % COMPACT_ROUNDS == 0:
            reached = reached.checkpoint()
    return reached
