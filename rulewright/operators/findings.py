"""Findings: selection, sampling, grouping, routing and summaries.

``findings`` is DataFrame(finding_id, rule, message, component, file_id, line, status, severity).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulewright.functions.fixed_values import (
    HANDLER_RULES, MAX_FIXES, NO_FIXER_REASON, OPEN_STATUSES, SAFE_RULES, TEXT_FIXER_RULES)
from rulewright.functions.text import base_name, component_path


def rule_table(spark: SparkSession, rules: list[str]) -> DataFrame:
    """A table of rule ids; its size is that of the list given."""
    return spark.createDataFrame([(r,) for r in rules], "rule string")


def project_of(component: Column) -> Column:
    """The component key without its last part."""
    return F.regexp_extract(component, r"^(.*):[^:]*$", 1)


def filter_open(findings: DataFrame, project: str) -> DataFrame:
    """Open findings of a project, given by its full key or by the part after the last colon."""
    return findings.where(F.col("status").isin(OPEN_STATUSES)
                          & project_of(F.col("component")).isin(project, project.rsplit(":", 1)[-1]))


def source_ladder(findings: DataFrame, project: str, hotspots: DataFrame | None = None) -> list[DataFrame]:
    """S3: the six sources in the order they are tried."""
    short = project.rsplit(":", 1)[-1]
    key, unresolved = project_of(F.col("component")), F.col("status") != "RESOLVED"
    exact = key == project
    return [findings.where(exact & unresolved), findings.where((key == short) & unresolved),
            findings.where(exact & F.col("status").isin(OPEN_STATUSES)), findings.where(exact),
            findings.where(F.startswith(key, F.lit(project))),
            findings.limit(0) if hotspots is None else hotspots.where(exact)]


def first_nonempty(sources: list[DataFrame]) -> DataFrame:
    """S3: rows of the first source that has any, with its number as ``source_no``.

    One lazy plan: the smallest source number present is a scalar subquery.
    """
    tagged = reduce(DataFrame.unionByName,
                    [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources, 1)])
    best = tagged.agg(F.min("source_no").alias("source_no")).scalar()
    return tagged.where(F.col("source_no") == best)


def select_fixable(findings: DataFrame, rules: list[str] = SAFE_RULES) -> DataFrame:
    """Findings whose rule is on the allow-list."""
    return findings.where(F.col("rule").isin(rules))


def rule_profile(findings: DataFrame, rules: list[str] = SAFE_RULES) -> DataFrame:
    """Findings and selected findings per rule."""
    return findings.groupBy("rule").agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.count(F.when(F.col("rule").isin(rules), 1)).alias("n_selected"))


def rule_coverage(findings: DataFrame, allow: list[str] = SAFE_RULES, handlers: list[str] = HANDLER_RULES,
                  fixers: list[str] = TEXT_FIXER_RULES) -> DataFrame:
    """Per rule, how it is covered and how many findings it has; known and found rules both show."""
    spark = findings.sparkSession
    known = None
    for name, rules in (("allow", allow), ("handler", handlers), ("text_fixer", fixers)):
        side = rule_table(spark, rules).withColumn(name, F.lit(True))
        known = side if known is None else known.join(side, "rule", "full")
    counts = findings.groupBy("rule").agg(F.count(F.lit(1)).alias("n_findings"))
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("allow", "handler", "text_fixer")]
    return known.join(counts, "rule", "full").select(
        "rule", *flags, F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def sample_cap(findings: DataFrame, n: int = MAX_FIXES, seed: int = 42) -> DataFrame:
    """At most ``n`` findings, a random choice that the seed repeats (no global sort)."""
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.col("finding_id").cast("string")).cast("binary"))
    return findings.orderBy(mixed, "finding_id").limit(n)


def with_path(findings: DataFrame) -> DataFrame:
    """P5: add ``path``, the part of the component after the last colon."""
    return findings.withColumn("path", component_path(F.col("component")))


GROUP_ROWS = 1_000


def group_by_file(findings: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Findings per file as sorted (line, rule, finding_id) lists.

    A file with more than ``group_rows`` findings is spread over ``n_parts`` rows by a hash of the
    finding id, so no list grows with the data; ``n_findings`` is the whole file's count.
    """
    with_file = with_path(findings)
    sizes = with_file.groupBy("path").agg(F.count(F.lit(1)).alias("n_findings")).withColumn(
        "n_parts", F.ceil(F.col("n_findings") / group_rows))
    spread = F.conv(F.substring(F.md5(F.col("finding_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")
    items = F.sort_array(F.collect_list(F.struct("line", "rule", "finding_id")))
    return (with_file.join(sizes, "path").withColumn("part", F.pmod(spread, F.col("n_parts")))
            .groupBy("path", "part", "n_parts", "n_findings").agg(items.alias("items")))


def split_missing(findings: DataFrame, files: DataFrame, key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """Findings whose file exists, and those whose file is missing."""
    known = files.select(key).distinct()
    return findings.join(known, key, "left_semi"), findings.join(known, key, "left_anti")


def route(findings: DataFrame, handlers: list[str] = HANDLER_RULES) -> DataFrame:
    """The tier a finding is sent to first."""
    path = component_path(F.col("component"))
    return findings.withColumn("tier", F.when(F.endswith(path, F.lit(".java")) & F.col("rule").isin(handlers), "rule")
                               .otherwise("model"))


def tiered_coalesce(results: DataFrame) -> DataFrame:
    """Per finding the first tier that succeeded, or a failure with its reason.

    ``results`` is (finding_id, tier int, success boolean, fixed_text, reason).
    """
    won = F.min(F.when(F.col("success"), F.struct("tier", "fixed_text")))
    lost = F.max(F.when(~F.col("success"), F.struct("tier", "reason")))
    both = results.groupBy("finding_id").agg(won.alias("w"), lost.alias("l"))
    return both.select(
        "finding_id", F.col("w").isNotNull().alias("success"), F.col("w.tier").alias("tier"),
        F.col("w.fixed_text").alias("fixed_text"),
        F.when(F.col("w").isNull(), F.coalesce("l.reason", F.lit(NO_FIXER_REASON))).alias("reason"))


def partition_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fixed and failed results; a missing verdict counts as failed."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return results.where(ok), results.where(~ok)


def fix_summary(fixed: DataFrame) -> DataFrame:
    """P10: one summary line per fixed finding."""
    name = base_name(component_path(F.col("component")))
    return fixed.select("finding_id", component_path(F.col("component")).alias("path"),
                        F.format_string("- Fixed %s: %s in `%s`", "rule", "message", name).alias("summary"))


def digest(df: DataFrame, group: list[str], order: list[str], text: Column, k: int = 5,
           noun: str = "issues") -> DataFrame:
    """Per group the first ``k`` entries and, if there are more, how many.

    The rank filter is pushed below the shuffle, so a large group sends ``k`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    top = (df.select(*group, *order, text.alias("_t")).withColumn("_r", rank).where(F.col("_r") <= k)
           .groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_r", "_t"))).alias("_top")))
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > k, F.concat(F.lit("\n- ... and "), (F.col("n") - k).cast("string"), F.lit(f" more {noun}")))
    lines = F.array_join(F.transform("_top", lambda x: F.concat(F.lit("- "), x["_t"])), "\n")
    return sizes.join(top, group).select(*group, "n", F.concat(lines, F.coalesce(more, F.lit(""))).alias("digest"))


def finding_lines(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings with the text of their line; positions outside the file drop out."""
    at = lines.select("file_id", F.col("line_no").alias("line"), F.col("line").alias("line_text"))
    return findings.join(at, ["file_id", "line"])


def out_of_range(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings that point outside their file (line 0 or past the end) and cannot be fixed."""
    return findings.join(lines.select("file_id", F.col("line_no").alias("line")), ["file_id", "line"], "left_anti")
