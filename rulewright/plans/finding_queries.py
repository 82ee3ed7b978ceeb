"""Queries for sources, selection, grouping and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulewright.functions.fixed_values import HANDLER_RULES, NO_FIXER_REASON, SAFE_RULES, TEXT_FIXER_RULES
from rulewright.operators import findings as P
from rulewright.plans.registry import query, quoted, with_tables
from rulewright.sources import readers
from rulewright.sources.derived import code_lines, findings, table

PROJECT = "org:proj1"


def _in(rules: list[str]) -> str:
    return "(" + ", ".join(map(quoted, rules)) + ")"


def _values(rules: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({quoted(r)})" for r in rules) + ") v(rule)"


PATH = "split_part(component, ':', -1)"
OPEN = "status IN ('OPEN', 'CONFIRMED', 'REOPENED')"


def finding_pages(spark, sf, size=50, overlap=0):
    """Findings as exported page documents; odd pages in the hotspots form."""
    fe = findings(spark, sf)
    total = fe.agg(F.count(F.lit(1)).alias("total")).scalar()
    page = F.floor(F.col("finding_id") / size)
    pages = F.array(page, F.when((F.col("finding_id") % size < overlap) & (page > 0), page - 1))
    rows = fe.select(F.explode(F.array_compact(pages)).alias("page_no"),
                     F.struct(F.col("finding_id").cast("string").alias("key"), "rule", "message", "component",
                              "status", "severity", "line").alias("f"))
    docs = rows.groupBy("page_no").agg(F.collect_list("f").alias("fs")).withColumn("total", total)
    odd = F.col("page_no") % 2 == 1
    doc = F.when(odd, F.to_json(F.struct(F.col("fs").alias("hotspots"), F.struct("total").alias("paging")))).otherwise(
        F.to_json(F.struct(F.col("fs").alias("issues"), F.col("total"))))
    return docs.select("page_no", doc.alias("doc"))


@query("s2_parse_finding_pages", with_tables("fe", body="""
SELECT CAST(floor(finding_id / 50) AS BIGINT) AS page_no, (SELECT count(*) FROM fe) AS total,
  CAST(finding_id AS STRING) AS key, rule, message, component, status, severity, line FROM fe"""))
def _(spark, sf):
    return readers.parse_pages(finding_pages(spark, sf), "doc").drop("start_column", "end_column")


@query("s2_event_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    props = F.from_json("props", "k bigint")
    return table(spark, sf, "events").select("event_id", props["k"].alias("k"))


@query("s3_first_nonempty_source", with_tables("fe", body="""
SELECT 1 AS source_no, * FROM fe WHERE regexp_extract(component, '^(.*):[^:]*$', 1) = 'org:proj1' AND status <> 'RESOLVED'"""))
def _(spark, sf):
    return P.first_nonempty(P.source_ladder(findings(spark, sf), PROJECT))


@query("s3_fallback_source", with_tables("fe", body="SELECT 5 AS source_no, * FROM fe WHERE component LIKE 'org:p%'"))
def _(spark, sf):
    return P.first_nonempty(P.source_ladder(findings(spark, sf), "org:p"))


@query("s4_merge_pages", with_tables("fe", body="""
SELECT CAST(finding_id AS STRING) AS key,
  CAST(CASE WHEN finding_id % 50 < 10 AND finding_id >= 50 THEN floor(finding_id / 50) - 1 ELSE floor(finding_id / 50) END AS BIGINT) AS page_no,
  rule, message, component, status, severity, line FROM fe"""))
def _(spark, sf):
    rows = readers.parse_pages(finding_pages(spark, sf, overlap=10), "doc")
    return readers.merge_pages(rows).drop("start_column", "end_column")


@query("s4_page_completeness", with_tables("fe", body="SELECT count(*) AS collected, count(*) AS total, true AS complete FROM fe"))
def _(spark, sf):
    return readers.page_completeness(readers.parse_pages(finding_pages(spark, sf, overlap=10), "doc"))


@query("s5_filter_open", with_tables("fe", body=f"""
SELECT * FROM fe WHERE {OPEN} AND regexp_extract(component, '^(.*):[^:]*$', 1) IN ('org:proj1', 'proj1')"""))
def _(spark, sf):
    return P.filter_open(findings(spark, sf), PROJECT)


@query("p1_select_fixable", with_tables("fe", body=f"SELECT * FROM fe WHERE rule IN {_in(SAFE_RULES)}"))
def _(spark, sf):
    return P.select_fixable(findings(spark, sf))


@query("p2_rule_profile", with_tables("fe", body=f"""
SELECT rule, count(*) AS n_findings, count(*) FILTER (WHERE rule IN {_in(SAFE_RULES)}) AS n_selected FROM fe GROUP BY rule"""))
def _(spark, sf):
    return P.rule_profile(findings(spark, sf))


COVERAGE_SQL = f"""cov AS (
  SELECT rule, bool_or(k = 'a') AS allow, bool_or(k = 'h') AS handler, bool_or(k = 't') AS text_fixer,
         sum(n) AS n_findings
  FROM (SELECT rule, 'a' AS k, 0 AS n FROM {_values(SAFE_RULES)}
        UNION ALL SELECT rule, 'h', 0 FROM {_values(HANDLER_RULES)}
        UNION ALL SELECT rule, 't', 0 FROM {_values(TEXT_FIXER_RULES)}
        UNION ALL SELECT rule, 'f', 1 FROM fe)
  GROUP BY rule)"""


@query("p3_rule_coverage", with_tables("fe", COVERAGE_SQL, body="""
SELECT rule, allow, handler, text_fixer, CAST(n_findings AS BIGINT) AS n_findings FROM cov"""))
def _(spark, sf):
    return P.rule_coverage(findings(spark, sf))


@query("p4_sample_cap", with_tables("fe", body="""
SELECT * FROM fe ORDER BY md5(concat('42:', CAST(finding_id AS STRING))), finding_id LIMIT 10"""))
def _(spark, sf):
    return P.sample_cap(findings(spark, sf))


@query("p5_component_path", with_tables("fe", body=f"SELECT finding_id, component, {PATH} AS path FROM fe"))
def _(spark, sf):
    return P.with_path(findings(spark, sf)).select("finding_id", "component", "path")


@query("p6_group_by_file", with_tables("fe", f"""s AS (
  SELECT {PATH} AS path, rule, line, finding_id, count(*) OVER (PARTITION BY {PATH}) AS n_findings FROM fe),
t AS (SELECT *, CAST(ceil(n_findings / 20) AS BIGINT) AS n_parts,
        ('0x' || substr(md5(CAST(finding_id AS STRING)), 1, 15))::BIGINT AS h FROM s)""", body="""
SELECT path, h % n_parts AS part, n_parts, n_findings,
  string_agg(concat(line, ':', rule, ':', finding_id), ',' ORDER BY line, rule, finding_id) AS items
FROM t GROUP BY 1, 2, 3, 4"""))
def _(spark, sf):
    grouped = P.group_by_file(findings(spark, sf), group_rows=20)
    shown = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["line"].cast("string"), x["rule"],
                                                                     x["finding_id"].cast("string"))), ",")
    return grouped.withColumn("items", shown)


@query("p7_present_files", with_tables("fe cl", body="SELECT * FROM fe WHERE file_id IN (SELECT file_id FROM cl)"))
def _(spark, sf):
    return P.split_missing(findings(spark, sf), code_lines(spark, sf))[0]


@query("p7_missing_files", with_tables("fe cl", body="SELECT * FROM fe WHERE file_id NOT IN (SELECT file_id FROM cl)"))
def _(spark, sf):
    return P.split_missing(findings(spark, sf), code_lines(spark, sf))[1]


@query("p8_route", with_tables("fe", body=f"""
SELECT finding_id, rule, CASE WHEN component LIKE '%.java' AND rule IN {_in(HANDLER_RULES)} THEN 'rule' ELSE 'model' END AS tier FROM fe"""))
def _(spark, sf):
    return P.route(findings(spark, sf)).select("finding_id", "rule", "tier")


def tier_results(fe):
    """Results of three tiers for every finding, derived from its columns."""
    tiers = F.array(
        F.struct(F.lit(1).alias("tier"), (F.col("status") == "OPEN").alias("success"),
                 F.concat(F.lit("rule fix "), "message").alias("fixed_text"), F.lit("rule tier failed").alias("reason")),
        F.struct(F.lit(2).alias("tier"), (F.col("severity") == "MAJOR").alias("success"),
                 F.concat(F.lit("second fix "), "message").alias("fixed_text"), F.lit("second tier failed").alias("reason")),
        F.struct(F.lit(3).alias("tier"), (F.col("line") > 6).alias("success"),
                 F.concat(F.lit("model fix "), "message").alias("fixed_text"), F.lit(None).cast("string").alias("reason")))
    return fe.select("finding_id", F.explode(tiers).alias("r")).select("finding_id", "r.*")


TIERED_SQL = f"""tc AS (
  SELECT finding_id, rule, message, component,
    CASE WHEN status = 'OPEN' THEN 1 WHEN severity = 'MAJOR' THEN 2 WHEN line > 6 THEN 3 END AS tier,
    CASE WHEN status = 'OPEN' THEN concat('rule fix ', message) WHEN severity = 'MAJOR' THEN concat('second fix ', message)
         WHEN line > 6 THEN concat('model fix ', message) END AS fixed_text FROM fe),
tr AS (SELECT finding_id, tier IS NOT NULL AS success, tier, fixed_text,
         CASE WHEN tier IS NULL THEN {quoted(NO_FIXER_REASON)} END AS reason, rule, message, component FROM tc)"""


@query("p8_tiered_coalesce", with_tables("fe", TIERED_SQL, body="SELECT finding_id, success, tier, fixed_text, reason FROM tr"))
def _(spark, sf):
    return P.tiered_coalesce(tier_results(findings(spark, sf)))


@query("p9_partition_results", with_tables("fe", TIERED_SQL, body="""
SELECT 'fixed' AS part, tier, CAST(NULL AS VARCHAR) AS reason, count(*) AS n FROM tr WHERE success GROUP BY tier
UNION ALL SELECT 'failed', NULL, reason, count(*) FROM tr WHERE NOT success GROUP BY reason"""))
def _(spark, sf):
    ok, bad = P.partition_results(P.tiered_coalesce(tier_results(findings(spark, sf))))
    count = F.count(F.lit(1)).alias("n")
    none_i, none_s = F.lit(None).cast("int"), F.lit(None).cast("string")
    return (ok.groupBy("tier").agg(count).select(F.lit("fixed").alias("part"), "tier", none_s.alias("reason"), "n")
            .unionByName(bad.groupBy("reason").agg(count)
                         .select(F.lit("failed").alias("part"), none_i.alias("tier"), "reason", "n")))


def _fixed(spark, sf):
    fe = findings(spark, sf)
    ok, _ = P.partition_results(P.tiered_coalesce(tier_results(fe)))
    return fe.join(ok.select("finding_id"), "finding_id", "left_semi")


@query("p10_fix_summary", with_tables("fe", TIERED_SQL, body=f"""
SELECT finding_id, {PATH} AS path,
  concat('- Fixed ', rule, ': ', message, ' in `', split_part({PATH}, '/', -1), '`') AS summary FROM tr WHERE success"""))
def _(spark, sf):
    return P.fix_summary(_fixed(spark, sf))


@query("p10_changed_files", with_tables("fe", TIERED_SQL, body=f"""
SELECT {PATH} AS path, count(*) AS n_fixed FROM tr WHERE success GROUP BY 1"""))
def _(spark, sf):
    return P.fix_summary(_fixed(spark, sf)).groupBy("path").agg(F.count(F.lit(1)).alias("n_fixed"))


@query("p11_digest", with_tables("fe", """r AS (
  SELECT rule, concat('- ', rule, ': ', message) AS t, finding_id,
    row_number() OVER (PARTITION BY rule ORDER BY finding_id) AS rn, count(*) OVER (PARTITION BY rule) AS n FROM fe)""", body="""
SELECT rule, n, concat(string_agg(t, chr(10) ORDER BY rn),
  CASE WHEN n > 5 THEN concat(chr(10), '- ... and ', n - 5, ' more issues') ELSE '' END) AS digest
FROM r WHERE rn <= 5 GROUP BY rule, n"""))
def _(spark, sf):
    return P.digest(findings(spark, sf), ["rule"], ["finding_id"], F.concat_ws(": ", "rule", "message"), 5)


@query("p11_project_digest", with_tables("fe", """p AS (SELECT *, regexp_extract(component, '^(.*):[^:]*$', 1) AS project FROM fe),
r AS (SELECT project, concat('- ', project) AS t, rule,
    row_number() OVER (PARTITION BY project ORDER BY n DESC, rule) AS rn, count(*) OVER (PARTITION BY project) AS n, n AS c
  FROM (SELECT project, rule, count(*) AS n FROM p GROUP BY 1, 2))""", body="""
SELECT project, n, concat(string_agg(concat('- ', rule, ' (', c, ')'), chr(10) ORDER BY rn),
  CASE WHEN n > 3 THEN concat(chr(10), '- ... and ', n - 3, ' more rules') ELSE '' END) AS digest
FROM r WHERE rn <= 3 GROUP BY project, n"""))
def _(spark, sf):
    counts = (findings(spark, sf).groupBy(P.project_of(F.col("component")).alias("project"), "rule")
              .agg((-F.count(F.lit(1))).alias("minus_n")))
    text = F.format_string("%s (%d)", "rule", -F.col("minus_n"))
    return P.digest(counts, ["project"], ["minus_n", "rule"], text, 3, "rules")


@query("p12_finding_lines", with_tables("fe cl", body="""
SELECT fe.*, cl.line AS line_text FROM fe JOIN cl ON cl.file_id = fe.file_id AND cl.line_no = fe.line"""))
def _(spark, sf):
    return P.finding_lines(findings(spark, sf), code_lines(spark, sf))


@query("p12_out_of_range", with_tables("fe cl", body="""
SELECT fe.* FROM fe WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.file_id = fe.file_id AND cl.line_no = fe.line)"""))
def _(spark, sf):
    return P.out_of_range(findings(spark, sf), code_lines(spark, sf))
