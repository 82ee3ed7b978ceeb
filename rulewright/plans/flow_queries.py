"""Queries for the end-to-end flows."""

from __future__ import annotations


from rulewright.plans import flows
from rulewright.plans.finding_queries import OPEN, PROJECT, _in
from rulewright.plans.registry import query, with_tables
from rulewright.sources.derived import findings, unit_lines, written_lines

def balance_sql(source, name):
    return f"""{name}c AS (SELECT file_id, generate_subscripts(cs, 1) AS i, unnest(cs) AS c FROM (SELECT file_id, regexp_extract_all(text, '[(){{}}\\[\\]]') AS cs FROM {source})),
{name}r AS (SELECT file_id, i, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS p, sum(CASE c WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END) OVER w AS s,
    sum(CASE c WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS b FROM {name}c WINDOW w AS (PARTITION BY file_id ORDER BY i)),
{name} AS MATERIALIZED (SELECT file_id, min(least(p, s, b)) >= 0 AND arg_max(p, i) = 0 AND arg_max(s, i) = 0 AND arg_max(b, i) = 0 AS ok FROM {name}r GROUP BY 1)"""


BALANCE_SQL = balance_sql("nt", "bl")
ALLOWED = ["java:S1118", "java:S1125", "java:S1155", "java:S1481", "java:S100", "java:S3776"]  # all rules that occur

# What each rule does to the units, line by line; see FIXTURES.md for the lines.
EDIT_SQL = f"""tg AS MATERIALIZED (SELECT *, CASE WHEN component LIKE '%.java' THEN 'rule' ELSE 'model' END AS tier FROM fe WHERE {OPEN}
  AND regexp_extract(component, '^(.*):[^:]*$', 1) IN ('org:proj1', 'proj1') AND rule IN {_in(ALLOWED)} AND file_id IN (SELECT file_id FROM cu)),
rt AS (SELECT finding_id, rule, file_id, line, 'my_func' || (1 + file_id % 7) AS fn, split_part(message, chr(39), 2) AS old FROM tg WHERE tier = 'rule'),
ed AS MATERIALIZED (
  SELECT finding_id, file_id, 2 AS line_no, i AS sub, 'insert' AS op, ['    private U' || file_id || '() {{', '        // Private constructor to prevent instantiation',
      '        throw new UnsupportedOperationException("Utility class");', '    }}', ''][i] AS text FROM rt, range(1, 6) t(i) WHERE rule = 'java:S1118'
  UNION ALL SELECT finding_id, file_id, 5, 0, 'replace', '        if (ready) {{ list.clear(); }}' FROM rt WHERE rule = 'java:S1125' AND line = 5
  UNION ALL SELECT finding_id, file_id, 6, 0, 'replace', '        boolean none = list.isEmpty();' FROM rt WHERE rule = 'java:S1155' AND line = 6
  UNION ALL SELECT finding_id, file_id, 7, 0, 'delete', NULL FROM rt WHERE rule = 'java:S1481' AND line = 7
  UNION ALL SELECT finding_id, file_id, 4, 0, 'replace', concat('    int ', CASE WHEN line IN (4, 5, 6, 8) THEN 'm' ELSE 'M' END, 'yFunc', 1 + file_id % 7, '(java.util.List list) {{')
    FROM rt WHERE rule = 'java:S100' AND old = fn AND line BETWEEN 1 AND 11
  UNION ALL SELECT finding_id, file_id, least(line, 3), -1, 'insert', '// TODO: Refactor this method to reduce complexity' FROM rt WHERE rule = 'java:S3776' AND line >= 2),
ow AS (SELECT file_id, line_no, arg_min(coalesce(text, ''), finding_id) AS won FROM ed WHERE op <> 'insert' GROUP BY 1, 2),
ef AS MATERIALIZED (SELECT finding_id, bool_and(op = 'insert' OR won = coalesce(text, '')) AS ok FROM ed LEFT JOIN ow USING (file_id, line_no) GROUP BY 1),
ok AS MATERIALIZED (SELECT DISTINCT file_id, line_no, sub, op, text FROM ed JOIN ef USING (finding_id) WHERE ok),
mg AS MATERIALIZED (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY line_no, sub) AS line_no, line FROM (
  SELECT file_id, line_no, 0 AS sub, CASE WHEN op = 'replace' THEN text ELSE line END AS line FROM (SELECT * FROM cu WHERE file_id IN (SELECT file_id FROM ok))
    LEFT JOIN (SELECT file_id, line_no, op, text FROM ok WHERE op <> 'insert') USING (file_id, line_no) WHERE op IS DISTINCT FROM 'delete'
  UNION ALL SELECT file_id, line_no, sub, text FROM ok WHERE op = 'insert')),
nt AS (SELECT file_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM mg GROUP BY 1),
{BALANCE_SQL},
rs AS MATERIALIZED (SELECT tg.*, ef.ok AS won, coalesce(bl.ok, true) AS fine, coalesce(ef.ok AND coalesce(bl.ok, true), false) AS success
  FROM tg LEFT JOIN ef USING (finding_id) LEFT JOIN bl ON bl.file_id = tg.file_id)"""
_REASON = """CASE WHEN success THEN NULL WHEN won THEN 'unbalanced' WHEN NOT won THEN 'conflict' WHEN tier = 'rule' THEN 'no rewrite' ELSE 'no handler' END AS reason"""


@query("e1_fix_findings", with_tables("cu fe", EDIT_SQL, body=f"SELECT finding_id, rule, message, component, file_id, line, tier, success, {_REASON} FROM rs"))
def _(spark, sf):
    return flows.fix_findings(findings(spark, sf), unit_lines(spark, sf), PROJECT, allow=ALLOWED)[1]


@query("e1_accepted_files", with_tables("cu fe", EDIT_SQL, body="SELECT file_id, CAST(line_no AS INT) AS line_no, line FROM mg JOIN bl USING (file_id) WHERE ok"))
def _(spark, sf):
    return flows.fix_findings(findings(spark, sf), unit_lines(spark, sf), PROJECT, allow=ALLOWED)[0]


def annotator(prompts):
    """Stand-in for a model: returns the file of the prompt with a comment below it."""
    if any("Message 3" in p for p in prompts):
        raise ValueError("refused")
    return [f"Done:\n```java\n{p.split('```java' + chr(10), 1)[1].rsplit(chr(10) + '```', 1)[0]}\n// reviewed\n```" for p in prompts]


@query("e1_two_tiers", with_tables("cu fe", EDIT_SQL, "co AS (SELECT file_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM cu GROUP BY 1)", balance_sql("co", "bo"), """
ak AS MATERIALIZED (SELECT finding_id, file_id, contains(message, 'Message 3') AS err FROM rs WHERE won IS NULL),
f1 AS (SELECT file_id, min(finding_id) AS f FROM ak WHERE NOT err GROUP BY 1)""", body=f"""
SELECT finding_id, rule, message, component, file_id, line, tier, success, {_REASON} FROM rs WHERE won IS NOT NULL
UNION ALL SELECT r.finding_id, r.rule, r.message, r.component, r.file_id, r.line, 'model', coalesce(r.finding_id = f AND bo.ok, false),
  CASE WHEN err THEN 'refused' WHEN r.finding_id <> f THEN 'superseded' WHEN NOT bo.ok THEN 'unbalanced' END
FROM rs r JOIN ak USING (finding_id) LEFT JOIN f1 ON f1.file_id = r.file_id JOIN bo ON bo.file_id = r.file_id"""))
def _(spark, sf):
    return flows.fix_findings(findings(spark, sf), unit_lines(spark, sf), PROJECT, fn=annotator, allow=ALLOWED)[1]


def reviewer(prompts):
    """Stand-in for a model: returns the code of the prompt with a comment below it."""
    out = []
    for p in prompts:
        code = p.split("ORIGINAL CODE:\n```java\n", 1)[1].rsplit("\n```\n\nREFACTORED CODE:", 1)[0]
        if "Message 3" in p:
            raise ValueError("refused")
        out.append(f"Done:\n```java\n{code}\n// reviewed\n```")
    return out


@query("e3_fix_complex", with_tables("cl fe", """
nt AS (SELECT file_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM cl GROUP BY 1),
""" + BALANCE_SQL, body="""
SELECT finding_id, NOT contains(message, 'Message 3') AND coalesce(ok, true) AS accepted,
  CASE WHEN contains(message, 'Message 3') THEN 'empty' WHEN NOT coalesce(ok, true) THEN 'unbalanced' END AS reason,
  CASE WHEN contains(message, 'Message 3') THEN 'fragment' ELSE 'unit' END AS form,
  CASE WHEN contains(message, 'Message 3') THEN 'refused' END AS error
FROM fe JOIN nt USING (file_id) LEFT JOIN bl USING (file_id) WHERE rule = 'java:S3776'"""))
def _(spark, sf):
    return flows.fix_complex(findings(spark, sf), written_lines(spark, sf), reviewer)
