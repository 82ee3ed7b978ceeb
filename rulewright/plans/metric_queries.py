"""Queries for complexity metrics, unused symbols and fixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulewright.operators import code as C
from rulewright.operators import declarations as D
from rulewright.operators import findings as P
from rulewright.operators import fixes as A
from rulewright.operators import graph as G
from rulewright.operators import line_rules as R
from rulewright.operators import lines as L
from rulewright.operators import metrics as M
from rulewright.plans import flows
from rulewright.plans.declaration_queries import (
    CLASS_SQL, EXACT_SQL, FIELD_SQL, IMPORT_SQL, METHOD_SQL, TYPE_SQL, corpus, head, m, parts_of, variables_sql)
from rulewright.plans.finding_queries import PATH
from rulewright.plans.line_queries import STMT_SQL
from rulewright.plans.line_rule_queries import DETECT_SQL, REWRITE_SQL
from rulewright.plans.registry import query, quoted as q, with_tables
from rulewright.sources.derived import code_lines, findings, table, written_lines


def n(pattern, c="line"):
    return f"CAST(len(regexp_extract_all({c}, {q(pattern)})) AS BIGINT)"


ML_SQL = METHOD_SQL + """,
ml AS MATERIALIZED (
  SELECT s.*, h.start_line AS method_line, h.end_line AS method_end, h.stmt_no = s.stmt_no AS header
  FROM sm s ASOF JOIN mr h ON h.file_id = s.file_id AND h.stmt_no <= s.stmt_no WHERE h.end_no IS NULL OR s.stmt_no <= h.end_no)"""

_TEXT = f"regexp_replace(text, {q(M.WILDCARD)}, '\\1', 'g')"
CYCLO_SQL = f"cy AS (SELECT file_id, method_line, CAST(1 + sum({n(M.BRANCH, _TEXT)}) AS BIGINT) AS cyclomatic FROM ml GROUP BY 1, 2)"
_COGNITIVE = f"CAST(sum({n(M.CONTROL, _TEXT)} * (1 + nesting)) - sum({n(M.CONTROL, _TEXT)}) * max(nesting) FILTER (header) AS BIGINT)"
_INNER = "(depth + CASE WHEN term = '{' THEN 1 ELSE 0 END)"
_NESTING = f"CAST(greatest(max({_INNER}) - max({_INNER}) FILTER (header), 0) AS BIGINT)"


def methods_of(spark, sf):
    lines = written_lines(spark, sf)
    parsed = C.parse(lines)
    return lines, parsed.done(), M.method_statements(parsed)


def declared_in(spark, sf, decisions=False):
    lines = written_lines(spark, sf)
    few = M.declarations(C.parse(lines), decisions)
    return lines, few, few.where("method_line IS NOT NULL")


@query("m1_cyclomatic", with_tables("cl", STMT_SQL, ML_SQL, CYCLO_SQL, body="SELECT * FROM cy"))
def _(spark, sf):
    return M.cyclomatic(methods_of(spark, sf)[2])


_CLEAN = f"regexp_replace(text, {q(M.NOT_BINARY)}, '', 'g')"


@query("m1_cyclomatic_strict", with_tables("cl", STMT_SQL, ML_SQL, body=f"""
SELECT file_id, method_line, CAST(1 + sum({n(M.BRANCH, _TEXT)} + {n(M.OPERATOR, _CLEAN)}) AS BIGINT) AS cyclomatic FROM ml GROUP BY 1, 2"""))
def _(spark, sf):
    return M.cyclomatic(methods_of(spark, sf)[2], strict=True)


@query("m2_cognitive", with_tables("cl", STMT_SQL, ML_SQL, body=f"SELECT file_id, method_line, {_COGNITIVE} AS cognitive FROM ml GROUP BY 1, 2"))
def _(spark, sf):
    return M.cognitive(methods_of(spark, sf)[2])


@query("m3_line_counts", with_tables("cl", STMT_SQL, METHOD_SQL, body=f"""
SELECT file_id, 'file' AS kind, 1 AS line_no, CAST(max(line_no) - min(line_no) + 1 AS BIGINT) AS line_count FROM cl GROUP BY 1
UNION ALL SELECT file_id, 'type', start_line, CAST(end_line - start_line + 1 AS BIGINT) FROM sm WHERE term = '{{' AND {m(D.TYPE, head())}
UNION ALL SELECT mr.file_id, 'method', mr.start_line, CAST(s.end_line - mr.start_line + 1 AS BIGINT) FROM mr JOIN sm s USING (file_id, stmt_no)"""))
def _(spark, sf):
    return M.line_counts(*corpus(spark, sf))


@query("m3_document_lines", "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count, quality, toxic "
                            "FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    counts = M.document_line_counts(table(spark, sf, "documents"), "doc_id", "text")
    return counts.join(table(spark, sf, "labels"), "doc_id", "left")


FILE_SQL = """fm AS (
  SELECT f.file_id, CAST(coalesce(sum(cyclomatic), 0) AS BIGINT) AS total_cyclomatic_complexity,
    CAST(coalesce(max(cyclomatic), 0) AS BIGINT) AS max_method_cyclomatic_complexity, count(cyclomatic) AS method_count
  FROM (SELECT DISTINCT file_id FROM cl) f LEFT JOIN cy USING (file_id) GROUP BY 1)"""


@query("m4_file_metrics", with_tables("cl", STMT_SQL, ML_SQL, CYCLO_SQL, FILE_SQL, body="SELECT * FROM fm"))
def _(spark, sf):
    lines, _, ml = methods_of(spark, sf)
    return M.file_metrics(lines, M.cyclomatic(ml))


@query("m5_complexity_record", with_tables("cl", STMT_SQL, TYPE_SQL, ML_SQL, CYCLO_SQL, FILE_SQL, IMPORT_SQL, CLASS_SQL, EXACT_SQL, body="""
SELECT me.file_id, 'method' AS part, concat(CASE WHEN class_name <> '' THEN class_name || '.' ELSE '' END, name,
    CASE WHEN len(parameter_types) > 0 THEN '#' || array_to_string(parameter_types, '#') ELSE '' END) AS name, start_line, end_line, cyclomatic AS value, CAST(NULL AS BIGINT) AS depends_on
FROM me JOIN cy ON cy.file_id = me.file_id AND cy.method_line = me.start_line
UNION ALL SELECT file_id, 'class', name, start_line, end_line, CAST(end_line - start_line + 1 AS BIGINT), NULL FROM ty
UNION ALL SELECT src, 'dependency', NULL, NULL, NULL, NULL, dst FROM ed
UNION ALL SELECT file_id, 'file', 'total_cyclomatic_complexity', NULL, NULL, total_cyclomatic_complexity, NULL FROM fm
UNION ALL SELECT file_id, 'file', 'max_method_cyclomatic_complexity', NULL, NULL, max_method_cyclomatic_complexity, NULL FROM fm
UNION ALL SELECT file_id, 'file', 'method_count', NULL, NULL, method_count, NULL FROM fm"""))
def _(spark, sf):
    lines = written_lines(spark, sf)
    return M.analyze_complexity(lines, C.parse(lines), G.import_edges(*parts_of(lines)))


NAMES_SQL = "regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')"


@query("m6_unused_fields", with_tables("cl", STMT_SQL, FIELD_SQL, f"""
nm AS MATERIALIZED (SELECT file_id, name, count(DISTINCT stmt_no) AS n FROM (SELECT file_id, stmt_no, unnest({NAMES_SQL}) AS name FROM sm) GROUP BY 1, 2)""", body="""
SELECT file_id, class_name, name, type_name, declaration_line FROM fl JOIN nm USING (file_id, name) WHERE NOT has_initializer AND NOT starts_with(name, '_') AND n = 1"""))
def _(spark, sf):
    return M.unused_fields(corpus(spark, sf)[1])


LOCAL_SQL = "lv AS (SELECT * FROM ml WHERE NOT header),\n" + variables_sql("lo", "lv", ["method_line"])
BODY_SQL = f"bn AS MATERIALIZED (SELECT file_id, method_line, name, count(DISTINCT stmt_no) AS n FROM (SELECT file_id, method_line, stmt_no, unnest({NAMES_SQL}) AS name FROM ml WHERE NOT header) GROUP BY 1, 2, 3)"


@query("m7_unused_variables", with_tables("cl", STMT_SQL, ML_SQL, LOCAL_SQL, BODY_SQL, body="""
SELECT file_id, method_line, name, type_name, declaration_line FROM lo JOIN bn USING (file_id, method_line, name) WHERE NOT starts_with(name, '_') AND n = 1"""))
def _(spark, sf):
    return M.unused_variables(methods_of(spark, sf)[2])


@query("m8_unused_parameters", with_tables("cl", STMT_SQL, ML_SQL, BODY_SQL, """
pa AS (SELECT file_id, start_line AS method_line, name AS method, unnest(parameter_names) AS parameter FROM mr WHERE term = '{')""", body="""
SELECT * FROM pa WHERE parameter <> '_' AND NOT EXISTS (
  SELECT 1 FROM bn WHERE bn.file_id = pa.file_id AND bn.method_line = pa.method_line AND bn.name = parameter)"""))
def _(spark, sf):
    _, stmts, ms = methods_of(spark, sf)
    return M.unused_parameters(stmts, ms)


@query("m9_symbol_summary", with_tables("cl", STMT_SQL, ML_SQL, FIELD_SQL, LOCAL_SQL, """
mk AS (SELECT *, concat(name, CASE WHEN len(parameter_types) > 0 THEN '#' || array_to_string(parameter_types, '#') ELSE '' END) AS k FROM me),
mo AS (SELECT *, concat(CASE WHEN class_name <> '' THEN class_name || '.' ELSE '' END, k) AS owner FROM mk)""", body="""
SELECT file_id, class_name AS owner, 'field' AS kind, name, type_name FROM fl
UNION ALL SELECT file_id, class_name, 'method', k, return_type FROM mo
UNION ALL SELECT file_id, owner, 'parameter', unnest(parameter_names), unnest(parameter_types) FROM mo
UNION ALL SELECT DISTINCT lo.file_id, mo.owner, 'variable', lo.name, lo.type_name FROM lo JOIN mo ON mo.file_id = lo.file_id AND mo.start_line = lo.method_line"""))
def _(spark, sf):
    _, st, ml = declared_in(spark, sf)
    return M.symbol_summary(st, ml)


@query("m10_usage_index", with_tables("cl", f"""
tk AS (SELECT file_id, line_no, unnest(list_distinct(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*'))) AS name,
         regexp_extract_all(line, {q(M.ASSIGNED)}, 1) AS a FROM cl)""", body="""
SELECT file_id, name, CAST(floor((line_no - 1) / 10) AS BIGINT) AS block, string_agg(line_no, ',' ORDER BY line_no) AS usage_lines,
  count(*) AS n_lines, bool_or(list_contains(a, name)) AS is_modified FROM tk GROUP BY 1, 2, 3"""))
def _(spark, sf):
    index = M.usage_index(code_lines(spark, sf), block_size=10)
    return index.withColumn("usage_lines", F.array_join("usage_lines", ","))


@query("m11_max_nesting", with_tables("cl", STMT_SQL, ML_SQL, body=f"SELECT file_id, method_line, {_NESTING} AS max_nesting FROM ml GROUP BY 1, 2"))
def _(spark, sf):
    return M.max_nesting(methods_of(spark, sf)[2])


@query("m_method_metrics", with_tables("cl", STMT_SQL, ML_SQL, body=f"""
SELECT file_id, method_line, CAST(1 + sum({n(M.BRANCH, _TEXT)}) AS BIGINT) AS cyclomatic, {_COGNITIVE} AS cognitive,
  CAST(max(greatest(line_no, coalesce(method_end, line_no))) - method_line + 1 AS BIGINT) AS line_count, {_NESTING} AS max_nesting FROM ml GROUP BY 1, 2"""))
def _(spark, sf):
    return M.method_metrics(methods_of(spark, sf)[2])


@query("d11_find_variables", with_tables("cl", STMT_SQL, ML_SQL, LOCAL_SQL, """
al AS (SELECT file_id, method_line, name, type_name, 0 AS rank, declaration_line FROM lo
  UNION ALL SELECT file_id, start_line, unnest(parameter_names), unnest(parameter_types), 1, start_line FROM me),
rk AS (SELECT *, row_number() OVER (PARTITION BY file_id, method_line, name ORDER BY rank, declaration_line, type_name) AS i FROM al)""", body="""
SELECT file_id, method_line, name, type_name, rank = 1 AS is_parameter, declaration_line FROM rk WHERE i = 1"""))
def _(spark, sf):
    _, st, ml = declared_in(spark, sf)
    return D.find_variables(M.method_variables(ml), D.extract_methods(st))


# Fixes ------------------------------------------------------------------------------------------
_NAME = """concat(CASE WHEN class_name <> '' THEN class_name || '.' ELSE '' END, name)"""
PROMPT_SQL = f"""tx AS (SELECT file_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM cl GROUP BY 1),
md AS (SELECT me.file_id, string_agg(concat('- ', {_NAME}, ':', chr(10), '  cyclomatic: ', cyclomatic), chr(10) ORDER BY start_line) AS d
  FROM me JOIN cy ON cy.file_id = me.file_id AND cy.method_line = me.start_line GROUP BY 1),
dp AS (SELECT src AS file_id, string_agg(concat('- file: ', dst), chr(10) ORDER BY dst) AS d FROM ed GROUP BY 1),
ms AS (SELECT file_id, concat('- total_cyclomatic_complexity: ', total_cyclomatic_complexity, chr(10), '- max_method_cyclomatic_complexity: ',
    max_method_cyclomatic_complexity, chr(10), '- method_count: ', method_count) AS d FROM fm)"""


def _section(title, text):
    return f"{q(title)}, chr(10), {text}"


@query("a1_render_prompts", with_tables("cl fe", STMT_SQL, TYPE_SQL, ML_SQL, CYCLO_SQL, FILE_SQL, IMPORT_SQL, CLASS_SQL, EXACT_SQL, PROMPT_SQL, body=f"""
SELECT finding_id, concat('Fix the finding below and keep the behaviour of the code.', chr(10, ), chr(10),
  'ISSUE DETAILS:', chr(10), '- Rule: ', rule, chr(10), '- Message: ', message, chr(10), '- File: ', {PATH}, chr(10), chr(10),
  'CODE METRICS:', chr(10), coalesce(ms.d, ''), chr(10), chr(10), 'METHOD DETAILS:', chr(10), coalesce(md.d, ''), chr(10), chr(10),
  'DEPENDENCIES:', chr(10), coalesce(dp.d, ''), chr(10), chr(10),
  'ORIGINAL CODE:', chr(10), '```java', chr(10), coalesce(tx.text, ''), chr(10), '```', chr(10), chr(10), 'REFACTORED CODE:', chr(10), '```java') AS prompt
FROM fe LEFT JOIN ms USING (file_id) LEFT JOIN md USING (file_id) LEFT JOIN dp USING (file_id) LEFT JOIN tx USING (file_id)""".replace("chr(10, )", "chr(10)")))
def _(spark, sf):
    return flows.prompts(findings(spark, sf), written_lines(spark, sf))[0]


@query("a1_short_prompts", with_tables("cl fe", body=f"""
SELECT finding_id, concat('Fix finding ', rule, ': ', message, chr(10), 'File: ', {PATH}, chr(10), 'Line ', fe.line, ':', chr(10), cl.line, chr(10), 'Answer with the fixed line only.') AS line_prompt,
  concat('Fix this finding:', chr(10), 'Rule: ', rule, chr(10), 'Message: ', message, chr(10), 'File: ', {PATH}, chr(10), 'Line: ', fe.line, chr(10), 'Answer with the fixed code only.') AS header_prompt
FROM fe JOIN cl ON cl.file_id = fe.file_id AND cl.line_no = fe.line"""))
def _(spark, sf):
    at = P.finding_lines(P.with_path(findings(spark, sf)), code_lines(spark, sf))
    issue = [F.col(c) for c in ("rule", "message", "path", "line")]
    return at.select("finding_id", A.line_prompt(*issue, F.col("line_text")).alias("line_prompt"),
                     A.header_prompt(*issue).alias("header_prompt"))


@query("a2_first_code_block_conversations", """
SELECT conv_id, turn, '' AS code FROM conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", A.first_code_block(F.col("text")).alias("code"))


RESPONSE_SQL = """tx AS (SELECT file_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM cl GROUP BY 1),
rs AS (SELECT file_id, text, CASE file_id % 4 WHEN 0 THEN concat('Answer:', chr(10), '  ```java  ', chr(10), text, chr(10), ' ```', chr(10), 'More', chr(10), '```java', chr(10), 'second', chr(10), '```')
    WHEN 1 THEN concat('```', chr(10), 'no', chr(10), '```java', chr(10), 'dropped', chr(10), '```java', chr(10), text, chr(10), '```')
    WHEN 2 THEN concat('```java', chr(10), text) ELSE concat('```java', chr(10), '```', chr(10), text) END AS response FROM tx)"""


def responses(lines):
    """Model answers made from every file: fenced, restarted, unclosed and empty blocks."""
    text, kind = F.col("text"), F.col("file_id") % 4
    fenced = F.concat(F.lit("Answer:\n  ```java  \n"), text, F.lit("\n ```\nMore\n```java\nsecond\n```"))
    again = F.concat(F.lit("```\nno\n```java\ndropped\n```java\n"), text, F.lit("\n```"))
    unclosed = F.concat(F.lit("```java\n"), text)
    empty = F.concat(F.lit("```java\n```\n"), text)
    return L.assemble(lines).withColumn("response", F.when(kind == 0, fenced).when(kind == 1, again)
                                        .when(kind == 2, unclosed).otherwise(empty))


@query("a2_first_code_block", with_tables("cl", RESPONSE_SQL, body="SELECT file_id, CASE WHEN file_id % 4 < 2 THEN text ELSE '' END AS code FROM rs"))
def _(spark, sf):
    return responses(code_lines(spark, sf)).select("file_id", A.first_code_block(F.col("response")).alias("code"))


def shout(prompts):
    """Stand-in for a model: refuses prompts about message 3 and answers the others in capitals."""
    if any("Message 3" in p for p in prompts):
        raise ValueError("refused")
    return [p.upper() for p in prompts]


@query("a3_batch_infer", with_tables("fe", body="""
SELECT finding_id, CASE WHEN NOT contains(message, 'Message 3') THEN upper(concat(rule, ': ', message)) END AS response,
  CASE WHEN contains(message, 'Message 3') THEN 'refused' END AS error FROM fe"""))
def _(spark, sf):
    prompts = findings(spark, sf).select("finding_id", F.concat_ws(": ", "rule", "message").alias("prompt"))
    return A.batch_infer(prompts, shout)


FIX_SQL = f"""tx AS (SELECT file_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM cl GROUP BY 1),
nw AS MATERIALIZED (SELECT file_id, string_agg(CASE WHEN {DETECT_SQL['R20']} THEN {REWRITE_SQL['R20']} ELSE line END, chr(10) ORDER BY line_no) AS text FROM cl GROUP BY 1),
vd AS (SELECT file_id, bool_and(status <> 'RESOLVED') AS passed FROM fe GROUP BY 1),
ch AS (SELECT file_id, generate_subscripts(cs, 1) AS i, unnest(cs) AS c FROM (SELECT file_id, regexp_extract_all(text, '[(){{}}\\[\\]]') AS cs FROM nw)),
rd AS (SELECT file_id, i, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS p, sum(CASE c WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END) OVER w AS s,
    sum(CASE c WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS b FROM ch WINDOW w AS (PARTITION BY file_id ORDER BY i)),
bl AS (SELECT file_id, min(least(p, s, b)) >= 0 AND arg_max(p, i) = 0 AND arg_max(s, i) = 0 AND arg_max(b, i) = 0 AS ok FROM rd GROUP BY 1),
ac AS (SELECT nw.file_id, CASE WHEN nw.text = tx.text THEN 'unchanged' WHEN NOT coalesce(ok, true) THEN 'unbalanced' WHEN NOT coalesce(passed, true) THEN 'tests failed' END AS reason
  FROM nw JOIN tx USING (file_id) LEFT JOIN vd USING (file_id) LEFT JOIN bl USING (file_id))"""


@query("a4_accept_fixes", with_tables("cl fe", FIX_SQL, body="SELECT file_id, reason IS NULL AS accepted, reason, 'unit' AS form FROM ac"))
def _(spark, sf):
    lines = code_lines(spark, sf)
    verdicts = findings(spark, sf).groupBy("file_id").agg(F.min(F.col("status") != "RESOLVED").alias("passed"))
    return A.accept_lines(lines, R.rewrite(lines, "R20"), verdicts)
