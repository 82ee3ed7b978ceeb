"""Queries for the rules that need more than one line."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulewright.operators import declarations as D
from rulewright.operators import file_rules as X
from rulewright.operators import lines as L
from rulewright.plans.declaration_queries import IMPORT_SQL, METHOD_SQL, blocks, corpus, joined, m, x
from rulewright.plans.line_queries import ANCHOR_SQL, LOOP_SQL, STMT_SQL, STRUCT_SQL
from rulewright.plans.registry import query, quoted as q, with_tables
from rulewright.sources.derived import code_lines, findings, table

TOKEN_SQL = """tk AS MATERIALIZED (
  SELECT DISTINCT file_id, line_no, unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM cl)"""
NUMBERED = "SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line_no, sub) AS INT) AS line_no, line FROM r"
S = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"
PLAIN = "NOT (contains(line, '//') OR contains(line, '*') OR contains(line, '\"') OR contains(line, chr(39)))"


R1_SQL = f"""us AS MATERIALIZED (SELECT DISTINCT file_id, unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*')) AS simple_name FROM cl WHERE NOT {m(D.IMPORT)}),
ui AS (SELECT file_id, line_no, path FROM (SELECT * FROM im WHERE NOT is_static AND NOT is_wildcard) ANTI JOIN us USING (file_id, simple_name))"""


@query("r1_unused_imports", with_tables("cl", IMPORT_SQL, R1_SQL, body="SELECT * FROM ui"))
def _(spark, sf):
    return X.unused_imports(code_lines(spark, sf))


@query("r1_remove_unused_imports", with_tables("cl", IMPORT_SQL, R1_SQL, body="SELECT * FROM cl ANTI JOIN ui USING (file_id, line_no)"))
def _(spark, sf):
    return X.remove_unused_imports(code_lines(spark, sf))


@query("r3_mark_complex_methods", with_tables("cl fe", """nd AS (
  SELECT file_id, line_no, max(CASE WHEN regexp_matches(line, '^\\s*(public|private|protected)') THEN line_no END)
    OVER (PARTITION BY file_id ORDER BY line_no) AS decl_line FROM cl)""", f"""r AS (
  SELECT file_id, line_no, 0 AS sub, line FROM cl UNION ALL
  SELECT DISTINCT nd.file_id, decl_line, -1, {q(X.TODO_COMPLEX)} FROM nd JOIN fe ON fe.file_id = nd.file_id AND fe.line = nd.line_no
  WHERE rule = 'java:S3776' AND decl_line > 1)""", body=NUMBERED))
def _(spark, sf):
    return X.mark_complex_methods(code_lines(spark, sf), findings(spark, sf))


@query("r5_strip_comments", with_tables("cl", f"""m AS (
  SELECT *, CASE WHEN contains(line, '*/') THEN 'close' WHEN starts_with({S}, '/*') THEN 'open' END AS mark FROM cl),
n AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM m)""",
       body=f"SELECT file_id, line_no, line FROM n WHERE coalesce(prev, '') <> 'open' AND NOT starts_with({S}, '/*') AND NOT starts_with({S}, '//')"))
def _(spark, sf):
    return X.strip_comments(code_lines(spark, sf))


@query("r6_private_constructor", with_tables("cl fe", ANCHOR_SQL, f"""t AS (
  SELECT an.* FROM an WHERE brace_line IS NOT NULL AND class_name <> '' AND file_id IN (SELECT file_id FROM fe WHERE rule = 'java:S1118')
    AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.file_id = an.file_id AND {x(X.PRIVATE_CONSTRUCTOR, 1)} = class_name)),
r AS (
  SELECT file_id, line_no, 0 AS sub, line FROM cl
  UNION ALL SELECT file_id, brace_line, 1, concat(brace_indent, '    private ', class_name, '() {{') FROM t
  UNION ALL SELECT file_id, brace_line, 2, concat(brace_indent, '        // Private constructor to prevent instantiation') FROM t
  UNION ALL SELECT file_id, brace_line, 3, concat(brace_indent, '        throw new UnsupportedOperationException("Utility class");') FROM t
  UNION ALL SELECT file_id, brace_line, 4, concat(brace_indent, '    }}') FROM t
  UNION ALL SELECT file_id, brace_line, 5, '' FROM t)""", body=NUMBERED))
def _(spark, sf):
    return X.add_private_constructor(code_lines(spark, sf), findings(spark, sf))


def literal_sql(source):
    return f"""lp AS MATERIALIZED (
  SELECT file_id, line_no, n, idx, piece, idx % 2 = 1 AND idx < n - 1 AS lit FROM (
    SELECT file_id, line_no, len(ps) AS n, generate_subscripts(ps, 1) - 1 AS idx, unnest(ps) AS piece
    FROM (SELECT file_id, line_no, string_split(line, '"') AS ps FROM {source} WHERE contains(line, '"')))),
ds AS (
  SELECT file_id, piece AS literal, count(*) AS n, concat('STR_', substr(regexp_replace(upper(piece), '[^A-Z0-9]', '_', 'g'), 1, 30)) AS short,
    min(line_no * 1048576 + idx) AS place
  FROM lp WHERE lit AND length(piece) >= 6 GROUP BY 1, 2 HAVING count(*) > 1),
du AS MATERIALIZED (
  SELECT file_id, literal, n, place, concat(short, CASE WHEN count(*) OVER (PARTITION BY file_id, short) > 1
    THEN '_' || substr(upper(md5(literal)), 1, 16) ELSE '' END) AS constant
  FROM ds)"""


@query("r8_duplicate_literals", with_tables("cl", literal_sql("cl"), body="""
SELECT file_id, literal, n, constant, CAST(place // 1048576 AS INT) AS first_line, CAST(place % 1048576 AS INT) AS first_idx FROM du"""))
def duplicate_literals(spark, sf):
    return X.duplicate_literals(code_lines(spark, sf))


PAGE_LINES_SQL = """WITH pl AS MATERIALIZED (
  SELECT file_id, generate_subscripts(ps, 1) AS line_no, unnest(ps) AS line FROM (SELECT page_id AS file_id, string_split(html, chr(10)) AS ps FROM pages)),
"""


@query("r8_duplicate_literals_pages", PAGE_LINES_SQL + literal_sql("pl") + """
SELECT file_id, literal, n, CAST(place // 1048576 AS INT) AS first_line, CAST(place % 1048576 AS INT) AS first_idx FROM du""")
def _(spark, sf):
    return X.duplicate_literals(L.explode_lines(table(spark, sf, "pages"), "page_id", "html")).drop("constant")


@query("r8_name_duplicate_literals", with_tables("cl", ANCHOR_SQL, literal_sql("cl"), """
rb AS (SELECT lp.file_id, lp.line_no, string_agg(CASE WHEN idx % 2 = 0 THEN piece WHEN lit AND du.constant IS NOT NULL AND an.brace_line IS NOT NULL THEN du.constant
    WHEN lit THEN concat('"', piece, '"') ELSE concat('"', piece) END, '' ORDER BY idx) AS line
  FROM lp LEFT JOIN du ON du.file_id = lp.file_id AND du.literal = lp.piece LEFT JOIN an ON an.file_id = lp.file_id GROUP BY 1, 2),
r AS (
  SELECT file_id, line_no, 0 AS sub, line FROM cl WHERE NOT contains(line, '"')
  UNION ALL SELECT file_id, line_no, 0, line FROM rb
  UNION ALL SELECT file_id, brace_line, place, concat(brace_indent, '    private static final String ', constant, ' = "', literal, '";') FROM du JOIN an USING (file_id) WHERE brace_line IS NOT NULL)""", body=NUMBERED))
def _(spark, sf):
    return X.name_duplicate_literals(code_lines(spark, sf))


@query("r9_concat_in_loops", with_tables("cl", LOOP_SQL, body=f"""
SELECT file_id, loop_line, {x(X.LOOP_VARIABLE, 1)} AS variable, count(*) AS n_lines FROM lr
WHERE closed AND (contains(line, '+=') OR contains(line, '= ')) AND contains(line, '"') AND {m(X.LOOP_VARIABLE)} GROUP BY 1, 2, 3"""))
def _(spark, sf):
    return X.concat_in_loops(code_lines(spark, sf))


R10_SQL = f"""nx AS (SELECT *, lead(line) OVER (PARTITION BY file_id ORDER BY line_no) AS nl FROM cl),
dr AS (SELECT file_id, line_no, {x(X.DECLARE, 2)} AS variable, {x(X.DECLARE, 3)} AS expression, {x(X.DECLARE, 1)} AS pad FROM nx
  WHERE {m(X.DECLARE)} AND {m(X.RETURN_NAME, 'nl')} AND {x(X.DECLARE, 2)} = {x(X.RETURN_NAME, 1, 'nl')})"""


@query("r10_immediate_returns", with_tables("cl", R10_SQL, body="SELECT file_id, line_no, variable, expression FROM dr"))
def _(spark, sf):
    return X.immediate_returns(code_lines(spark, sf))


@query("r10_return_directly", with_tables("cl", R10_SQL, body="""
SELECT cl.file_id, cl.line_no, CASE WHEN dr.file_id IS NOT NULL THEN concat(pad, 'return ', expression, ';') ELSE line END AS line
FROM cl LEFT JOIN dr USING (file_id, line_no) WHERE NOT EXISTS (SELECT 1 FROM dr d WHERE d.file_id = cl.file_id AND d.line_no + 1 = cl.line_no)"""))
def _(spark, sf):
    return X.return_directly(code_lines(spark, sf))


R11_SQL = f"""u0 AS (
  SELECT file_id, line_no AS use_line, {x(X.URL_USE, 1)} AS name, {x(X.URL_TEXT, 1)} AS base_url,
    list_filter(regexp_extract_all(line, {q(X.URL_PARAMETER)}, 1), lambda p: p <> {x(X.URL_USE, 1)}) AS params FROM cl WHERE {m(X.URL_USE)}),
u1 AS (
  SELECT u0.*, max(cl.line_no) AS def_line FROM u0 JOIN cl ON cl.file_id = u0.file_id AND cl.line_no BETWEEN use_line - 19 AND use_line - 1
    AND contains(line, concat(' ', name, ' =')) WHERE base_url <> '' AND len(params) > 0 GROUP BY ALL),
uc AS MATERIALIZED (
  SELECT u1.*, line AS def_text FROM u1 JOIN cl ON cl.file_id = u1.file_id AND cl.line_no = def_line
  WHERE NOT (contains(line, 'UriComponentsBuilder') OR contains(line, 'URIBuilder') OR contains(line, 'UriBuilder'))),
uf AS MATERIALIZED (SELECT file_id, def_line, min(use_line) AS use_line FROM uc GROUP BY 1, 2),
ub AS MATERIALIZED (SELECT uc.*, regexp_extract(def_text, '^(\\s*)', 1) AS pad FROM uf JOIN uc USING (file_id, def_line, use_line))"""


@query("r11_url_concatenations", with_tables("cl", R11_SQL, body="""
SELECT * REPLACE (array_to_string(params, ', ') AS params) FROM uc"""))
def _(spark, sf):
    return joined(X.url_concatenations(code_lines(spark, sf)), "params")


@query("r11_build_urls", with_tables("cl", R11_SQL, f"""
r AS (
  SELECT cl.file_id, cl.line_no, 0 AS sub, CASE WHEN ub.file_id IS NOT NULL
      THEN concat(pad, 'String ', name, ' = UriComponentsBuilder.fromHttpUrl("', base_url, '")')
    WHEN EXISTS (SELECT 1 FROM ub u WHERE u.file_id = cl.file_id AND u.use_line = cl.line_no) THEN concat(line, '  // Fixed: URL construction made safe')
    ELSE line END AS line
  FROM cl LEFT JOIN ub ON ub.file_id = cl.file_id AND ub.def_line = cl.line_no
  UNION ALL SELECT file_id, def_line, i, concat(pad, '    .queryParam("', params[i], '", ', params[i], ')') FROM (SELECT *, generate_subscripts(params, 1) AS i FROM ub)
  UNION ALL SELECT file_id, def_line, len(params) + 1, concat(pad, '    .build().toUriString();') FROM ub
  UNION ALL SELECT file_id, max(line_no), 1000, {q(X.URI_IMPORT)} FROM cl
    WHERE file_id IN (SELECT file_id FROM ub) AND contains(line, 'import ') AND contains(line, ';') GROUP BY 1)""", body=NUMBERED))
def _(spark, sf):
    return X.build_urls(code_lines(spark, sf))


R12_SQL = """em AS (SELECT mr.file_id, body_line AS line_no, line, mr.end_line FROM mr JOIN cl ON cl.file_id = mr.file_id AND cl.line_no = body_line WHERE empty AND mr.term = '{')"""


@query("r12_empty_methods", with_tables("cl", STMT_SQL, METHOD_SQL, R12_SQL, body="SELECT * FROM em"))
def _(spark, sf):
    return X.empty_methods(*corpus(spark, sf))


@query("r12_explain_empty_methods", with_tables("cl", STMT_SQL, METHOD_SQL, R12_SQL, """r AS (
  SELECT file_id, line_no, 0 AS sub, line FROM cl UNION ALL
  SELECT file_id, line_no, 1, concat(regexp_extract(line, '^(\\s*)', 1), '    // Intentionally empty - Add a reason') FROM em WHERE end_line > line_no)""", body=NUMBERED))
def _(spark, sf):
    lines, st = corpus(spark, sf)
    return X.explain_empty_methods(lines, st, "Add a reason (or code)")


RENAME_SQL = """rn0 AS (
  SELECT fe.file_id, fe.line, finding_id, split_part(message, chr(39), 2) AS old,
    CASE WHEN contains(cl.line, '(') THEN 'camel' ELSE 'pascal' END AS style
  FROM fe JOIN cl ON cl.file_id = fe.file_id AND cl.line_no = fe.line WHERE rule = 'java:S100' AND contains(message, 'Rename this')),
rn1 AS (SELECT *, string_split(lower(old), '_') AS ps FROM rn0),
rn2 AS (SELECT file_id, old, line, finding_id,
    concat(CASE WHEN style = 'camel' THEN ps[1] ELSE concat(upper(ps[1][1]), substr(ps[1], 2)) END,
      list_aggregate(list_transform(ps[2:], lambda w: concat(upper(w[1]), substr(w, 2))), 'string_agg', '')) AS new FROM rn1),
rn AS MATERIALIZED (SELECT file_id, old, arg_min(new, CAST(line AS BIGINT) * 1000000000 + finding_id) AS new FROM rn2 GROUP BY 1, 2)"""


@query("r13_renames", with_tables("cl fe", RENAME_SQL, body="SELECT * FROM rn"))
def _(spark, sf):
    return X.renames(findings(spark, sf), code_lines(spark, sf))


@query("r13_rename_in_files", with_tables("cl fe", RENAME_SQL, """pc AS (
  SELECT file_id, line_no, generate_subscripts(ps, 1) AS idx, unnest(ps) AS piece
  FROM (SELECT file_id, line_no, regexp_extract_all(line, '([A-Za-z0-9_]+|[^A-Za-z0-9_]+)', 1) AS ps FROM cl))""", body="""
SELECT pc.file_id, line_no, string_agg(coalesce(new, piece), '' ORDER BY idx) AS line
FROM pc LEFT JOIN rn ON rn.file_id = pc.file_id AND rn.old = pc.piece GROUP BY 1, 2"""))
def _(spark, sf):
    lines = code_lines(spark, sf)
    return X.rename_in_files(lines, X.renames(findings(spark, sf), lines))


@query("r14_freeze_exception_fields", with_tables("cl", STRUCT_SQL, """hd AS (
  SELECT *, last_value(CASE WHEN contains(code, 'class ') AND (contains(code, 'Exception') OR contains(code, 'Error')) AND contains(code, '{')
    THEN {'l': line_no, 'e': end_line} END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM st)""", body="""
SELECT file_id, line_no, CASE WHEN h IS NULL OR line_no > coalesce(h.e, line_no)
    OR NOT (contains(line, ';') AND NOT contains(line, 'final ') AND NOT regexp_matches(line, '^\\s*(//|/\\*|\\*|@)')) THEN line
  WHEN contains(line, 'private') THEN regexp_replace(line, '^(.*?)private ', '\\1private final ')
  WHEN contains(line, 'protected') THEN regexp_replace(line, '^(.*?)protected ', '\\1protected final ')
  WHEN contains(line, 'public') THEN regexp_replace(line, '^(.*?)public ', '\\1public final ') ELSE line END AS line FROM hd"""))
def _(spark, sf):
    return X.freeze_exception_fields(blocks(spark, sf)[1])


R16_SQL = f"""sw AS (
  SELECT h.file_id, h.line_no, h.end_line, h.line, {x(X.CATCH, 1, 'h.code')} AS exception
  FROM st h JOIN st b ON b.file_id = h.file_id AND b.line_no > h.line_no AND b.line_no < h.end_line
  WHERE {m(X.CATCH, 'h.code')} GROUP BY ALL
  HAVING count(*) FILTER (WHERE regexp_matches(b.line, '\\S')) > 0
    AND count(*) FILTER (WHERE contains(lower(b.code), 'log') OR contains(b.code, 'throw')) = 0)"""


@query("r16_swallowed_exceptions", with_tables("cl", STRUCT_SQL, R16_SQL, body="SELECT * FROM sw"))
def _(spark, sf):
    return X.swallowed_exceptions(blocks(spark, sf)[1])


@query("r16_log_swallowed_exceptions", with_tables("cl", STRUCT_SQL, R16_SQL, """r AS (
  SELECT file_id, line_no, 0 AS sub, line FROM cl UNION ALL
  SELECT file_id, line_no, 1, concat(regexp_extract(line, '^(\\s*)', 1), 'log.error("Error occurred: ', exception, '", ', exception, ');') FROM sw)""", body=NUMBERED))
def _(spark, sf):
    return X.log_swallowed_exceptions(*blocks(spark, sf))


MAGIC_SQL = f"""mg AS MATERIALIZED (
  SELECT file_id, number, count(*) AS n, concat('MAGIC_NUMBER_', translate(upper(number), '.-+', '_MP')) AS constant, min(line_no * 1048576 + i - 1) AS place
  FROM (SELECT file_id, line_no, generate_subscripts(ns, 1) AS i, unnest(ns) AS number
        FROM (SELECT file_id, line_no, regexp_extract_all(line, {q(X.NUMBER)}, 1) AS ns FROM cl WHERE {PLAIN}))
  WHERE number NOT IN ('0', '1') GROUP BY 1, 2)"""


@query("r17_magic_numbers", with_tables("cl", MAGIC_SQL, body="""
SELECT file_id, number, n, constant, CAST(place // 1048576 AS INT) AS first_line, CAST(place % 1048576 AS INT) AS first_idx FROM mg"""))
def _(spark, sf):
    return X.magic_numbers(code_lines(spark, sf))


@query("r17_name_magic_numbers", with_tables("cl", ANCHOR_SQL, MAGIC_SQL, f"""r AS (
  SELECT cl.file_id, line_no, 0 AS sub, CASE WHEN brace_line IS NOT NULL AND {PLAIN}
    THEN array_to_string(list_transform(list_zip(string_split_regex(line, {q(X.NUMBER)}), regexp_extract_all(line, {q(X.NUMBER)}, 1)),
      lambda z: concat(z[1], CASE WHEN z[2] IN ('0', '1') THEN z[2] WHEN z[2] IS NULL THEN '' ELSE concat('MAGIC_NUMBER_', translate(upper(z[2]), '.-+', '_MP')) END)), '') ELSE line END AS line
  FROM cl LEFT JOIN an USING (file_id)
  UNION ALL SELECT file_id, brace_line, place, concat(brace_indent, '    private static final ', CASE WHEN contains(number, '.') THEN 'double' ELSE 'int' END,
    ' ', constant, ' = ', number, ';') FROM mg JOIN an USING (file_id) WHERE brace_line IS NOT NULL)""", body=NUMBERED))
def _(spark, sf):
    return X.name_magic_numbers(code_lines(spark, sf))


@query("r18_log_instead_of_print", with_tables("cl", ANCHOR_SQL, f"""pf AS (
  SELECT DISTINCT an.* FROM an JOIN cl USING (file_id) WHERE brace_line IS NOT NULL AND {m(X.PRINT)}),
r AS (
  SELECT file_id, line_no, 0 AS sub, regexp_replace(line, {q(X.PRINT)}, 'LOGGER.info(\\1);', 'g') AS line FROM cl
  UNION ALL SELECT file_id, decl_line, -3, 'import org.slf4j.Logger;' FROM pf
  UNION ALL SELECT file_id, decl_line, -2, 'import org.slf4j.LoggerFactory;' FROM pf
  UNION ALL SELECT file_id, decl_line, -1, '' FROM pf
  UNION ALL SELECT file_id, brace_line, 1, concat(brace_indent, '    private static final Logger LOGGER = LoggerFactory.getLogger(', class_name, '.class);') FROM pf)""", body=NUMBERED))
def _(spark, sf):
    return X.log_instead_of_print(code_lines(spark, sf))


R19_SQL = f"""pm AS (SELECT file_id, line_no, {x(X.LAST_WORD_BEFORE_PAREN, 1)} AS name FROM cl
    WHERE contains(line, 'private ') AND contains(line, '(') AND NOT contains(line, ';') AND {m(X.LAST_WORD_BEFORE_PAREN)}),
um AS (SELECT * FROM pm WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.file_id = pm.file_id AND cl.line_no <> pm.line_no
    AND (contains(line, concat('.', name, '(')) OR contains(line, concat(' ', name, '(')))))"""


@query("r19_unused_private_methods", with_tables("cl", R19_SQL, body="SELECT * FROM um"))
def _(spark, sf):
    return X.unused_private_methods(code_lines(spark, sf))


@query("r19_mark_unused_private_methods", with_tables("cl", R19_SQL, body="""
SELECT cl.file_id, cl.line_no, CASE WHEN um.name IS NOT NULL
  THEN regexp_replace(line, '^(.*?)private ', '\\1// TODO: Remove or use this private method: private ') ELSE line END AS line
FROM cl LEFT JOIN um USING (file_id, line_no)"""))
def _(spark, sf):
    return X.mark_unused_private_methods(code_lines(spark, sf))


@query("r25_get_instead_of_contains_key", with_tables("cl", "nx AS (SELECT *, lead(line) OVER (PARTITION BY file_id ORDER BY line_no) AS nl FROM cl)", body=f"""
SELECT file_id, line_no, CASE WHEN contains(line, '.containsKey(') AND contains(line, 'if (') AND contains(nl, 'get(')
  THEN regexp_replace(line, {q(X.CONTAINS_KEY)}, '\\1.get(\\2) != null', 'g') ELSE line END AS line FROM nx"""))
def _(spark, sf):
    return X.get_instead_of_contains_key(code_lines(spark, sf))


R30_SQL = f"""al AS (SELECT file_id, line_no, {x(X.ASSIGNED_LOCAL, 1)} AS name FROM cl
    WHERE contains(line, ' = ') AND contains(line, ';') AND NOT starts_with({S}, '//') AND regexp_matches({x(X.ASSIGNED_LOCAL, 1)}, '^[A-Za-z_][A-Za-z0-9_]*$')),
ul AS (SELECT * FROM al WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.file_id = al.file_id AND tk.name = al.name AND tk.line_no <> al.line_no))"""


@query("r30_unused_locals", with_tables("cl", TOKEN_SQL, R30_SQL, body="SELECT * FROM ul"))
def _(spark, sf):
    return X.unused_locals(code_lines(spark, sf))


@query("r30_remove_unused_locals", with_tables("cl", TOKEN_SQL, R30_SQL, body="SELECT * FROM cl ANTI JOIN ul USING (file_id, line_no)"))
def _(spark, sf):
    return X.remove_unused_locals(code_lines(spark, sf))


@query("r31_recursion_candidates", with_tables("cl", body=f"""
SELECT file_id, min(line_no) AS line_no, arg_min({x(X.FIRST_CALL, 1)}, line_no) AS callee FROM cl
WHERE {m(X.FIRST_CALL)} GROUP BY 1"""))
def _(spark, sf):
    return X.recursion_candidates(code_lines(spark, sf))
