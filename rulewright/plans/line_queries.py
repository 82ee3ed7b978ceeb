"""Queries for the line table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulewright.functions.text import has, plain_code
from rulewright.operators import code as C
from rulewright.operators import lines as L
from rulewright.plans.registry import query, quoted, with_tables
from rulewright.sources.derived import code_lines, table

# Code by reading each file's whole text at once: comments and literals are tokens of one pattern.
WHOLE_TOKEN = r"""\"(?:[^"\\\n]|\\[^\n])*"?|'(?:[^'\\\n]|\\[^\n])*'?|//[^\n]*|/\*(?s:.*?)(?:\*/|\z)"""
CODE_SQL = f"""tw AS (SELECT file_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM cl GROUP BY 1),
tk0 AS (SELECT file_id, string_split_regex(t, {quoted(WHOLE_TOKEN)}) AS g, regexp_extract_all(t, {quoted(WHOLE_TOKEN)}) AS m FROM tw),
tk1 AS (SELECT file_id, g, list_transform(m, lambda k: CASE WHEN k[1] = '/' THEN regexp_replace(k, '[^\n]', ' ', 'g')
    ELSE concat(k[1], repeat(' ', length(k) - CASE WHEN length(k) > 1 AND k[-1] = k[1] THEN 2 ELSE 1 END), CASE WHEN length(k) > 1 AND k[-1] = k[1] THEN k[1] ELSE '' END) END) AS m FROM tk0),
tk2 AS (SELECT file_id, string_split(array_to_string(list_transform(list_zip(g, m), lambda z: concat(z[1], coalesce(z[2], ''))), ''), chr(10)) AS cs FROM tk1),
tk3 AS (SELECT file_id, CAST(generate_subscripts(cs, 1) AS INT) AS line_no, unnest(cs) AS code FROM tk2),
ct AS MATERIALIZED (SELECT cl.*, code FROM cl JOIN tk3 USING (file_id, line_no))"""

# Brace depth by plain windows: depth before/after a line and the lowest depth on it.
DEPTH_SQL = CODE_SQL + """,
d0 AS (
  SELECT file_id, line_no, line, code,
         length(code) - length(replace(code, '{', '')) AS o, length(code) - length(replace(code, '}', '')) AS c,
         length(regexp_extract(code, '^[^{]*', 0)) - length(replace(regexp_extract(code, '^[^{]*', 0), '}', '')) AS lead
  FROM ct),
d1 AS (
  SELECT *, CAST(sum(o - c) OVER (PARTITION BY file_id ORDER BY line_no) AS BIGINT) AS depth_after FROM d0),
d2 AS (
  SELECT file_id, line_no, line, code, o, c, depth_after - o + c AS depth_before, depth_after,
         least(depth_after - o + c - lead, depth_after) AS dip FROM d1)"""

# Block ends and parents by self joins (files are short here).
STRUCT_SQL = DEPTH_SQL + """,
e1 AS (
  SELECT i.file_id, i.line_no, min(j.line_no) AS end_line
  FROM d2 i JOIN d2 j ON j.file_id = i.file_id AND j.line_no > i.line_no
   AND j.dip < i.depth_after AND j.dip < j.depth_before
  WHERE i.depth_after > i.dip GROUP BY 1, 2),
p1 AS (
  SELECT i.file_id, i.line_no, max(j.line_no) AS parent_line
  FROM d2 i JOIN d2 j ON j.file_id = i.file_id AND j.line_no < i.line_no
   AND j.depth_after > j.dip AND j.depth_after = i.dip
  GROUP BY 1, 2),
st AS MATERIALIZED (
  SELECT d.file_id, d.line_no, d.line, d.code, d.depth_before, d.depth_after, d.dip,
         CASE WHEN d.o > 0 AND d.c > 0 AND d.depth_after = d.dip THEN d.line_no ELSE e.end_line END AS end_line,
         p.parent_line, pl.code AS parent_text
  FROM d2 d LEFT JOIN e1 e USING (file_id, line_no) LEFT JOIN p1 p USING (file_id, line_no)
  LEFT JOIN d2 pl ON pl.file_id = d.file_id AND pl.line_no = p.parent_line)"""

# Statements by plain windows over the whole file, blocks by as-of joins on the brace level.
INIT_SQL = "code"
for _ in range(3):
    INIT_SQL = f"regexp_replace({INIT_SQL}, {quoted(C.INITIALISER)}, '\\1(\\2)', 'g')"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
STMT_SQL = CODE_SQL + f""",
pc0 AS (SELECT file_id, line_no, string_split_regex(c, '[;{{}}]') AS g, list_append(regexp_extract_all(c, '[;{{}}]'), NULL) AS t FROM (SELECT file_id, line_no, {INIT_SQL} AS c FROM ct)),
pc1 AS (SELECT file_id, line_no, generate_subscripts(g, 1) AS idx, unnest(g) AS text, unnest(t) AS term FROM pc0),
pc2 AS (SELECT *, sum(length(replace(text, ')', '')) - length(replace(text, '(', ''))) OVER (PARTITION BY file_id ORDER BY line_no, idx) AS r
  FROM pc1 WHERE term IS NOT NULL OR regexp_matches(text, '\\S')),
pc3 AS (SELECT *, last_value(CASE WHEN term IN ('{{', '}}') THEN r END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM pc2),
pc4 AS (SELECT *, coalesce(term IN ('{{', '}}') OR (term = ';' AND r <= coalesce(base, 0)), false) AS ends FROM pc3),
pc5 AS (SELECT *, sum(ends::INT) OVER (PARTITION BY file_id ORDER BY line_no, idx) - ends::INT AS stmt_no FROM pc4),
sm0 AS (SELECT file_id, stmt_no, {_STRIP.format("regexp_replace(string_agg(CASE WHEN NOT ends AND term = ';' THEN text || ';' ELSE text END, ' ' ORDER BY line_no, idx), '\\s+', ' ', 'g')")} AS text,
    max(line_no) AS line_no, max(CASE WHEN ends THEN term END) AS term,
    coalesce(min(line_no) FILTER (regexp_matches(text, '\\S') AND NOT regexp_matches(text, {quoted(C.NOTE_LINE.replace('*+', '*'))})), max(line_no)) AS start_line FROM pc5 GROUP BY 1, 2),
sm1 AS (SELECT *, CASE term WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END AS step FROM sm0 WHERE text <> '' OR term IS DISTINCT FROM ';'),
sm2 AS MATERIALIZED (SELECT *, sum(step) OVER (PARTITION BY file_id ORDER BY stmt_no) - step AS depth FROM sm1),
br AS (SELECT file_id, stmt_no, term, CASE term WHEN '{{' THEN depth ELSE depth - 1 END AS level, line_no, start_line, text FROM sm2 WHERE term IN ('{{', '}}')),
bb AS MATERIALIZED (SELECT o.file_id, o.stmt_no, o.level, o.start_line, o.text, c.stmt_no AS end_no, c.line_no AS end_line, c.text = '' AS bare
  FROM (SELECT * FROM br WHERE term = '{{') o ASOF LEFT JOIN (SELECT * FROM br WHERE term = '}}') c ON c.file_id = o.file_id AND c.level = o.level AND c.stmt_no > o.stmt_no),
cb0 AS MATERIALIZED (SELECT file_id, stmt_no, end_no FROM bb WHERE regexp_matches(text, {quoted(C.CONTROL_BLOCK)})
  QUALIFY end_no IS NULL OR row_number() OVER (PARTITION BY file_id, level, end_no ORDER BY stmt_no DESC) = 1),
sm3 AS (SELECT s.*, o.start_line AS parent_line, o.text AS parent_text FROM sm2 s ASOF LEFT JOIN bb o
  ON o.file_id = s.file_id AND o.level = s.depth - 1 AND o.stmt_no < s.stmt_no WHERE s.term IS DISTINCT FROM '}}' OR s.text <> ''),
sm AS MATERIALIZED (SELECT s.file_id, s.stmt_no, s.start_line, s.line_no, s.text, s.term, s.depth, b.end_line, b.end_no,
    coalesce(b.end_no = s.stmt_no + 1 AND b.bare, false) AS empty, s.parent_line, s.parent_text, count(c.stmt_no) AS nesting
  FROM sm3 s LEFT JOIN bb b ON b.file_id = s.file_id AND b.stmt_no = s.stmt_no
  LEFT JOIN cb0 c ON c.file_id = s.file_id AND c.stmt_no < s.stmt_no AND (c.end_no IS NULL OR c.end_no >= s.stmt_no) GROUP BY ALL)"""

ANCHOR_SQL = """a0 AS (
  SELECT file_id, min(line_no) AS decl_line FROM cl
  WHERE contains(line, 'class ') AND (contains(line, 'public ') OR contains(line, 'final ')) GROUP BY 1),
a1 AS (
  SELECT a0.file_id, decl_line, min(line_no) AS brace_line
  FROM a0 LEFT JOIN cl ON cl.file_id = a0.file_id AND line_no >= decl_line AND contains(line, '{') GROUP BY 1, 2),
an AS MATERIALIZED (
  SELECT a1.*, regexp_extract(d.line, 'class\\s+([A-Za-z0-9_]+)', 1) AS class_name,
         regexp_extract(b.line, '^(\\s*)', 1) AS brace_indent
  FROM a1 JOIN cl d ON d.file_id = a1.file_id AND d.line_no = decl_line
  LEFT JOIN cl b ON b.file_id = a1.file_id AND b.line_no = brace_line)"""


def _split_sql(source: str, key: str, text: str) -> str:
    return (f"SELECT file_id, CAST(generate_subscripts(parts, 1) AS INT) AS line_no, unnest(parts) AS line "
            f"FROM (SELECT {key} AS file_id, string_split({text}, chr(10)) AS parts FROM {source})")


@query("l1_explode_documents", _split_sql("documents", "doc_id", "text"))
def _(spark, sf):
    return L.explode_lines(table(spark, sf, "documents"), "doc_id", "text")


@query("l1_explode_pages", _split_sql("pages", "page_id", "html"))
def _(spark, sf):
    return L.explode_lines(table(spark, sf, "pages"), "page_id", "html")


@query("l1_explode_conversations",
       _split_sql("conversations", "concat(CAST(conv_id AS STRING), ':', CAST(turn AS STRING))", "text"))
def _(spark, sf):
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return L.explode_lines(table(spark, sf, "conversations"), key, "text")


@query("l2_assemble", with_tables("cl", body="SELECT file_id, string_agg(line, chr(10) ORDER BY line_no) AS text "
                                             "FROM cl GROUP BY file_id"))
def _(spark, sf):
    return L.assemble(code_lines(spark, sf))


@query("l2_assemble_documents", "SELECT doc_id AS file_id, text FROM documents")
def _(spark, sf):
    return L.assemble(L.explode_lines(table(spark, sf, "documents"), "doc_id", "text"))


@query("l3_next_line", with_tables("cl", body="SELECT file_id, line_no, line, lead(line) OVER "
                                              "(PARTITION BY file_id ORDER BY line_no) AS next_line FROM cl"))
def _(spark, sf):
    return L.with_next(code_lines(spark, sf))


@query("l4_lookback_definition", with_tables("cl", body="""
SELECT file_id, line_no, max(CASE WHEN contains(line, ' = ') THEN line_no END) OVER
  (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS match_line FROM cl"""))
def _(spark, sf):
    return L.lookback(code_lines(spark, sf), has(F.col("line"), " = "), 19).drop("line")


@query("l4_lookback_class_header", with_tables("cl", body="""
SELECT file_id, line_no, max(CASE WHEN contains(line, 'class ') AND (contains(line, 'Exception') OR contains(line, 'Error'))
  THEN line_no END) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS match_line FROM cl"""))
def _(spark, sf):
    line = F.col("line")
    header = has(line, "class ") & has(line, "Exception", "Error")
    return L.lookback(code_lines(spark, sf), header, 10, include_current=True).drop("line")


@query("l5_nearest_declaration", with_tables("cl", body="""
SELECT file_id, line_no, max(CASE WHEN regexp_matches(line, '^\\s*(public|private|protected)') THEN line_no END)
  OVER (PARTITION BY file_id ORDER BY line_no) AS decl_line FROM cl"""))
def _(spark, sf):
    return L.nearest_decl(code_lines(spark, sf)).drop("line")


@query("l6_comment_state", with_tables("cl", """m AS (
  SELECT file_id, line_no, CASE WHEN contains(line, '*/') THEN 'close' WHEN contains(line, '/*') THEN 'open' END AS mark
  FROM cl)""", body="""
SELECT file_id, line_no, mark, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'open', false) AS in_comment FROM m"""))
def _(spark, sf):
    return L.comment_state(code_lines(spark, sf)).drop("line")


@query("l7_block_depth", with_tables("cl", DEPTH_SQL, body="SELECT file_id, line_no, depth_before, depth_after, dip FROM d2"))
def _(spark, sf):
    return L.block_depth(code_lines(spark, sf)).drop("line", "code")


@query("l12_code_text", with_tables("cl", CODE_SQL, body="SELECT file_id, line_no, code FROM ct"))
def _(spark, sf):
    return C.code_text(code_lines(spark, sf)).select("file_id", "line_no", "code")


@query("l13_statements", with_tables("cl", STMT_SQL, body="""
SELECT file_id, CAST(stmt_no AS BIGINT) AS stmt_no, start_line, line_no, text, term, CAST(depth AS BIGINT) AS depth, end_line, CAST(end_no AS BIGINT) AS end_no,
  empty, parent_line, parent_text, CAST(nesting AS BIGINT) AS nesting FROM sm"""))
def _(spark, sf):
    return C.statements(code_lines(spark, sf)).drop("parts")


@query("l7_block_ends", with_tables("cl", STRUCT_SQL, body="SELECT file_id, line_no, end_line FROM st WHERE contains(code, '{')"))
def _(spark, sf):
    return L.block_ends(code_lines(spark, sf))


@query("l7_block_parents", with_tables("cl", STRUCT_SQL, body="SELECT file_id, line_no, parent_line, parent_text FROM st"))
def _(spark, sf):
    return L.structure(code_lines(spark, sf)).select("file_id", "line_no", "parent_line", "parent_text")


LOOP_SQL = """m AS (
  SELECT file_id, line_no, line,
    CASE WHEN contains(line, 'for (') OR contains(line, 'while (') OR contains(line, 'do {') THEN line_no
         WHEN contains(line, '}') AND NOT contains(line, 'else') THEN 0 END AS mark FROM cl),
n AS (
  SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no) AS op,
    first_value(mark IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM m),
lr AS (SELECT file_id, line_no, line, CASE WHEN op > 0 THEN op END AS loop_line, coalesce(op > 0, false) AND coalesce(nx = 0, false) AS closed FROM n)"""


@query("l8_loop_regions", with_tables("cl", LOOP_SQL, body="SELECT file_id, line_no, loop_line, closed FROM lr"))
def _(spark, sf):
    return L.loop_regions(code_lines(spark, sf)).drop("line")


@query("l9_class_anchor", with_tables("cl", ANCHOR_SQL, body="SELECT file_id, decl_line, brace_line, class_name, brace_indent FROM an"))
def _(spark, sf):
    return L.class_anchor(code_lines(spark, sf))


@query("l10_insert_delete_renumber", with_tables("cl", """r AS (
  SELECT file_id, line_no, 0 AS sub, line FROM cl WHERE NOT contains(line, 'TODO')
  UNION ALL SELECT file_id, line_no, 1, '    // checked' FROM cl WHERE contains(line, 'class '))""", body="""
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line_no, sub) AS INT) AS line_no, line FROM r"""))
def _(spark, sf):
    lines = code_lines(spark, sf)
    kept = L.delete_lines(lines, lines.where(has(F.col("line"), "TODO")))
    marks = lines.where(has(F.col("line"), "class ")).select(
        "file_id", "line_no", F.lit(1).alias("sub"), F.lit("    // checked").alias("line"))
    return L.insert_after(kept, marks)


@query("l11_plain_code", with_tables("cl", body="""
SELECT file_id, line_no, NOT (contains(line, '//') OR contains(line, '*') OR contains(line, '"')
  OR contains(line, chr(39))) AS plain FROM cl"""))
def _(spark, sf):
    return code_lines(spark, sf).select("file_id", "line_no", plain_code(F.col("line")).alias("plain"))
