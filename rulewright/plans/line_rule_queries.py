"""Queries for the line rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulewright.functions import text as T
from rulewright.functions.fixed_values import HANDLER_RULES, SAFE_RULES, TEXT_FIXER_RULES
from rulewright.operators import line_rules as R
from rulewright.operators import lines as L
from rulewright.operators.findings import rule_table
from rulewright.plans.registry import query, quoted as q, with_tables
from rulewright.sources.derived import code_lines, findings, table


def any_of(needles, c="line"):
    return "(" + " OR ".join(f"contains({c}, {q(n)})" for n in needles) + ")"


STRIPPED = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"
NOT_PLAIN = any_of(["//", "*", '"', "'"])


def m(pattern, c="line"):
    return f"regexp_matches({c}, {q(pattern)})"


def sub(pattern, new, c="line"):
    return f"regexp_replace({c}, {q(pattern)}, {q(new)}, 'g')"


def _boolean_sql():
    arms = " ".join(f"WHEN {m(k)} OR {m(n)} THEN {sub(n, '!' + chr(92) + '1', sub(k, chr(92) + '1'))}"
                    for k, n, _ in R.BOOLEAN_FORMS)
    return f"CASE {arms} ELSE line END"


def _size_sql():
    arms = " ".join(f"WHEN {m(p)} THEN {sub(p, ('' if e else '!') + chr(92) + '1.isEmpty()')}" for p, e in R.SIZE_FORMS)
    return f"CASE WHEN {NOT_PLAIN} THEN line {arms} ELSE line END"


FOUND = f"list_filter(regexp_extract_all(line, {q(R.ASSIGNMENT)}), lambda x: regexp_matches(lower(x), {q(R.CREDENTIAL)}))[1]"
ASSIGNED_CRED = f"CASE WHEN regexp_matches(lower(line), 'pass|pwd|secret|key') THEN {FOUND} END"
CRED_VAR = f"concat(upper(regexp_extract({FOUND}, '^([A-Za-z0-9_]+)', 1)), '_PASSWORD')"

DETECT_SQL = {
    "R2": " OR ".join(m(p) for f in R.BOOLEAN_FORMS for p in f[:2]),
    "R4": f"NOT {any_of(['/*', '*/'])} AND starts_with({STRIPPED}, '//') AND length({STRIPPED}) > 3 "
          f"AND {any_of([';', '{', '}'])} AND NOT {any_of(['TODO', 'FIXME', 'NOTE'])}",
    "R7": f"{m(R.LITERAL_RIGHT)} OR {m(R.LITERAL_LEFT)}",
    "R15": m(R.EMPTY_CATCH),
    "R20": f"NOT {NOT_PLAIN} AND ({' OR '.join(m(p) for p, _ in R.SIZE_FORMS)})",
    "R21-fixme": "contains(line, 'FIXME')",
    "R21-todo": "contains(line, 'TODO')",
    "R22": f"regexp_matches(lower(line), 'password|secret|key') AND {m(R.SECRET_LITERAL)}",
    "R23": "contains(line, 'createStatement()') OR (contains(line, 'execute(') AND contains(line, '+') "
           f"AND NOT contains(line, '?') AND {m(R.SQL_CONCAT)})",
    "R24": f"{any_of(['File.', 'Path.'])} AND NOT contains(line, 'getCanonicalPath') AND {m(R.NEW_FILE)}",
    "R26": m(R.EQUALS_LITERAL),
    "R27": f"{m(R.IF_RETURN)} OR {m(R.TERNARY_RETURN)}",
    "R32": f"regexp_matches(lower(line), {q(R.CREDENTIAL)})",
    "R33": f"{m(R.JDBC_URL)} OR {m(R.DB_USER)} OR {m(R.DB_PASSWORD)}",
    "R34": f"({ASSIGNED_CRED}) IS NOT NULL",
}
B = chr(92)
REWRITE_SQL = {
    "R2": _boolean_sql(),
    "R4": "NULL",
    "R7": sub(R.LITERAL_LEFT, f"{B}1.equals({B}2)", sub(R.LITERAL_RIGHT, f"{B}1.equals({B}2)")),
    "R15": sub(R.EMPTY_CATCH, f"{B}1" + R.EMPTY_CATCH_BODY),
    "R20": _size_sql(),
    "R22": sub(R.SECRET_LITERAL, f'{B}1System.getenv("SECURE_CREDENTIAL"){B}2'),
    "R23": f"CASE WHEN contains(line, 'createStatement()') THEN replace(line, 'createStatement()', {q(R.PREPARED)}) "
           f"ELSE {sub(R.SQL_CONCAT, '?')} END",
    "R24": sub(R.NEW_FILE, f"new File(new File({B}1).getCanonicalFile())"),
    "R26": sub(R.EQUALS_LITERAL, f'{B}1"{B}3".equals({B}2)'),
    "R27": f"CASE WHEN {m(R.IF_RETURN)} THEN {sub(R.IF_RETURN, f'return {B}1;')} ELSE {sub(R.TERNARY_RETURN, f'return {B}1;')} END",
    "R33": sub(R.DB_PASSWORD, f"{B}1${{DB_PASSWORD}}{B}3", sub(R.DB_USER, f"{B}1${{DB_USERNAME}}{B}3",
               sub(R.JDBC_URL, f"${{DB_URL}}{B}1"))),
    "R34": f"concat(substr(line, 1, instr(line, {FOUND}) - 1), regexp_extract({FOUND}, '^([A-Za-z0-9_]+\\s*=\\s*)', 1), "
           f"'System.getenv(\"', {CRED_VAR}, '\")', substr(line, instr(line, {FOUND}) + length({FOUND})))",
}
NAMES = {
    "R2": "boolean_literal", "R4": "commented_code", "R7": "literal_identity", "R15": "empty_catch_line",
    "R20": "size_check", "R22": "secret_literal", "R23": "sql_concat", "R24": "raw_path", "R26": "literal_first",
    "R27": "boolean_return", "R33": "database_credential", "R34": "credential_assignment",
}


def _register(rule_id: str, name: str) -> None:
    new, hit = REWRITE_SQL[rule_id], DETECT_SQL[rule_id]
    body = (f"SELECT file_id, line_no, new AS line FROM (SELECT file_id, line_no, "
            f"CASE WHEN {hit} THEN {new} ELSE line END AS new FROM cl) WHERE new IS NOT NULL")

    @query(f"{rule_id.lower()}_rewrite_{name}", with_tables("cl", body=body))
    def _(spark, sf):
        return R.rewrite(code_lines(spark, sf), rule_id)


for _id, _name in NAMES.items():
    _register(_id, _name)


@query("r33_comment_rows", with_tables("cl", body=f"""
SELECT file_id, line_no, -9 AS sub, '// The database URL comes from the application''s configuration' AS line FROM cl WHERE {m(R.JDBC_URL)}
UNION ALL SELECT file_id, line_no, CASE WHEN {m(R.JDBC_URL)} THEN -8 ELSE -9 END, '// Database user and password come from the environment or a vault' FROM cl
  WHERE {m(R.DB_USER)} OR {m(R.DB_PASSWORD)}"""))
def _(spark, sf):
    return R.database_comment_rows(code_lines(spark, sf))


HITS_SQL = "hits AS (" + " UNION ALL ".join(
    f"SELECT file_id, line_no, line, {q(r)} AS rule_id FROM cl WHERE {c}" for r, c in DETECT_SQL.items()) + ")"


@query("r0_all_rules", with_tables("cl", HITS_SQL, body="SELECT * FROM hits"))
def _(spark, sf):
    return R.scan_rules(code_lines(spark, sf))


def _listed(rules):
    return "(" + ", ".join(map(q, rules)) + ")"


_SERVER = "CASE rule_id " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.SERVER_RULE.items()) + " END"


@query("r0_rule_hits", with_tables("cl", HITS_SQL, body=f"""
SELECT rule_id, rule, n_hits, n_files, rule IN {_listed(SAFE_RULES)} AS allow, rule IN {_listed(HANDLER_RULES)} AS handler,
  rule IN {_listed(TEXT_FIXER_RULES)} AS text_fixer
FROM (SELECT rule_id, {_SERVER} AS rule, count(*) AS n_hits, count(DISTINCT file_id) AS n_files FROM hits GROUP BY rule_id)"""))
def rule_hits(spark, sf):
    """Flagship: hits per rule with the rule's coverage."""
    server = F.create_map(*[F.lit(x) for kv in R.SERVER_RULE.items() for x in kv])
    per_file = R.scan_rules(code_lines(spark, sf)).groupBy("rule_id", "file_id").agg(F.count(F.lit(1)).alias("n"))
    hits = per_file.groupBy("rule_id").agg(F.sum("n").alias("n_hits"), F.count(F.lit(1)).alias("n_files"))
    rule = server[F.col("rule_id")]
    return hits.select("rule_id", rule.alias("rule"), "n_hits", "n_files", rule.isin(SAFE_RULES).alias("allow"),
                       rule.isin(HANDLER_RULES).alias("handler"), rule.isin(TEXT_FIXER_RULES).alias("text_fixer"))


@query("r2_rewrite_named_lines", with_tables("cl fe", body=f"""
SELECT file_id, line_no, CASE WHEN named AND ({DETECT_SQL['R2']}) THEN {REWRITE_SQL['R2']} ELSE line END AS line
FROM (SELECT cl.*, EXISTS (SELECT 1 FROM fe WHERE fe.rule = 'java:S1125' AND fe.file_id = cl.file_id AND fe.line = cl.line_no) AS named FROM cl)"""))
def _(spark, sf):
    return R.rewrite(code_lines(spark, sf), "R2", findings(spark, sf))


@query("r15_empty_catch_text", with_tables("cl", "t AS (SELECT file_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM cl GROUP BY 1)",
       body=f"SELECT file_id, {sub(R.EMPTY_CATCH, B + '1' + R.EMPTY_CATCH_BODY, 'text')} AS text FROM t WHERE {m(R.EMPTY_CATCH, 'text')}"))
def _(spark, sf):
    whole = L.assemble(code_lines(spark, sf))
    return whole.where(R.empty_catch(F.col("text"))).select("file_id", R.fill_empty_catch(F.col("text")).alias("text"))


@query("r21_tags", with_tables("cl", HITS_SQL, body="""
SELECT file_id, rule_id, count(*) AS n, min(line_no) AS first_line FROM hits WHERE rule_id LIKE 'R21-%' GROUP BY 1, 2"""))
def _(spark, sf):
    return R.tag_report(code_lines(spark, sf))


@query("r28_r29_case_conversion", with_tables("cl", """w AS (
  SELECT DISTINCT unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM cl),
p AS (SELECT name, string_split(lower(name), '_') AS ps FROM w)""", body="""
SELECT name,
  CASE WHEN regexp_matches(name, '^[ms_][A-Z]') THEN concat(name[1], lower(name[2]), substr(name, 3))
       WHEN contains(name, '_') THEN concat(ps[1], coalesce(list_aggregate(list_transform(ps[2:], lambda x: concat(upper(x[1]), substr(x, 2))), 'string_agg', ''), ''))
       WHEN regexp_matches(name, '^[A-Z][a-z]') THEN concat(lower(name[1]), substr(name, 2)) ELSE name END AS camel,
  CASE WHEN contains(name, '_') THEN coalesce(list_aggregate(list_transform(ps, lambda x: concat(upper(x[1]), substr(x, 2))), 'string_agg', ''), '')
       WHEN regexp_matches(name, '^[a-z]') THEN concat(upper(name[1]), substr(name, 2)) ELSE name END AS pascal FROM p"""))
def _(spark, sf):
    names = code_lines(spark, sf).select(F.explode(T.tokens(F.col("line"))).alias("name")).distinct()
    return names.select("name", T.to_camel_case(F.col("name")).alias("camel"), T.to_pascal_case(F.col("name")).alias("pascal"))


@query("r32_documents_by_source", f"""
SELECT source, count(*) AS n_docs, count(*) FILTER (WHERE regexp_matches(lower(text), {q(R.CREDENTIAL)})) AS n_indicator,
  count(*) FILTER (WHERE regexp_matches(text, {q(R.NAME_SECRET)}) OR regexp_matches(text, {q(R.VALUE_SECRET)})) AS n_hard_coded
FROM documents GROUP BY source""")
def documents_by_source(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count(F.when(R.credential_indicator(text), 1)).alias("n_indicator"),
        F.count(F.when(R.assigned_credential(text), 1)).alias("n_hard_coded"))


@query("r33_database_credential_documents", f"""
SELECT doc_id, {m(R.DB_USER, 'text')} AS has_user, {m(R.DB_PASSWORD, 'text')} AS has_password, {m(R.JDBC_URL, 'text')} AS has_url FROM documents""")
def _(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", t.rlike(R.DB_USER).alias("has_user"),
                                                t.rlike(R.DB_PASSWORD).alias("has_password"), t.rlike(R.JDBC_URL).alias("has_url"))


@query("r34_redact_documents", f"""
SELECT doc_id, regexp_replace(regexp_replace(text, {q(R.NAME_SECRET)}, '\\1***\\3', 'g'), {q(R.VALUE_SECRET)}, '\\1***\\3', 'g') AS text
FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.redact_assignments(F.col("text")).alias("text"))


@query("r34_rewrite_with_comments", with_tables("cl", f"""r AS (
  SELECT file_id, line_no, 0 AS sub, CASE WHEN {DETECT_SQL['R34']} THEN {REWRITE_SQL['R34']} ELSE line END AS line FROM cl
  UNION ALL SELECT file_id, line_no, -1, concat('// Set ', {CRED_VAR}, ' environment variable with a secure password')
  FROM cl WHERE {DETECT_SQL['R34']})""", body="""
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line_no, sub) AS INT) AS line_no, line FROM r"""))
def _(spark, sf):
    lines = code_lines(spark, sf)
    return L.insert_after(R.rewrite(lines, "R34"), R.credential_comments(lines))


@query("s6_changed_files", with_tables("cl", f"""n AS (
  SELECT file_id, string_agg(line, chr(10) ORDER BY line_no) AS old,
         string_agg(CASE WHEN {DETECT_SQL['R20']} THEN {REWRITE_SQL['R20']} ELSE line END, chr(10) ORDER BY line_no) AS text
  FROM cl GROUP BY 1)""", body="SELECT file_id, text FROM n WHERE text <> old"))
def _(spark, sf):
    from rulewright.sources.sinks import changed_files
    lines = code_lines(spark, sf)
    return changed_files(L.assemble(lines), L.assemble(R.rewrite(lines, "R20")))


@query("s6_changed_lines", with_tables("cl", f"""n AS (
  SELECT file_id, line_no, line AS old, CASE WHEN {DETECT_SQL['R20']} THEN {REWRITE_SQL['R20']} ELSE line END AS line FROM cl)""", body="""
SELECT file_id, line_no, line FROM n WHERE file_id IN (SELECT file_id FROM n WHERE line <> old)"""))
def _(spark, sf):
    from rulewright.sources.sinks import changed_lines
    lines = code_lines(spark, sf)
    return changed_lines(lines, R.rewrite(lines, "R20"))
