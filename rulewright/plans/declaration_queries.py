"""Queries for declarations and the dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.functions.fixed_values import COMMON_TYPES, PRIMITIVE_TYPES
from rulewright.operators import code as C
from rulewright.operators import declarations as D
from rulewright.operators import graph as G
from rulewright.operators import lines as L
from rulewright.operators import metrics as M
from rulewright.plans.line_queries import CODE_SQL, STMT_SQL
from rulewright.plans.registry import query, quoted as q, with_tables
from rulewright.sources.derived import code_lines, dep_edges, written_lines


def re2(pattern):
    """The pattern without possessive repeats, which the comparison engine neither has nor needs."""
    return pattern.replace("*+", "*").replace("++", "+")


def x(pattern, group, c="line"):
    return f"regexp_extract({c}, {q(re2(pattern))}, {group})"


def m(pattern, c="line"):
    return f"regexp_matches({c}, {q(re2(pattern))})"


def listed(words):
    return "(" + ", ".join(map(q, words)) + ")"


def trimmed(c):
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


PACKAGE_SQL = f"""pk AS (SELECT file_id, arg_min({x(D.PACKAGE, 1)}, line_no) AS package FROM cl WHERE {m(D.PACKAGE)} GROUP BY 1)"""

IMPORT_SQL = f"""im AS (
  SELECT file_id, line_no, {x(D.IMPORT, 2)} AS path, split_part({x(D.IMPORT, 2)}, '.', -1) AS simple_name,
    coalesce({x(D.IMPORT, 1)}, '') <> '' AS is_static, ends_with({x(D.IMPORT, 2)}, '.*') AS is_wildcard
  FROM cl WHERE {m(D.IMPORT)})"""

def head(c="text"):
    return f"regexp_replace({c}, {q(re2(D.NOTES))}, '')"


def cut(text, opens="(<[{", closes=")>]}", begins=None):
    """Pieces of a list between the commas outside all brackets."""
    surplus = f"length(translate(p, '{closes}', '')) - length(translate(p, '{opens}', ''))"
    fresh = "a.d <= 0" + (f" AND {m(begins, 'b.l[1]')}" if begins else "")
    return (f"list_filter(list_reduce(list_transform(string_split({text}, ','), lambda p: {{'l': [p], 'd': {surplus}}}), "
            f"lambda a, b: CASE WHEN {fresh} THEN {{'l': list_concat(a.l, b.l), 'd': b.d}} "
            f"ELSE {{'l': list_concat(a.l[1:-2], [concat(a.l[-1], ',', b.l[1])]), 'd': a.d + b.d}} END).l, lambda p: trim(p) <> '')")


TYPE_SQL = PACKAGE_SQL + f""",
ty AS MATERIALIZED (
  SELECT sm.file_id, {x(D.TYPE, 3, head())} AS name, concat(coalesce(package || '.', ''), {x(D.TYPE, 3, head())}) AS qualified_name,
    coalesce(package, '') AS package, {x(D.TYPE, 2, head())} AS kind, {head()} AS h, regexp_extract(text, {q(re2(D.NOTES))}, 0) AS notes,
    ({x(D.TYPE, 2, head())} = 'interface' OR contains({x(D.TYPE, 1, head())}, 'abstract')) AS is_abstract, start_line, end_line
  FROM sm LEFT JOIN pk USING (file_id) WHERE term = '{{' AND {m(D.TYPE, head())})"""

OWNER = f"CASE WHEN {m(D.TYPE, head('parent_text'))} THEN {x(D.TYPE, 3, head('parent_text'))} ELSE '' END"


def _params(i):
    clean = f"regexp_replace({trimmed('p')}, {q(re2(f'^(?:final |{C.NOTE} ?)+'))}, '')"
    return f"list_transform({cut('params')}, lambda p: regexp_extract({clean}, '^(.*?)\\s*([A-Za-z_][A-Za-z0-9_]*)$', {i}))"


METHOD_SQL = f"""m0 AS (
  SELECT file_id, stmt_no, start_line, line_no, end_line, end_no, empty, coalesce({OWNER}, '') AS class_name, {x(D.METHOD, 1, head())} AS mods, {trimmed(x(D.METHOD, 3, head()))} AS ret,
    {x(D.METHOD, 4, head())} AS nm, {x(D.METHOD, 5, head())} AS params, term AS op FROM sm WHERE term IN ('{{', ';') AND contains(text, '(') AND {m(D.METHOD, head())}),
m1 AS (SELECT *, ret = '' AND nm = class_name AS ctor, {_params(2)} AS pn, {_params(1)} AS pt FROM m0),
mr AS MATERIALIZED (
  SELECT file_id, class_name, CASE WHEN ctor THEN concat('<init>', nm, '(', array_to_string(pt, ','), ')') ELSE nm END AS name,
    pn AS parameter_names, pt AS parameter_types, CASE WHEN ctor THEN 'void' ELSE ret END AS return_type,
    list_filter(string_split_regex(lower({trimmed('mods')}), '\\s+'), lambda s: s <> '') AS modifiers,
    start_line, CASE WHEN op = ';' THEN line_no ELSE end_line END AS end_line, stmt_no, CASE WHEN op = ';' THEN stmt_no ELSE end_no END AS end_no,
    line_no AS body_line, empty, op AS term
  FROM m1 WHERE nm NOT IN {listed(D.NOT_A_NAME)} AND ret NOT IN {listed(D.NOT_A_TYPE)} AND (ret <> '' OR ctor)
    AND (mods <> '' OR class_name <> '')),
me AS (SELECT * EXCLUDE (stmt_no, end_no, body_line, empty, term) FROM mr)"""


def variables_sql(name, source, keep):
    cols = "".join(f"{k}, " for k in keep)
    return f"""{name} AS MATERIALIZED (
  SELECT file_id, {cols}regexp_extract(d, '^\\s*([A-Za-z_][A-Za-z0-9_]*)', 1) AS name, type_name,
    contains(d, '=') AS has_initializer, start_line AS declaration_line
  FROM (SELECT file_id, {cols}start_line, {x(D.VARIABLE, 2, head())} AS type_name, unnest({cut(x(D.VARIABLE, 3, head()), '([{', ')]}', D.DECLARATOR)}) AS d
        FROM {source} WHERE (term = ';' OR (term = '{{' AND {m(D.ARRAY_START, 'text')})) AND {m(D.VARIABLE, head())} AND {x(D.VARIABLE, 2, head())} NOT IN {listed(D.NOT_A_TYPE)}))"""


FIELD_SQL = f"""f0 AS (SELECT *, {x(D.TYPE, 3, head('parent_text'))} AS class_name FROM sm WHERE {m(D.TYPE, head('parent_text'))}),
""" + variables_sql("fl", "f0", ["class_name"])

CALL_SQL = f"""c0 AS (
  SELECT file_id, line_no, line, code, regexp_extract_all(code, {q(D.CALL_NAME)}, 1) AS ts, regexp_extract_all(code, {q(D.CALL_ARGS)}, 1) AS args,
    string_split_regex(code, '\\([^()]*') AS gaps FROM ct WHERE contains(code, '(')),
c1 AS (SELECT file_id, line_no, line, code, generate_subscripts(ts, 1) - 1 AS call_no, unnest(ts) AS t, unnest(args) AS a, unnest(gaps[1:len(ts)]) AS g FROM c0),
c2 AS (SELECT *, sum(length(g) + 1 + length(a)) OVER (PARTITION BY file_id, line_no ORDER BY call_no) - length(a) AS upto FROM c1),
c3 AS (SELECT file_id, line_no, call_no, generate_subscripts(string_split(a, ','), 1) AS i, unnest(string_split(a, ',')) AS p, upto, line FROM c2),
c4 AS (SELECT *, sum(length(p) + 1) OVER (PARTITION BY file_id, line_no, call_no ORDER BY i) - length(p) - 1 AS o FROM c3),
c5 AS (SELECT file_id, line_no, call_no, string_agg({trimmed('substr(line, CAST(upto + o + 1 AS INT), length(p))')}, ', ' ORDER BY i)
    FILTER ({trimmed('substr(line, CAST(upto + o + 1 AS INT), length(p))')} <> '') AS arguments FROM c4 GROUP BY 1, 2, 3),
ca AS (
  SELECT file_id, line_no, CAST(call_no AS INT) AS call_no, split_part(t, '.', -1) AS method_name,
    CASE WHEN contains(t, '.') THEN split_part(t, '.', 1) END AS receiver, coalesce(arguments, '') AS arguments
  FROM c1 JOIN c5 USING (file_id, line_no, call_no) WHERE regexp_matches(split_part(t, '.', -1), '^[A-Za-z_]') AND split_part(t, '.', -1) NOT IN {listed(D.NOT_A_NAME)}
    AND NOT ({m(D.DECLARED, 'code')} AND {x(D.DECLARED, 1, 'code')} NOT IN {listed(D.NOT_A_TYPE)} AND {x(D.DECLARED, 2, 'code')} = split_part(t, '.', -1)))"""


def corpus(spark, sf):
    """Line table and statements."""
    lines = written_lines(spark, sf)
    return lines, C.statements(lines)


def blocks(spark, sf):
    """Line table and block structure by line, dealt out for scans."""
    lines = written_lines(spark, sf)
    return lines, L.structure_blocks(lines)


def joined(df: DataFrame, *cols: str) -> DataFrame:
    """Lists as text, for comparison."""
    return df.withColumns({c: F.array_join(c, ", ") for c in cols})


@query("d1_imports", with_tables("cl", IMPORT_SQL, body="SELECT * FROM im"))
def _(spark, sf):
    return D.extract_imports(code_lines(spark, sf))


@query("d1_packages", with_tables("cl", PACKAGE_SQL, body="SELECT * FROM pk"))
def _(spark, sf):
    return D.extract_packages(code_lines(spark, sf))


@query("d2_types", with_tables("cl", STMT_SQL, TYPE_SQL, body="""
SELECT * EXCLUDE (h, notes), CASE WHEN kind = 'interface' THEN coalesce(array_to_string(list_transform(string_split(regexp_extract(h, ' extends (.*)$', 1), ','), lambda p: trim(p)), ', '), '') ELSE '' END AS interfaces,
  array_to_string(regexp_extract_all(notes, '@([A-Za-z0-9_.]+)', 1), ', ') AS annotations FROM ty"""))
def _(spark, sf):
    lines, st = corpus(spark, sf)
    return joined(D.extract_types(st, lines), "interfaces", "annotations")


@query("d3_methods", with_tables("cl", STMT_SQL, METHOD_SQL, body="""
SELECT * REPLACE (array_to_string(parameter_names, ', ') AS parameter_names, array_to_string(parameter_types, ', ') AS parameter_types,
  array_to_string(modifiers, ', ') AS modifiers),
  CASE WHEN len(parameter_types) > 0 THEN concat(name, '#', array_to_string(parameter_types, '#')) ELSE name END AS method_key FROM me"""))
def _(spark, sf):
    methods = D.extract_methods(corpus(spark, sf)[1])
    keyed = methods.withColumn("method_key", D.method_key(F.col("name"), F.col("parameter_types")))
    return joined(keyed, "parameter_names", "parameter_types", "modifiers")


@query("d4_fields", with_tables("cl", STMT_SQL, FIELD_SQL, body="SELECT *, false AS is_enum_constant FROM fl"))
def _(spark, sf):
    return D.extract_fields(corpus(spark, sf)[1])


@query("d5_calls", with_tables("cl", CODE_SQL, CALL_SQL, body="SELECT * FROM ca"))
def _(spark, sf):
    return joined(D.extract_calls(code_lines(spark, sf)), "arguments")


CLASS_SQL = "cm AS (SELECT qualified_name AS class_name, max(file_id) AS file_id FROM ty GROUP BY 1)"
EXACT_SQL = """ed AS (SELECT DISTINCT im.file_id AS src, cm.file_id AS dst FROM im JOIN cm ON im.path = cm.class_name
  WHERE NOT im.is_wildcard AND im.file_id <> cm.file_id)"""
WILD_SQL = """us AS (SELECT DISTINCT file_id AS src, path[:-3] AS prefix FROM im WHERE is_wildcard),
mb AS MATERIALIZED (SELECT DISTINCT prefix, cm.file_id AS dst FROM (SELECT DISTINCT prefix FROM us) p JOIN cm ON starts_with(cm.class_name, p.prefix))"""


def parts(spark, sf):
    return parts_of(written_lines(spark, sf))


def parts_of(lines):
    """Imports and class map."""
    return D.extract_imports(lines), G.class_map(D.type_names(lines))


@query("d6_class_map", with_tables("cl", STMT_SQL, TYPE_SQL, CLASS_SQL, body="SELECT * FROM cm"))
def _(spark, sf):
    return parts(spark, sf)[1]


@query("d7_import_edges", with_tables("cl", STMT_SQL, TYPE_SQL, IMPORT_SQL, CLASS_SQL, EXACT_SQL, body="SELECT * FROM ed"))
def import_edges(spark, sf):
    return G.import_edges(*parts(spark, sf))


@query("d8_wildcard_halves", with_tables("cl", STMT_SQL, TYPE_SQL, IMPORT_SQL, CLASS_SQL, WILD_SQL, body="""
SELECT 'use' AS half, src AS file_id, prefix FROM us UNION ALL SELECT 'member', dst, prefix FROM mb"""))
def _(spark, sf):
    imports, classes = parts(spark, sf)
    uses = G.wildcard_uses(imports)
    members = G.wildcard_members(uses, classes)
    return (uses.select(F.lit("use").alias("half"), F.col("src").alias("file_id"), "prefix")
            .unionByName(members.select(F.lit("member").alias("half"), F.col("dst").alias("file_id"), "prefix")))


@query("d8_wildcard_fanout", with_tables("cl", STMT_SQL, TYPE_SQL, IMPORT_SQL, CLASS_SQL, WILD_SQL, body="""
SELECT src AS file_id, prefix, count(*) AS n_files FROM us JOIN mb USING (prefix) WHERE src <> dst GROUP BY 1, 2"""))
def wildcard_fanout(spark, sf):
    imports, classes = parts(spark, sf)
    uses = G.wildcard_uses(imports)
    return G.wildcard_fanout(uses, G.wildcard_members(uses, classes))


@query("d8_wildcard_fanout_dot", with_tables("cl", STMT_SQL, TYPE_SQL, IMPORT_SQL, CLASS_SQL, """
us AS (SELECT DISTINCT file_id AS src, path[:-3] AS prefix FROM im WHERE is_wildcard),
mb AS (SELECT DISTINCT prefix, cm.file_id AS dst FROM (SELECT DISTINCT prefix FROM us) p JOIN cm ON starts_with(cm.class_name, p.prefix || '.'))""", body="""
SELECT src AS file_id, prefix, count(*) AS n_files FROM us JOIN mb USING (prefix) WHERE src <> dst GROUP BY 1, 2"""))
def _(spark, sf):
    imports, classes = parts(spark, sf)
    uses = G.wildcard_uses(imports)
    return G.wildcard_fanout(uses, G.wildcard_members(uses, classes, boundary="dot"))


@query("d9_degrees", with_tables("dg", body="""
SELECT file_id, CAST(sum(o) AS BIGINT) AS n_dependencies, CAST(sum(i) AS BIGINT) AS n_dependents
FROM (SELECT src AS file_id, 1 AS o, 0 AS i FROM dg UNION ALL SELECT dst, 0, 1 FROM dg) GROUP BY 1"""))
def _(spark, sf):
    return G.degrees(dep_edges(spark, sf))


def _seed_rows(spark):
    return spark.createDataFrame([(35,), (36,), (-1,)], "file_id bigint")


@query("d9_dependents", with_tables("dg", body="SELECT dst AS file_id, src AS used_by FROM dg WHERE dst IN (35, 36, -1)"))
def _(spark, sf):
    return G.dependents(dep_edges(spark, sf), _seed_rows(spark))


@query("d9_dependencies", with_tables("dg", body="SELECT src, dst FROM dg WHERE src IN (35, 36, -1)"))
def _(spark, sf):
    return G.dependencies(dep_edges(spark, sf), _seed_rows(spark))


@query("d9_find_class_file", with_tables("cl", STMT_SQL, TYPE_SQL, IMPORT_SQL, CLASS_SQL, body="""
SELECT class_name, cm.file_id FROM (SELECT DISTINCT path AS class_name FROM im WHERE NOT is_wildcard) LEFT JOIN cm USING (class_name)"""))
def _(spark, sf):
    imports, classes = parts(spark, sf)
    return G.find_class_file(classes, imports.where("NOT is_wildcard").select(F.col("path").alias("class_name")))


IMPACT_SQL = """seeds AS (SELECT unnest([35, 36, -1]) AS seed),
reach AS (
  SELECT seed, src AS file_id FROM seeds JOIN dg ON dst = seed WHERE src <> seed
  UNION SELECT seed, src FROM reach JOIN dg ON dst = reach.file_id WHERE src <> seed)"""


@query("d10_impact", with_tables("dg", IMPACT_SQL, body="""
SELECT r.seed, r.file_id, CASE WHEN EXISTS (SELECT 1 FROM dg WHERE dst = r.seed AND src = r.file_id) THEN 'direct' ELSE 'transitive' END AS kind FROM reach r"""))
def impact(spark, sf):
    return G.impact(dep_edges(spark, sf), _seed_rows(spark))


@query("d10_impact_with_wildcards", with_tables("cl", STMT_SQL, TYPE_SQL, IMPORT_SQL, CLASS_SQL, EXACT_SQL, WILD_SQL, """
hop AS MATERIALIZED (SELECT src AS a, 'f' || dst AS b FROM ed UNION ALL SELECT src, 'p' || prefix FROM us),
seeds AS (SELECT max(file_id) AS seed FROM cm),
reach AS (
  SELECT seed, 'f' || seed AS node FROM seeds
  UNION SELECT seed, n.b FROM reach JOIN (SELECT b AS k, 'f' || a AS b FROM hop UNION ALL SELECT 'f' || dst, 'p' || prefix FROM mb) n ON n.k = reach.node)""", body="""
SELECT seed, CAST(substr(node, 2) AS BIGINT) AS file_id,
  CASE WHEN EXISTS (SELECT 1 FROM ed WHERE dst = seed AND 'f' || src = node)
         OR EXISTS (SELECT 1 FROM us JOIN mb USING (prefix) WHERE dst = seed AND 'f' || src = node) THEN 'direct' ELSE 'transitive' END AS kind
FROM reach WHERE node[1] = 'f' AND node <> 'f' || seed"""))
def _(spark, sf):
    imports, classes = parts(spark, sf)
    uses = G.wildcard_uses(imports)
    members = G.wildcard_members(uses, classes)
    seeds = classes.agg(F.max("file_id").alias("file_id"))
    return G.impact(G.import_edges(imports, classes), seeds, (uses, members))


def _asked(lines):
    """Imported classes, asked for by full path and, from the importing file, by simple name."""
    imports = D.extract_imports(lines).where("NOT is_wildcard").join(D.extract_packages(lines), "file_id", "left")
    both = F.explode(F.array("path", "simple_name")).alias("name")
    return imports.select("file_id", "package", both).distinct()


ASKED_SQL = """ak AS (SELECT DISTINCT im.file_id, package, unnest([path, simple_name]) AS name FROM im LEFT JOIN pk USING (file_id) WHERE NOT is_wildcard),
aq AS (SELECT *, CASE WHEN contains(name, '.') OR coalesce(package, '') = '' THEN name ELSE package || '.' || name END AS qualified_name FROM ak)"""


@query("d11_find_class", with_tables("cl", STMT_SQL, TYPE_SQL, IMPORT_SQL, ASKED_SQL, body="""
SELECT aq.file_id, aq.package, aq.name, aq.qualified_name, t.file_id AS found_file, t.kind AS found_kind, t.start_line AS found_line
FROM aq LEFT JOIN (SELECT * FROM ty QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY file_id, start_line) = 1) t USING (qualified_name)"""))
def _(spark, sf):
    lines, st = corpus(spark, sf)
    return D.find_class(D.extract_types(st, lines), _asked(lines))


@query("d11_find_method", with_tables("cl", STMT_SQL, TYPE_SQL, METHOD_SQL, body="""
SELECT ak.file_id, ak.package, ak.name, CASE WHEN ak.package = '' THEN ak.name ELSE ak.package || '.' || ak.name END AS qualified_name,
  t.file_id AS found_file, t.kind AS found_kind, t.start_line AS found_line, 'helper1' AS method_name, e.return_type, e.start_line AS method_line
FROM (SELECT DISTINCT file_id, package, name FROM ty) ak
LEFT JOIN (SELECT * FROM ty QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY file_id, start_line) = 1) t
  ON t.qualified_name = CASE WHEN ak.package = '' THEN ak.name ELSE ak.package || '.' || ak.name END
LEFT JOIN (SELECT * FROM me WHERE name = 'helper1' QUALIFY row_number() OVER (PARTITION BY file_id, class_name ORDER BY start_line) = 1) e
  ON e.file_id = t.file_id AND e.class_name = t.name"""))
def _(spark, sf):
    lines = written_lines(spark, sf)
    st = M.declarations(C.parse(lines))
    types = D.extract_types(st, lines)
    wanted = types.select("file_id", "package", "name", F.lit("helper1").alias("method_name")).distinct()
    return D.find_method(D.extract_methods(st), types, wanted)


RESOLVE_SQL = f"""nm AS (SELECT DISTINCT file_id, type_name FROM (
    SELECT file_id, type_name FROM fl UNION ALL SELECT file_id, unnest(parameter_types) FROM me
    UNION ALL SELECT file_id, concat(simple_name, '[]') FROM im)),
bs AS (SELECT *, regexp_replace(type_name, '(\\[\\])+$', '') AS base, regexp_extract(type_name, '((?:\\[\\])*)$', 1) AS suffix FROM nm),
ri AS (SELECT file_id, simple_name AS base, max(path) AS p FROM im WHERE NOT is_static AND NOT is_wildcard GROUP BY 1, 2),
rs AS (SELECT package, name AS base, max(qualified_name) AS s FROM ty WHERE package <> '' GROUP BY 1, 2)"""


@query("d12_resolve_types", with_tables("cl", STMT_SQL, TYPE_SQL, METHOD_SQL, FIELD_SQL, IMPORT_SQL, RESOLVE_SQL, body=f"""
SELECT bs.file_id, type_name, concat(CASE WHEN bs.base IN {listed(PRIMITIVE_TYPES)} THEN bs.base
  ELSE coalesce(s, p, CASE WHEN bs.base IN {listed(COMMON_TYPES)} THEN 'java.lang.' || bs.base END, bs.base) END, suffix) AS resolved
FROM bs LEFT JOIN pk USING (file_id) LEFT JOIN ri ON ri.file_id = bs.file_id AND ri.base = bs.base
LEFT JOIN rs ON rs.package = pk.package AND rs.base = bs.base"""))
def _(spark, sf):
    lines = written_lines(spark, sf)
    st, imports = M.declarations(C.parse(lines)), D.extract_imports(lines)
    names = (D.extract_fields(st).select("file_id", "type_name")
             .unionByName(D.extract_methods(st).select("file_id", F.explode("parameter_types").alias("type_name")))
             .unionByName(imports.select("file_id", F.concat("simple_name", F.lit("[]")).alias("type_name"))))
    return D.resolve_types(names, imports, D.extract_types(st, lines), D.extract_packages(lines))
