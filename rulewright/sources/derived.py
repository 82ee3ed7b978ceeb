"""Tables derived from the given ones, as laid down in FIXTURES.md.

``code_lines`` is a corpus of Java-like files, ``findings`` a table of analysis findings and
``dep_edges`` a dependency graph. Each has a Spark builder and the SQL text the comparison engine
runs; both share the expressions below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.operators.scan import parts_for
from rulewright.sources.scratch import settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Content of a body line, from part p, supplier s and line number n of an order line.
BODY_LINE = """CASE p % 40
  WHEN 0  THEN concat('import org.lib', CAST(p % 20 AS STRING), '.C', CAST(p AS STRING), ';')
  WHEN 1  THEN concat('import org.lib', CAST(s % 20 AS STRING), '.*;')
  WHEN 2  THEN concat('    if (list', CAST(n AS STRING), '.size() == 0) {')
  WHEN 3  THEN '    }'
  WHEN 4  THEN concat('    // TODO: check ', CAST(s AS STRING))
  WHEN 5  THEN concat('    // FIXME ', CAST(s AS STRING))
  WHEN 6  THEN concat('    // old', CAST(n AS STRING), '.call();')
  WHEN 7  THEN concat('    String secret_key = "sk', CAST(p AS STRING), '";')
  WHEN 8  THEN concat('    int v', CAST(s % 3 AS STRING), ' = ', CAST(p AS STRING), ';')
  WHEN 9  THEN concat('    return v', CAST(s % 3 AS STRING), ';')
  WHEN 10 THEN '    for (int i = 0; i < 10; i++) {'
  WHEN 11 THEN concat('    System.out.println("message ', CAST(s % 7 AS STRING), '");')
  WHEN 12 THEN '    if (flag == true) {'
  WHEN 13 THEN '    /* note'
  WHEN 14 THEN '    */'
  WHEN 15 THEN '    } catch (Exception e) { }'
  WHEN 16 THEN concat('    private void helper', CAST(s % 4 AS STRING), '(int a) {')
  WHEN 17 THEN concat('    helper', CAST(s % 4 AS STRING), '(1);')
  WHEN 18 THEN concat('    if (name.equals("admin', CAST(n AS STRING), '")) {')
  WHEN 19 THEN concat('    String url = "jdbc:db://h', CAST(n AS STRING), '/x";')
  WHEN 20 THEN concat('    out += "chunk', CAST(n AS STRING), '";')
  WHEN 21 THEN '    return ok ? true : false;'
  WHEN 22 THEN concat('    boolean e = 0 < items', CAST(n AS STRING), '.size();')
  WHEN 23 THEN concat('    public int my_func', CAST(n AS STRING), '() {')
  WHEN 24 THEN concat('    stmt.execute("SELECT a WHERE id = " + id', CAST(n AS STRING), ' + "");')
  WHEN 25 THEN '    Statement st = conn.createStatement();'
  WHEN 26 THEN '    File f = new File(base + File.separator);'
  WHEN 27 THEN concat('    if (cache.containsKey(k', CAST(n AS STRING), ')) {')
  WHEN 28 THEN concat('    x = cache.get(k', CAST(n AS STRING), ');')
  WHEN 29 THEN concat('    if (code == "A', CAST(n AS STRING), '") {')
  WHEN 30 THEN concat('    return walk', CAST(n AS STRING), '(node);')
  WHEN 31 THEN concat('    String user = "root', CAST(n AS STRING), '"; String password = "pw', CAST(n AS STRING), '";')
  WHEN 32 THEN concat('    String link = host + "/api/v', CAST(n AS STRING), '/" + id;')
  WHEN 33 THEN concat('    String host = "http://h', CAST(n AS STRING), '";')
  WHEN 34 THEN '    } catch (IOException e) {'
  WHEN 35 THEN '    handle(e);'
  WHEN 36 THEN concat('    if (n', CAST(n AS STRING), ' > 0) { return true; } else { return false; }')
  WHEN 37 THEN concat('    if (items', CAST(n AS STRING), '.size() != 0 && a > 2.5) {')
  WHEN 38 THEN concat('    private int Bad_Name', CAST(n AS STRING), ';')
  ELSE         concat('    static class MyException', CAST(n AS STRING), ' extends Exception {') END"""

FINDING_COLUMNS = """event_id AS finding_id,
       CASE event_type WHEN 'signup' THEN 'java:S1118' WHEN 'error' THEN 'java:S1125' WHEN 'click' THEN 'java:S1155'
            WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'java:S100' ELSE 'java:S3776' END ELSE 'java:S1481' END AS rule,
       CASE WHEN event_type = 'view' AND event_id % 2 = 0
            THEN concat('Rename this name ', chr(39), 'my_func', CAST(1 + event_id % 7 AS STRING), chr(39), ' to match the convention')
            ELSE concat('Message ', CAST(event_id % 9 AS STRING)) END AS message,
       concat('org:proj', CAST(user_id % 3 AS STRING), ':src/F', CAST(user_id AS STRING), CASE WHEN event_id % 5 = 0 THEN '.py' ELSE '.java' END) AS component,
       user_id AS file_id,
       CAST(event_id % 10 AS INT) AS line,
       CASE event_id % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'CONFIRMED' WHEN 2 THEN 'REOPENED' ELSE 'RESOLVED' END AS status,
       CASE event_id % 3 WHEN 0 THEN 'MAJOR' WHEN 1 THEN 'MINOR' ELSE 'INFO' END AS severity"""

CODE_LINES_SQL = f"""WITH body AS (
  SELECT l_orderkey AS f, l_partkey AS p, l_suppkey AS s, l_linenumber AS n,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM lineitem),
files AS (SELECT DISTINCT l_orderkey AS f FROM lineitem)
SELECT f AS file_id, CAST(1 AS INT) AS line_no, concat('package org.lib', CAST(f % 20 AS STRING), ';') AS line FROM files
UNION ALL
SELECT f, CAST(2 AS INT), concat('public class C', CAST(f AS STRING), ' {{') FROM files
UNION ALL
SELECT f, CAST(rn + 2 AS INT), {BODY_LINE} FROM body"""

FINDINGS_SQL = f"SELECT {FINDING_COLUMNS} FROM events"

# A complete small file for every user of events, with something for several rules at fixed lines.
UNIT_LINES = """array(
    concat('package org.unit', CAST(u % 5 AS STRING), ';'),
    concat('public final class U', CAST(u AS STRING), ' {'),
    '    private boolean ready; // set later',
    concat('    int my_func', CAST(1 + u % 7 AS STRING), '(java.util.List list) {'),
    '        if (ready == true) { list.clear(); }',
    '        boolean none = list.size() == 0;',
    concat('        int spare', CAST(u % 3 AS STRING), ' = 1;'),
    CASE WHEN u % 3 = 0 THEN '        list.add(\")\");' ELSE '        list.add(none);' END,
    CASE WHEN u % 11 = 0 THEN '        return none ? 0 : 1; }' ELSE '        return none ? 0 : 1;' END,
    '    }', '}')"""
UNIT_LINES_SQL = f"""SELECT u AS file_id, CAST(generate_subscripts(ls, 1) AS INT) AS line_no, unnest(ls) AS line
FROM (SELECT u, {UNIT_LINES.replace('array(', 'list_value(', 1)} AS ls FROM (SELECT DISTINCT user_id AS u FROM events))"""

DEP_EDGES_SQL = """SELECT DISTINCT l_partkey AS src, l_suppkey * 20 - l_linenumber AS dst
FROM lineitem
WHERE l_partkey <> l_suppkey * 20 - l_linenumber"""


def code_lines(spark: SparkSession, sf_dir: str, counted: bool = False) -> DataFrame:
    """CL: files of numbered lines. One shuffle: the first body line of a file brings its header. ``counted`` deals the
    order lines out in parts of a fixed size, which don't grow with the table, where Spark would choose them."""
    orders = table(spark, sf_dir, "lineitem")
    if counted:
        orders = orders.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").repartition(
            parts_for(orders.count()), "l_orderkey")
    body = orders.selectExpr(
        "l_orderkey AS f", "l_partkey AS p", "l_suppkey AS s", "l_linenumber AS n",
        "row_number() OVER (PARTITION BY l_orderkey "
        "ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn")
    own = F.struct((F.col("rn") + 2).alias("line_no"), F.expr(BODY_LINE).alias("line"))
    head = F.array(
        F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("package org.lib"), F.col("f") % 20, F.lit(";")).alias("line")),
        F.struct(F.lit(2).alias("line_no"), F.concat(F.lit("public class C"), F.col("f"), F.lit(" {")).alias("line")),
        own)
    rows = body.select("f", F.explode(F.when(F.col("rn") == 1, head).otherwise(F.array(own))).alias("r"))
    return rows.select(F.col("f").alias("file_id"), F.col("r.line_no").cast("int").alias("line_no"), "r.line")


def written_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CL, written once and read back: each reading of :func:`code_lines` would sort the order lines and put the lines'
    texts together anew."""
    return settled(code_lines(spark, sf_dir, counted=True))


def unit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CU: one complete file per user."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct()
    return users.select(F.col("u").alias("file_id"), F.posexplode(F.expr(UNIT_LINES)).alias("_p", "line")).select(
        "file_id", (F.col("_p") + 1).alias("line_no"), "line")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FE: one finding per event."""
    return spark.sql(f"SELECT {FINDING_COLUMNS} FROM {{events}}", events=table(spark, sf_dir, "events"))


def dep_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DG: src depends on dst."""
    return (table(spark, sf_dir, "lineitem")
            .selectExpr("l_partkey AS src", "l_suppkey * 20 - l_linenumber AS dst").where("src <> dst").distinct())
