"""Edit table: what findings want to change, conflicts, and one merge.

An edit is (finding_id, file_id, line_no, sub, op, text): ``replace`` or ``delete`` a line, or ``insert``
a text before (``sub`` < 0) or behind (``sub`` > 0) it. Every handler reads the same lines and adds rows;
nothing is rewritten until all edits are known, so no handler depends on another's output or on the order
they run in. A handler looks at the lines its findings name; only renames look up further lines, by token.

Conflicts: each line goes to the finding with the least id that wants to replace or delete it, together
with all findings that want the same; a finding is carried out whole or not at all. Equal insertions are
made once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions.text import indent
from rulewright.operators import file_rules as X
from rulewright.operators import line_rules as R
from rulewright.operators import lines as L
from rulewright.operators.code import statements

LINE_HANDLERS = {server: R.LINE_RULES[rule] for rule, server in R.SERVER_RULE.items() if R.LINE_RULES[rule].rewrite}
FILE_HANDLERS = """java:S1118 java:S1481 java:S1068 java:S100 java:S117 java:S1488 java:S1186 java:S112 java:S1144 java:S2864
 java:S1128 java:S106 java:S109 java:S1192 java:S116 java:S3776""".split()
HANDLED = [*LINE_HANDLERS, *FILE_HANDLERS]


def _edit(rows: DataFrame, op: str | Column, text: Column, sub: int | Column = 0, line: str = "line_no") -> DataFrame:
    op = F.lit(op) if isinstance(op, str) else op
    sub = F.lit(sub) if isinstance(sub, int) else sub
    return rows.select("finding_id", "file_id", F.col(line).cast("int").alias("line_no"), sub.cast("bigint").alias("sub"),
                       op.alias("op"), text.cast("string").alias("text"))


def _line_edits(at: DataFrame) -> list[DataFrame]:
    """Line rules, and the comments that R33 and R34 put above."""
    line = F.col("line")
    text = op = None
    for server, rule in LINE_HANDLERS.items():
        hit, new = (F.col("rule") == server) & rule.detect(line), rule.rewrite(line)
        text = F.when(hit, new) if text is None else text.when(hit, new)
        one = F.when(new.isNull(), "delete").when(new != line, "replace")
        op = F.when(hit, one) if op is None else op.when(hit, one)
    done = at.where(F.col("rule").isin(*LINE_HANDLERS)).withColumns({"_op": op, "_new": text}).where("_op IS NOT NULL")
    notes = F.when(F.col("rule") == R.SERVER_RULE["R34"], F.array(R.credential_comment(line))).when(
        F.col("rule") == R.SERVER_RULE["R33"], R.database_comments(line))
    above = done.select("finding_id", "file_id", "line_no", F.posexplode(notes).alias("_i", "_t"))
    return [_edit(done, F.col("_op"), F.col("_new")), _edit(above, "insert", F.col("_t"), F.col("_i") - 9)]


def _file_edits(named: DataFrame, at: DataFrame, lines: DataFrame) -> list[DataFrame]:
    """Rules that need more than the line: ``named`` are findings, ``at`` findings with their line."""
    rule, key, out = F.col("rule"), ["file_id", "line_no"], []
    of = lambda df, *rules: df.where(rule.isin(*rules))
    file_of = lambda *rules: of(named, *rules).select("finding_id", "file_id")

    anchors = L.class_anchor(lines).where("brace_line IS NOT NULL AND class_name <> ''")
    made = X.private_constructors(lines, anchors).join(file_of("java:S1118"), "file_id")
    out.append(_edit(made, "insert", F.col("line"), F.col("sub")))

    gone = X.unused_locals(lines).select(*key)
    fields = X.unused_private_fields(lines).select(*key)
    imports = X.unused_imports(lines).select(*key)
    for r, doomed in (("java:S1481", gone), ("java:S1068", fields), ("java:S1128", imports)):
        out.append(_edit(of(at, r).join(doomed, key, "left_semi"), "delete", F.lit(None)))

    changes = X.finding_renames(named, lines)
    out.append(_edit(X.renamed_lines(lines, changes), "replace", F.col("new_line")))

    first = X.immediate_returns(lines).join(lines, key)
    both = of(at, "java:S1488").select("finding_id", "file_id", F.explode(F.array("line_no", F.col("line_no") - 1)).alias("line_no")).join(first, key)
    out.append(_edit(both, "replace", F.concat(indent(F.col("line")), F.lit("return "), F.col("expression"), F.lit(";"))))
    out.append(_edit(both.withColumn("line_no", F.col("line_no") + 1), "delete", F.lit(None)))

    note = F.concat(indent(F.col("line")), F.lit("    // Intentionally empty"))
    empty = X.empty_methods(lines, statements(lines)).where("end_line > line_no")
    out.append(_edit(of(named, "java:S1186").join(empty, key), "insert", note, 1))
    log = F.concat(indent(F.col("line")), F.format_string('    log.error("Error occurred: %s", %s);', "exception", "exception"))
    blocks = L.structure_blocks(lines)
    caught = X.swallowed_exceptions(blocks)
    out.append(_edit(of(named, "java:S112").join(caught.drop("end_line"), key), "insert", log, 1))

    unused = X.unused_private_methods(lines).select(*key)
    mark = F.regexp_replace("line", "^(.*?)private ", "$1// TODO: Remove or use this private method: private ")
    out.append(_edit(of(at, "java:S1144").join(unused, key, "left_semi"), "replace", mark))
    get = X.get_instead_of_contains_key(lines).withColumnRenamed("line", "_new")
    out.append(_edit(of(at, "java:S2864").join(get, key).where("_new <> line"), "replace", F.col("_new")))
    frozen = X.freeze_exception_fields(blocks).withColumnRenamed("line", "_new")
    out.append(_edit(of(at, "java:S116").join(frozen, key).where("_new <> line"), "replace", F.col("_new")))

    prints = of(at, "java:S106").where(F.col("line").rlike(X.PRINT))
    out.append(_edit(prints, "replace", F.regexp_replace("line", X.PRINT, "LOGGER.info($1);")))
    extra = X.logger_lines(lines).join(prints.select("finding_id", "file_id"), "file_id")
    out.append(_edit(extra, "insert", F.col("line"), F.col("sub")))

    heads = L.nearest_decl(lines).where("decl_line > 1").select(*key, "decl_line")
    marked = of(named, "java:S3776").join(heads, key).withColumn("line_no", F.col("decl_line"))
    out.append(_edit(marked, "insert", F.lit(X.TODO_COMPLEX), -1))

    brace = anchors.select("file_id", "brace_line", "brace_indent")
    magic = of(at, "java:S109").join(brace, "file_id").withColumn("_new", X.with_named_numbers(F.col("line"))).where("_new <> line")
    out.append(_edit(magic, "replace", F.col("_new")))
    numbers = magic.select("finding_id", "file_id", "brace_line", "brace_indent", F.explode(F.array_distinct(X.numbers_of(F.col("line")))).alias("number"))
    out.append(_edit(numbers, "insert", X.number_declaration(), F.lit(100) + F.pmod(F.xxhash64("number"), F.lit(1 << 40)), "brace_line"))
    twice = X.duplicate_literals(lines).select("file_id", "literal", "constant")
    literal = of(at, "java:S1192").join(brace, "file_id").withColumn("literal", F.explode(F.array_distinct(X.literals_of(F.col("line"))))).join(twice, ["file_id", "literal"])
    cut = F.replace(F.col("line"), F.concat(F.lit('"'), F.col("literal"), F.lit('"')), F.col("constant"))
    one = literal.groupBy("finding_id", "file_id", "line_no").agg(F.min_by(F.struct(cut.alias("new"), "constant", "literal", "brace_line", "brace_indent"), "literal").alias("c"))
    one = one.select("finding_id", "file_id", "line_no", "c.*")
    out.append(_edit(one, "replace", F.col("new")))
    declared = F.format_string('%s    private static final String %s = "%s";', "brace_indent", "constant", "literal")
    out.append(_edit(one, "insert", declared, F.lit(100) + F.pmod(F.xxhash64("literal"), F.lit(1 << 40)), "brace_line"))
    return out


def propose(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """All edits that the handlers of the findings' rules want. ``lines`` should hold the findings' files only."""
    named = findings.select("finding_id", "rule", "message", "file_id", F.col("line").alias("line_no"))
    at = named.join(lines, ["file_id", "line_no"])
    return reduce(DataFrame.unionByName, [*_line_edits(at), *_file_edits(named, at, lines)])


def resolve(edits: DataFrame) -> DataFrame:
    """The edits, with ``ok`` on those of findings that win everywhere. One row per line decides about it."""
    want = F.struct("op", F.coalesce("text", F.lit("")).alias("t"))
    owners = edits.where("op <> 'insert'").groupBy("file_id", "line_no").agg(F.min(F.struct("finding_id", want.alias("want")))["want"].alias("_won"))
    seen = edits.join(owners, ["file_id", "line_no"], "left")
    lost = seen.where((F.col("op") != "insert") & (F.col("_won") != want)).select("finding_id").distinct().withColumn("_lost", F.lit(True))
    return seen.drop("_won").join(lost, "finding_id", "left").withColumn("ok", F.col("_lost").isNull()).drop("_lost")


def merge(lines: DataFrame, edits: DataFrame, block_size: int | None = None) -> DataFrame:
    """The lines after the ``ok`` edits, numbered anew. ``lines`` should hold the edited files only."""
    ok = edits.where("ok")
    change = ok.where("op <> 'insert'").groupBy("file_id", "line_no").agg(F.first("op").alias("_op"), F.first("text").alias("_text"))
    kept = lines.join(change, ["file_id", "line_no"], "left").where("_op IS NULL OR _op = 'replace'").select(
        "file_id", "line_no", F.lit(0).cast("bigint").alias("sub"), F.when(F.col("_op").isNotNull(), F.col("_text")).otherwise(F.col("line")).alias("line"))
    added = ok.where("op = 'insert'").select("file_id", "line_no", "sub", F.col("text").alias("line")).distinct()
    return L.renumber(kept.unionByName(added), block_size=block_size)
