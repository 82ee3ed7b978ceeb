"""Complexity metrics and unused symbols.

``stmts`` are the statements of a corpus (:func:`rulewright.operators.code.statements`): comments and the
insides of literals are blank, so words in them count for nothing. ``method_statements`` assigns every
statement to the method it lies in; everything else is an aggregation or an anti join on top. Reports are
long tables (one row per symbol or metric), so no row collects a whole file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions.text import has, tokens
from rulewright.operators import declarations as D
from rulewright.operators.scan import BLOCK_LINES, Blocks, Last, line_block
from rulewright.sources.scratch import settled

BRANCH = r"\b(?:if|for|while|do|case|catch)\b|\?|&&|\|\|"
WILDCARD = r"([<,]) ?\?"  # a question mark of a generic type decides nothing
NOT_BINARY = r"\+\+|--|[-+*/%&|^]=|->"
OPERATOR = r"==|!=|<=|>=|[-+*/%<>^]"
CONTROL = r"\b(?:if|for|while|do|switch|try|catch)\b|\?"
ASSIGNED = r"([A-Za-z_][A-Za-z0-9_]*)\s*(?:[-+*/%&|^]?=(?:[^=]|$)|\+\+|--)"
METHOD_KEY = ["file_id", "method_line"]


def in_methods(parsed: Blocks) -> DataFrame:
    """All statements, with ``method_line``, ``method_end`` (null: never closed) and whether they are the ``header``;
    outside methods all three are null. ``is_method`` says whether a statement is a method's header at all.

    A statement belongs to the last header at or above it whose block has not ended. ``parsed`` is what
    :func:`rulewright.operators.code.parse` deals out, so this needs no exchange of its own.
    """
    closed = F.col("term") == ";"
    end = F.struct(F.col("stmt_no").alias("no"), F.col("start_line").alias("line"), F.when(closed, F.col("line_no")).otherwise(F.col("end_line")).alias("end"),
                   F.when(closed, F.col("stmt_no")).otherwise(F.col("end_no")).alias("end_no"))
    marked = parsed.map(lambda rows: rows.withColumn("is_method", D.method_header()))
    seen = marked.scan(["stmt_no"], _m=Last(F.when(F.col("is_method"), end))).done()
    inside = F.col("_m").isNotNull() & (F.col("_m.end_no").isNull() | (F.col("stmt_no") <= F.col("_m.end_no")))
    return seen.withColumns({"method_line": F.when(inside, F.col("_m.line")), "method_end": F.when(inside, F.col("_m.end")),
                             "header": F.when(inside, F.col("_m.no") == F.col("stmt_no"))}).drop("_m")


def method_statements(parsed: Blocks) -> DataFrame:
    """The statements of :func:`in_methods` that lie in a method."""
    return in_methods(parsed).where("method_line IS NOT NULL").drop("is_method")


def declarations(parsed: Blocks, decisions: bool = False) -> DataFrame:
    """The statements of :func:`in_methods` that declare a type, a method, a variable or an enum's constants, and with
    ``decisions`` those in methods that hold one; written once.

    Reports that join several kinds of declarations read these few rows again and again, where each reading of
    ``parsed`` would cut the whole corpus into statements anew.
    """
    wanted = [F.col("is_method"), (F.col("term") == "{") & D.type_header(F.col("text")), D.declares_variables(), D.in_enum()]
    if decisions:
        wanted.append(F.col("method_line").isNotNull() & (branches() > 0))
    return settled(in_methods(parsed).where(reduce(lambda a, b: a | b, [F.coalesce(w, F.lit(False)) for w in wanted])).withColumn(
        "parts", F.when(D.in_enum(), F.col("parts"))).drop("is_method"))


def _decisions() -> Column:
    return F.regexp_replace("text", WILDCARD, "$1")


def branches(strict: bool = False) -> Column:
    """M1: decisions in a statement; ``strict`` also counts comparison and arithmetic operators."""
    likely = has(F.col("text"), "if", "for", "while", "do", "case", "catch", "?", "&&", "||")
    n = F.when(likely, F.regexp_count(_decisions(), F.lit(BRANCH))).otherwise(0)
    if strict:
        n = n + F.regexp_count(F.regexp_replace("text", NOT_BINARY, ""), F.lit(OPERATOR))
    return n


def _control() -> Column:
    return F.regexp_count(_decisions(), F.lit(CONTROL))


def _inner_depth() -> Column:
    return F.col("depth") + F.when(F.col("term") == "{", 1).otherwise(0)


def cyclomatic(ms: DataFrame, strict: bool = False) -> DataFrame:
    """M1: one plus the decisions of the method."""
    return ms.groupBy(*METHOD_KEY).agg((F.sum(branches(strict)) + 1).alias("cyclomatic"))


def cognitive(ms: DataFrame) -> DataFrame:
    """M2: every control word costs one plus the control blocks around it within its method."""
    return method_metrics(ms).select(*METHOD_KEY, "cognitive")


def line_counts(lines: DataFrame, stmts: DataFrame) -> DataFrame:
    """M3: lines per file, type and method; without an end the count is unknown."""
    span = (F.col("end_line") - F.col("start_line") + 1).cast("bigint").alias("line_count")
    per_file = lines.groupBy("file_id").agg((F.max("line_no") - F.min("line_no") + 1).cast("bigint").alias("line_count")).select(
        "file_id", F.lit("file").alias("kind"), F.lit(1).alias("line_no"), "line_count")
    kind = F.when((F.col("term") == "{") & D.type_header(F.col("text")), "type").when(D.method_header(), "method")
    blocks = stmts.withColumn("kind", kind).where("kind IS NOT NULL")
    return per_file.unionByName(blocks.select("file_id", "kind", F.col("start_line").alias("line_no"), span))


def document_line_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """M3 on texts, without taking them apart."""
    return df.select(id_col, (F.regexp_count(text_col, F.lit("\n")) + 1).cast("bigint").alias("line_count"))


def max_nesting(ms: DataFrame) -> DataFrame:
    """Deepest block inside a method, counted from its body."""
    return method_metrics(ms).select(*METHOD_KEY, "max_nesting")


def method_metrics(ms: DataFrame) -> DataFrame:
    """M1, M2, M3 and M11 of every method in one aggregation over its statements."""
    n, head = _control(), F.col("header")
    per = ms.groupBy(*METHOD_KEY).agg(
        F.sum(branches()).alias("_b"), F.sum(n * (F.col("nesting") + 1)).alias("_all"), F.sum(n).alias("_n"),
        F.max(F.when(head, F.col("nesting"))).alias("_base"), F.max(_inner_depth()).alias("_deep"),
        F.max(F.when(head, _inner_depth())).alias("_body"), F.max(F.greatest("line_no", F.coalesce("method_end", "line_no"))).alias("_last"))
    return per.select(
        *METHOD_KEY, (F.col("_b") + 1).alias("cyclomatic"), (F.col("_all") - F.col("_n") * F.col("_base")).alias("cognitive"),
        (F.col("_last") - F.col("method_line") + 1).cast("bigint").alias("line_count"),
        F.greatest(F.col("_deep") - F.col("_body"), F.lit(0)).alias("max_nesting"))


def file_metrics(files: DataFrame, per_method: DataFrame) -> DataFrame:
    """M4: totals per file, zero where a file has no methods."""
    sums = per_method.groupBy("file_id").agg(
        F.sum("cyclomatic").alias("_t"), F.max("cyclomatic").alias("_m"), F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("bigint")
    return files.select("file_id").distinct().join(sums, "file_id", "left").select(
        "file_id", F.coalesce("_t", zero).alias("total_cyclomatic_complexity"),
        F.coalesce("_m", zero).alias("max_method_cyclomatic_complexity"), F.coalesce("_n", zero).alias("method_count"))


def analyze_complexity(lines: DataFrame, parsed: Blocks, edges: DataFrame) -> DataFrame:
    """M5: the analysis record of every file as rows (file_id, part, name, start_line, end_line, value, depends_on).

    Parts: ``method`` (value = cyclomatic), ``class`` (value = lines), ``dependency`` (depends_on = the file
    depended on, of the type that files have) and the three file metrics.
    """
    stmts, none = declarations(parsed, decisions=True), F.lit(None)
    nothing = none.cast(edges.schema["dst"].dataType).alias("depends_on")
    per_method = cyclomatic(stmts.where("method_line IS NOT NULL")).withColumnRenamed("method_line", "start_line")
    methods = D.extract_methods(stmts).join(per_method, ["file_id", "start_line"])
    name = F.concat_ws(".", F.when(F.col("class_name") != "", F.col("class_name")),
                       D.method_key(F.col("name"), F.col("parameter_types")))
    rows = methods.select("file_id", F.lit("method").alias("part"), name.alias("name"), "start_line", "end_line",
                          F.col("cyclomatic").alias("value"), nothing)
    types = stmts.where((F.col("term") == "{") & D.type_header(F.col("text"))).select(
        "file_id", F.lit("class").alias("part"), D.type_name(F.col("text")).alias("name"), "start_line",
        "end_line", (F.col("end_line") - F.col("start_line") + 1).cast("bigint").alias("value"), nothing)
    deps = edges.select(F.col("src").alias("file_id"), F.lit("dependency").alias("part"), none.cast("string").alias("name"),
                        none.cast("int").alias("start_line"), none.cast("int").alias("end_line"), none.cast("bigint").alias("value"), F.col("dst").alias("depends_on"))
    totals = file_metrics(lines, per_method)
    names = [c for c in totals.columns if c != "file_id"]
    flat = totals.select("file_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("t"))
    flat = flat.select("file_id", F.lit("file").alias("part"), "t.name", none.cast("int").alias("start_line"),
                       none.cast("int").alias("end_line"), "t.value", nothing)
    return rows.unionByName(types).unionByName(deps).unionByName(flat)


# Unused symbols ---------------------------------------------------------------------------------
def named_once(rows: DataFrame, variables: Column, *keys: str) -> DataFrame:
    """The ``variables`` of a statement whose name occurs in no other statement with the same ``keys``; ``_`` names
    are exempt. One reading of ``rows``: a name that occurs once has only its own statement's variables beside it."""
    names = rows.select(*keys, variables.alias("_v"), "text").select(*keys, "_v", F.explode(tokens(F.col("text"))).alias("name"))
    once = names.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("_n"), F.first("_v").alias("_v")).where("_n = 1")
    return once.where(~F.startswith("name", F.lit("_"))).select(*keys, "name", F.explode("_v").alias("_v")).where("_v.name = name")


def unused_fields(stmts: DataFrame) -> DataFrame:
    """M6: fields without initialiser whose name occurs in no other statement; ``_`` names are exempt."""
    parent = F.col("parent_text")
    fields = F.when(D.type_header(parent), F.transform(
        F.filter(D.variables(), lambda v: ~v["has_initializer"]),
        lambda v: F.struct(D.type_name(parent).alias("class_name"), v["name"].alias("name"), v["type_name"].alias("type_name"), F.col("start_line").alias("declaration_line"))))
    return named_once(stmts, fields, "file_id").select("file_id", "_v.*")


def method_variables(ms: DataFrame) -> DataFrame:
    """Local variables of every method, one row per declaration."""
    return D.variable_rows(ms.where("NOT header"), "method_line")


def unused_variables(ms: DataFrame) -> DataFrame:
    """M7: local variables whose name occurs in no other statement of the method."""
    local = F.transform(D.variables(), lambda v: F.struct(v["name"].alias("name"), v["type_name"].alias("type_name"), F.col("start_line").alias("declaration_line")))
    return named_once(ms.where("NOT header"), local, *METHOD_KEY).select(*METHOD_KEY, "_v.*")


def unused_parameters(stmts: DataFrame, ms: DataFrame) -> DataFrame:
    """M8: parameters (except ``_``) that the body of their method never names; a report only.

    ``ms`` holds the headers as well, so ``stmts`` isn't read: a header brings its parameters, the other statements
    the names they use, and both meet in one aggregation. Only headers that begin on one line share a list."""
    names = F.when(F.col("header"), F.when(F.col("term") == "{", D.parameter_names())).otherwise(tokens(F.col("text")))
    rows = ms.select(*METHOD_KEY, F.when(F.col("header"), D.method_name()).alias("method"), F.explode(names).alias("parameter"))
    per = rows.where("parameter <> '_'").groupBy(*METHOD_KEY, "parameter").agg(
        F.max(F.col("method").isNull()).alias("_used"), F.collect_list("method").alias("_methods"))
    return per.where("NOT _used").select(*METHOD_KEY, F.explode("_methods").alias("method"), "parameter")


def symbol_summary(stmts: DataFrame, ms: DataFrame) -> DataFrame:
    """M9: every symbol as (file_id, owner, kind, name, type_name).

    Owners are classes for fields and methods, ``Class.method-key`` for parameters and variables.
    """
    methods = D.extract_methods(stmts)
    key = D.method_key(F.col("name"), F.col("parameter_types"))
    full = F.concat_ws(".", F.when(F.col("class_name") != "", F.col("class_name")), key)
    fields = D.extract_fields(stmts).select("file_id", F.col("class_name").alias("owner"), F.lit("field").alias("kind"), "name", "type_name")
    own = methods.select("file_id", F.col("class_name").alias("owner"), F.lit("method").alias("kind"), key.alias("name"),
                         F.col("return_type").alias("type_name"))
    params = methods.select("file_id", full.alias("owner"), F.explode(F.arrays_zip(
        F.col("parameter_names").alias("n"), F.col("parameter_types").alias("t"))).alias("p")).select(
        "file_id", "owner", F.lit("parameter").alias("kind"), F.col("p.n").alias("name"), F.col("p.t").alias("type_name"))
    owners = methods.select("file_id", F.col("start_line").alias("method_line"), full.alias("owner"))
    variables = method_variables(ms).join(owners, METHOD_KEY).select(
        "file_id", "owner", F.lit("variable").alias("kind"), "name", "type_name").distinct()
    return fields.unionByName(own).unionByName(params).unionByName(variables)


def usage_index(lines: DataFrame, block_size: int = BLOCK_LINES) -> DataFrame:
    """Per file and name the lines it is used on and whether any assigns it.

    One row per block of lines, so a name used everywhere in a huge file has several bounded lists.
    """
    assigned = F.regexp_extract_all("line", F.lit(ASSIGNED), F.lit(1))
    rows = lines.select("file_id", "line_no", line_block("line_no", block_size).alias("block"), assigned.alias("_a"),
                        F.explode(tokens(F.col("line"))).alias("name"))
    return rows.groupBy("file_id", "name", "block").agg(
        F.sort_array(F.collect_list("line_no")).alias("usage_lines"), F.count(F.lit(1)).alias("n_lines"),
        F.max(F.array_contains("_a", F.col("name"))).alias("is_modified"))
