"""Declarations.

Types, methods and fields are read from statements (:func:`rulewright.operators.code.statements`, here
``stmts``) by pattern: a statement is one line of text whatever its layout in the file, comments and the
insides of literals are blank, and its owner is the block that encloses it. There is no parser, and a
malformed file yields fewer rows, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions.fixed_values import COMMON_TYPES, PRIMITIVE_TYPES
from rulewright.functions.text import has, starts, strip
from rulewright.operators.code import NOTE, code_of, code_text

PACKAGE = r"^\s*package\s+([A-Za-z0-9_.]+)\s*;"
IMPORT = r"^\s*import\s+(static\s+)?([A-Za-z0-9_.]+(?:\.\*)?)\s*;"
ANNOTATION = r"@([A-Za-z0-9_.]+)"
NOTES = rf"^(?:\) ?)?(?:{NOTE} ?)*"
TYPE = (r"^((?:(?:public|private|protected|abstract|final|static|strictfp|sealed) )*)"
        r"(class|interface|enum) ([A-Za-z_][A-Za-z0-9_]*)")
TYPE_LINE = (rf"(?:^|[;{{}}])\s*(?:{NOTE}\s*)*(?:(?:public|private|protected|abstract|final|static|strictfp|sealed)\s+)*"
             r"(?:class|interface|enum)\s+([A-Za-z_][A-Za-z0-9_]*)")
EXTENDS = r"\bextends ([^{]+)$"
GENERIC = r"[A-Za-z_][A-Za-z0-9_.]*(?: ?<[^()=;]*>)?(?: ?\[ ?\])*"
TYPE_PARAMETERS = r"<(?:[^<>()=;]|<(?:[^<>()=;]|<[^<>()=;]*>)*+>)*+>"
METHOD = (r"^((?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp) )*)"
          rf"({TYPE_PARAMETERS} ?)?((?:{GENERIC} )?)([A-Za-z_][A-Za-z0-9_]*) ?\((.*)\)(?: ?\[ ?\])*(?: throws [^()]*)?(?: default .*)?$")
_ONE = r"[A-Za-z_][A-Za-z0-9_]*"
VARIABLE = (r"^((?:(?:public|private|protected|static|final|transient|volatile) )*)"
            rf"({GENERIC}) ({_ONE}(?: ?\[ ?\])*(?: ?[=,].*)?)$")
DECLARATOR = rf"^\s*{_ONE}(?: ?\[ ?\])*\s*(?:=.*)?$"
ARRAY_START = r"= ?(?:new [^=]*\] ?)?$"
ENUM_CONSTANTS = r"^\s*[A-Z][A-Z0-9_]*(?:\s*\([^()]*\))?(?:\s*,\s*[A-Z][A-Z0-9_]*(?:\s*\([^()]*\))?)*\s*,?\s*$"
ENUM_CONSTANT = r"(?:^|,)\s*([A-Z][A-Z0-9_]*)"
DECLARED = (r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*"
            rf"(?:{TYPE_PARAMETERS}\s*)?"
            r"([A-Za-z_][A-Za-z0-9_.]*)(?:\s*<[^()=;]*>)?(?:\s*\[\s*\])*\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(")
CALL_NAME = r"((?:[A-Za-z0-9_]+\.)?[A-Za-z0-9_]*)\("
CALL_ARGS = r"\(([^()]*)"

# Words that no declaration or call is named after.
NOT_A_TYPE = "return package import throw new else case goto break continue assert".split()
NOT_A_NAME = "if for while switch catch return synchronized new super this else do try throw assert".split()


# D1 ---------------------------------------------------------------------------------------------
def extract_packages(lines: DataFrame) -> DataFrame:
    """Package per file (the first declaration)."""
    found = lines.where(F.col("line").rlike(PACKAGE))
    return found.groupBy("file_id").agg(
        F.regexp_extract(F.min(F.struct("line_no", "line"))["line"], PACKAGE, 1).alias("package"))


def extract_imports(lines: DataFrame) -> DataFrame:
    """One row per import line."""
    path = F.regexp_extract("line", IMPORT, 2)
    return lines.where(F.col("line").rlike(IMPORT)).select(
        "file_id", "line_no", path.alias("path"), F.element_at(F.split(path, r"\."), -1).alias("simple_name"),
        (F.regexp_extract("line", IMPORT, 1) != "").alias("is_static"), F.endswith(path, F.lit(".*")).alias("is_wildcard"))


# D2 ---------------------------------------------------------------------------------------------
def head(c: Column) -> Column:
    """A statement without the annotations in front."""
    return F.when(starts(c, "@", ")"), F.regexp_replace(c, NOTES, "")).otherwise(c)


def type_header(c: Column) -> Column:
    return head(c).rlike(TYPE)


def type_name(c: Column) -> Column:
    return F.regexp_extract(head(c), TYPE, 3)


def _qualified(name: Column) -> Column:
    package = F.coalesce(F.col("package"), F.lit(""))
    return F.when(package == "", name).otherwise(F.concat_ws(".", package, name))


def type_names(lines: DataFrame) -> DataFrame:
    """D2 without extents: which file declares which class. Needs no statements: only lines with a header
    or a comment mark are shuffled."""
    heads = code_of(lines, F.col("line").rlike(r"\b(?:class|interface|enum)\b")).select(
        "file_id", "line_no", F.explode(F.regexp_extract_all("code", F.lit(TYPE_LINE), F.lit(1))).alias("name"))
    return heads.join(extract_packages(lines), "file_id", "left").select(
        "file_id", "line_no", "name", _qualified(F.col("name")).alias("qualified_name"))


def extract_types(stmts: DataFrame, lines: DataFrame) -> DataFrame:
    """Classes, interfaces and enums with their annotations."""
    text = head(F.col("text"))
    kind, mods = F.regexp_extract(text, TYPE, 2), F.regexp_extract(text, TYPE, 1)
    parents = F.transform(top_level(F.regexp_extract(text, EXTENDS, 1)), strip)
    notes = F.regexp_extract_all(F.regexp_extract("text", NOTES, 0), F.lit(ANNOTATION), F.lit(1))
    empty = F.array().cast("array<string>")
    package, name = F.coalesce(F.col("package"), F.lit("")), F.regexp_extract(text, TYPE, 3)
    return stmts.where((F.col("term") == "{") & type_header(F.col("text"))).join(extract_packages(lines), "file_id", "left").select(
        "file_id", name.alias("name"), _qualified(name).alias("qualified_name"), package.alias("package"),
        kind.alias("kind"), ((kind == "interface") | has(mods, "abstract")).alias("is_abstract"),
        F.when((kind == "interface") & text.rlike(EXTENDS), parents).otherwise(empty).alias("interfaces"),
        notes.alias("annotations"), "start_line", "end_line")


# D3 ---------------------------------------------------------------------------------------------
def _surplus(c: Column, opens: str, closes: str) -> Column:
    return F.length(F.translate(c, closes, "")) - F.length(F.translate(c, opens, ""))


def top_level(text: Column, opens: str = "(<[{", closes: str = ")>]}", begins: str | None = None) -> Column:
    """A list cut at the commas outside all brackets; a piece that doesn't look as ``begins`` says goes on the one before."""
    def add(acc, piece):
        fresh = acc["depth"] <= 0
        if begins is not None:
            fresh = fresh & (piece.rlike(begins) | (F.size(acc["list"]) == 0))
        last = F.concat_ws(",", F.try_element_at(acc["list"], F.lit(-1)), piece)
        depth = F.when(fresh, 0).otherwise(acc["depth"]) + _surplus(piece, opens, closes)
        return F.struct(F.when(fresh, F.array_append(acc["list"], piece)).otherwise(
            F.array_append(F.slice(acc["list"], F.lit(1), F.greatest(F.size(acc["list"]) - 1, F.lit(0))), last)).alias("list"), depth.alias("depth"))

    start = F.struct(F.array().cast("array<string>").alias("list"), F.lit(0).alias("depth"))
    return F.filter(F.aggregate(F.split(text, ",", -1), start, add, lambda acc: acc["list"]), lambda p: strip(p) != "")


def parameter_part(i: int, params: Column) -> Column:
    """Names (1) or types (0) of a parameter list text."""
    clean = F.transform(top_level(params), lambda p: F.regexp_replace(strip(p), rf"^(?:final |{NOTE} ?)+", ""))
    return F.transform(clean, lambda p: F.regexp_extract(p, r"^(.*?)\s*([A-Za-z_][A-Za-z0-9_]*)$", i + 1))


def _owner() -> Column:
    parent = F.col("parent_text")
    return F.coalesce(F.when(type_header(parent), type_name(parent)).otherwise(""), F.lit(""))


def method_header() -> Column:
    """Whether a statement is a method or constructor header. The patterns stand in a ``when``, as Spark may take what
    conditions have in common out of an AND and work it out for every statement."""
    text = head(F.col("text"))
    mods, ret, name = F.regexp_extract(text, METHOD, 1), strip(F.regexp_extract(text, METHOD, 3)), F.regexp_extract(text, METHOD, 4)
    sound = ~name.isin(NOT_A_NAME) & ~ret.isin(NOT_A_TYPE) & ((ret != "") | (name == _owner())) & ((mods != "") | (_owner() != ""))
    likely = F.col("term").isin("{", ";") & F.contains(F.col("text"), F.lit("("))
    return F.when(likely, F.when(text.rlike(METHOD), sound).otherwise(False)).otherwise(False)


def is_constructor() -> Column:
    """Of a statement that is a :func:`method_header`."""
    text = head(F.col("text"))
    return (strip(F.regexp_extract(text, METHOD, 3)) == "") & (F.regexp_extract(text, METHOD, 4) == _owner())


def method_name() -> Column:
    """Of a statement that is a :func:`method_header`."""
    text = head(F.col("text"))
    name, types = F.regexp_extract(text, METHOD, 4), parameter_part(0, F.regexp_extract(text, METHOD, 5))
    return F.when(is_constructor(), F.concat(F.lit("<init>"), name, F.lit("("), F.array_join(types, ","), F.lit(")"))).otherwise(name)


def parameter_names() -> Column:
    """Of a statement that is a :func:`method_header`."""
    return parameter_part(1, F.regexp_extract(head(F.col("text")), METHOD, 5))


def method_rows(stmts: DataFrame) -> DataFrame:
    """The columns of :func:`extract_methods`, with ``stmt_no``, ``end_no``, the line of the opening brace
    (``body_line``) and whether the body is ``empty``."""
    text = head(F.col("text"))
    part = {n: F.regexp_extract(text, METHOD, i) for i, n in ((1, "mods"), (3, "ret"), (4, "name"), (5, "params"))}
    rows = stmts.where(method_header()).select("file_id", "stmt_no", "start_line", "line_no", "term", "end_line", "end_no", "empty",
                                               _owner().alias("class_name"), *[v.alias(k) for k, v in part.items()])
    rows = rows.withColumn("ret", strip(F.col("ret")))
    ctor, types = (F.col("ret") == "") & (F.col("name") == F.col("class_name")), parameter_part(0, F.col("params"))
    closed = F.col("term") == ";"
    return rows.select(
        "file_id", "class_name",
        F.when(ctor, F.concat(F.lit("<init>"), F.col("name"), F.lit("("), F.array_join(types, ","), F.lit(")")))
        .otherwise(F.col("name")).alias("name"),
        parameter_part(1, F.col("params")).alias("parameter_names"), types.alias("parameter_types"),
        F.when(ctor, "void").otherwise(F.col("ret")).alias("return_type"),
        F.filter(F.split(F.lower(strip(F.col("mods"))), r"\s+"), lambda x: x != "").alias("modifiers"),
        "start_line", F.when(closed, F.col("line_no")).otherwise(F.col("end_line")).alias("end_line"),
        "stmt_no", F.when(closed, F.col("stmt_no")).otherwise(F.col("end_no")).alias("end_no"), F.col("line_no").alias("body_line"), "empty", "term")


def extract_methods(stmts: DataFrame) -> DataFrame:
    """D3: methods and constructors. A constructor is ``<init>Name(types)`` and returns void.

    A header counts when it has a modifier or lies directly in a type; ``class_name`` is the
    enclosing type, empty when the header lies in some other block. A method without a matching
    closing brace has no ``end_line``.
    """
    return method_rows(stmts).drop("stmt_no", "end_no", "body_line", "empty", "term")


def method_key(name: Column, types: Column) -> Column:
    """Overloads are told apart by their parameter types."""
    return F.when(F.size(types) > 0, F.concat(name, F.lit("#"), F.array_join(types, "#"))).otherwise(name)


# D4 ---------------------------------------------------------------------------------------------
def declares_variables() -> Column:
    text = head(F.col("text"))
    ends = (F.col("term") == ";") | ((F.col("term") == "{") & F.col("text").rlike(ARRAY_START))
    known = F.when(text.rlike(VARIABLE), ~F.regexp_extract(text, VARIABLE, 2).isin(NOT_A_TYPE)).otherwise(False)
    return F.when(ends & has(F.col("text"), " "), known).otherwise(False)


def variables() -> Column:
    """The variables (name, type_name, has_initializer) a statement declares; null where it declares none."""
    text = head(F.col("text"))
    parts = top_level(F.regexp_extract(text, VARIABLE, 3), "([{", ")]}", DECLARATOR)
    return F.when(declares_variables(), F.transform(parts, lambda d: F.struct(
        F.regexp_extract(d, rf"^\s*({_ONE})", 1).alias("name"), F.regexp_extract(text, VARIABLE, 2).alias("type_name"), has(d, "=").alias("has_initializer"))))


def variable_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per declarator of every variable declaration among statements."""
    return rows.select("file_id", *keep, "start_line", F.explode(variables()).alias("_v")).select(
        "file_id", *keep, "_v.*", F.col("start_line").alias("declaration_line"))


def in_enum() -> Column:
    parent = F.col("parent_text")
    return F.when(has(parent, "enum "), F.regexp_extract(head(parent), TYPE, 2) == "enum").otherwise(False)


def extract_fields(stmts: DataFrame) -> DataFrame:
    """Fields (declarations directly in a type) and enum constants, one row per name. Both are read from a
    statement at once, so the statements are read once."""
    parent = F.col("parent_text")
    inside = stmts.where(type_header(parent)).withColumn("class_name", type_name(parent))
    item = lambda name, kind, value, line, constant: F.struct(
        name.alias("name"), kind.alias("type_name"), value.alias("has_initializer"), line.alias("declaration_line"), F.lit(constant).alias("is_enum_constant"))
    fields = F.transform(variables(), lambda v: item(v["name"], v["type_name"], v["has_initializer"], F.col("start_line"), False))
    names = lambda p: F.regexp_extract_all(F.regexp_replace(p["text"], r"\([^()]*\)", ""), F.lit(ENUM_CONSTANT), F.lit(1))
    constants = F.when(in_enum(), F.flatten(F.transform(
        F.filter("parts", lambda p: p["text"].rlike(ENUM_CONSTANTS)),
        lambda p: F.transform(names(p), lambda n: item(n, F.col("class_name"), F.lit(True), p["line_no"], True)))))
    return inside.select("file_id", "class_name", F.explode(F.flatten(F.array_compact(F.array(fields, constants)))).alias("_f")).select(
        "file_id", "class_name", "_f.*")


# D5 ---------------------------------------------------------------------------------------------
def extract_calls(lines: DataFrame) -> DataFrame:
    """One row per call in the code; the arguments are the line's text up to the next bracket, cut at
    the commas of the code."""
    code = F.col("code")
    pairs = F.arrays_zip(F.regexp_extract_all(code, F.lit(CALL_NAME), F.lit(1)).alias("t"),
                         F.regexp_extract_all(code, F.lit(CALL_ARGS), F.lit(1)).alias("a"), F.slice(F.split(code, r"\([^()]*", -1), 1, 1 << 30).alias("g"))
    target = F.col("_c.t")
    name = F.element_at(F.split(target, r"\."), -1)
    declared = code.rlike(DECLARED) & ~F.regexp_extract(code, DECLARED, 1).isin(NOT_A_TYPE)
    own = F.coalesce(declared & (F.regexp_extract(code, DECLARED, 2) == name), F.lit(False))
    # Where the arguments stand: behind what comes before the bracket. Literals are blank in the code, so they are cut out of the line.
    upto = F.aggregate(F.slice("_all", F.lit(1), F.col("call_no")), F.lit(0), lambda n, c: n + F.length(c["g"]) + F.length(c["a"]) + 1) + F.length("_c.g") + 2
    raw = F.substring(F.col("line"), upto, F.length("_c.a"))
    pieces = F.split(F.col("_c.a"), ",", -1)
    at = lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p) + 1)
    args = F.transform(pieces, lambda p, i: strip(F.substring(raw, at(i) + 1, F.length(p))))
    return (code_text(lines).where(has(code, "(")).select("file_id", "line_no", "line", "code", pairs.alias("_all"))
            .select("*", F.posexplode("_all").alias("call_no", "_c"))
            .where(name.rlike("^[A-Za-z_]") & ~name.isin(NOT_A_NAME) & ~own)
            .select("file_id", "line_no", "call_no", name.alias("method_name"),
                    F.when(has(target, "."), F.element_at(F.split(target, r"\."), 1)).alias("receiver"),
                    F.filter(args, lambda x: x != "").alias("arguments")))


# D11 --------------------------------------------------------------------------------------------
def find_class(types: DataFrame, wanted: DataFrame) -> DataFrame:
    """Look up names (file_id, package, name); a simple name is taken from the asker's package.

    Every name gets one answer: of several files that declare the class the one with the smallest id, and
    nulls where none does. The lookup side has one row per name."""
    name, package = F.col("name"), F.coalesce("package", F.lit(""))
    full = F.when(has(name, ".") | (package == ""), name).otherwise(F.concat_ws(".", package, name))
    first = F.min(F.struct(F.col("file_id").alias("found_file"), F.col("start_line").alias("found_line"), F.col("kind").alias("found_kind")))
    target = types.groupBy("qualified_name").agg(first.alias("_f"))
    return wanted.withColumn("qualified_name", full).join(target, "qualified_name", "left").select(
        "qualified_name", *wanted.columns, "_f.found_file", "_f.found_kind", "_f.found_line")


def find_method(methods: DataFrame, types: DataFrame, wanted: DataFrame) -> DataFrame:
    """Look up (file_id, package, name, method_name) - a class name, then a method of it. Every name gets
    one answer: of overloads the first in the file, nulls where the class or the method isn't known."""
    hit = find_class(types, wanted).withColumn("_c", F.element_at(F.split("qualified_name", r"\."), -1))
    target = methods.groupBy(F.col("file_id").alias("found_file"), F.element_at(F.split("class_name", r"\."), -1).alias("_c"),
                             F.col("name").alias("method_name")).agg(F.min(F.struct("start_line", "return_type")).alias("_m"))
    return hit.join(target, ["found_file", "_c", "method_name"], "left").select(
        *hit.drop("_c").columns, F.col("_m.return_type").alias("return_type"), F.col("_m.start_line").alias("method_line"))


def find_variables(locals_: DataFrame, methods: DataFrame) -> DataFrame:
    """The variable every name of a method stands for, locals before parameters."""
    params = methods.select("file_id", F.col("start_line").alias("method_line"),
                            F.explode(F.arrays_zip(F.col("parameter_names").alias("name"),
                                                   F.col("parameter_types").alias("type_name"))).alias("p"))
    rows = (locals_.select("file_id", "method_line", "name", "type_name", F.lit(0).alias("rank"), "declaration_line")
            .unionByName(params.select("file_id", "method_line", "p.name", "p.type_name", F.lit(1).alias("rank"),
                                       F.col("method_line").alias("declaration_line"))))
    best = F.min(F.struct("rank", "declaration_line", "type_name"))
    return rows.groupBy("file_id", "method_line", "name").agg(best.alias("b")).select(
        "file_id", "method_line", "name", F.col("b.type_name").alias("type_name"),
        (F.col("b.rank") == 1).alias("is_parameter"), F.col("b.declaration_line").alias("declaration_line"))


# D12 --------------------------------------------------------------------------------------------
def resolve_types(names: DataFrame, imports: DataFrame, types: DataFrame, packages: DataFrame) -> DataFrame:
    """Full name of each (file_id, type_name): same package, then imports, then built-ins.

    Both lookup sides have one row per key.
    """
    base = F.regexp_replace("type_name", r"(\[\])+$", "")
    suffix = F.regexp_extract("type_name", r"((?:\[\])*)$", 1)
    imported = (imports.where(~F.col("is_static") & ~F.col("is_wildcard"))
                .groupBy("file_id", F.col("simple_name").alias("_base")).agg(F.max("path").alias("_imported")))
    siblings = (types.where(F.col("package") != "").groupBy("package", F.col("name").alias("_base"))
                .agg(F.max("qualified_name").alias("_sibling")))
    rows = (names.select("file_id", "type_name").distinct().withColumns({"_base": base, "_suffix": suffix})
            .join(imported, ["file_id", "_base"], "left").join(packages, "file_id", "left")
            .join(siblings, ["package", "_base"], "left"))
    built_in = F.when(F.col("_base").isin(COMMON_TYPES), F.concat(F.lit("java.lang."), F.col("_base")))
    full = F.when(F.col("_base").isin(PRIMITIVE_TYPES), F.col("_base")).otherwise(
        F.coalesce("_sibling", "_imported", built_in, "_base"))
    return rows.select("file_id", "type_name", F.concat(full, F.col("_suffix")).alias("resolved"))
