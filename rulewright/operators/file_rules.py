"""Rules that need more of a file than one line.

Names are compared as whole identifiers, not as substrings. ``tokens`` are counted per file and name
with a map-side combine, so a name that fills a third of a corpus is one small row per task.
Rewrites that only remove lines leave gaps in the numbering; those that insert lines renumber.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions.text import (
    has, indent, plain_code, starts, strip, to_camel_case, to_pascal_case, tokens)
from rulewright.operators import declarations as D
from rulewright.operators import lines as L
from rulewright.operators.scan import Blocks, Last, Total, Upcoming, extent, line_block, scan

LINE_COLS = L.LINE_COLS
TODO_COMPLEX = "// TODO: Refactor this method to reduce complexity"
PRIVATE_CONSTRUCTOR = r"\bprivate\s+([A-Za-z0-9_]+)\s*\("
DECLARE = r"^(\s*)[A-Za-z0-9_]+\s+([A-Za-z0-9_]+)\s*=\s*(.+);\s*$"
RETURN_NAME = r"^\s*return\s+([A-Za-z0-9_]+)\s*;\s*$"
LOOP_VARIABLE = r"^\s*([A-Za-z0-9_]+)\s*[+=]"
URL_USE = r"""([A-Za-z0-9_]+)\s*\+\s*['"][^'"+]*['"]"""
URL_TEXT = r"""['"]([^'"+]*)['"]"""
URL_PARAMETER = r"\+\s*([A-Za-z0-9_]+)"
ASSIGNED_NAME = r" ([A-Za-z0-9_]+) ="
URI_BUILDERS = ["UriComponentsBuilder", "URIBuilder", "UriBuilder"]
URI_IMPORT = "import org.springframework.web.util.UriComponentsBuilder;"
CATCH = r"\bcatch\s*\([^()]*?([A-Za-z0-9_]+)\s*\)\s*\{"
NUMBER = r"\b(\d+(?:\.\d+)?(?:[eE][-+]?\d+)?[fFdDlL]?)\b"
PRINT = r"System\.out\.print(?:ln)?\((.*?)\);"
LAST_WORD_BEFORE_PAREN = r"^[^(]*?([^\s(]+)\s*\("
CALLED = r"[. ]([A-Za-z0-9_]+)\("
CONTAINS_KEY = r"([A-Za-z0-9_.]+)\.containsKey\(([^)]+)\)"
ASSIGNED_LOCAL = r"^[^=]*?([^\s=]+)\s*="
FIRST_CALL = r"\breturn\b.*?([A-Za-z_][A-Za-z0-9_]*)\s*\(.*\)"
PIECES = r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"
WORDS = r"([A-Za-z0-9_]+)"
PRIVATE_FIELD = r"^\s*private\s+(?:(?:static|final|transient|volatile)\s+)*[A-Za-z0-9_.<>,\[\]]+\s+([A-Za-z0-9_]+)\s*;"


# Tokens -----------------------------------------------------------------------------------------
def line_tokens(lines: DataFrame) -> DataFrame:
    """Distinct identifiers of every line."""
    return lines.select("file_id", "line_no", F.explode(tokens(F.col("line"))).alias("name"))


def token_lines(lines: DataFrame) -> DataFrame:
    """On how many lines of its file a name occurs."""
    return line_tokens(lines).groupBy("file_id", "name").agg(F.count(F.lit(1)).alias("n_lines"))


def _one_per_file(findings: DataFrame, rule: str) -> DataFrame:
    return findings.where(F.col("rule") == rule).select("file_id").distinct()


def _rebuilt(pieces: DataFrame) -> DataFrame:
    """Lines put together from (file_id, line_no, idx, text) pieces."""
    items = F.sort_array(F.collect_list(F.struct("idx", "text")))
    return pieces.groupBy("file_id", "line_no").agg(
        F.array_join(F.transform(items, lambda p: p["text"]), "").alias("line"))


# R1 ---------------------------------------------------------------------------------------------
def unused_imports(lines: DataFrame) -> DataFrame:
    """Imports whose simple name occurs on no other kind of line; wildcard and static ones stay."""
    imports = D.extract_imports(lines).where("NOT is_static AND NOT is_wildcard")
    used = line_tokens(lines.where(~F.col("line").rlike(D.IMPORT))).select(
        "file_id", F.col("name").alias("simple_name")).distinct()
    return imports.join(used, ["file_id", "simple_name"], "left_anti").select("file_id", "line_no", "path")


def remove_unused_imports(lines: DataFrame) -> DataFrame:
    return L.delete_lines(lines, unused_imports(lines))


# R3 ---------------------------------------------------------------------------------------------
def mark_complex_methods(lines: DataFrame, findings: DataFrame, rule: str = "java:S3776") -> DataFrame:
    """A TODO above the declaration nearest to each finding, once per declaration, never on line 1."""
    named = findings.where(F.col("rule") == rule).select("file_id", F.col("line").alias("line_no")).distinct()
    marks = (L.nearest_decl(lines).join(named, ["file_id", "line_no"], "left_semi").where("decl_line > 1")
             .select("file_id", F.col("decl_line").alias("line_no")).distinct())
    return L.insert_after(lines, marks.select("*", F.lit(-1).alias("sub"), F.lit(TODO_COMPLEX).alias("line")))


# R5 ---------------------------------------------------------------------------------------------
def strip_comments(lines: DataFrame) -> DataFrame:
    """Drop comment lines and block comment regions."""
    return (L.comment_state(lines, opener_first=True)
            .where(~F.col("in_comment") & ~starts(strip(F.col("line")), "/*", "//")).select(*LINE_COLS))


# R6 ---------------------------------------------------------------------------------------------
def add_private_constructor(lines: DataFrame, findings: DataFrame | None = None, rule: str = "java:S1118") -> DataFrame:
    """A private constructor behind the class anchor, unless the file has one for that class."""
    anchors = L.class_anchor(lines).where("brace_line IS NOT NULL AND class_name <> ''")
    if findings is not None:
        anchors = anchors.join(_one_per_file(findings, rule), "file_id", "left_semi")
    return L.insert_after(lines, private_constructors(lines, anchors))


def private_constructors(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rows to insert at each anchor whose class has no private constructor."""
    existing = lines.where(F.col("line").rlike(PRIVATE_CONSTRUCTOR)).select(
        "file_id", F.regexp_extract("line", PRIVATE_CONSTRUCTOR, 1).alias("class_name")).distinct()
    anchors = anchors.join(existing, ["file_id", "class_name"], "left_anti")
    texts = [F.format_string("    private %s() {", "class_name"),
             F.lit("        // Private constructor to prevent instantiation"),
             F.lit('        throw new UnsupportedOperationException("Utility class");'), F.lit("    }")]
    rows = F.array(*[F.concat("brace_indent", t) for t in texts], F.lit(""))
    extra = anchors.select("file_id", F.col("brace_line").alias("line_no"), F.posexplode(rows).alias("_i", "line"))
    return extra.select("file_id", "line_no", (F.col("_i") + 1).alias("sub"), "line")


# R8 ---------------------------------------------------------------------------------------------
def literal_pieces(lines: DataFrame) -> DataFrame:
    """Lines with quotes cut at them; odd pieces that are closed are literals."""
    cut = F.split(F.col("line"), '"', -1)
    return (lines.where(has(F.col("line"), '"'))
            .select("file_id", "line_no", F.size(cut).alias("n"), F.posexplode(cut).alias("idx", "piece"))
            .withColumn("is_literal", (F.col("idx") % 2 == 1) & (F.col("idx") < F.col("n") - 1)))


def literals_of(line: Column, min_length: int = 6) -> Column:
    """The closed literals of a line that have at least ``min_length`` characters."""
    pieces = F.split(line, '"', -1)
    return F.filter(pieces, lambda p, i: (i % 2 == 1) & (i < F.size(pieces) - 1) & (F.length(p) >= min_length))


def duplicate_literals(lines: DataFrame, min_length: int = 6) -> DataFrame:
    """Literals of at least ``min_length`` characters that a file has more than once.

    ``constant`` is a readable name of up to 30 characters; where literals of one file share it, each gets an
    ending made from its whole text.
    """
    found = (literal_pieces(lines).where(F.col("is_literal") & (F.length("piece") >= min_length))
             .groupBy("file_id", F.col("piece").alias("literal"))
             .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "idx")).alias("_first")).where("n > 1"))
    short = F.concat(F.lit("STR_"), F.substring(F.regexp_replace(F.upper("literal"), "[^A-Z0-9]", "_"), 1, 30))
    found = found.withColumn("_short", short)
    shared = found.groupBy("file_id", "_short").agg(F.count(F.lit(1)).alias("_same")).where("_same > 1")
    ending = F.concat(F.lit("_"), F.substring(F.upper(F.md5(F.col("literal").cast("binary"))), 1, 16))
    const = F.concat("_short", F.when(F.col("_same").isNotNull(), ending).otherwise(""))
    return found.join(shared, ["file_id", "_short"], "left").select(
        "file_id", "literal", "n", const.alias("constant"),
        F.col("_first.line_no").alias("first_line"), F.col("_first.idx").alias("first_idx"))


def name_duplicate_literals(lines: DataFrame) -> DataFrame:
    """Declare a constant per duplicate literal behind the class anchor and use it."""
    anchors = L.class_anchor(lines).where("brace_line IS NOT NULL")
    dup = duplicate_literals(lines).join(anchors, "file_id")
    known = dup.select("file_id", F.col("literal").alias("piece"), F.lit(True).alias("is_literal"), "constant")
    piece = F.col("piece")
    text = (F.when(F.col("idx") % 2 == 0, piece).when(F.col("constant").isNotNull(), F.col("constant"))
            .when(F.col("is_literal"), F.concat(F.lit('"'), piece, F.lit('"'))).otherwise(F.concat(F.lit('"'), piece)))
    rebuilt = _rebuilt(literal_pieces(lines).join(known, ["file_id", "piece", "is_literal"], "left").withColumn("text", text))
    body = lines.where(~has(F.col("line"), '"')).unionByName(rebuilt)
    declared = dup.select(
        "file_id", F.col("brace_line").alias("line_no"), L.sub_at(F.col("first_line"), F.col("first_idx")).alias("sub"),
        F.format_string('%s    private static final String %s = "%s";', "brace_indent", "constant", "literal").alias("line"))
    return L.insert_after(body, declared, anchors.select("file_id", F.col("brace_line").alias("anchor")))


# R9 ---------------------------------------------------------------------------------------------
def concat_in_loops(lines: DataFrame) -> DataFrame:
    """Variables that a closed loop builds from string literals, with the number of lines."""
    line = F.col("line")
    grows = has(line, "+=", "= ") & has(line, '"') & line.rlike(LOOP_VARIABLE)
    return (L.loop_regions(lines).where(F.col("closed") & grows)
            .groupBy("file_id", "loop_line", F.regexp_extract("line", LOOP_VARIABLE, 1).alias("variable"))
            .agg(F.count(F.lit(1)).alias("n_lines")))


# R10 --------------------------------------------------------------------------------------------
def _returned(line: Column, following: Column) -> Column:
    return F.coalesce(line.rlike(DECLARE) & following.rlike(RETURN_NAME)
                      & (F.regexp_extract(line, DECLARE, 2) == F.regexp_extract(following, RETURN_NAME, 1)), F.lit(False))


def return_directly(lines: DataFrame) -> DataFrame:
    """``T v = e;`` followed by ``return v;`` becomes ``return e;``."""
    line = F.col("line")
    both = scan(lines, ["file_id"], ["line_no"], _next=Upcoming(line), _prev=Last(line, current=False))
    new = F.when(_returned(line, F.col("_next")),
                 F.concat(indent(line), F.lit("return "), F.regexp_extract("line", DECLARE, 3), F.lit(";"))).otherwise(line)
    return both.where(~_returned(F.col("_prev"), line)).select("file_id", "line_no", new.alias("line"))


def immediate_returns(lines: DataFrame) -> DataFrame:
    """The declarations that are returned on the next line."""
    return (L.with_next(lines).where(_returned(F.col("line"), F.col("next_line")))
            .select("file_id", "line_no", F.regexp_extract("line", DECLARE, 2).alias("variable"),
                    F.regexp_extract("line", DECLARE, 3).alias("expression")))


# R11 --------------------------------------------------------------------------------------------
def url_concatenations(lines: DataFrame, reach: int = 19) -> DataFrame:
    """URLs built by concatenation from a variable defined in the ``reach`` lines before.

    A definition lies in the use's bucket of ``reach + 1`` lines or the one before, so the range join
    is an equality join of small groups.
    """
    size = reach + 1
    bucket = F.floor(F.col("line_no") / size)
    line = F.col("line")
    name = F.regexp_extract("line", URL_USE, 1)
    params = F.filter(F.regexp_extract_all("line", F.lit(URL_PARAMETER), F.lit(1)), lambda p: p != name)
    uses = lines.where(line.rlike(URL_USE)).select(
        "file_id", F.col("line_no").alias("use_line"), name.alias("name"),
        F.regexp_extract("line", URL_TEXT, 1).alias("base_url"), params.alias("params"),
        F.explode(F.array(bucket, bucket - 1)).alias("_b"))
    uses = uses.where((F.col("base_url") != "") & (F.size("params") > 0))
    names = F.array_distinct(F.regexp_extract_all("line", F.lit(ASSIGNED_NAME), F.lit(1)))
    defs = lines.where(has(line, " =")).select("file_id", F.explode(names).alias("name"), bucket.alias("_b"),
                                               F.col("line_no").alias("def_line"), F.col("line").alias("def_text"))
    near = (uses.join(defs, ["file_id", "name", "_b"])
            .where((F.col("def_line") < F.col("use_line")) & (F.col("def_line") >= F.col("use_line") - reach))
            .groupBy("file_id", "use_line", "name", "base_url", "params")
            .agg(F.max(F.struct("def_line", "def_text")).alias("d")))
    return (near.where(~has(F.col("d.def_text"), *URI_BUILDERS))
            .select("file_id", "use_line", "name", "base_url", "params", "d.def_line", "d.def_text"))


def build_urls(lines: DataFrame) -> DataFrame:
    """Replace each definition by a URI builder for its first use and mark that use."""
    found = url_concatenations(lines)
    first = found.groupBy("file_id", "def_line").agg(
        F.min(F.struct("use_line", "name", "base_url", "params", "def_text")).alias("u")).select("file_id", "def_line", "u.*")
    pad = indent(F.col("def_text"))
    head = F.format_string('%sString %s = UriComponentsBuilder.fromHttpUrl("%s")', pad, "name", "base_url")
    heads = first.select("file_id", F.col("def_line").alias("line_no"), head.alias("_head"), F.lit(None).cast("boolean").alias("_use"))
    marks = first.select("file_id", F.col("use_line").alias("line_no"), F.lit(None).cast("string").alias("_head"), F.lit(True).alias("_use"))
    edits = heads.unionByName(marks).groupBy("file_id", "line_no").agg(F.max("_head").alias("_head"), F.max("_use").alias("_use"))
    marked = F.when(F.col("_use"), F.concat(F.col("line"), F.lit("  // Fixed: URL construction made safe"))).otherwise(F.col("line"))
    body = lines.join(edits, ["file_id", "line_no"], "left").select(
        "file_id", "line_no", F.coalesce("_head", marked).alias("line"))
    tail = F.concat(F.transform("params", lambda p: F.format_string('    .queryParam("%s", %s)', p, p)),
                    F.array(F.lit("    .build().toUriString();")))
    builder = first.select("file_id", F.col("def_line").alias("line_no"), pad.alias("_pad"), F.posexplode(tail).alias("_i", "_t"))
    extra = builder.select("file_id", "line_no", (F.col("_i") + 1).alias("sub"), F.concat("_pad", "_t").alias("line"))
    line = F.col("line")
    places = lines.groupBy("file_id").agg(
        F.max(F.when(has(line, "import ") & has(line, ";"), F.col("line_no"))).alias("line_no"),
        F.max(has(line, URI_IMPORT)).alias("_has")).where("line_no IS NOT NULL AND NOT _has")
    imports = places.join(first.select("file_id").distinct(), "file_id", "left_semi").select(
        "file_id", "line_no", F.lit(1 << 19).alias("sub"), F.lit(URI_IMPORT).alias("line"))
    return L.insert_after(body, extra.unionByName(imports))


# R12, R16 ---------------------------------------------------------------------------------------
def _dealt(st: DataFrame | Blocks) -> Blocks:
    return st if isinstance(st, Blocks) else Blocks(st, ["file_id"], [line_block("line_no")])


def interior_counts(st: DataFrame | Blocks, start: Column, **conds: Column) -> DataFrame:
    """For blocks opened on a ``start`` line: how many lines strictly inside meet each condition.

    Differences of running totals at both ends, so long blocks cost no more than short ones. An opening line
    is put at its end line once more and finds the totals there, so dealt rows (:func:`lines.structure_blocks`)
    stay in their parts and nothing is joined.
    """
    dealt = _dealt(st)
    sums = dealt.scan(["line_no"], **{k: Total(c.cast("bigint")) for k, c in conds.items()})
    place = lambda pos, sub: F.struct(F.col(pos).alias("pos"), F.lit(sub).alias("sub"))
    own = F.col("_e.sub") == 0
    opens = start & (F.col("end_line") > F.col("line_no"))

    def events(rows: DataFrame) -> DataFrame:
        places = F.array_compact(F.array(place("line_no", 0), F.when(opens, place("end_line", 1))))
        return rows.withColumn("_e", F.explode(places)).select(
            *dealt.parts, "_e.pos", "_e.sub", "line_no", "end_line", F.when(~own, F.col("line")).alias("line"),
            *[F.when(own, F.col(k) - c.cast("bigint")).otherwise(F.col(k)).alias(k) for k, c in conds.items()])

    both = sums.map(events)  # an end may lie in a later block, so files of several blocks are dealt out again
    both = both if both.whole else Blocks(both.done(), ["file_id"], [line_block("pos")], tasks=dealt.tasks)
    found = both.scan(["pos", "sub"], _at=Last(F.when(F.col("sub") == 0, F.struct(*conds)))).done().where("sub = 1")
    return found.select("file_id", "line_no", "line", "end_line", *[(F.col(f"_at.{k}") - F.col(k)).alias(k) for k in conds])


def empty_methods(lines: DataFrame, stmts: DataFrame) -> DataFrame:
    """Methods with nothing but blanks and comments between their braces, by the line of the opening brace.

    Only lines with a brace can be asked for. Both sides are dealt out in counted parts, as Spark's own grow with the corpus."""
    key, braces = ["file_id", "line_no"], lines.where(has(F.col("line"), "{"))
    tasks = extent(braces)[1]
    found = D.method_rows(stmts).where("empty AND term = '{'").select("file_id", F.col("body_line").alias("line_no"), "end_line")
    return found.repartition(tasks, *key).join(braces.repartition(tasks, *key), key).select("file_id", "line_no", "line", "end_line")


def explain_empty_methods(lines: DataFrame, stmts: DataFrame, message: str = "Empty method") -> DataFrame:
    """Put a comment into empty methods; of a message, the part before ``(`` counts."""
    note = F.concat(indent(F.col("line")), F.lit(f"    // Intentionally empty - {message.split('(')[0].strip()}"))
    whole, tasks = extent(lines)
    return L.insert_after(lines, empty_methods(lines, stmts).where("end_line > line_no").select(
        "file_id", "line_no", F.lit(1).alias("sub"), note.alias("line")), whole=whole, tasks=tasks)


def swallowed_exceptions(st: DataFrame | Blocks) -> DataFrame:
    """Catch blocks with a body that neither logs nor throws."""
    line, code = F.col("line"), F.col("code")
    handled = has(F.lower(code), "log") | has(code, "throw")
    inside = interior_counts(st, code.rlike(CATCH), n_body=strip(line) != "", n_handled=handled)
    return inside.where("n_body > 0 AND n_handled = 0").select(
        "file_id", "line_no", "end_line", "line", F.regexp_extract("line", CATCH, 1).alias("exception"))


def log_swallowed_exceptions(lines: DataFrame, st: DataFrame | Blocks) -> DataFrame:
    """Log the exception on the first line of the block."""
    text = F.concat(indent(F.col("line")), F.format_string('log.error("Error occurred: %s", %s);', "exception", "exception"))
    st = _dealt(st)
    return L.insert_after(lines, swallowed_exceptions(st).select("file_id", "line_no", F.lit(1).alias("sub"), text.alias("line")),
                          whole=st.whole, tasks=st.tasks)


# R13 --------------------------------------------------------------------------------------------
def renames(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, old, new) from messages "Rename this ... 'x'"; the first finding of a name counts."""
    named = findings.where(F.col("rule").isin("java:S100", "java:S117") & has(F.col("message"), "Rename this")
                           & has(F.col("message"), "'"))
    old = F.element_at(F.split("message", "'"), 2)
    at = lines.select("file_id", F.col("line_no").alias("line"), F.col("line").alias("_text"))
    rows = named.select("file_id", "line", "finding_id", "rule", old.alias("old")).join(at, ["file_id", "line"])
    return _renamed(rows).groupBy("file_id", "old").agg(F.min_by("new", F.struct("line", "finding_id")).alias("new"))


def _renamed(rows: DataFrame) -> DataFrame:
    is_class = (F.col("rule") == "java:S100") & ~has(F.col("_text"), "(")
    new = F.when(is_class, to_pascal_case(F.col("old"))).otherwise(to_camel_case(F.col("old")))
    return rows.withColumn("new", new).where("new <> old")


def finding_renames(named: DataFrame, lines: DataFrame) -> DataFrame:
    """R13 by finding: (finding_id, file_id, old, new) for findings (finding_id, rule, message, file_id, line_no)."""
    rows = named.where(F.col("rule").isin("java:S100", "java:S117") & has(F.col("message"), "Rename this") & has(F.col("message"), "'"))
    at = lines.select("file_id", "line_no", F.col("line").alias("_text"))
    return _renamed(rows.withColumn("old", F.element_at(F.split("message", "'"), 2)).join(at, ["file_id", "line_no"])).select("finding_id", "file_id", "old", "new")


def word_postings(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Where the whole words (file_id, old) occur: lines are taken apart into their words, and only those asked for go on."""
    own = lines.select("file_id", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(WORDS), F.lit(1)))).alias("old"))
    return own.join(words, ["file_id", "old"])


def renamed_lines(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """R13 by finding: the lines that each rename changes, with their new text."""
    keys = [c for c in changes.columns if c not in ("old", "new")]
    found = word_postings(lines, changes).groupBy("line_no", *keys).agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_m"))
    pieces = F.regexp_extract_all("line", F.lit(PIECES), F.lit(1))
    new = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(F.col("_m"), p), p)), "")
    return lines.join(found, ["file_id", "line_no"]).select(*keys, "line_no", new.alias("new_line"))


def rename_in_files(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace whole words, all renames of a file at once; only lines that hold one are rewritten."""
    hit = renamed_lines(lines, changes.select("file_id", "old", "new"))
    return lines.join(hit, ["file_id", "line_no"], "left").select(
        "file_id", "line_no", F.coalesce("new_line", "line").alias("line"))


# R14 --------------------------------------------------------------------------------------------
def freeze_exception_fields(st: DataFrame | Blocks) -> DataFrame:
    """Make fields of exception classes final, up to the end of the class.

    Header and opening brace are on one line; a class that never closes runs to the end of the file.
    """
    line, text = F.col("line"), strip(F.col("line"))
    head = has(F.col("code"), "class ") & has(F.col("code"), "Exception", "Error") & has(F.col("code"), "{")
    seen = _dealt(st).scan(["line_no"], _h=Last(F.when(head, F.struct("line_no", "end_line")), current=False)).done()
    inside = F.col("_h").isNotNull() & F.coalesce(F.col("line_no") <= F.col("_h.end_line"), F.lit(True))
    field = (has(line, ";") & has(line, "private", "protected", "public") & ~has(line, "final ")
             & ~starts(text, "//", "/*", "*", "@"))
    new = F.when(~(inside & field), line)
    for word in ("private", "protected", "public"):
        new = new.when(has(line, word), F.regexp_replace("line", f"^(.*?){word} ", f"$1{word} final "))
    return seen.select("file_id", "line_no", new.alias("line"))


# R17 --------------------------------------------------------------------------------------------
def numbers_of(line: Column) -> Column:
    """The magic numbers of a line: all but 0 and 1, with their exponent and suffix."""
    found = F.regexp_extract_all(line, F.lit(NUMBER), F.lit(1))
    return F.when(plain_code(line), F.filter(found, lambda n: ~n.isin("0", "1"))).otherwise(F.array().cast("array<string>"))


def constant_name(number: Column) -> Column:
    """A name of its own for every number: letters and digits stay, the point becomes ``_``, a minus ``M``."""
    return F.concat(F.lit("MAGIC_NUMBER_"), F.translate(F.upper(number), ".-+", "_MP"))


def number_declaration() -> Column:
    """The declaration of ``number`` by its kind, for rows with ``brace_indent``."""
    n = F.col("number")
    kind = (F.when(n.rlike("[lL]$"), "long").when(n.rlike("[fF]$"), "float").when(n.rlike("[.eEdD]"), "double").otherwise("int"))
    return F.format_string("%s    private static final %s %s = %s;", "brace_indent", kind, constant_name(n), "number")


def with_named_numbers(line: Column) -> Column:
    """A plain line with its magic numbers replaced by their constants."""
    gaps = F.split(line, NUMBER, -1)
    names = F.transform(F.regexp_extract_all(line, F.lit(NUMBER), F.lit(1)), lambda n: F.when(n.isin("0", "1"), n).otherwise(constant_name(n)))
    swapped = F.array_join(F.zip_with(gaps, names, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    return F.when(plain_code(line), swapped).otherwise(line)


def magic_numbers(lines: DataFrame) -> DataFrame:
    """Numbers other than 0 and 1 on plain lines, per file with their first place."""
    rows = lines.select("file_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(NUMBER), F.lit(1))).alias("idx", "number"),
                        plain_code(F.col("line")).alias("_plain")).where(F.col("_plain") & ~F.col("number").isin("0", "1"))
    return rows.groupBy("file_id", "number").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "idx")).alias("_first")).select(
        "file_id", "number", "n", constant_name(F.col("number")).alias("constant"),
        F.col("_first.line_no").alias("first_line"), F.col("_first.idx").alias("first_idx"))


def name_magic_numbers(lines: DataFrame) -> DataFrame:
    """Declare a constant per magic number behind the class anchor and use it on plain lines.

    Every number of a plain line is magic in its file, so the replacement itself needs no join. A
    constant is declared by its kind: ``2.5f`` is a float, ``5000000000L`` a long, ``1e3`` a double.
    """
    anchors = L.class_anchor(lines).where("brace_line IS NOT NULL")
    line = F.col("line")
    body = lines.join(anchors.select("file_id", "brace_line"), "file_id", "left").select(
        "file_id", "line_no", F.when(F.col("brace_line").isNotNull(), with_named_numbers(line)).otherwise(line).alias("line"))
    declared = magic_numbers(lines).join(anchors, "file_id").select(
        "file_id", F.col("brace_line").alias("line_no"), L.sub_at(F.col("first_line"), F.col("first_idx")).alias("sub"), number_declaration().alias("line"))
    return L.insert_after(body, declared, anchors.select("file_id", F.col("brace_line").alias("anchor")))


# R18 --------------------------------------------------------------------------------------------
def log_instead_of_print(lines: DataFrame) -> DataFrame:
    """Logger calls instead of prints; imports before the class, the logger field inside it."""
    line = F.col("line")
    body = lines.withColumn("line", F.regexp_replace("line", PRINT, "LOGGER.info($1);"))
    return L.insert_after(body, logger_lines(lines))


def logger_lines(lines: DataFrame) -> DataFrame:
    """The rows to insert in files that print: imports before the class, the logger field inside it."""
    line = F.col("line")
    files = lines.groupBy("file_id").agg(
        F.max(line.rlike(PRINT)).alias("_prints"), F.max(has(line, "import org.slf4j.Logger")).alias("_imported"),
        F.max(has(line, "private static final Logger LOGGER")).alias("_declared")).where("_prints")
    at = files.join(L.class_anchor(lines).where("brace_line IS NOT NULL"), "file_id")
    imports = ["import org.slf4j.Logger;", "import org.slf4j.LoggerFactory;", ""]
    before = at.where("NOT _imported").select(
        "file_id", F.col("decl_line").alias("line_no"), F.posexplode(F.array(*map(F.lit, imports))).alias("_i", "line")
    ).withColumn("sub", F.col("_i") - 3)
    field = F.format_string("%s    private static final Logger LOGGER = LoggerFactory.getLogger(%s.class);",
                            "brace_indent", "class_name")
    behind = at.where("NOT _declared").select("file_id", F.col("brace_line").alias("line_no"), F.lit(1).alias("sub"), field.alias("line"))
    return before.drop("_i").unionByName(behind)


# R19 --------------------------------------------------------------------------------------------
def unused_private_methods(lines: DataFrame) -> DataFrame:
    """Private methods whose name is called on no other line of the file."""
    line = F.col("line")
    called = F.array_distinct(F.regexp_extract_all("line", F.lit(CALLED), F.lit(1)))
    calls = (lines.select("file_id", F.explode(called).alias("name"))
             .groupBy("file_id", "name").agg(F.count(F.lit(1)).alias("n")))
    name = F.regexp_extract("line", LAST_WORD_BEFORE_PAREN, 1)
    declared = lines.where(has(line, "private ") & has(line, "(") & ~has(line, ";") & line.rlike(LAST_WORD_BEFORE_PAREN)).select(
        "file_id", "line_no", name.alias("name"), F.array_contains(called, name).cast("int").alias("_own"))
    return (declared.join(calls, ["file_id", "name"], "left")
            .where(F.coalesce("n", F.lit(0)) - F.col("_own") == 0).select("file_id", "line_no", "name"))


def mark_unused_private_methods(lines: DataFrame) -> DataFrame:
    found = unused_private_methods(lines).select("file_id", "line_no", F.lit(True).alias("_unused"))
    new = F.regexp_replace("line", "^(.*?)private ", "$1// TODO: Remove or use this private method: private ")
    return lines.join(found, ["file_id", "line_no"], "left").select(
        "file_id", "line_no", F.when(F.col("_unused"), new).otherwise(F.col("line")).alias("line"))


# R25 --------------------------------------------------------------------------------------------
def get_instead_of_contains_key(lines: DataFrame) -> DataFrame:
    """``m.containsKey(k)`` before a ``get(`` becomes ``m.get(k) != null``; the receiver stays."""
    line = F.col("line")
    hit = has(line, ".containsKey(") & has(line, "if (") & F.coalesce(has(F.col("next_line"), "get("), F.lit(False))
    new = F.when(hit, F.regexp_replace("line", CONTAINS_KEY, "$1.get($2) != null")).otherwise(line)
    return L.with_next(lines).select("file_id", "line_no", new.alias("line"))


# R30 --------------------------------------------------------------------------------------------
def unused_locals(lines: DataFrame) -> DataFrame:
    """Assigned names that occur on no other line of the file."""
    line = F.col("line")
    name = F.regexp_extract("line", ASSIGNED_LOCAL, 1)
    assigned = lines.where(has(line, " = ") & has(line, ";") & ~starts(strip(line), "//") & name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"))
    once = token_lines(lines).where("n_lines = 1").select("file_id", "name")
    return assigned.select("file_id", "line_no", name.alias("name")).join(once, ["file_id", "name"], "left_semi")


def unused_private_fields(lines: DataFrame) -> DataFrame:
    """Private fields without initialiser whose name occurs on no other line of the file."""
    found = lines.where(F.col("line").rlike(PRIVATE_FIELD)).select("file_id", "line_no", F.regexp_extract("line", PRIVATE_FIELD, 1).alias("name"))
    once = token_lines(lines).where("n_lines = 1").select("file_id", "name")
    return found.join(once, ["file_id", "name"], "left_semi").select("file_id", "line_no", "name")


def remove_unused_locals(lines: DataFrame) -> DataFrame:
    return L.delete_lines(lines, unused_locals(lines))


# R31 --------------------------------------------------------------------------------------------
def recursion_candidates(lines: DataFrame) -> DataFrame:
    """Per file the first line that returns a call, for review (the call after ``return``)."""
    line = F.col("line")
    found = lines.where(has(line, "return") & line.rlike(FIRST_CALL))
    first = F.min(F.struct("line_no", "line"))
    return found.groupBy("file_id").agg(first.alias("f")).select(
        "file_id", F.col("f.line_no").alias("line_no"), F.regexp_extract("f.line", FIRST_CALL, 1).alias("callee"))


