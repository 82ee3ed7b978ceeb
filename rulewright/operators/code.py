"""Code text and statements.

``code_text`` blanks comments and the insides of literals, so that no later pattern reads a brace, a
word or a number there. Whether a line is entered inside a block comment is a state, and a line maps
it to a state: ``/*`` may open a comment, but not inside a string, and ``*/`` closes one, but not
outside. The maps of a file's lines are composed by :class:`rulewright.operators.scan.Compose`.

``statements`` cuts code at ``;``, ``{`` and ``}`` wherever the lines end, with each statement's
block. Strings end with their line; text blocks (three quotes) are not known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions.text import has, occurrences, strip
from rulewright.operators.scan import BLOCK_LINES, Blocks, Compose, Last, Total, Upcoming, extent, line_block

TOKEN = r'''"(?:[^"\\]|\\[^\n])*+"?|'(?:[^'\\]|\\[^\n])*+'?|//[^\n]*+|/\*[^\n]*?\*/|/\*[^\n]*+'''
PLACE = ""  # stands for a literal or comment while the code around it is rewritten
INITIALISER = r"([=(,\[\]{]\s*)\{([^{};]*)\}"
NOTE = r"@[A-Za-z0-9_.]+(?:\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*+\))*+\))?"
NOTE_LINE = rf"^\s*(?:{NOTE}\s*)+$"
CONTROL_BLOCK = r"\b(?:if|else|for|while|do|switch|try|catch|finally)\b"


# L12 --------------------------------------------------------------------------------------------
def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _joined(gaps: Column, tokens: Column) -> Column:
    return F.array_join(F.zip_with(gaps, tokens, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")


def _blank(token: Column) -> Column:
    quote, n = F.substring(token, 1, 1), F.length(token)
    closed = (n > 1) & F.endswith(token, quote)
    inside = F.concat(quote, F.repeat(F.lit(" "), n - F.when(closed, 2).otherwise(1)), F.when(closed, quote).otherwise(""))
    return F.when(quote == "/", F.repeat(F.lit(" "), n)).otherwise(inside)


def _blanked(text: Column) -> Column:
    return _joined(F.split(text, TOKEN, -1), F.transform(_tokens(text), _blank))


def _comment_open(text: Column) -> Column:
    """Whether a text that begins as code ends inside a block comment."""
    last = F.try_element_at(_tokens(text), F.lit(-1))
    return F.coalesce(F.startswith(last, F.lit("/*")) & ~(F.endswith(last, F.lit("*/")) & (F.length(last) >= 4)), F.lit(False))


def comment_marks() -> Column:
    """Lines that can change the comment state; only they and the lines asked for are needed to know it."""
    return has(F.col("line"), "/*", "*/")


def entered(blocks: Blocks) -> Blocks:
    """Add ``in_comment`` and ``code`` to line rows."""
    line, marks = F.col("line"), comment_marks()
    inside = F.concat(F.lit("/*"), line)
    state = Compose(F.when(marks, _comment_open(line)), F.when(marks, _comment_open(inside)))
    code = (F.when(F.col("in_comment"), F.substring(_blanked(inside), 3, 1 << 30))
            .when(has(line, '"', "'", "//", "/*"), _blanked(line)).otherwise(line))
    return blocks.scan(["line_no"], in_comment=state).map(lambda rows: rows.withColumn("code", code))


def line_blocks(lines: DataFrame, block_size: int | None = None) -> Blocks:
    """Line rows dealt out for several scans."""
    whole, tasks = extent(lines, block_size)
    return Blocks(lines.select("file_id", "line_no", "line"), ["file_id"], [line_block("line_no", block_size)],
                  whole, several_scans=True, tasks=tasks)


def code_text(lines: DataFrame, block_size: int | None = None) -> DataFrame:
    """(file_id, line_no, line, in_comment, code). ``code`` has the length of the line; comments
    are blank, and so is what stands between the quotes of a literal."""
    return entered(Blocks(lines.select("file_id", "line_no", "line"), ["file_id"], [line_block("line_no", block_size)])).done()


def code_of(lines: DataFrame, wanted: Column, block_size: int | None = None) -> DataFrame:
    """Code of the ``wanted`` lines only; besides them, just the lines with comment marks are shuffled."""
    few = lines.where(wanted | comment_marks()).withColumn("_wanted", wanted)
    blocks = Blocks(few.select("file_id", "line_no", "line", "_wanted"), ["file_id"], [line_block("line_no", block_size)])
    return entered(blocks).done().where("_wanted").drop("_wanted")


def outside_literals(line: Column, rewrite) -> Column:
    """``rewrite`` applied to a line with one character in place of each literal and comment, which are put
    back afterwards. The rewrite must keep those characters and their order."""
    masked = F.array_join(F.split(line, TOKEN, -1), PLACE)
    back = _joined(F.split(rewrite(masked), PLACE, -1), _tokens(line))
    plain = ~has(line, '"', "'", "//", "/*")
    return F.when(plain, rewrite(line)).when(F.contains(line, F.lit(PLACE)), line).otherwise(back)


def without_literals(line: Column) -> Column:
    """The line with one character in place of each literal and comment, for detection."""
    return F.when(has(line, '"', "'", "//", "/*"), F.array_join(F.split(line, TOKEN, -1), PLACE)).otherwise(line)


# L13 --------------------------------------------------------------------------------------------
def _one_line(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def statements(lines: DataFrame, block_size: int | None = None) -> DataFrame:
    """The rows of :func:`parse`."""
    return parse(lines, block_size).done()


def parse(lines: DataFrame, block_size: int | None = None) -> Blocks:
    """One row per statement, block header or block end, dealt out for scans by (file, stmt_no).

    ``text`` is the code up to the terminator ``term``, on one line with single blanks; ``parts`` has it
    by line. ``start_line`` is the first line that holds more than annotations, ``line_no`` that of the
    terminator. ``depth`` is the brace depth before the terminator. On rows that open a block,
    ``end_line`` and ``end_no`` name the line and statement that close it (null: never closed) and
    ``empty`` says whether nothing stands in it. ``parent_line`` and ``parent_text`` belong to the
    header of the block that the statement lies in, ``nesting`` counts the control blocks around it.

    A ``;`` inside the brackets of a ``for`` or ``try`` header ends nothing. Array initialisers written
    on one line are no blocks.
    """
    size = block_size or BLOCK_LINES
    code = F.col("code")
    for _ in range(3):  # nested initialisers, the innermost first
        code = F.when(F.contains("code", F.lit("{")) & F.contains("code", F.lit("}")), F.regexp_replace(code, INITIALISER, "$1($2)")).otherwise(F.col("code"))
    cut = F.arrays_zip(F.split(code, "[;{}]", -1).alias("text"), F.regexp_extract_all(code, F.lit("[;{}]"), F.lit(0)).alias("term"))

    def pieces(rows: DataFrame) -> DataFrame:
        out = rows.select(*(c for c in rows.columns if c not in ("line", "in_comment", "code")), F.posexplode(cut).alias("idx", "p"))
        out = out.select("*", "p.text", "p.term").drop("p").where(F.col("term").isNotNull() | (strip(F.col("text")) != ""))
        round_ = occurrences(F.col("text"), "(") - occurrences(F.col("text"), ")")
        return out.withColumn("round", F.when(has(F.col("text"), "(", ")"), round_).otherwise(0).cast("bigint"))

    brace, at = F.col("term").isin("{", "}"), ["line_no", "idx"]
    by_line = line_blocks(lines, size)
    cutting = entered(by_line).map(pieces).scan(at, _round=Total(F.col("round")))
    cutting = cutting.scan(at, _base=Last(F.when(brace, F.col("_round")), current=False))
    ends = F.coalesce(brace | ((F.col("term") == ";") & (F.col("_round") <= F.coalesce("_base", F.lit(0)))), F.lit(False))
    cutting = cutting.map(lambda rows: rows.withColumn("_ends", ends.cast("bigint"))).scan(at, _count=Total(F.col("_ends")))
    numbered = cutting.map(lambda rows: rows.select(
        *by_line.parts, (F.col("_count") - F.col("_ends")).alias("stmt_no"), "line_no", "idx",
        F.when((F.col("_ends") == 0) & (F.col("term") == ";"), F.concat("text", "term")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_ends") == 1, F.col("term")).alias("term")))
    # A statement may end in a later block than it begins, so files of several blocks are dealt out again by statement.
    blocks = numbered if numbered.whole else Blocks(
        numbered.done(), ["file_id"], [F.floor(F.col("stmt_no") / F.lit(size))], several_scans=True, tasks=by_line.tasks)
    solid = (strip(F.col("text")) != "") & ~(has(F.col("text"), "@") & F.col("text").rlike(NOTE_LINE))
    text = _one_line(F.array_join(F.transform("parts", lambda p: p["text"]), " "))
    step = F.when(F.col("term") == "{", 1).when(F.col("term") == "}", -1).otherwise(0).cast("bigint")

    def whole(rows: DataFrame) -> DataFrame:
        found = rows.groupBy(*blocks.parts, "stmt_no").agg(
            F.sort_array(F.collect_list(F.struct("line_no", "idx", "text"))).alias("parts"),
            F.min(F.when(solid, F.col("line_no"))).alias("_first"), F.max("line_no").alias("line_no"), F.max("term").alias("term"))
        return found.select(*blocks.parts, "stmt_no", F.coalesce("_first", "line_no").cast("int").alias("start_line"), "line_no", "parts", "term",
                            text.alias("text")).where((F.col("text") != "") | (F.col("term") != ";"))

    body = blocks.map(whole).scan(["stmt_no"], _after=Total(step))

    # Events by level: a statement lies in the block that was opened last at its level; a block ends with the next closing brace there.
    depth = F.col("_after") - step
    member = F.when(F.col("term").isNull() | (F.col("term") != "}") | (F.col("text") != ""), F.struct((depth - 1).alias("level"), F.lit(1).alias("sub")))
    edge = F.when(F.col("term") == "{", F.struct(depth.alias("level"), F.lit(2).alias("sub"))).when(
        F.col("term") == "}", F.struct((depth - 1).alias("level"), F.lit(2).alias("sub")))

    def events(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_e", F.explode(F.array_compact(F.array(member, edge)))).select(
            *blocks.parts, "stmt_no", "start_line", "line_no", "text", "term", depth.alias("depth"), "_e.level", "_e.sub",
            F.when(F.col("_e.sub") == 1, F.col("parts")).alias("parts"))

    opens, closes = (F.col("sub") == 2) & (F.col("term") == "{"), (F.col("sub") == 2) & (F.col("term") == "}")
    last = F.when(opens, F.struct("start_line", "text")).when(closes, F.struct(F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("string").alias("text")))
    seen = body.map(events).scan(
        ["stmt_no", "sub"], ("level",), _open=Last(last, current=False),
        _end=Upcoming(F.when(closes, F.struct("line_no", "stmt_no", (F.col("text") == "").alias("bare")))))
    control = lambda c: F.coalesce(c.rlike(CONTROL_BLOCK), F.lit(False)).cast("bigint")
    delta = F.when(opens, control(F.col("text"))).when(closes, -control(F.col("_open.text"))).otherwise(F.lit(0).cast("bigint"))
    rows = seen.map(lambda r: r.withColumn("_delta", delta)).scan(
        ["stmt_no", "sub"], nesting=Total(F.col("_delta")), _next=Upcoming(F.struct("stmt_no", "_end")))
    end = F.when((F.col("term") == "{") & (F.col("_next.stmt_no") == F.col("stmt_no")), F.col("_next._end"))  # the block's own event follows
    return rows.map(lambda r: r.where("sub = 1").select(
        *blocks.parts, "stmt_no", "start_line", "line_no", "text", "term", "depth", end["line_no"].alias("end_line"), end["stmt_no"].alias("end_no"),
        F.coalesce((end["stmt_no"] == F.col("stmt_no") + 1) & end["bare"], F.lit(False)).alias("empty"),
        F.col("_open.start_line").alias("parent_line"), F.col("_open.text").alias("parent_text"), "nesting", "parts"))
