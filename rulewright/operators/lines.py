"""Line table and context operators.

``lines`` is DataFrame(file_id, line_no, line) with 1-based line numbers. All per-file state goes
through :func:`rulewright.operators.scan.scan`, so a file may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions.text import has, occurrences, starts, strip
from rulewright.operators import scan as _scan
from rulewright.operators.code import entered, line_blocks
from rulewright.operators.scan import Blocks, Last, Total, Upcoming, line_block, scan

LINE_COLS = ["file_id", "line_no", "line"]


def explode_lines(df: DataFrame, id_col: str | Column, text_col: str) -> DataFrame:
    """L1: one row per line, split on line feeds only; a final empty line is kept. No shuffle."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return df.select(key.alias("file_id"),
                     F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("_p", "line")
                     ).select("file_id", (F.col("_p") + 1).alias("line_no"), "line")


def _joined(pos: str, text: str) -> Column:
    items = F.sort_array(F.collect_list(F.struct(pos, text)))
    return F.array_join(F.transform(items, lambda x: x[text]), "\n")


def assemble_blocks(lines: DataFrame, block_size: int | None = None) -> DataFrame:
    """L2 for files too long for one value: text per block of lines, (file_id, blk, piece)."""
    return (lines.withColumn("blk", line_block("line_no", block_size))
            .groupBy("file_id", "blk").agg(_joined("line_no", "line").alias("piece")))


def assemble(lines: DataFrame) -> DataFrame:
    """L2: text per file. Blocks are joined first, so only the finished pieces of a file meet."""
    return assemble_blocks(lines).groupBy("file_id").agg(_joined("blk", "piece").alias("text"))


def with_next(lines: DataFrame, block_size: int | None = None) -> DataFrame:
    """L3: the following line of the same file, null on the last line."""
    return scan(lines, ["file_id"], ["line_no"], block_size, next_line=Upcoming(F.col("line")))


def lookback(lines: DataFrame, cond: Column, k: int, include_current: bool = False,
             block_size: int | None = None) -> DataFrame:
    """L4: number of the nearest line within the last ``k`` lines that meets ``cond``.

    ``include_current`` counts the line itself as one of the ``k``. The nearest match is within
    reach exactly if the last match seen is, so no bounded self join is needed.
    """
    reach = k - 1 if include_current else k
    out = scan(lines, ["file_id"], ["line_no"], block_size,
               match_line=Last(F.when(cond, F.col("line_no")), current=include_current))
    return out.withColumn("match_line", F.when(F.col("line_no") - F.col("match_line") <= reach, F.col("match_line")))


def nearest_decl(lines: DataFrame, block_size: int | None = None) -> DataFrame:
    """Number of the nearest line at or above that starts with an access modifier."""
    decl = starts(strip(F.col("line")), "public", "private", "protected")
    return scan(lines, ["file_id"], ["line_no"], block_size, decl_line=Last(F.when(decl, F.col("line_no"))))


def comment_state(lines: DataFrame, opener_first: bool = False, block_size: int | None = None) -> DataFrame:
    """Whether a line is entered inside a block comment, and the mark it carries.

    ``opener_first`` counts an opening mark only at the start of the line (used by R5).
    """
    line = F.col("line")
    opens = starts(strip(line), "/*") if opener_first else has(line, "/*")
    mark = F.when(has(line, "*/"), F.lit("close")).when(opens, F.lit("open"))
    out = scan(lines.withColumn("mark", mark), ["file_id"], ["line_no"], block_size,
               _prev=Last(F.col("mark"), current=False))
    return out.withColumn("in_comment", F.coalesce(F.col("_prev") == "open", F.lit(False))).drop("_prev")


def _depths(lines: DataFrame, block_size: int | None) -> Blocks:
    code = F.col("code")
    opens, closes = occurrences(code, "{"), occurrences(code, "}")
    lead = occurrences(F.regexp_extract(code, r"^[^{]*", 0), "}")
    out = entered(line_blocks(lines, block_size)).scan(["line_no"], depth_after=Total((opens - closes).cast("bigint")))
    before = F.col("depth_after") - opens + closes
    return out.map(lambda rows: rows.withColumns({"depth_before": before, "dip": F.least(before - lead, F.col("depth_after"))}).drop("in_comment"))


def block_depth(lines: DataFrame, block_size: int | None = None) -> DataFrame:
    """``code`` (:mod:`rulewright.operators.code`), brace depth of the code before and after each line,
    and the lowest depth reached on it (``dip``).

    ``} else {`` leaves the depth unchanged but dips by one, i.e. it closes one block and opens one.
    """
    return _depths(lines, block_size).done()


def structure(lines: DataFrame, block_size: int | None = None) -> DataFrame:
    """The rows of :func:`structure_blocks`."""
    return structure_blocks(lines, block_size).done()


def structure_blocks(lines: DataFrame, block_size: int | None = None) -> Blocks:
    """Block structure of a corpus (L7 with ends and parents), dealt out for scans by (file, line_no).

    Adds to :func:`block_depth`:

    * ``end_line`` - on lines that leave a block open, the line that closes it (null: never closed);
      on lines that open and close a block, the line itself;
    * ``parent_line``, ``parent_text`` - the line that opened the block this line lies in, and its code.

    A block opened at depth ``d`` ends at the first later line that dips to ``d`` or lower, and a line
    whose dip is ``d + 1`` lies in the last block opened at ``d``. So every line sends at most a few
    events to the groups ``(file, depth)`` and both questions are one scan over those groups. Only the
    event that asks for the parent carries the line; the end comes to it from the line's next event.
    """
    d = _depths(lines, block_size)
    pos, parts = F.col("line_no"), d.parts
    event = lambda level, sub: F.struct(level.alias("level"), F.lit(sub).alias("sub"))
    ends = F.when(F.col("depth_before") > F.col("dip"), F.transform(F.sequence(F.col("dip"), F.col("depth_before") - 1), lambda lv: event(lv, 0)))
    member = F.array(event(F.col("dip") - 1, 1))
    start = F.when(F.col("depth_after") > F.col("dip"), F.array(event(F.col("depth_after") - 1, 2)))
    none = F.expr("cast(array() as array<struct<level:bigint,sub:int>>)")

    def events(rows: DataFrame) -> DataFrame:
        own = F.col("_e.sub") == 1
        return rows.withColumn("_e", F.explode(F.concat(F.coalesce(ends, none), member, F.coalesce(start, none)))).select(
            *parts, "line_no", F.when(own, F.col("line")).alias("line"), F.when(F.col("_e.sub") > 0, F.col("code")).alias("code"),
            "depth_before", "depth_after", "dip", "_e.level", "_e.sub")

    seen = d.map(events).scan(["line_no", "sub"], ("level",), _end=Upcoming(F.when(F.col("sub") == 0, pos)),
                              _parent=Last(F.when(F.col("sub") == 2, F.struct("line_no", "code")), current=False))
    rows = seen.scan(["line_no", "sub"], _next=Upcoming(F.struct("line_no", "sub", "_end")))
    both = has(F.col("code"), "{") & has(F.col("code"), "}") & (F.col("depth_after") == F.col("dip"))
    opened = (F.col("_next.line_no") == pos) & (F.col("_next.sub") == 2)
    return rows.map(lambda r: r.where("sub = 1").select(
        *parts, "line_no", "line", "code", "depth_before", "depth_after", "dip", F.when(both, pos).when(opened, F.col("_next._end")).cast("int").alias("end_line"),
        F.col("_parent.line_no").alias("parent_line"), F.col("_parent.code").alias("parent_text")))


def block_ends(lines: DataFrame, block_size: int | None = None) -> DataFrame:
    """(file_id, line_no, end_line) for every line with an opening brace."""
    return (structure(lines, block_size).where(has(F.col("code"), "{"))
            .select("file_id", "line_no", "end_line"))


def loop_regions(lines: DataFrame, block_size: int | None = None) -> DataFrame:
    """``loop_line`` = line that opened the loop the line lies in; ``closed`` = the loop ends.

    A loop header replaces the loop before it; a line with ``}`` and without ``else`` ends it.
    """
    line = F.col("line")
    mark = (F.when(has(line, "for (", "while (", "do {"), F.col("line_no"))
            .when(has(line, "}") & ~has(line, "else"), F.lit(0)))
    out = scan(lines.withColumn("_m", mark), ["file_id"], ["line_no"], block_size,
               _open=Last(F.col("_m")), _next=Upcoming(F.col("_m")))
    return (out.withColumn("loop_line", F.when(F.col("_open") > 0, F.col("_open")))
            .withColumn("closed", F.col("loop_line").isNotNull() & F.coalesce(F.col("_next") == 0, F.lit(False)))
            .drop("_m", "_open", "_next"))


def class_anchor(lines: DataFrame, block_size: int | None = None) -> DataFrame:
    """Per file the first class header with ``public`` or ``final`` and the brace line after it.

    Only lines that matter (headers and braces) are shuffled.
    """
    line = F.col("line")
    decl = has(line, "class ") & has(line, "public ", "final ")
    few = lines.where(decl | has(line, "{"))
    brace = scan(few, ["file_id"], ["line_no"], block_size,
                 _b=Upcoming(F.when(has(line, "{"), F.struct("line_no", "line")), current=True))
    first = brace.where(decl).groupBy("file_id").agg(F.min(F.struct("line_no", "line", "_b")).alias("a"))
    return first.select(
        "file_id", F.col("a.line_no").alias("decl_line"), F.col("a._b.line_no").alias("brace_line"),
        F.regexp_extract("a.line", r"class\s+([A-Za-z0-9_]+)", 1).alias("class_name"),
        F.regexp_extract("a._b.line", r"^(\s*)", 1).alias("brace_indent"))


SUB_STEP = 1 << 32  # places on one line; line numbers have 31 bits, so a place fits a bigint


def sub_at(line_no: Column, idx: Column) -> Column:
    """Order number for rows put behind one anchor, from the place their content was first seen."""
    return (line_no.cast("bigint") * SUB_STEP + idx).cast("bigint")


def renumber(rows: DataFrame, anchors: DataFrame | None = None, block_size: int | None = None,
             whole: bool = False, tasks: int | None = None) -> DataFrame:
    """Number the rows of each file 1..n in (line_no, sub) order.

    ``sub`` orders rows put at the same line: 0 is the line itself, negative before it, positive
    after it. A row's new number is a running count, so a file may be of any size. Where very many
    rows go behind one line per file (generated constants), ``anchors`` (file_id, anchor) names that
    line and its insertions are cut into blocks by ``sub`` as well. ``whole`` says that no file has
    several blocks (without ``anchors``) and ``tasks`` is the number of parts, as :func:`scan.extent` tells them of the lines.
    """
    size = block_size or _scan.BLOCK_LINES
    blocks = [line_block("line_no", size)]
    if anchors is not None:
        rows = rows.join(anchors.select("file_id", F.col("anchor").alias("_anchor")), "file_id", "left")
        behind = (F.col("line_no") == F.col("_anchor")) & (F.col("sub") > 0)
        part = F.when(behind, 1).when(F.col("line_no") > F.col("_anchor"), 2).otherwise(0)
        blocks += [part, F.when(behind, F.floor(F.col("sub") / F.lit(SUB_STEP * size))).otherwise(0)]
    return Blocks(rows, ["file_id"], blocks, whole and anchors is None, tasks=tasks).scan(["line_no", "sub"], _no=Total(F.lit(1).cast("bigint"))).done().select(
        "file_id", F.col("_no").cast("int").alias("line_no"), "line")


def delete_lines(lines: DataFrame, doomed: DataFrame) -> DataFrame:
    """Remove the lines named by (file_id, line_no); numbers keep their gaps until renumbered."""
    return lines.join(doomed.select("file_id", "line_no"), ["file_id", "line_no"], "left_anti")


def insert_after(lines: DataFrame, extra: DataFrame, anchors: DataFrame | None = None,
                 block_size: int | None = None, whole: bool = False, tasks: int | None = None) -> DataFrame:
    """Insert ``extra`` (file_id, line_no, sub, line) around the given lines and renumber."""
    rows = lines.select("file_id", "line_no", F.lit(0).cast("bigint").alias("sub"), "line")
    return renumber(rows.unionByName(extra.select("file_id", "line_no", F.col("sub").cast("bigint"), "line")),
                    anchors, block_size, whole, tasks)
