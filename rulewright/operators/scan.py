"""Ordered scans over groups of any size.

A window over ``file_id`` alone puts a whole file into one task, so one huge file would stall the
job. Rows are dealt out by group and block of consecutive rows (:class:`Blocks`), and a scan works
in three steps:

1. windows inside ``(group, block)`` - tasks of bounded size;
2. for groups of several blocks, one summary row per block and a window over those summaries (one
   row per 65,536 lines);
3. a join that carries the state of the earlier (or later) blocks in.

Ordinary files have one block. The table of groups with several is then empty, and AQE drops steps 2
and 3 when it sees that. Any number of scans, and row-local steps between them, follow one dealing of
the rows: a scan over ``(group, more keys)`` needs no other exchange, only a sort. Operators that chain
scans ask first whether any file has several blocks and how many lines there are (:func:`extent`); mostly
no file has, and the number of parts follows from the lines, so a task's rows don't grow with the corpus.

Spark shares an exchange only if both readers ask for the same rows and columns, so both sides touch
all columns, and rows without a key, which belong to no group, are left out first. Callers select
what they need before a scan.
"""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.sources.scratch import ensure_checkpoint_dir

BLOCK_LINES = 65_536
TASK_LINES = 2 * BLOCK_LINES  # a part holds about so many: whole files, so up to a block more


@dataclass(frozen=True)
class Total:
    """Running sum up to and including the row."""
    expr: Column


@dataclass(frozen=True)
class Last:
    """Last non-null value at or before the row (``current=False``: strictly before)."""
    expr: Column
    current: bool = True


@dataclass(frozen=True)
class Upcoming:
    """First non-null value after the row (``current=True``: at or after)."""
    expr: Column
    current: bool = False


@dataclass(frozen=True)
class Compose:
    """State (on or off) in which a row is entered, each row mapping the two states to a state.

    ``from_off`` and ``from_on`` say whether the state is on after a row that is entered in state off
    or on; null leaves it alone. A group starts in state off. Maps of two states are composed from two
    running values: those that forget the state they were entered in set it anew, those that swap the
    states are counted, and the state is the last one set, swapped once more for each swap since."""
    from_off: Column
    from_on: Column


def line_block(pos: str = "line_no", size: int | None = None) -> Column:
    return F.floor((F.col(pos) - 1) / F.lit(size or BLOCK_LINES))


def extent(lines: DataFrame, size: int | None = None, task_lines: int = TASK_LINES) -> tuple[bool, int]:
    """Whether no file has more than one block of lines, and in how many parts to deal the lines out. One pass
    that reads the line numbers only.

    The parts are counted here because AQE merges those it may choose itself up to a size in compressed bytes:
    a chain of scans holds a part in one sort after the other, and its memory would grow with the corpus."""
    last, n = lines.agg(F.max("line_no"), F.count(F.lit(1))).head()
    return (last or 0) <= (size or BLOCK_LINES), parts_for(n, task_lines)


def parts_for(rows: int, task_rows: int = TASK_LINES) -> int:
    """In how many parts to deal out so many rows."""
    return max(2, -(-rows // task_rows))


def _odd(count: Column) -> Column:
    return count % 2 != 0


def _lead(value: str, parts: list[str], order: list[str]) -> str:
    """The next row's value that isn't null, in SQL, as the function has no such option."""
    listed = lambda cols: ", ".join(f"`{c}`" for c in cols)
    return f"lead(`{value}`, 1) IGNORE NULLS OVER (PARTITION BY {listed(parts)} ORDER BY {listed(order)})"


def _composed(df: DataFrame, off: Column, on: Column, window, name: str) -> DataFrame:
    """Add the composition of the maps up to and including each row: ``{name}_off`` and ``{name}_on``."""
    df = df.withColumns({f"{name}_a": F.coalesce(off, F.lit(False)), f"{name}_b": F.coalesce(on, F.lit(True))})
    a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
    df = df.withColumn(f"{name}_p", F.sum(F.when(a & ~b, 1).otherwise(0)).over(window))
    swapped = _odd(F.col(f"{name}_p"))
    df = df.withColumn(f"{name}_c", F.last(F.when(a == b, a != swapped), ignorenulls=True).over(window))
    return df.withColumns({f"{name}_off": F.coalesce(F.col(f"{name}_c"), F.lit(False)) != swapped,
                           f"{name}_on": F.coalesce(F.col(f"{name}_c"), F.lit(True)) != swapped}).drop(f"{name}_a", f"{name}_b", f"{name}_p", f"{name}_c")


class Blocks:
    """Rows dealt out by ``keys`` and the columns ``cut``, which grow with the order of the scans to come.

    ``whole`` says that every group has one block; then there is no state to carry and the plan of any
    number of scans stays a single line. Otherwise a scan reads its rows twice, and for ``several_scans``
    its result is checkpointed, so that a chain of scans doesn't double its plan each time. ``tasks`` is the
    number of parts; without it Spark chooses."""

    def __init__(self, rows: DataFrame, keys: list[str], cut: list[Column], whole: bool = False, several_scans: bool = False, tasks: int | None = None):
        self.keys, self.blk, self.whole, self.several_scans = keys, [] if whole else [f"_blk{i}" for i in range(len(cut))], whole, several_scans
        self.tasks = tasks
        self.parts = keys + self.blk
        base = rows.withColumns(dict(zip(self.blk, cut)))
        base = base.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.parts]))
        if whole:
            self.rows = base.repartition(tasks, *self.parts) if tasks else base
            return
        base = base.repartition(*([tasks] if tasks else []), *self.parts)
        touched = F.try_add(F.hash(*base.columns).cast("bigint"), F.lit(1))  # needs every column, is never null
        per_block = base.groupBy(*self.parts).agg(F.count(touched).alias("_touched"))
        self.several = (per_block.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
                        .where("_n > 1 AND _touched > 0").select(*self.parts))
        # A filter that isn't deterministic stays where it is, above the exchange, and so does what it reads.
        self.rows = base.where(F.when(F.monotonically_increasing_id() >= 0, touched.isNotNull()))
        if several_scans:
            ensure_checkpoint_dir(rows.sparkSession)
            self.several = self.several.checkpoint()

    def map(self, step: Callable[[DataFrame], DataFrame]) -> Blocks:
        """A row-local step, or an aggregation by the dealt keys and more; it keeps the dealt keys."""
        out = copy(self)
        out.rows = step(self.rows)
        return out

    def scan(self, order: list[str], within: tuple[str, ...] = (), **specs: Total | Last | Upcoming | Compose) -> Blocks:
        """Add one column per spec, evaluated per ``keys`` and ``within`` group in ``order``."""
        parts, place = [*self.parts, *within], F.struct(*order)
        forward = Window.partitionBy(*parts).orderBy(*order)
        up_to = forward.rowsBetween(Window.unboundedPreceding, 0)
        over = Window.partitionBy(*self.keys, *within)
        before, after = (over.orderBy(*(o or [F.lit(0)])).rowsBetween(Window.unboundedPreceding, -1) for o in (self.blk, [F.desc(c) for c in self.blk]))

        rows, local, summary, carry = self.rows, {}, [], {}
        for name, s in specs.items():
            if isinstance(s, Total):
                local[name] = F.sum(s.expr).over(up_to)
                summary.append(F.sum(s.expr).alias(f"_s_{name}"))
                carry[name] = F.sum(f"_s_{name}").over(before)
            elif isinstance(s, Compose):
                rows = _composed(rows, s.from_off, s.from_on, up_to, f"_m_{name}")
                local[f"_m_{name}_off0"] = F.lag(f"_m_{name}_off", 1, False).over(forward)
                local[f"_m_{name}_on0"] = F.lag(f"_m_{name}_on", 1, True).over(forward)
                summary.append(F.max_by(F.struct(F.col(f"_m_{name}_off").alias("off"), F.col(f"_m_{name}_on").alias("on")), place).alias(f"_s_{name}"))
            else:
                back, edge = isinstance(s, Upcoming), 0 if s.current else -1
                if back:  # looks ahead in the one order, which needs no second sort
                    rows, ahead = rows.withColumn(f"_u_{name}", s.expr), F.expr(_lead(f"_u_{name}", parts, order))
                    local[name] = F.coalesce(F.col(f"_u_{name}"), ahead) if s.current else ahead
                else:
                    local[name] = F.last(s.expr, ignorenulls=True).over(forward.rowsBetween(Window.unboundedPreceding, edge))
                pick = F.min_by if back else F.max_by
                summary.append(pick(s.expr, F.when(s.expr.isNotNull(), place)).alias(f"_s_{name}"))
                carry[name] = F.last(f"_s_{name}", ignorenulls=True).over(after if back else before)
        looked_at = [f"_u_{n}" for n, s in specs.items() if isinstance(s, Upcoming)]
        local_rows = rows.withColumns(local).drop(*looked_at)
        temporary = [f"_m_{n}_{e}" for n, s in specs.items() if isinstance(s, Compose) for e in ("off", "on", "off0", "on0")]
        if self.whole:
            states_in = {n: F.col(f"_m_{n}_off0") for n, s in specs.items() if isinstance(s, Compose)}
            return self.map(lambda _: local_rows.withColumns(states_in).drop(*temporary))
        states = rows.join(self.several, self.parts, "left_semi").groupBy(*parts).agg(*summary)
        for name, s in specs.items():
            if isinstance(s, Compose):
                in_order = over.orderBy(*self.blk)
                states = _composed(states, F.col(f"_s_{name}.off"), F.col(f"_s_{name}.on"), in_order.rowsBetween(Window.unboundedPreceding, 0), f"_t_{name}")
                carry[name] = F.lag(f"_t_{name}_off", 1, False).over(in_order)
        carried = states.select(*parts, F.struct(*[c.alias(n) for n, c in carry.items()]).alias("_carry"))
        if within:  # joined by block, so that the dealt rows stay where they are
            entry = F.struct(F.struct(*within).alias("k"), F.col("_carry").alias("v"))
            carried = carried.groupBy(*self.parts).agg(F.map_from_entries(F.collect_list(entry)).alias("_carry"))
        out = local_rows.join(carried, self.parts, "left")
        got = F.try_element_at(F.col("_carry"), F.struct(*within)) if within else F.col("_carry")
        final = {}
        for name, s in specs.items():
            c = got[name]
            if isinstance(s, Total):
                final[name] = F.col(name) + F.coalesce(c, F.lit(0))
            elif isinstance(s, Compose):
                final[name] = F.when(F.coalesce(c, F.lit(False)), F.col(f"_m_{name}_on0")).otherwise(F.col(f"_m_{name}_off0"))
            else:
                final[name] = F.coalesce(F.col(name), c)
        out = out.withColumns(final).drop("_carry", *temporary)
        return self.map(lambda _: out.checkpoint() if self.several_scans else out)

    def done(self) -> DataFrame:
        return self.rows.drop(*self.blk)


def scan(rows: DataFrame, keys: list[str], order: list[str], block_size: int | None = None,
         blocks: list[Column] | None = None, **specs: Total | Last | Upcoming | Compose) -> DataFrame:
    """Add one column per spec, evaluated per ``keys`` group in ``order``.

    ``blocks`` are columns that grow with ``order``; the default cuts the first order column, which
    must then be a 1-based position.
    """
    return Blocks(rows, keys, blocks or [line_block(order[0], block_size)]).scan(order, **specs).done()
