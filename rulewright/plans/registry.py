"""Query registry: name, Spark callable and, where SQL can say it, the comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rulewright.sources import derived

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

_CTES = {
    "cl": f"cl AS MATERIALIZED ({derived.CODE_LINES_SQL})",
    "fe": f"fe AS MATERIALIZED ({derived.FINDINGS_SQL})",
    "cu": f"cu AS MATERIALIZED ({derived.UNIT_LINES_SQL})",
    "dg": f"dg AS MATERIALIZED ({derived.DEP_EDGES_SQL})",
}


def with_tables(names: str, *ctes: str, body: str) -> str:
    """SQL over the derived tables: ``names`` is e.g. "cl fe", then further CTEs, then the body."""
    parts = [_CTES[n] for n in names.split()] + list(ctes)
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" + body) if parts else body


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"
