"""Text column helpers. Every regex uses explicit ASCII classes, so Java and RE2 agree on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[A-Za-z0-9_]+"
IDENT = "[A-Za-z_][A-Za-z0-9_]*"


def strip(c: Column) -> Column:
    """Remove white space at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def indent(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\s*)", 1)


def has(c: Column, *needles: str) -> Column:
    """True when the text contains any of the needles."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles])


def starts(c: Column, *prefixes: str) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(c, F.lit(p)) for p in prefixes])


def occurrences(c: Column, ch: str) -> Column:
    """How often one character occurs."""
    return F.length(c) - F.length(F.translate(c, ch, ""))


def tokens(c: Column) -> Column:
    """Distinct identifiers of a line."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({IDENT})"), F.lit(1)))


def plain_code(c: Column) -> Column:
    """A line without comment or literal marks."""
    return ~has(c, "//", "/*", "*", '"', "'")


def component_path(c: Column) -> Column:
    """P5: the part of a component key after the last colon."""
    return F.element_at(F.split(c, ":"), -1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _capitalised(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))


def to_camel_case(name: Column) -> Column:
    """camelCase; a one-letter member prefix (m, s, _) before a capital stays."""
    parts = F.split(F.lower(name), "_")
    rest = F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: p != "")
    return (
        F.when(name.rlike("^[ms_][A-Z]"),
               F.concat(F.substring(name, 1, 1), F.lower(F.substring(name, 2, 1)), F.substring(name, 3, 1 << 30)))
        .when(has(name, "_"), F.concat(F.element_at(parts, 1), F.array_join(_capitalised(rest), "")))
        .when(name.rlike("^[A-Z][a-z]"), F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30)))
        .otherwise(name)
    )


def to_pascal_case(name: Column) -> Column:
    """PascalCase."""
    parts = F.filter(F.split(F.lower(name), "_"), lambda p: p != "")
    return (
        F.when(has(name, "_"), F.array_join(_capitalised(parts), ""))
        .when(name.rlike("^[a-z]"), F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30)))
        .otherwise(name)
    )
