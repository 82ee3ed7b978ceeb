"""Fix generation and acceptance (A1-A4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions.text import strip
from rulewright.operators import lines as L
from rulewright.operators.scan import Total, scan

# Section titles of the prompt, in order; the wording around them is free.
SECTIONS = ["ISSUE DETAILS:", "CODE METRICS:", "METHOD DETAILS:", "DEPENDENCIES:", "ORIGINAL CODE:", "REFACTORED CODE:"]
OPENING_FENCE, CLOSING_FENCE = "```java", "```"
UNKNOWN, NO_MESSAGE = "Unknown", "No message provided"


def _bullets(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {name}: "), value)


def method_details(per_method: DataFrame) -> DataFrame:
    """The method block of a file's prompt from (file_id, start_line, name, metric columns)."""
    metrics = [c for c in per_method.columns if c not in ("file_id", "start_line", "name")]
    entry = F.concat(F.lit("- "), F.col("name"), F.lit(":"),
                     *[F.concat(F.lit(f"\n  {m}: "), F.col(m).cast("string")) for m in metrics])
    items = F.sort_array(F.collect_list(F.struct("start_line", "name", entry.alias("t"))))
    return per_method.groupBy("file_id").agg(F.array_join(F.transform(items, lambda x: x["t"]), "\n").alias("method_details"))


def dependency_details(edges: DataFrame) -> DataFrame:
    items = F.array_sort(F.collect_set("dst"))
    return edges.groupBy(F.col("src").alias("file_id")).agg(
        F.array_join(F.transform(items, lambda d: F.concat(F.lit("- file: "), d.cast("string"))), "\n").alias("dependencies"))


def render_prompts(findings: DataFrame, totals: DataFrame, methods: DataFrame, deps: DataFrame, code: DataFrame) -> DataFrame:
    """A1: one prompt per finding, from per-file tables with at most one row per file.

    ``totals`` is (file_id, metric columns); the others hold the texts made by the functions above
    and ``code`` is (file_id, text). A prompt holds its file's whole text, as specified.
    """
    metrics = [c for c in totals.columns if c != "file_id"]
    block = totals.select("file_id", F.concat_ws("\n", *[_bullets(m, F.col(m).cast("string")) for m in metrics]).alias("metrics"))
    parts = (findings.join(block, "file_id", "left").join(methods, "file_id", "left").join(deps, "file_id", "left")
             .join(code, "file_id", "left"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    issue = F.concat_ws("\n", _bullets("Rule", F.coalesce("rule", F.lit(UNKNOWN))),
                        _bullets("Message", F.coalesce("message", F.lit(NO_MESSAGE))),
                        _bullets("File", F.coalesce("path", F.lit(UNKNOWN))))
    fenced = F.concat(F.lit(OPENING_FENCE + "\n"), text("text"), F.lit("\n" + CLOSING_FENCE))
    bodies = [issue, text("metrics"), text("method_details"), text("dependencies"), fenced, F.lit(OPENING_FENCE)]
    prompt = F.concat_ws("\n\n", F.lit("Fix the finding below and keep the behaviour of the code."),
                         *[F.concat(F.lit(s + "\n"), b) for s, b in zip(SECTIONS, bodies)])
    return parts.select("finding_id", prompt.alias("prompt"))


def line_prompt(rule: Column, message: Column, path: Column, line: Column, text: Column) -> Column:
    """A1, short form for one line."""
    return F.concat_ws("\n", F.concat(F.lit("Fix finding "), rule, F.lit(": "), message), F.concat(F.lit("File: "), path),
                       F.concat(F.lit("Line "), line.cast("string"), F.lit(":")), text, F.lit("Answer with the fixed line only."))


def header_prompt(rule: Column, message: Column, path: Column, line: Column) -> Column:
    """A1, short form without code."""
    return F.concat_ws("\n", F.lit("Fix this finding:"), F.concat(F.lit("Rule: "), rule), F.concat(F.lit("Message: "), message),
                       F.concat(F.lit("File: "), path), F.concat(F.lit("Line: "), line.cast("string")),
                       F.lit("Answer with the fixed code only."))


def first_code_block(text: Column) -> Column:
    """A2: the first closed java block of a response, "" when there is none.

    A fence is a line that equals it after trimming; a second opening fence starts the block anew.
    Works inside the row, so it needs no shuffle.
    """
    lines = F.split(text, "\n", -1)
    marks = F.transform(lines, strip)
    first = F.array_position(marks, OPENING_FENCE).cast("int")
    at = F.greatest(first, F.lit(1))  # slice needs a valid start on every row
    tail = F.slice(marks, at, F.size(marks))
    rest = F.array_position(tail, CLOSING_FENCE).cast("int")
    close = at - 1 + rest
    span = F.slice(marks, at, F.greatest(rest - 1, F.lit(0)))
    open_ = close - F.array_position(F.reverse(span), OPENING_FENCE).cast("int")
    body = F.slice(lines, F.greatest(open_ + 1, F.lit(1)), F.greatest(close - open_ - 1, F.lit(0)))
    return F.when((first > 0) & (rest > 0), F.array_join(body, "\n")).otherwise("")


def batch_infer(prompts: DataFrame, fn: Callable[[list[str]], list[str]], batch_rows: int = 256) -> DataFrame:
    """A3: call ``fn`` on batches of prompts. A failing batch is cut in halves until the failing rows are alone,
    so one bad prompt among 256 costs some 16 calls; every other prompt of the failing half is asked again only
    on the way down.

    The output has (finding_id, response, error): an error stays with its row and the job goes on. The id keeps
    its type.
    """
    def ask(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            answers = list(fn(texts))
            if len(answers) != len(texts):
                raise ValueError(f"{len(answers)} answers for {len(texts)} prompts")
            return [(a, None) for a in answers]
        except Exception as e:
            if len(texts) <= 1:
                return [(None, str(e))] * len(texts)
            half = len(texts) // 2
            return ask(texts[:half]) + ask(texts[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), batch_rows):
                part = frame.iloc[at:at + batch_rows]
                got = ask(list(part["prompt"]))
                yield pd.DataFrame({"finding_id": part["finding_id"].values, "response": [g[0] for g in got], "error": [g[1] for g in got]})

    id_type = prompts.schema["finding_id"].dataType.simpleString()
    return prompts.select("finding_id", "prompt").mapInPandas(run, f"finding_id {id_type}, response string, error string")


def balanced(text: Column) -> Column:
    """Whether (), [] and {} each close what they open and never go negative. Map-only.

    A weaker check than parsing: it does not look at the order of different brackets.
    """
    marks = F.split(F.regexp_replace(text, r"[^(){}\[\]]", ""), "")

    def step(acc, ch):
        def move(k, o, c):
            return acc[k] + F.when(ch == o, 1).when(ch == c, -1).otherwise(0)
        p, s, b = move("p", "(", ")"), move("s", "[", "]"), move("b", "{", "}")
        return F.struct(p.alias("p"), s.alias("s"), b.alias("b"), (acc["ok"] & (p >= 0) & (s >= 0) & (b >= 0)).alias("ok"))

    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("s"), F.lit(0).alias("b"), F.lit(True).alias("ok"))
    return F.aggregate(marks, start, step, lambda a: a["ok"] & (a["p"] == 0) & (a["s"] == 0) & (a["b"] == 0))


HEADS = r"^\s*(?:package |import |public class|class |interface |enum )"


def accept_fixes(old: DataFrame, new: DataFrame, verdicts: DataFrame | None = None, key: str = "file_id") -> DataFrame:
    """A4: accept a fix that is not empty, differs, is balanced and whose test verdict is not false.

    ``verdicts`` is (key, passed) with at most one row per key; no verdict counts as passed. ``form``
    says whether the text is a whole unit or a fragment; further columns of ``new`` are kept.
    """
    text, before = F.col("text"), F.col("_old")
    more = [c for c in new.columns if c not in (key, "text")]
    checked = new.join(old.select(key, text.alias("_old")), key, "left")
    checked = checked.join(verdicts, key, "left") if verdicts is not None else checked.withColumn("passed", F.lit(True))
    blank = strip(text) == ""
    reason = (F.when(F.coalesce(blank, F.lit(True)), "empty").when(text.eqNullSafe(before), "unchanged")
              .when(~balanced(text), "unbalanced").when(F.coalesce(F.col("passed"), F.lit(True)) == F.lit(False), "tests failed"))
    return checked.select(key, *more, reason.isNull().alias("accepted"), reason.alias("reason"),
                          F.when(text.rlike(HEADS), "unit").otherwise("fragment").alias("form"))


# A4 by lines ------------------------------------------------------------------------------------
def line_balance(line: Column) -> Column:
    """What a line does to the depth of (), [] and {}: per kind the sum and the lowest value on the way, the
    elements of a monoid that runs over the lines of a file."""
    marks = F.split(F.regexp_replace(line, r"[^(){}\[\]]", ""), "")

    def step(acc, ch):
        out = []
        for k, (o, c) in BRACKETS.items():
            s = acc[k] + F.when(ch == o, 1).when(ch == c, -1).otherwise(0)
            out += [s.alias(k), F.least(acc[f"{k}_low"], s).alias(f"{k}_low")]
        return F.struct(*out)

    start = F.struct(*[F.lit(0).alias(n) for k in BRACKETS for n in (k, f"{k}_low")])
    return F.aggregate(marks, start, step)


BRACKETS = {"round": ("(", ")"), "square": ("[", "]"), "curly": ("{", "}")}


def balanced_files(lines: DataFrame, block_size: int | None = None) -> DataFrame:
    """(file_id, balanced) for files with brackets: no depth goes below zero and all end at zero. No file is put
    together: lines send their sums and lows, which run over the file by blocks."""
    few = lines.where(F.col("line").rlike(r"[(){}\[\]]")).select("file_id", "line_no", line_balance(F.col("line")).alias("b")).select("file_id", "line_no", "b.*")
    runs = scan(few, ["file_id"], ["line_no"], block_size, **{f"{k}_run": Total(F.col(k).cast("bigint")) for k in BRACKETS})
    ok = [(F.min(F.col(f"{k}_run") - F.col(k) + F.col(f"{k}_low")) >= 0) & (F.sum(k) == 0) for k in BRACKETS]
    return runs.groupBy("file_id").agg((ok[0] & ok[1] & ok[2]).alias("balanced"))


def file_digests(lines: DataFrame) -> DataFrame:
    """(file_id, digest): count and combined hash of a file's numbered lines."""
    return lines.groupBy("file_id").agg(F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("line_no", "line")).alias("x"),
                                                 F.sum(F.xxhash64("line", "line_no").cast("decimal(38,0)")).alias("s")).alias("digest"))


def accept_lines(old: DataFrame, new: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """A4 for line tables: the columns of :func:`accept_fixes` by file. Texts are never put together, so a
    file of any size passes; changes show in line digests."""
    solid = strip(F.col("line")) != ""
    first = F.min_by("line", F.when(solid, F.col("line_no")))
    facts = new.groupBy("file_id").agg(F.max(solid).alias("_solid"), first.alias("_first"))
    same = file_digests(new).join(file_digests(old).withColumnRenamed("digest", "_old"), "file_id").where(F.col("digest") == F.col("_old")).select(
        "file_id", F.lit(True).alias("_same"))
    checked = facts.join(same, "file_id", "left").join(balanced_files(new), "file_id", "left")
    checked = checked.join(verdicts, "file_id", "left") if verdicts is not None else checked.withColumn("passed", F.lit(True))
    reason = (F.when(~F.coalesce("_solid", F.lit(False)), "empty").when(F.col("_same"), "unchanged")
              .when(~F.coalesce("balanced", F.lit(True)), "unbalanced").when(~F.coalesce("passed", F.lit(True)), "tests failed"))
    return checked.select("file_id", reason.isNull().alias("accepted"), reason.alias("reason"),
                          F.when(F.col("_first").rlike(HEADS), "unit").otherwise("fragment").alias("form"))
