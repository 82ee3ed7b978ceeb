"""End-to-end flows: each is one lazy plan made of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.functions.fixed_values import SAFE_RULES
from rulewright.operators import code as C
from rulewright.operators import declarations as D
from rulewright.operators import edits as E
from rulewright.operators import findings as P
from rulewright.operators import fixes as A
from rulewright.operators import graph as G
from rulewright.operators import lines as L
from rulewright.operators import metrics as M
from rulewright.sources.scratch import ensure_checkpoint_dir, settled


def targets(findings: DataFrame, lines: DataFrame, project: str, cap: int | None = None, seed: int = 42,
            allow: list[str] = SAFE_RULES) -> DataFrame:
    """Open findings of a project that are on the allow-list and point into a known file, with their tier;
    ``cap`` keeps a seeded sample of that many."""
    chosen = P.route(P.select_fixable(P.filter_open(findings, project), allow), E.HANDLED)
    if cap is not None:
        chosen = P.sample_cap(chosen, cap, seed)
    return P.split_missing(chosen, lines)[0]


def fix_findings(findings: DataFrame, lines: DataFrame, project: str, cap: int | None = None, verdicts: DataFrame | None = None,
                 fn: Callable[[list[str]], list[str]] | None = None, allow: list[str] = SAFE_RULES) -> tuple[DataFrame, DataFrame]:
    """Findings to fixes, rule tier and model tier; (accepted files as lines, one result row per finding).

    Rule tier: all handlers propose edits of the files that have findings, conflicts are settled, one merge
    makes the new lines and each file passes the gate or stays as it was. Model tier: findings without a
    handler, or whose handler had nothing to change, are put to ``fn`` with the file as the rule tier left
    it; of a file's answers the one for the least finding id counts, and passes the same gate. Files without
    findings are neither read beyond their ids nor put together. What every later step reads - the chosen
    findings, their files, the edits, the new lines - is checkpointed once, as is a model's every answer.
    """
    ensure_checkpoint_dir(lines.sparkSession)
    chosen = targets(findings, lines, project, cap, allow=allow).checkpoint()
    files = chosen.select("file_id").distinct()
    old = lines.join(files, "file_id", "left_semi").checkpoint()
    edits = E.resolve(E.propose(chosen.where("tier = 'rule'"), old).checkpoint()).checkpoint()
    touched = old.join(edits.where("ok").select("file_id").distinct(), "file_id", "left_semi")
    merged = E.merge(touched, edits).checkpoint()
    gate = A.accept_lines(touched, merged, verdicts).checkpoint()
    accepted = merged.join(gate.where("accepted").select("file_id"), "file_id", "left_semi")
    by_finding = edits.groupBy("finding_id").agg(F.min("ok").alias("_ok"))
    state = chosen.join(by_finding, "finding_id", "left").join(gate.select("file_id", "accepted", F.col("reason").alias("_gate")), "file_id", "left")
    done = F.coalesce(F.col("_ok") & F.col("accepted"), F.lit(False))
    reason = F.when(done, None).when(F.col("_ok"), F.col("_gate")).when(~F.col("_ok"), "conflict").when(F.col("tier") == "rule", "no rewrite").otherwise("no handler")
    result = ["finding_id", "rule", "message", "component", "file_id", "line"]
    ruled = state.select(*result, "tier", done.alias("success"), reason.alias("reason"), F.col("_ok").isNull().alias("_open"))
    if fn is None:
        return accepted, ruled.drop("_open")

    asked = ruled.where("_open").join(files, "file_id", "left_semi")
    now = accepted.unionByName(old.join(accepted.select("file_id").distinct(), "file_id", "left_anti"))
    text = L.assemble(now.join(asked.select("file_id").distinct(), "file_id", "left_semi"))  # a prompt holds its file
    where = P.with_path(asked.drop("_open"))
    head = A.header_prompt(F.col("rule"), F.col("message"), F.col("path"), F.col("line"))
    prompts = where.join(text, "file_id").select("finding_id", F.concat(head, F.lit(f"\n{A.OPENING_FENCE}\n"), F.col("text"), F.lit(f"\n{A.CLOSING_FENCE}")).alias("prompt"))
    answers = A.batch_infer(prompts, fn).select("finding_id", A.first_code_block(F.coalesce("response", F.lit(""))).alias("text"), "error").checkpoint()
    answers = asked.select("finding_id", "file_id").join(answers, "finding_id")
    first = answers.where("text <> ''").groupBy("file_id").agg(F.min_by(F.struct("finding_id", "text"), "finding_id").alias("a")).select("file_id", "a.*")
    new = L.explode_lines(first, "file_id", "text")
    verdict = A.accept_lines(now, new, verdicts).checkpoint()
    taken = new.join(verdict.where("accepted").select("file_id"), "file_id", "left_semi")
    files_out = taken.unionByName(accepted.join(taken.select("file_id").distinct(), "file_id", "left_anti"))
    told = (asked.drop("tier", "success", "reason", "_open").join(answers.select("finding_id", "error", (F.col("text") == "").alias("_none")), "finding_id", "left")
            .join(first.select("file_id", F.col("finding_id").alias("_first")), "file_id", "left")
            .join(verdict.select("file_id", "accepted", F.col("reason").alias("_gate")), "file_id", "left"))
    mine = F.col("finding_id") == F.col("_first")
    good = F.coalesce(mine & F.col("accepted"), F.lit(False))
    why = F.when(good, None).when(F.col("error").isNotNull(), F.col("error")).when(F.col("_none"), "no code").when(mine, F.col("_gate")).otherwise("superseded")
    modelled = told.select(*result, F.lit("model").alias("tier"), good.alias("success"), why.alias("reason"))
    return files_out, ruled.where("NOT _open").drop("_open").unionByName(modelled)


def prompts(findings: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A1 for findings: (their prompts, (file_id, text) of their files). The findings' files are looked up once and cut
    into statements once; of all other files only the class names are read, which imports may mean."""
    mine = settled(lines.join(findings.select("file_id").distinct(), "file_id", "left_semi"))
    few = M.declarations(C.parse(mine), decisions=True)
    per_method = M.cyclomatic(few.where("method_line IS NOT NULL"))
    name = F.concat_ws(".", F.when(F.col("class_name") != "", F.col("class_name")), F.col("name"))
    detail = D.extract_methods(few).select("file_id", "start_line", name.alias("name")).join(
        per_method.withColumnRenamed("method_line", "start_line"), ["file_id", "start_line"])
    edges = G.import_edges(D.extract_imports(mine), G.class_map(D.type_names(lines)))
    text = L.assemble(mine)
    return A.render_prompts(P.with_path(findings), M.file_metrics(mine, per_method), A.method_details(detail),
                            A.dependency_details(edges), text), text


def fix_complex(findings: DataFrame, lines: DataFrame, fn: Callable[[list[str]], list[str]],
                rule: str = "java:S3776") -> DataFrame:
    """Complex findings: metrics, prompt, inference, code extraction and acceptance, per finding."""
    asked = P.split_missing(findings.where(F.col("rule") == rule), lines)[0]
    put, text = prompts(asked, lines)
    answers = A.batch_infer(put, fn)
    fixed = answers.select("finding_id", A.first_code_block(F.coalesce("response", F.lit(""))).alias("text"), "error")
    original = asked.select("finding_id", "file_id").join(text, "file_id").select("finding_id", "text")
    return A.accept_fixes(original, fixed, key="finding_id")  # one pass over the answers
