"""The queries of the training-data operators over the given tables, with comparison SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.llm import (decontam, exact_dedup, hard_negatives, html_text, langid, licenses, lm, merkle, packing, secrets, shards, simhash, warc)
from rulewright.llm.common import fold, table

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query("""SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


# A tree of directories from the table's own columns: every hundredth document is a licence file at some level.
PATH = """concat(coalesce(source, 'none'), '/', CASE
  WHEN doc_id % 5000 = 200 THEN 'LICENSE'
  WHEN doc_id % 1000 = 100 THEN concat(coalesce(lang, 'none'), '/COPYING')
  WHEN doc_id % 100 = 0 THEN concat(coalesce(lang, 'none'), '/d', (doc_id div 100) % 10, '/LICENSE')
  ELSE concat(coalesce(lang, 'none'), '/d', (doc_id div 100) % 10, '/s', doc_id % 3, '/doc', doc_id, '.txt') END)"""


@query()
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").withColumn("path", F.expr(PATH)))
    return found.withColumnRenamed("id", "doc_id")


@query()
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"), budget=2, width=3).select(
        F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query("""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST(concat('0x', substr(x, CAST(i // 4 * 5 + 1 AS INT), 5)) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h""")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    return warc.round_trip(pages, min_bytes=0).select(
        F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


@query(r"""WITH w AS (SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS rid, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents
  UNION ALL SELECT 'i', item_id, row_number() OVER (), regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark),
s AS (SELECT DISTINCT side, id, rid, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT side, id, rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT id, rid, count(*) AS n FROM s WHERE side = 'i' GROUP BY ALL),
c AS (SELECT d.id AS doc_id, d.rid AS drid, i.id AS item_id, i.rid, count(*) AS n_shared FROM s d JOIN s i ON d.s = i.s
  WHERE d.side = 'd' AND i.side = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, n_shared, n_shared / n AS containment FROM c JOIN n USING (rid) WHERE n_shared >= 0.8 * n""")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    return langid.predict(docs, langid.train(docs.where(~held_out)), carry=held_out).select(
        F.col("id").alias("doc_id"), F.col("carry").alias("held_out"), "lang_pred", "score")


@query()
def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), shards=40).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).withColumnRenamed("id", "doc_id")


def _span_sql() -> str:
    parts = []
    for no, (kind, pattern, group, least) in enumerate(secrets.BASE_RULES):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""SELECT rid, '{kind}' AS kind, {no} AS no, least({least}, length(v)) = {least} AS ok, length(g) AS g, length(m) AS n, i
  FROM (SELECT rid, unnest(string_split_regex(text, {p})) AS g, unnest(regexp_extract_all(text, {p}, 0)) AS m, unnest(regexp_extract_all(text, {p}, {group})) AS v,
    generate_subscripts(string_split_regex(text, {p}), 1) AS i FROM d WHERE regexp_matches(text, {p}))""")
    return "\n  UNION ALL ".join(parts)


@query(f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
a AS ({_span_sql()}),
b AS (SELECT *, sum(g + coalesce(n, 0)) OVER (PARTITION BY rid, kind ORDER BY i) - coalesce(n, 0) AS s FROM a),
f AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(concat(kind, ':', s, ':', s + n), ',' ORDER BY s, no) AS spans FROM b WHERE ok AND n IS NOT NULL GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (rid)""")
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.create_ledger(spark))
    spans = secrets.joined(F.col("spans"))  # the ledger has no rules beyond the base ones
    return found.select(F.col("id").alias("doc_id"), *(secrets.count_kind(F.col("spans"), r[0]).alias(f"n_{r[0]}") for r in secrets.BASE_RULES),
                        F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


@query()
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 7) == 2
    training = docs.where(~held_out)
    counts = lm.count_tokens(training)
    vocab = lm.vocabulary(counts)
    found = lm.score(docs, counts, vocab, lm.train(training, vocab), carry=held_out)
    return found.select(F.col("id").alias("doc_id"), F.col("carry").alias("held_out"), "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"),
                        "base_score", "score")


def _merkle_sql() -> str:
    """Ten levels of eight, enough for 8^10 rows of a language; a tree that is down to one node keeps it."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    field = lambda c: f"coalesce(concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', {c}), '-')"
    leaf = lambda text: f"sha256(concat({', '.join(map(field, ['doc_id', 'source', 'lang', 'n_chars', text]))}))"
    up = """SELECT t, i // 8 AS i, CAST(ceil(n / 8) AS BIGINT) AS n, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {0} GROUP BY t, i // 8, n"""
    parts = [f"""crc(doc_id, odd) AS (SELECT doc_id, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) FROM (SELECT DISTINCT doc_id FROM documents)),
d AS (SELECT doc_id, coalesce('=' || lang, '') AS t, {leaf('text')} AS h, CASE WHEN xor(odd, 4294967295) % 3 = 0 THEN {leaf(f"translate(text, '{upper}', '{lower}')")} ELSE {leaf('text')} END AS now
  FROM documents JOIN crc USING (doc_id)),
a0 AS MATERIALIZED (SELECT t, row_number() OVER (PARTITION BY t ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY t) AS n, h, doc_id, now FROM d)"""]
    parts += [f"a{k + 1} AS MATERIALIZED ({up.format(f'a{k}')})" for k in range(10)]
    parts += ["b0 AS MATERIALIZED (SELECT 1 AS t, row_number() OVER (ORDER BY encode(t)) - 1 AS i, count(*) OVER () AS n, h, t AS lang FROM a10)"]
    parts += [f"b{k + 1} AS MATERIALIZED ({up.format(f'b{k}')})" for k in range(10)]
    proof, now, joins = [], "now", []
    for x, i, t in (("a", "a0.i", "a0.t"), ("b", "b0.i", "1")):
        for k in range(10):
            own, run = f"({i} // {8 ** k})", f"{x}r{k}"
            joins.append(f"LEFT JOIN (SELECT t, i // 8 AS g, array_agg(h ORDER BY i) AS r FROM {x}{k} WHERE n > 1 GROUP BY ALL) {run} ON {run}.t = {t} AND {run}.g = {own} // 8")
            before, after = (f"coalesce(array_to_string({run}.r[{cut}], ''), '')" for cut in (f"1:CAST({own} % 8 AS INT)", f"CAST({own} % 8 AS INT) + 2:"))
            proof += [before, after]
            parts_now = f"f{x}{k}"
            joins.append(f"CROSS JOIN LATERAL (SELECT CASE WHEN {run}.r IS NULL THEN {now} ELSE sha256(concat({before}, {now}, {after})) END AS {parts_now})")
            now = parts_now
        if x == "a":
            joins.append("JOIN b0 ON b0.lang = a0.t")
    return (f"WITH {', '.join(parts)} SELECT doc_id, a0.h AS leaf, b0.h AS subroot, (SELECT h FROM b10) AS root, sha256(concat({', '.join(proof)})) AS proof_sha256, "
            f"{now} AS folded_root, {now} = (SELECT h FROM b10) AS verified FROM a0 {' '.join(joins)}")


@query(_merkle_sql())
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(fold("doc_id", 3) == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    found = merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", arity=8, changed={"text": tampered})
    folded = merkle.fold(F.col("changed_leaf"), F.col("path"))
    out = found.select(F.col("key").alias("doc_id"), *(merkle.hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")),
                       merkle.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query()
def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_text.extract(pages, html_text.train(pages), carry=("url",))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
