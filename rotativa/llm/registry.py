"""The queries of the training-data operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotativa.llm import cross_tokens, exact_dedup, lm, mixing, near_dup, neighbours, packing, pii, repetition, toxicity, url_rules, warc, whitening
from rotativa.llm.common import id_remainder, table
from rotativa.session import materialize

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("first").alias("kept"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id", "source"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = repetition.measure_repetition(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & repetition.repetition_verdict())


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in pii.KINDS],
        F.sha2(pii.in_words(F.col("base_spans")), 256).alias("base_sha256"),
        pii.in_words(F.col("spans")).alias("spans"),
    )


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = warc.write_bundles(table(spark, sf_dir, "pages"))
    return warc.read_bundles(materialize(bundles, "warc"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), id_remainder("doc_id", 7) != 2)


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.stored_pieces(table(spark, sf_dir, "documents")))


def op11_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokens.align_tokens(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    # At sizes where the exact number has no place in a long, it is null here and stays in the operator's result.
    deviation = F.col("deviation").try_cast("bigint").alias("deviation")
    return found.select(F.col("id").alias("vec_id"), "component", "n", deviation, "whitened", "explained", "identity_error")


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_toxicity": op2_toxicity,
    "op3_mix_sources": op3_mix_sources,
    "op4_url_filter": op4_url_filter,
    "op5_nearest_vectors": op5_nearest_vectors,
    "op6_repetition_rules": op6_repetition_rules,
    "op7_personal_data": op7_personal_data,
    "op8_warc_round_trip": op8_warc_round_trip,
    "op9_language_model": op9_language_model,
    "op10_pack_sequences": op10_pack_sequences,
    "op11_cross_tokens": op11_cross_tokens,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_whitened_vectors": op13_whitened_vectors,
}

_BLANK = r"[^\x20\x09-\x0D]+"

ORACLE = {
    "op3_mix_sources": rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_BLANK}')), 0) AS size FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, source_size * 3 AS cap, source_size * 3 / weight AS ratio,
    sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER earlier, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS weights
  FROM sizes
  WINDOW earlier AS (ORDER BY source_size * 3 / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (SELECT *, rest::DOUBLE / weights::DOUBLE AS level FROM ranked),
targets AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN cap::DOUBLE
    ELSE (SELECT max(level) FROM levels WHERE ratio > level) * weight END AS target,
    ('0x' || substr(md5('mix-1:' || coalesce(source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM levels
), placed AS (
  SELECT doc_id, size, source_size, target, shift,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected,
    row_number() OVER (PARTITION BY s.source ORDER BY size, substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8), doc_id) - 1 AS i
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, least((floor((i + 1) * expected + shift) - floor(i * expected + shift))::BIGINT, 3) AS copies FROM placed
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM counted
""",
    "op4_url_filter": r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), rules(verdict, rule, rule_host, rule_path) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
    ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), fits AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules r
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path
""",
    "op12_exact_dedup": r"""
WITH normal AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM normal WINDOW same AS (PARTITION BY text_sha256)
""",
}
