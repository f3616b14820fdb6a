"""The queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dialogue, jaccard, langid, lempel_ziv, lines, media, merkle, mixing, packing, repeats, secretscan, sql, tokens, toxicity
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]

#: Parameters of the queries.
TOKEN_LIMIT = 2048
BYTE_RANKS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), words=4, percent=85)


def op3_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempel_ziv.edited_fingerprints(documents(spark, sf_dir))


def op4_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), block_words=BLOCK).drop("source")


def op9_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.store_payload(documents(spark, sf_dir)))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT, ranks=BYTE_RANKS)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digests(secretscan.scan(documents(spark, sf_dir)))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_phrase_fingerprints": op3_phrase_fingerprints,
    "op4_run_length_repeats": op4_run_length_repeats,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_progressive_jpeg": op9_progressive_jpeg,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_secret_scan": op11_secret_scan,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def _seeded(x: str, seed: int) -> str:
    p = mixing.PRIME
    first = f"((((coalesce({x}, -1) % {p}) + {p}) % {p}) * 48271 + {seed}) % {p}"
    return f"((xor({first}, ({first}) >> 15) * 69621 + 1013904223) % {p})"


def _apportioned(name: str, table: str, group: str, unit: str, votes: str, seats: str, order: str) -> str:
    """CTEs of the shares of ``seats`` by highest quotients, as ``mixing.apportion``."""
    by = f"PARTITION BY {group}" if group else ""
    return f"""{name}1 AS (SELECT *, CASE WHEN sum({votes}) OVER ({by}) > 0 THEN CAST(floor({seats} * ({votes} / sum({votes}) OVER ({by})) + 0.5) AS BIGINT) ELSE 0 END AS base FROM {table}),
 {name}2 AS (SELECT *, CAST(abs(sum(base) OVER ({by}) - {seats}) AS BIGINT) AS off FROM {name}1),
 {name}3 AS (SELECT *, greatest(0, base - off) AS sure, CAST({seats} - sum(greatest(0, base - off)) OVER ({by}) AS BIGINT) AS rest FROM {name}2),
 {name}4 AS (SELECT *, unnest(CASE WHEN off > 0 THEN range(sure + 1, base + off + 1) ELSE [NULL] END) AS k FROM {name}3),
 {name}5 AS (SELECT *, row_number() OVER ({by} ORDER BY {votes} / (2 * k - 1) DESC NULLS LAST, {order}, k) AS place FROM {name}4),
 {name} AS (SELECT {unit}, any_value(sure) + count(*) FILTER (k IS NOT NULL AND place <= rest) AS quota FROM {name}5 GROUP BY {unit})"""


def _taken(x: str, block: int) -> str:
    j = f"(({x}) // {block})"
    before, after = (f"(({k} * q + c) // m)" for k in (j, f"({j} + 1)"))
    return f"(passes * ({x}) + {before} * {block} + ({after} - {before}) * (({x}) - {j} * {block}))"


BLOCK = 16
_BEFORE = "OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
MIX_SQL = f"""WITH sized AS (SELECT doc_id, source IS NULL AS nul, coalesce(source, '') AS src, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, {_seeded("doc_id", 7)} AS h FROM documents),
 s1 AS (SELECT nul, src, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM sized GROUP BY 1, 2),
 s2 AS (SELECT *, row_number() OVER (ORDER BY nul, src) - 1 AS rk FROM s1),
 s3 AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 2 AS cap, source_size * 2 / CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS ratio FROM s2),
 s4 AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) {_BEFORE}, 0)) / (sum(w) OVER () - coalesce(sum(w) {_BEFORE}, 0)) AS level FROM s3),
 s5 AS (SELECT *, least(cap::DOUBLE, max(level) OVER () * w) AS target, CAST(least(ceil({mixing.SHARD_ROOTS} * sqrt(n)), ceil(n / {mixing.SHARD_ROWS})) AS BIGINT) AS shards FROM s4),
 sources AS (SELECT *, CAST(floor(sum(target) OVER () / {BLOCK} + 0.5) AS BIGINT) AS blocks FROM s5),
 {_apportioned("quotas", "sources", "", "nul, src", "target", "blocks", "rk")},
 dealt AS (SELECT d.*, source_size, target, rk, h % shards AS shard FROM sized d JOIN sources USING (nul, src)),
 parts AS (SELECT nul, src, shard, any_value(rk) AS rk, CAST(sum(size) AS BIGINT) AS words, any_value(quota) AS seats FROM dealt JOIN quotas USING (nul, src) GROUP BY 1, 2, 3),
 {_apportioned("shares", "parts", "nul, src", "nul, src, shard, words, rk", "words", "seats", "shard")},
 t1 AS (SELECT *, (words + {BLOCK - 1}) // {BLOCK} AS m FROM shares),
 t2 AS (SELECT *, least(quota, 2 * m) AS all_q, CASE WHEN m > 0 THEN greatest(0, least(quota, 2 * m) - 1) // m ELSE 0 END AS passes FROM t1),
 t3 AS (SELECT nul, src, shard, m, passes, all_q - passes * m AS q, CASE WHEN m > 0 THEN {_seeded("shard * 65537 + rk", 8)} % m ELSE 0 END AS c FROM t2),
 placed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY nul, src, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM dealt JOIN t3 USING (nul, src, shard))
 SELECT doc_id, size, source_size, target, CAST(CASE WHEN m > 0 THEN {_taken("stop", BLOCK)} - {_taken("stop - size", BLOCK)} ELSE 0 END AS BIGINT) AS taken FROM placed"""

ORACLE: dict[str, str] = {"op8_source_mix": MIX_SQL, "op11_secret_scan": sql.secrets_sql(), "op12_conversation_repair": sql.dialogue_sql(), "op13_merkle_manifest": sql.merkle_sql()}
