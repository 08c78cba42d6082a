"""The contract's queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exactdedup, html, lm, packing, quality, sharding, simhash, sstable, warc
from .common import written


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sstable.write(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return sstable.read(spark, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = sharding.shard(_table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    digest = written(moved.select("doc_id", "size", crc.alias("text_crc32"), "shard", "range", "here"), "shard-digest")
    return sharding.slots(digest).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = written(quality.measure(_table(spark, sf_dir, "documents"), ["doc_id", "source"]), "quality")
    return quality.judge(measured, "source").select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op4_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(_table(spark, sf_dir, "documents"))


def op5_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.groups(_table(spark, sf_dir, "documents"))


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(_table(spark, sf_dir, "documents"), ranks, pattern)


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.fit_and_score(_table(spark, sf_dir, "documents"))


def op9_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
v AS (SELECT r, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, w, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS again FROM v),
f AS (SELECT r, w, again OR coalesce(lag(again) OVER p, false) OR coalesce(lag(again, 2) OVER p, false) AS covered FROM c WINDOW p AS (PARTITION BY r ORDER BY i)),
m AS (SELECT r, count(*) AS n, sum(length(w)) AS ch, count(*) FILTER (covered) AS rep FROM f GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
b AS (SELECT doc_id, source, coalesce(n, 0)::BIGINT AS n_words, coalesce(ch, 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN m USING (r) LEFT JOIN l USING (r)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM j GROUP BY source),
s AS (SELECT sum(f)::DOUBLE / sum(n) AS mean, coalesce(var_samp(f::DOUBLE / n), 0) AS v, avg(1.0::DOUBLE / n) AS i FROM h),
p AS (SELECT mean, CASE WHEN mean * (1 - mean) <= 0 THEN 1.0 WHEN v - mean * (1 - mean) * i <= 0 THEN 1000.0
  ELSE least(1000.0, greatest(1.0, mean * (1 - mean) / (v - mean * (1 - mean) * i) - 1)) END AS weight FROM s),
bad AS (SELECT source FROM h, p WHERE (f + mean * weight) / (n + weight) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM j.source) AS kept
FROM j
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS p FROM documents),
g AS (SELECT doc_id, sha256(t) AS s, count(*) OVER (PARTITION BY t) AS n,
  first_value(doc_id) OVER (PARTITION BY t ORDER BY p DESC, doc_id NULLS LAST) AS k, row_number() OVER (PARTITION BY t ORDER BY p DESC, doc_id NULLS LAST) AS o FROM d)
SELECT doc_id, k AS keep_id, n AS group_size, o = 1 AS kept, s AS text_sha256 FROM g
"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, html, sha1(html) AS h, row_number() OVER w AS o, first_value(page_id) OVER w AS best
  FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::INT >> ((3 - i % 4) * 5)::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN o = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN o > 1 THEN best END AS refers_to
FROM q
"""

QUERIES = {f.__name__: f for f in (op1_sstable_shards, op2_histogram_sort, op3_host_quality, op4_simhash_ball, op5_chunk_recipes, op6_bpe_transducer, op7_harmonic_packing, op8_maxent_lm, op9_tree_scoring, op10_warc_revisits)}
ORACLE_SQL: dict[str, str] = {"op3_host_quality": OP3_SQL, "op5_chunk_recipes": OP5_SQL, "op10_warc_revisits": OP10_SQL}
