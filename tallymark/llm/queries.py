"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chaining, cotraining, near_dedup, packing, quality_rules, sharding, suffix_dedup, url_filters

BYTE_BPE = "byte_bpe_50k.tiktoken"
BYTE_TOKENIZER = "byte_bpe_50k.json"
BYTE_BPE_SPECIAL = {"<|endoftext|>": 50256}
WORD_BPE = "word_bpe_49k.json"
CAPACITY, END_ID = 1024, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cotraining_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: F.pmod(vec_id, F.lit(50)) == 0, 5)


def packed(docs: DataFrame, keep_ids: bool = False) -> DataFrame:
    pieces = packing.token_pieces(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.PATTERN, BYTE_BPE_SPECIAL, CAPACITY, END_ID, keep_ids)
    return packing.pack(pieces, CAPACITY)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).drop("ids")


def year():
    """The first instant of the year that the derived dates lie in; it has no time zone, so the session's plays no part."""
    return F.lit("2024-01-01").cast("timestamp_ntz")


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time: the table has none, so it follows from the id, over the year 2024."""
    minute = F.pmod(F.col("page_id") * 7919, F.lit(525600))
    return pages.select("page_id", "url", (year() + F.make_dt_interval(mins=minute.cast("int"))).alias("fetched_at"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list over the table's own hosts: hosts are blocked and lifted again, one domain and some sections are listed late."""
    host = F.regexp_extract(F.lower("url"), url_filters.HOST, 2)
    hosts = pages.select(host.alias("host")).where("host <> ''").distinct().withColumn("n", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("long"))
    steps = [(0, "host", F.col("host"), "block", F.col("n") % 90), (1, "host", F.col("host"), "allow", 90 + F.col("n") % 70), (2, "host", F.col("host"), "lift", 170 + F.col("n") % 80), (3, "prefix", F.concat("host", F.lit("/en")), "block", 200 + F.col("n") % 100), (4, "domain", F.regexp_extract("host", "[^.]+[.][^.]+$", 0), "block", 320 + F.col("n") % 3)]
    entry = lambda k, kind, pattern, action, day: F.struct((F.col("n") * 8 + k).alias("entry_id"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), (year() + F.make_dt_interval(days=day.cast("int"))).alias("listed_at"))
    five = F.filter(F.array(*(entry(*s) for s in steps)), lambda e: F.pmod(e["entry_id"], F.lit(8)) != F.col("n") % 5)
    return hosts.select(F.explode(five).alias("e")).select("e.*")  # one scan of the pages makes all entries


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.filter_urls(captures(pages), dated_list(pages))


OP4_SQL = r"""
WITH captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(CAST((page_id * 7919) % 525600 AS BIGINT)) AS fetched_at,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://([^/?#@]*@)?([^/?#:]+)', 2) AS host,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://[^/?#]+/([^/?#]+)', 1) AS segment
  FROM pages),
hosts AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 4) AS BIGINT) AS n FROM captures WHERE host <> ''),
entries AS (
  SELECT n * 8 + 0 AS entry_id, 'host' AS kind, host AS pattern, 'block' AS action, TIMESTAMP '2024-01-01' + to_days(CAST(n % 90 AS INTEGER)) AS listed_at FROM hosts WHERE n % 5 <> 0
  UNION ALL SELECT n * 8 + 1, 'host', host, 'allow', TIMESTAMP '2024-01-01' + to_days(CAST(90 + n % 70 AS INTEGER)) FROM hosts WHERE n % 5 <> 1
  UNION ALL SELECT n * 8 + 2, 'host', host, 'lift', TIMESTAMP '2024-01-01' + to_days(CAST(170 + n % 80 AS INTEGER)) FROM hosts WHERE n % 5 <> 2
  UNION ALL SELECT n * 8 + 3, 'prefix', host || '/en', 'block', TIMESTAMP '2024-01-01' + to_days(CAST(200 + n % 100 AS INTEGER)) FROM hosts WHERE n % 5 <> 3
  UNION ALL SELECT n * 8 + 4, 'domain', regexp_extract(host, '[^.]+[.][^.]+$', 0), 'block', TIMESTAMP '2024-01-01' + to_days(CAST(320 + n % 3 AS INTEGER)) FROM hosts WHERE n % 5 <> 4),
current AS (SELECT kind, pattern, listed_at, max(entry_id) AS entry_id, arg_max(action, entry_id) AS action FROM entries GROUP BY ALL),
held AS (SELECT *, lead(listed_at) OVER (PARTITION BY kind, pattern ORDER BY listed_at) AS valid_to FROM current),
hits AS (
  SELECT c.page_id, h.*, row_number() OVER (PARTITION BY c.page_id ORDER BY CASE kind WHEN 'prefix' THEN 2000 WHEN 'host' THEN 1000 ELSE length(pattern) END DESC, entry_id DESC) AS nth
  FROM captures c JOIN held h ON c.fetched_at >= h.listed_at AND (h.valid_to IS NULL OR c.fetched_at < h.valid_to) AND h.action <> 'lift'
   AND ((h.kind = 'host' AND h.pattern = c.host) OR (h.kind = 'prefix' AND h.pattern = c.host || '/' || c.segment)
     OR (h.kind = 'domain' AND (c.host = h.pattern OR c.host LIKE '%.' || h.pattern))))
SELECT c.page_id, c.url, c.fetched_at, nullif(c.host, '') AS host, coalesce(h.action, 'pass') AS verdict, h.entry_id, h.listed_at
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.nth = 1
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op7_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(table(spark, sf_dir, "documents"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), digest=True)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.Options(words=2, numerator=80, denominator=100))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cotraining_classifier": op1_cotraining_classifier,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_url_filters": op4_url_filters,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_sharding": op6_sharding,
    "op7_fuzzy_passages": op7_fuzzy_passages,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality_rules": op10_quality_rules,
}
ORACLES: dict[str, str] = {"op4_url_filters": OP4_SQL}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
