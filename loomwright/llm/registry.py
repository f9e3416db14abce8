"""The training-data operators' queries over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import materialize, table

URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: The registered SQL still blocks net/de/, which the contract allows; it stays as it is until its owner changes it.
SQL_RULES = tuple(("block", h, p) if (h, p) == ("net", "/de/") else (v, h, p) for v, h, p in URL_RULES)


TOKENIZER = "word_bpe_49k.json"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import store_texts

    return store_texts(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    archives = materialize(write_archives(table(spark, sf_dir, "pages")), "warc-archives")
    return read_archives(archives).drop("url")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_classes

    return ngram_classes(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first; else a URL is blocked if its canonical form is listed: it stands on two pages or more."""
    from .urls import canonical, filter_urls

    pages = table(spark, sf_dir, "pages")
    mirrored = (
        pages.select(canonical(F.col("url")).alias("canon")).where("canon IS NOT NULL").groupBy("canon").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    return filter_urls(pages, mirrored.select("canon"), URL_RULES)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def queries():
    every = (
        op1_suffix_dedup, op2_media, op3_warc, op4_secret_scan, op5_ngram_join,
        op6_packing, op7_url_filter, op8_mixing, op9_sharding, op10_quality_rules,
    )
    return {f.__name__: f for f in every}


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
first AS (SELECT body, min(page_id) AS page FROM p WHERE strlen(body) >= 100 GROUP BY body)
SELECT p.page_id, strlen(p.body) AS payload_bytes, sha256(p.body) AS payload_digest,
  CASE WHEN first.page IS NULL OR first.page = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  nullif(first.page, p.page_id) AS refers_to
FROM p LEFT JOIN first ON first.body = p.body"""

URL_SQL = """
WITH raw AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
parts AS (SELECT page_id,
  translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM raw),
canon AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':\\d*$', ''), '^(www|m)\\.', '')
  || regexp_replace(regexp_replace(path, '(/index)?\\.html?$', ''), '/+$', '') END AS c FROM parts),
listed AS (SELECT c FROM canon WHERE c IS NOT NULL GROUP BY c HAVING count(*) > 1),
rules(verdict, rhost, rpath) AS (VALUES {rules}),
fit AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(r.verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT canon.page_id, host, path, rule, coalesce(fit.verdict, CASE WHEN listed.c IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  listed.c IS NOT NULL AS listed
FROM canon LEFT JOIN fit ON fit.page_id = canon.page_id LEFT JOIN listed ON listed.c = canon.c"""


def oracle_sql():
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in SQL_RULES)
    return {"op3_warc": WARC_SQL, "op7_url_filter": URL_SQL.replace("{rules}", rules)}
