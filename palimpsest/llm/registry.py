"""Queries over whole tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontamination, mixing, quality_classifier, quality_rules, revisit, sharding, simhash, substring_dedup, token_counts, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", "removed", "repeats")


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op3_quality_rules"] = quality_rules.ORACLE_SQL


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "shard_id", "version", "tier", "shard_docs", "shard_bytes")


ORACLES["op5_sharding"] = sharding.ORACLE_SQL


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLES["op9_mixing"] = mixing.ORACLE_SQL


def captures(pages: DataFrame) -> DataFrame:
    """The pages as a crawl: a full response for each, and a later 304 for its URL in another spelling."""
    tag = F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16)
    day = (F.col("page_id") % 28).cast("string")
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("kind"), F.when(F.col("page_id") % 11 == 10, 404).otherwise(200).alias("status"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Last-Modified"), day, F.lit("Content-Length"), F.length("html").cast("string")).alias("headers"), F.col("html").alias("body"),
    )
    again = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("page_id") % 3 == 0, "#again").otherwise(""))
    renewed = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.regexp_replace(again, "^https?://(www[.])?", "HTTPS://www.").alias("url"), (F.col("page_id") + 1000 + F.col("page_id") % 13 * 100).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), F.when(F.col("page_id") % 5 == 0, "other").otherwise(F.concat(F.lit("W/"), tag)), F.lit("Date"), F.concat(F.lit("t"), F.col("page_id").cast("string")), F.lit("Content-Length"), F.lit("0"), F.lit("Set-Cookie"), F.lit("x=1")).alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return response.unionByName(renewed)


@query
def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisit.resolve(captures(table(spark, sf_dir, "pages")), only_304=True)
    names = ("cache-control", "content-length", "content-type", "date", "etag", "last-modified", "set-cookie")
    text = F.concat_ws(";", *(F.concat(F.lit(f"{n}="), F.try_element_at("headers", F.lit(n))) for n in names))
    return found.select("record_id", "url_key", "ts", "kind", "outcome", "source_id", F.length("body").cast("long").alias("body_chars"), F.md5("body").alias("body_md5"), text.alias("headers"))


ORACLES["op2_warc_revisits"] = f"""
WITH p AS (SELECT page_id, url, html, substr(md5(coalesce(html, '')), 1, 16) AS tag FROM pages),
a AS (SELECT page_id * 2 AS record_id, page_id AS ts, url, html AS body, tag, (page_id % 28)::VARCHAR AS day, CASE WHEN page_id % 11 = 10 THEN 404 ELSE 200 END AS status FROM p),
f AS (SELECT *, {revisit.canonical_sql('url')} AS url_key FROM a),
r AS (SELECT page_id * 2 + 1 AS record_id, page_id + 1000 + page_id % 13 * 100 AS ts, CASE WHEN page_id % 5 = 0 THEN 'other' ELSE tag END AS tag, 't' || page_id AS date,
        CASE WHEN page_id % 5 = 0 THEN 'other' ELSE 'W/' || tag END AS etag,
        regexp_replace(regexp_replace(url, '#.*$', '') || CASE WHEN page_id % 3 = 0 THEN '#again' ELSE '' END, '^https?://(www[.])?', 'HTTPS://www.') AS url FROM p),
k AS (SELECT *, {revisit.canonical_sql('url')} AS url_key FROM r),
j AS (SELECT k.*, f.record_id AS source_id, f.tag AS f_tag, f.day, f.body, row_number() OVER (PARTITION BY k.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) AS place
      FROM k LEFT JOIN f ON k.url_key = f.url_key AND f.ts < k.ts AND f.status = 200),
o AS (SELECT *, CASE WHEN source_id IS NULL THEN 'unmatched' WHEN tag = f_tag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j WHERE place = 1)
SELECT record_id, url_key, ts, 'response' AS kind, CASE WHEN status = 200 THEN 'full' ELSE 'not-full' END AS outcome, CASE WHEN status = 200 THEN record_id END AS source_id,
       length(body) AS body_chars, md5(body) AS body_md5, concat_ws(';', 'content-length=' || length(body), 'content-type=text/html', 'etag=' || tag, 'last-modified=' || day) AS headers FROM f
UNION ALL
SELECT record_id, url_key, ts, 'revisit', outcome, source_id, CASE WHEN outcome = 'resolved' THEN length(body) END, CASE WHEN outcome = 'resolved' THEN md5(body) END,
       CASE WHEN outcome = 'resolved' THEN concat_ws(';', 'content-length=' || length(body), 'content-type=text/html', 'date=' || date, 'etag=' || etag, 'last-modified=' || day)
            ELSE concat_ws(';', 'content-length=0', 'date=' || date, 'etag=' || etag, 'set-cookie=x=1') END FROM o"""


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
