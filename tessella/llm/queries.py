"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import classifier, decontam, lm, mixing, ngram_join, quality, secrets, spelling, substring, tokens, urlfilter, warc, whitening
from tessella.llm._util import table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), RULES, keep=("page_id",))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.records_of_pages(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select(F.col("id").alias("revisit_id"), "url_key", F.col("response_id"), "verdict", headers.alias("headers"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.find_repeats(table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "n_words", F.col("first_key").alias("first_doc_id"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes_of(table(spark, sf_dir, "documents"), n=3, num=9, den=10)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
  (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT max_by(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM parts
"""

OP4_SQL = r"""
WITH named AS (
  SELECT page_id AS k, html, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') || regexp_extract(rest, '^[^/?]*(.*)$', 1), '/$', '') AS url_key
  FROM (SELECT page_id, html, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM pages)),
responses AS (
  SELECT k * 10 AS id, k * 10 AS ts, url_key, md5(html) AS tag FROM named
  UNION ALL SELECT k * 10 + 5, k * 10 + 2000, url_key, md5(html || '2') FROM named WHERE k % 3 = 0
  UNION ALL SELECT k * 10 + 1, k * 10 + 6000, url_key, md5(html || '3') FROM named WHERE k % 5 = 0),
revisits AS (
  SELECT k * 10 + 7 AS id, k * 10 + 4005 AS ts, k + 4005 AS date, url_key, CASE WHEN k % 3 = 0 AND k % 4 <> 0 THEN md5(html || '2') ELSE md5(html) END AS tag FROM named
  UNION ALL SELECT k * 10 + 8, k * 10 - 5, k - 5, url_key, md5(html) FROM named WHERE k % 9 = 0),
found AS (
  SELECT v.id, v.date, v.url_key, v.tag, r.id AS response_id, r.tag AS response_tag
  FROM revisits v ASOF LEFT JOIN (SELECT url_key, ts, max(id) AS id, arg_max(tag, id) AS tag FROM responses GROUP BY ALL) r ON v.url_key = r.url_key AND v.ts > r.ts)
SELECT id AS revisit_id, url_key, response_id,
  CASE WHEN response_id IS NULL THEN 'no_response' WHEN tag = response_tag THEN 'resolved' ELSE 'mismatch' END AS verdict,
  CASE WHEN response_id IS NOT NULL AND tag = response_tag THEN 'content-type=text/html;date=' || date || ';etag=W/' || tag || ';server=origin'
       ELSE 'date=' || date || ';etag=W/' || tag || ';server=edge' END AS headers
FROM found
"""

OP6_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, text,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('mix-1' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u,
    greatest(0.05, 1 - 10 * coalesce((length(text) - length(translate(text, '#*$%&|<>', ''))) / greatest(length(text), 1), 0.0)) AS w
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
named AS (SELECT *, 3 * source_size AS lim, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM sizes),
filled AS (
  SELECT *, coalesce(sum(lim) OVER b, 0)::BIGINT AS full_, (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS others, sum(source_size) OVER ()::BIGINT AS total
  FROM named WINDOW b AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
worth AS (SELECT total - full_ AS left_, others FROM filled WHERE (total - full_) * weight <= lim * others ORDER BY lim / weight, source NULLS LAST LIMIT 1),
goal AS (SELECT source, source_size, least(lim::DOUBLE, coalesce(weight * (SELECT left_ FROM worth) / (SELECT others FROM worth), lim::DOUBLE)) AS target FROM filled),
budget AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM goal),
summed AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.w, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM docs d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, size * (epochs + CASE WHEN 2 * ahead + size <= 2 * rest THEN 1 ELSE 0 END)::BIGINT AS taken FROM summed
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op4_warc_revisits": OP4_SQL, "op6_source_mixing": OP6_SQL}
