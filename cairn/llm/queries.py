"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import chat_format, decontaminate, fingerprint, language_id, license_scan, line_dedup, near_dedup, packing, substring_dedup, url_filter
from cairn.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

#: The rules of the URL filter query; fixed values.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

#: The extra conversation of the chat query.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.repeated_spans(table(spark, sf_dir, "documents")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.mapInArrow(line_dedup.digest, "doc_id long, n_lines long, n_dropped long, kept_chars long, kept_sha256 string")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat_format.digest_windows(chat_format.format_conversations(rows.unionByName(extra), tokenizer_path=public_tokenizers.path("byte_bpe_50k.json")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), F.when((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0), 1).otherwise(0)).alias("bad"))
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, action string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels, rules).select("page_id", "host", "path", "rule", "verdict")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_fingerprint, op2_packing, op3_substring_dedup, op4_line_dedup, op5_decontamination, op6_chat_format, op7_url_filter, op8_language_id, op9_license_scan, op10_near_dedup)}

_SUFFIXES = ", ".join(f"'{x}'" for x in url_filter.TWO_LABEL_SUFFIXES)

#: The URL filter in DuckDB's SQL.
URL_SQL = f"""
WITH rows AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
outcomes AS (
  SELECT doc_id AS page_id, CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END AS bad
  FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL),
counted AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS b
  FROM rows LEFT JOIN outcomes USING (page_id) GROUP BY host),
named AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS bare FROM counted),
parted AS (
  SELECT *, CASE WHEN len(string_split(bare, '.')) < 2 THEN bare ELSE array_to_string(string_split(bare, '.')[-2:], '.') END AS two FROM named),
hosts AS (
  SELECT host, n, b,
    CASE WHEN two IN ({_SUFFIXES}) THEN array_to_string(string_split(bare, '.')[-3:], '.') ELSE two END AS domain,
    CASE WHEN two IN ({_SUFFIXES}) THEN two ELSE string_split(bare, '.')[-1] END AS suffix
  FROM parted),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM domains GROUP BY ALL),
sums AS (
  SELECT 'h' AS level, sum(n) AS n, sum(b) AS b, sum(CASE WHEN n > 0 THEN b * b / n END) AS q, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS k FROM hosts
  UNION ALL SELECT 'd', sum(n), sum(b), sum(CASE WHEN n > 0 THEN b * b / n END), sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) FROM domains
  UNION ALL SELECT 's', sum(n), sum(b), sum(CASE WHEN n > 0 THEN b * b / n END), sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) FROM suffixes),
spread AS (
  SELECT level, coalesce(n, 0) AS n, coalesce(b, 0) AS b,
    CASE WHEN coalesce(n, 0) = 0 THEN 2.0 ELSE least(200.0, greatest(2.0, (b / n) * (1 - b / n) / greatest(1e-6, (q - b * b / n) / n - (b / n) * (1 - b / n) * (k - 1) / n) - 1)) END AS s
  FROM sums),
means AS (
  SELECT h.host, h.n, h.b, sh.s AS sh,
    (d.b + sd.s * ((s.b + ss.s * ((sh.b + 1) / (sh.n + 2))) / (s.n + ss.s))) / (d.n + sd.s) AS mu
  FROM hosts h JOIN domains d USING (domain, suffix) JOIN suffixes s USING (suffix)
  JOIN spread sh ON sh.level = 'h' JOIN spread sd ON sd.level = 'd' JOIN spread ss ON ss.level = 's'),
beta AS (SELECT host, b + sh * mu AS x, n - b + sh * (1 - mu) AS y FROM means),
fame AS (SELECT host, x / (x + y) - 1.645 * sqrt(x * y / ((x + y) * (x + y) * (x + y + 1))) AS bad_low FROM beta),
rules(rule_host, rule_path, action) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
fits AS (
  SELECT r.page_id, r.host, r.path, u.rule_host || u.rule_path AS rule, u.action,
    row_number() OVER (PARTITION BY r.page_id, r.host, r.path ORDER BY length(u.rule_host || u.rule_path) DESC, u.rule_host || u.rule_path DESC, u.action DESC) AS place
  FROM (SELECT DISTINCT page_id, host, path FROM rows) r JOIN rules u
    ON (r.host = u.rule_host OR ends_with(r.host, '.' || u.rule_host)) AND starts_with(r.path, u.rule_path))
SELECT r.page_id, r.host, r.path, f.rule, coalesce(f.action, CASE WHEN m.bad_low > 0.3 THEN 'block' ELSE 'allow' END) AS verdict
FROM rows r JOIN fame m USING (host)
LEFT JOIN fits f ON f.place = 1 AND f.page_id = r.page_id AND f.host = r.host AND f.path = r.path
"""

ORACLES = {"op7_url_filter": URL_SQL}
