"""Catalogs over the driver's tables, on which the registered queries run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import values

REG, DIR, LNK = values.S_IFREG | 0o644, values.S_IFDIR | 0o755, values.S_IFLNK | 0o777


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """Whole seconds since the epoch of a zone-less timestamp."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of ``/c/<customer>`` named by priority, one version per order."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/c/"), F.col("o_custkey").cast("string")).alias("path"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderkey").alias("version_key"),
        F.floor("o_totalprice").cast("long").alias("size"),
        F.when(F.col("o_orderkey") % 5 == 0, DIR).when(F.col("o_orderkey") % 7 == 0, LNK).otherwise(REG).cast("long").alias("mode"),
        (F.col("o_orderkey") % 11 == 0).alias("is_generated"),
        (F.col("o_orderstatus") == "P").alias("is_tombstone"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of ``/u/<user>``, one version per event; an error is a tombstone."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"),
        F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")).alias("name"),
        F.col("event_id").alias("version_key"),
        (F.col("event_type") == "error").alias("is_tombstone"),
        F.floor(F.col("value")).cast("long").alias("size"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members ``/<lang>/<source>/<doc_id>``."""
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit(""), "lang", "source").alias("path"), F.col("doc_id").cast("string").alias("name"), F.col("doc_id").alias("version_key"), F.lit(None).cast("double").alias("mtime"), F.lit(0).cast("long").alias("uid"), F.lit(0).cast("long").alias("gid"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources with members ``/n/<nation>``: suppliers, customers, nations; the kind goes by the key."""

    def one(name: str, key: str, nation: str, place: int) -> DataFrame:
        kind = (F.col(key) * (place + 3)) % 4
        return table(spark, sf_dir, name).select(F.lit("/n").alias("path"), F.col(nation).cast("string").alias("name"), F.col(key).cast("long").alias("version_key"), F.when(kind == 0, DIR).when(kind == 1, LNK).otherwise(REG).cast("long").alias("mode"), F.lit(place).alias("source_idx"))

    return one("supplier", "s_suppkey", "s_nationkey", 0).unionByName(one("customer", "c_custkey", "c_nationkey", 1)).unionByName(one("nation", "n_nationkey", "n_nationkey", 2))


SOURCES_SQL = f"""
sources AS (
  SELECT '/n' AS path, s_nationkey::VARCHAR AS name, s_suppkey::BIGINT AS version_key, CASE WHEN s_suppkey * 3 % 4 = 0 THEN {DIR} WHEN s_suppkey * 3 % 4 = 1 THEN {LNK} ELSE {REG} END::BIGINT AS mode, 0 AS source_idx FROM supplier
  UNION ALL SELECT '/n', c_nationkey::VARCHAR, c_custkey::BIGINT, CASE WHEN c_custkey * 4 % 4 = 0 THEN {DIR} WHEN c_custkey * 4 % 4 = 1 THEN {LNK} ELSE {REG} END, 1 FROM customer
  UNION ALL SELECT '/n', n_nationkey::VARCHAR, n_nationkey::BIGINT, CASE WHEN n_nationkey * 5 % 4 = 0 THEN {DIR} WHEN n_nationkey * 5 % 4 = 1 THEN {LNK} ELSE {REG} END, 2 FROM nation)"""
ORDERS_SQL = f"""
files AS (
  SELECT '/c/' || o_custkey AS path, o_orderpriority AS name, o_orderkey AS version_key, floor(o_totalprice)::BIGINT AS size,
    CASE WHEN o_orderkey % 5 = 0 THEN {DIR} WHEN o_orderkey % 7 = 0 THEN {LNK} ELSE {REG} END::BIGINT AS mode,
    o_orderkey % 11 = 0 AS is_generated, o_orderstatus = 'P' AS is_tombstone
  FROM orders)"""
EVENTS_SQL = """
files AS (
  SELECT '/u/' || user_id AS path, 'f' || (event_id % 7) AS name, event_id AS version_key, event_type = 'error' AS is_tombstone, floor(value)::BIGINT AS size
  FROM events)"""
