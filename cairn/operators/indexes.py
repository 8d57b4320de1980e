"""Stored indexes: metadata, back end checks, fingerprints as JSON, nested indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import values

FINGERPRINT = "size long, mtime double, mtime_ns long, prefix_sha256 string, suffix_sha256 string, full_sha256 string"


def metadata_value(metadata: DataFrame, key: str) -> str | None:
    """One value of a key/value table."""
    row = metadata.where(F.col("key") == key).select("value").first()
    return row["value"] if row else None


def check_backend(metadata: DataFrame, backend: str) -> None:
    """An index made by another back end does not fit; one without a name does."""
    stored = metadata_value(metadata, "backendName")
    if stored not in (None, backend):
        raise ValueError(f"index was made by {stored}, not {backend}")


def parse_fingerprint(text: str | Column) -> Column:
    """Struct of a stored fingerprint; a fractional mtime is cut to whole seconds."""
    f = F.from_json(F.col(text) if isinstance(text, str) else text, FINGERPRINT)
    return F.when(f.isNotNull(), f.withField("mtime", f["mtime"].cast("long").cast("double")))


def fingerprint_json(fingerprint: str | Column) -> Column:
    return F.to_json(F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint)


def stale_archives(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(archive_id, state) of archives known to either side: ``stored`` and ``now`` hold a fingerprint struct each."""
    both = stored.select("archive_id", F.col("fingerprint").alias("stored")).join(now.select("archive_id", F.col("fingerprint").alias("now")), "archive_id", "full")
    return both.select("archive_id", values.staleness("stored", "now").alias("state"))


def usable_nested(asked: DataFrame, stored: DataFrame, schema_version: int) -> DataFrame:
    """Nested indexes for ``asked(member_key, fingerprint)``: same key, version and fingerprint.

    The middle digest counts only where both sides have one.
    """
    s = stored.where(F.col("schema_version") == schema_version).withColumnRenamed("fingerprint", "_stored")
    return asked.withColumnRenamed("fingerprint", "_asked").join(s, "member_key").where(values.fingerprints_match("_asked", "_stored")).drop("_asked", "_stored")


def nested_members(metadata: DataFrame, key: str = "nestedMembers") -> DataFrame:
    """(path, offset, size) of the JSON side list of nested archives."""
    found = F.from_json("value", "array<struct<path:string,offset:long,size:long>>")
    return metadata.where(F.col("key") == key).select(F.explode(found).alias("m")).select("m.path", "m.offset", "m.size")


def replace_blocks(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Block maps after storing new ones: an archive's map is replaced as a whole."""
    return stored.join(new.select("archive_id").distinct(), "archive_id", "left_anti").unionByName(new)
