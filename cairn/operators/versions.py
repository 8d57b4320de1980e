"""Versions of members: newest, n-th, counts, listings, tombstones, paging.

A member is (path, name); its rows are versions ordered by ``version_key``, of
which null stands for -1.  Version 0 is the newest, 1, 2, ... count from the
oldest, -1, -2, ... back from the newest; a version that does not exist has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import values

MEMBER = ("path", "name")


def version_order() -> Column:
    return F.coalesce(F.col("version_key"), F.lit(-1))


#: Types that a hash aggregation can hold in place.
FIXED = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def newest(rows: DataFrame, keys, order: Column) -> DataFrame:
    """Of the rows with equal keys the one with the greatest ``order``: one aggregation with map-side combine.

    Where all other columns have a fixed width it is a hash aggregation without a
    sort, a value for each column, which all take the same row; else whole rows
    are held, and Spark sorts by key.
    """
    rest = [f for f in rows.schema.fields if f.name not in keys]
    if all(isinstance(f.dataType, FIXED) for f in rest):
        return rows.groupBy(*keys).agg(*[F.max_by(F.col(f.name), order).alias(f.name) for f in rest]).select(*rows.columns) if rest else rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[f.name for f in rest]), order).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def latest(files: DataFrame, keys=MEMBER) -> DataFrame:
    """The newest row of each member."""
    return newest(files, keys, version_order())


def version_count(files: DataFrame, keys=MEMBER) -> DataFrame:
    return files.groupBy(*keys).agg(F.count(F.lit(1)).alias("versions"))


def numbered(files: DataFrame, keys=MEMBER) -> DataFrame:
    """Rows with ``version`` (1 = oldest) and ``back`` (0 = newest)."""
    up = Window.partitionBy(*keys).orderBy(version_order().asc())
    down = Window.partitionBy(*keys).orderBy(version_order().desc())
    return files.withColumn("version", F.row_number().over(up).cast("long")).withColumn("back", F.row_number().over(down).cast("long") - 1)


def nth_version(files: DataFrame, n: int, *, clamp: bool = False, keys=MEMBER) -> DataFrame:
    """One version of each member; with ``clamp`` a negative n beyond the oldest gives the oldest."""
    if n == 0:
        return latest(files, keys)
    order = version_order().asc() if n > 0 else version_order().desc()
    w = Window.partitionBy(*keys).orderBy(order)
    rows = files.withColumn("_n", F.row_number().over(w))
    if n < 0 and clamp:
        rows = rows.withColumn("_most", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        return rows.where(F.col("_n") == F.least(F.lit(1 - n), F.col("_most"))).drop("_n", "_most")
    return rows.where(F.col("_n") == (n if n > 0 else 1 - n)).drop("_n")


def lookup(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows for ``requests(path, name, version)``: a batch of point lookups as one join."""
    asked = requests.select(F.col("path"), F.col("name"), F.col("version").cast("long").alias("_asked"))
    few = files.join(asked.select("path", "name").distinct(), ["path", "name"], "left_semi")
    rows = numbered(few)
    hit = ((F.col("_asked") > 0) & (F.col("version") == F.col("_asked"))) | ((F.col("_asked") <= 0) & (F.col("back") == -F.col("_asked")))
    return rows.join(asked, ["path", "name"]).where(hit).select("path", "name", F.col("_asked").alias("version"), *[c for c in files.columns if c not in MEMBER])


def list_directory(files: DataFrame, path: str) -> DataFrame:
    """Newest row of each name in a directory; the filter reaches the scan."""
    return latest(files.where(F.col("path") == path))


def list_dirents(files: DataFrame, path: str) -> DataFrame:
    return list_directory(files.select("path", "name", "version_key", "mode", "size"), path).select("name", "mode", "size")


def open_cookie(files: DataFrame) -> DataFrame:
    """What a read of the newest version needs, as one struct."""
    return latest(files).select("path", "name", F.struct("archive_id", "version_key", "data_offset", "size", "is_sparse").alias("cookie"))


def exists(files: DataFrame, requests: DataFrame) -> DataFrame:
    return requests.join(files.select("path", "name"), ["path", "name"], "left_semi")


def directories(files: DataFrame, requests: DataFrame) -> DataFrame:
    return requests.join(latest(files).where(values.is_directory("mode")).select("path", "name"), ["path", "name"], "left_semi")


def version_paths(files: DataFrame) -> DataFrame:
    """Virtual rows: each member's versions as ``name.versions/1 .. n``; a real path of that name wins."""
    rows = numbered(files).withColumn("_dir", F.concat(F.col("path"), F.lit("/"), F.col("name"), F.lit(".versions")))
    virtual = rows.select(F.col("_dir").alias("path"), F.col("version").cast("string").alias("name"), *[c for c in files.columns if c not in MEMBER])
    return virtual.join(files.select("path", "name").distinct(), ["path", "name"], "left_anti")


def regular_payloads(files: DataFrame) -> DataFrame:
    """Members with content to hash: regular, not empty, with a header and not generated."""
    return files.where((F.col("size") > 0) & values.is_regular("mode") & F.col("version_key").isNotNull() & ~F.coalesce("is_generated", F.lit(False)))


def visible(files: DataFrame) -> DataFrame:
    """Newest rows without members whose newest row is a tombstone."""
    return latest(files).where(~F.coalesce("is_tombstone", F.lit(False)))


def visible_versions(files: DataFrame) -> DataFrame:
    """All versions but those of members that a tombstone hides; tombstones are no versions."""
    hidden = latest(files).where(F.coalesce("is_tombstone", F.lit(False))).select("path", "name")
    return files.where(~F.coalesce("is_tombstone", F.lit(False))).join(hidden, ["path", "name"], "left_anti")


def page(files: DataFrame, path: str, *, after: str | None = None, limit: int = 100) -> DataFrame:
    """Keyset page of a directory: the next ``limit`` names behind ``after``."""
    rows = list_directory(files, path)
    return (rows if after is None else rows.where(F.col("name") > after)).orderBy("name").limit(limit)


def pages(files: DataFrame, size: int) -> DataFrame:
    """Every directory's newest rows with the number of their page."""
    w = Window.partitionBy("path").orderBy("name")
    return latest(files).withColumn("page", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def replace_on_key(rows: DataFrame, ordinal: str, keys=("path", "name", "version_key")) -> DataFrame:
    """Bulk insert with replacement: of rows with equal keys the last inserted stays."""
    return newest(rows, keys, F.col(ordinal))


def first_names(rows: DataFrame, normalized: Column, ordinal: str) -> DataFrame:
    """(normalized, name): the first stored name of each normalized one."""
    return rows.groupBy(normalized.alias("normalized")).agg(F.min_by("name", ordinal).alias("name"))


def number_duplicates(rows: DataFrame, name: str, position: str) -> DataFrame:
    """``unique_name``: the second and later rows of a name get ``-1``, ``-2``, ..."""
    w = Window.partitionBy(name).orderBy(position)
    n = F.row_number().over(w) - 1
    return rows.withColumn("unique_name", F.when(n > 0, F.concat(F.col(name), F.lit("-"), n.cast("string"))).otherwise(F.col(name)))
