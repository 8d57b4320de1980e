"""Union of several sources, and symbolic links.

Sources are rows with ``source_idx``; a later source is laid over an earlier one.
Lookup and list differ on purpose: a lookup takes the last directory if any source
has one, else the last row; a list lets a later file replace a directory but
never a later link.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import paths, values
from cairn.operators.versions import MEMBER, newest, version_order

HOPS = 8


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows with the place of their source."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("source_idx", F.lit(i)) for i, s in enumerate(sources)])


def union_lookup(rows: DataFrame) -> DataFrame:
    """Version 0 of each member of the union (rows: the newest of each source)."""
    # one number for (is a directory, place): sources are far fewer than 2^31
    return newest(rows, MEMBER, F.when(values.is_directory("mode"), F.lit(1 << 31)).otherwise(F.lit(0)).cast("long") + F.col("source_idx"))


def union_list(rows: DataFrame) -> DataFrame:
    """The merged listing: the last source, but a directory is not replaced by links alone."""
    rest = [c for c in rows.columns if c not in MEMBER]
    solid = ~values.is_symlink("mode")
    both = rows.groupBy(*MEMBER).agg(F.max_by(F.struct(*rest), F.when(solid, F.col("source_idx"))).alias("_solid"), F.max_by(F.struct(*rest), F.col("source_idx")).alias("_last"))
    keep = F.coalesce(values.is_directory(F.col("_solid.mode")), F.lit(False))
    return both.select(*MEMBER, F.when(keep, F.col("_solid")).otherwise(F.col("_last")).alias("_row")).select(*MEMBER, "_row.*").select(*rows.columns)


def union_versions(rows: DataFrame) -> DataFrame:
    """All versions of the union with ``version`` (1 = oldest of the first source) and ``back``."""
    up = Window.partitionBy(*MEMBER).orderBy(F.col("source_idx"), version_order())
    down = Window.partitionBy(*MEMBER).orderBy(F.col("source_idx").desc(), version_order().desc())
    return rows.withColumn("version", F.row_number().over(up).cast("long")).withColumn("back", F.row_number().over(down).cast("long") - 1)


def prune_sources(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, source_idx): the immutable sources that can have a requested directory."""
    have = rows.groupBy("path").agg(F.collect_set("source_idx").alias("sources"))
    return requests.select("path").distinct().join(have, "path").select("path", F.explode("sources").alias("source_idx"))


def resolve_links(links: DataFrame, hops: int = HOPS) -> DataFrame:
    """(link, target): where each link of ``links(link, target)`` ends after at most ``hops`` steps.

    Null for a cycle and for a chain that is longer; each step is one equality join.
    """
    edge = links.select(F.col("link").alias("_from"), F.col("target").alias("_to"))
    now = links.select("link", F.col("target").alias("at"), F.array("link").alias("seen"), F.lit(False).alias("lost"))
    for _ in range(hops - 1):
        moved = now.join(edge, now["at"] == edge["_from"], "left")
        loop = F.array_contains("seen", F.col("at"))
        now = moved.select("link", F.when(F.col("_to").isNotNull() & ~loop & ~F.col("lost"), F.col("_to")).otherwise(F.col("at")).alias("at"), F.when(F.col("_to").isNotNull() & ~loop, F.concat("seen", F.array("at"))).otherwise(F.col("seen")).alias("seen"), (F.col("lost") | loop).alias("lost"))
    end = now.join(edge, now["at"] == edge["_from"], "left")
    return end.select("link", F.when(~F.col("lost") & F.col("_from").isNull(), F.col("at")).alias("target"))


def link_table(files: DataFrame) -> DataFrame:
    """(link, target) of the symbolic links of a catalog, as normalized paths."""
    at = paths.join("path", "name")
    return files.where(values.is_symlink("mode")).select(at.alias("link"), paths.link_target(at, "linkname").alias("target"))
