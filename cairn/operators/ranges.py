"""Byte ranges: segments, blocks, windows, split volumes, caches, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts that a key's rows are cut into, by quantiles of their order, so one huge archive is not one task's.
PARTS = 64


def _cuts(rows: DataFrame, order: str) -> list:
    """At most PARTS - 1 numbers that cut the rows in parts of about one size."""
    found = rows.select(F.percentile_approx(order, [i / PARTS for i in range(1, PARTS)], 1000)).first()[0]
    return sorted(set(found or []))


def _part(order: str, cuts: list) -> Column:
    """Number of the part: how many cuts are at or below the value."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order))) if cuts else F.lit(0)


def segment_offsets(segments: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """``logical_offset``: where each segment starts in its member, a running sum without itself.

    Sums run within parts of a member; what the parts before hold is added, a row for
    each part.
    """
    rows = segments.withColumn("_part", _part(order, _cuts(segments, order)))
    w = Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.sum(size).alias("_total"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    own = rows.withColumn("_within", F.coalesce(F.sum(size).over(w), F.lit(0)))
    met = own.join(totals, own[key].eqNullSafe(totals["_key"]) & (own["_part"] == totals["_of"]))
    return met.withColumn("logical_offset", F.col("_within") + F.col("_before")).select(*segments.columns, "logical_offset")


def overlapping_segments(reads: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """The part of each segment that a read of (key, offset, size) needs: kind, file_offset, len, in order."""
    end = F.col("offset") + F.col("size")
    stop = F.col("logical_offset") + F.col("len")
    low, high = F.greatest("offset", "logical_offset"), F.least(end, stop)
    return reads.join(segments, key).where((F.col("logical_offset") < end) & (stop > F.col("offset"))).select(key, "offset", "size", "ord", "kind", (F.col("file_offset") + low - F.col("logical_offset")).alias("file_offset"), (high - low).alias("len"))


def read_bytes(content: str | Column, offset: Column, size: Column) -> Column:
    """Bytes of a binary column; short at its end."""
    return F.substring(F.col(content) if isinstance(content, str) else content, (offset + 1).cast("int"), size.cast("int"))


def block_intervals(blocks: DataFrame, key: str = "archive_id") -> DataFrame:
    """Blocks with ``data_end`` from the next offset; the sentinel closes the last and goes."""
    w = Window.partitionBy(key).orderBy("data_offset")
    return blocks.withColumn("data_end", F.lead("data_offset").over(w)).where("data_end is not null")


def broken_maps(blocks: DataFrame, key: str = "archive_id") -> DataFrame:
    """Keys of block maps whose compressed offsets do not rise with the data offsets."""
    w = Window.partitionBy(key).orderBy("data_offset", "comp_offset")
    last = F.lag("comp_offset").over(w)
    return blocks.withColumn("_last", last).where("_last is not null and comp_offset <= _last").select(key).distinct()


def block_of(reads: DataFrame, blocks: DataFrame, key: str, offset: str, block: list[str]) -> DataFrame:
    """As-of join: to each read the block with the greatest ``data_offset`` not above its offset.

    Reads and blocks are sorted together by key, in parts of a key by offset; the last
    block seen is carried on, into a part from those before it.
    """
    cuts = _cuts(blocks, "data_offset")
    marks = blocks.select(key, F.col("data_offset").alias("_at"), F.lit(0).alias("_kind"), F.struct(*[F.col(c) for c in block]).alias("_block")).withColumn("_part", _part("_at", cuts))
    asks = reads.select(key, F.col(offset).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_block"].dataType).alias("_block"), F.struct("*").alias("_read")).withColumn("_part", _part("_at", cuts))
    both = marks.withColumn("_read", F.lit(None).cast(asks.schema["_read"].dataType)).unionByName(asks)
    w = Window.partitionBy(key, "_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    # of each part its last block, carried over the parts: a row for each part of a key
    ends = marks.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.max_by("_block", "_at").alias("_last"))
    parts = ends.select("_key").distinct().withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))))
    earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.join(ends, ["_key", "_of"], "left").withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).select("_key", "_of", "_carried")
    found = both.withColumn("_own", F.last("_block", ignorenulls=True).over(w)).where("_kind = 1")
    met = found.join(carried, found[key].eqNullSafe(carried["_key"]) & (found["_part"] == carried["_of"]), "left").withColumn("_found", F.coalesce("_own", "_carried"))
    return met.select("_read.*", *[F.col(f"_found.{c}").alias(c) for c in block])


def windows(size: Column, chunk: int) -> Column:
    """Inclusive ranges (start, stop) of ``chunk`` bytes that cover ``size`` bytes; none for 0."""
    return F.when(size > 0, F.transform(F.sequence(F.lit(0).cast("long"), size - 1, F.lit(chunk).cast("long")), lambda s: F.struct(s.alias("start"), F.least(s + chunk - 1, size - 1).alias("stop")))).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>"))


def sequential_reads(reads: DataFrame, key: str, order: str) -> DataFrame:
    """Reads with ``sequential``: it starts where the one before it ended."""
    w = Window.partitionBy(key).orderBy(order)
    return reads.withColumn("sequential", F.coalesce(F.lag(F.col("offset") + F.col("size")).over(w) == F.col("offset"), F.lit(False)))


def volume_islands(volumes: DataFrame, key: str, number: str) -> DataFrame:
    """Runs of consecutive volume numbers: key, first, last, parts; a split set is the run that starts at 0 or 1."""
    w = Window.partitionBy(key).orderBy(number)
    rows = volumes.select(key, F.col(number).cast("long").alias("_n")).distinct().withColumn("_island", F.col("_n") - F.row_number().over(w.orderBy("_n")))
    return rows.groupBy(key, "_island").agg(F.min("_n").alias("first"), F.max("_n").alias("last"), F.count(F.lit(1)).alias("parts")).drop("_island")


def eviction_order(cache: DataFrame, shard: str, pinned: str, used: str, tie: str) -> DataFrame:
    """``victim_rank``: unpinned entries first, least recently used first, in each shard."""
    w = Window.partitionBy(shard).orderBy(F.col(pinned), F.col(used), F.col(tie))
    return cache.withColumn("victim_rank", F.row_number().over(w).cast("long"))


def idle_sessions(changes: DataFrame, key: str, ts: str, gap: float) -> DataFrame:
    """Runs of changes with pauses of at most ``gap`` seconds: key, session, first_ts, last_ts, changes."""
    w = Window.partitionBy(key).orderBy(ts)
    new = F.coalesce((F.col(ts) - F.lag(ts).over(w) > gap).cast("long"), F.lit(1).cast("long"))
    rows = changes.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("changes"))


def group_pages(pages: DataFrame) -> DataFrame:
    """One row per logical stream of ``pages(archive_id, serial, offset, size)``: sum of sizes, first offset, pages.

    The ranges themselves stay rows: ``stream_ranges``.
    """
    return pages.groupBy("archive_id", "serial").agg(F.sum("size").alias("size"), F.min("offset").alias("first_offset"), F.count(F.lit(1)).alias("pages"))


def stream_ranges(pages: DataFrame) -> DataFrame:
    """The pages of each stream with their place in it, ``logical_offset``; a stream of any number of pages."""
    keyed = pages.withColumn("_stream", F.struct("archive_id", "serial"))
    return segment_offsets(keyed, "_stream", "offset", "size").drop("_stream")


def geometric_mean(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.where(F.col(value) > 0).groupBy(*keys).agg(F.exp(F.avg(F.log(F.col(value)))).alias("geomean"))
