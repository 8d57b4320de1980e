"""Idle-gap commits as a stream: a file is committed once it has not changed for a while."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from cairn.functions import paths


def idle_files(changes: DataFrame, gap: str, *, late: str = "0 seconds") -> DataFrame:
    """Sessions of changes ``(path, name, ts)``, each out once its file was idle for ``gap``.

    A session window with a watermark: state is kept for files that are still hot
    only, and changes that come later than ``late`` are dropped by the watermark.
    """
    rows = changes.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("session"), "path", "name").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("changes")).select("path", "name", F.col("session.start").alias("first_ts"), "last_ts", "changes")


def keep_hot_parents(deletions: DataFrame, hot: DataFrame) -> DataFrame:
    """Deletions of directories that hold no hot file: hot files' ancestors meet them by equality."""
    above = hot.select(F.explode(paths.ancestors(paths.join("path", "name"))).alias("_a")).distinct()
    return deletions.join(above, paths.join("path", "name") == F.col("_a"), "left_anti")


def commit_stream(changes: DataFrame, gap: str, commit: Callable[[DataFrame, int], None], *, checkpoint: str, late: str = "0 seconds", flush: bool = False) -> DataStreamWriter:
    """A writer that hands each batch of idle files to ``commit(rows, generation)``; with ``flush`` it ends when the input is read.

    The batch number is the content generation: it grows with every commit.
    """
    out = idle_files(changes, gap, late=late).writeStream.outputMode("append").foreachBatch(commit).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True) if flush else out.trigger(processingTime="1 second")


def current_generation(rows: DataFrame, generation: str = "generation") -> DataFrame:
    """Rows of the newest generation only."""
    newest = rows.agg(F.max(generation).alias("_newest"))
    return rows.join(F.broadcast(newest), rows[generation] == newest["_newest"]).drop("_newest")  # one row
