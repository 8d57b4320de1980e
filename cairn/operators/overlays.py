"""Write overlays: a change table with tombstones over a base catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import paths, values
from cairn.operators.versions import MEMBER, newest


def apply_overlay(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Base rows that the overlay neither deletes nor replaces, plus its live rows.

    A deleted directory hides everything below it: ancestors of base rows meet
    deleted paths by an equality join.
    """
    changed = overlay.select(*MEMBER).distinct()
    gone = overlay.where("deleted").select(paths.join("path", "name").alias("_gone")).distinct()
    kept = base.join(changed, list(MEMBER), "left_anti")
    inside = kept.select(*MEMBER, F.explode(F.concat(paths.ancestors(F.concat(F.col("path"), F.lit("/"), F.col("name"))), F.array())).alias("_gone")).join(gone, "_gone", "left_semi").select(*MEMBER).distinct()
    live = overlay.where(~F.col("deleted")).drop("deleted")
    return kept.join(inside, list(MEMBER), "left_anti").unionByName(live, allowMissingColumns=True).select(*[c for c in base.columns])


def latest_changes(log: DataFrame, ordinal: str) -> DataFrame:
    """A change log to the overlay table: the last change of each member."""
    return newest(log, MEMBER, F.col(ordinal))


def mark_deleted(overlay: DataFrame, base: DataFrame, targets: DataFrame) -> DataFrame:
    """Overlay after deleting ``targets(path, name)``: a tombstone where the base has the member, else no row."""
    rest = overlay.join(targets, list(MEMBER), "left_anti")
    known = targets.join(base.select(*MEMBER).distinct(), list(MEMBER), "left_semi")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in overlay.schema.fields if f.name not in (*MEMBER, "deleted")]
    return rest.unionByName(known.select(*MEMBER, *empty, F.lit(True).alias("deleted")))


def mark_present(overlay: DataFrame, rows: DataFrame) -> DataFrame:
    """Overlay after creating or changing ``rows``."""
    return overlay.join(rows.select(*MEMBER), list(MEMBER), "left_anti").unionByName(rows.withColumn("deleted", F.lit(False)), allowMissingColumns=True)


def non_empty_directories(view: DataFrame, targets: DataFrame) -> DataFrame:
    """The directories among ``targets`` that may not be removed, as they have entries."""
    return targets.join(view.select(F.col("path").alias("_p")).distinct(), paths.join("path", "name") == F.col("_p"), "left_semi")


def rename(overlay: DataFrame, base: DataFrame, moves: DataFrame) -> DataFrame:
    """Overlay after renaming files: ``moves(path, name, new_path, new_name)``; directories are refused."""
    view = apply_overlay(base, overlay)
    moved = view.join(moves, list(MEMBER)).where(~values.is_directory("mode"))
    rest = [F.col(f.name) if f.name in moved.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in overlay.schema.fields if f.name not in (*MEMBER, "deleted")]
    made = moved.select(F.col("new_path").alias("path"), F.col("new_name").alias("name"), *rest)
    return mark_present(mark_deleted(overlay, base, moved.select(*MEMBER)), made)


def truncate(overlay: DataFrame, base: DataFrame, sizes: DataFrame) -> DataFrame:
    """Overlay after setting files' sizes: ``sizes(path, name, size)``; what is no regular file of the view is refused."""
    asked = sizes.select(*MEMBER, F.col("size").alias("_size"))
    rows = apply_overlay(base, overlay).where(values.is_regular("mode")).join(asked, list(MEMBER)).withColumn("size", F.col("_size")).drop("_size")
    return mark_present(overlay, rows)


def make_members(overlay: DataFrame, base: DataFrame, rows: DataFrame) -> DataFrame:
    """Overlay after making files, directories or links; what the view has already, and what has no directory above it, is refused."""
    view = apply_overlay(base, overlay)
    folders = view.where(values.is_directory("mode")).select(paths.join("path", "name").alias("_above")).unionByName(rows.where(values.is_directory("mode")).select(paths.join("path", "name").alias("_above"))).distinct()
    new = rows.join(view.select(*MEMBER), list(MEMBER), "left_anti")
    return mark_present(overlay, new.where("path = ''").unionByName(new.where("path <> ''").join(folders, F.col("path") == F.col("_above"), "left_semi")))


def commit_plan(base: DataFrame, overlay: DataFrame, *, now: float | None = None, idle: float | None = None) -> DataFrame:
    """(action, path, name): deletions are tombstones and replaced members, appends live files and empty directories.

    With ``idle`` only files unchanged for so long are appended, and tombstones of
    directories that hold a hotter file wait for it.
    """
    live = overlay.where(~F.col("deleted"))
    hot = None
    if idle is not None:
        hot = live.where(~values.is_directory("mode") & (F.col("mtime") > F.lit(now - idle)))
        live = live.join(hot.select(*MEMBER), list(MEMBER), "left_anti")
    parents = live.select(F.col("path").alias("_p")).distinct()
    full = live.where(values.is_directory("mode")).join(parents, paths.join("path", "name") == F.col("_p"), "left_semi").select(*MEMBER)
    append = live.join(full, list(MEMBER), "left_anti").select(F.lit("append").alias("action"), *MEMBER)
    replaced = live.where(~values.is_directory("mode")).join(base.select(*MEMBER).distinct(), list(MEMBER), "left_semi").select(*MEMBER)
    delete = overlay.where("deleted").select(*MEMBER).union(replaced).distinct()
    if hot is not None:
        above = hot.select(F.explode(paths.ancestors(F.concat(F.col("path"), F.lit("/"), F.col("name")))).alias("_a")).distinct()
        delete = delete.join(above, paths.join("path", "name") == F.col("_a"), "left_anti")
    return delete.select(F.lit("delete").alias("action"), *MEMBER).unionByName(append)


def delete_patterns(plan: DataFrame) -> DataFrame:
    """Every spelling of the deleted members that an archive may hold."""
    return plan.where("action = 'delete'").select("path", "name", F.explode(paths.deletion_forms(paths.join("path", "name"))).alias("member"))


def snapshot_whiteouts(entries: DataFrame) -> DataFrame:
    """Tombstones of directory snapshots ``entries(path, snapshot, name)``: names of the snapshot before that are gone.

    Each snapshot knows its successor by one window over the distinct snapshots
    of a directory; the difference is an anti-join.
    """
    shots = entries.select("path", "snapshot").distinct()
    after = shots.withColumn("_next", F.lead("snapshot").over(Window.partitionBy("path").orderBy("snapshot"))).where("_next is not null")
    old = entries.select("path", "snapshot", "name").distinct().join(after, ["path", "snapshot"]).select("path", F.col("_next").alias("snapshot"), "name")
    return old.join(entries.select("path", "snapshot", "name"), ["path", "snapshot", "name"], "left_anti")
