"""Layers over a catalog: prefix, path transform, parents, nested archives, mounts, attributes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths, values
from cairn.operators.versions import MEMBER


def mount_under(files: DataFrame, prefix: str) -> DataFrame:
    """The catalog below ``prefix``; its directories come from ``synthesize_parents``."""
    p = "/" + "/".join(x for x in prefix.split("/") if x not in ("", "."))
    return files if p == "/" else files.withColumn("path", F.concat(F.lit(p), F.col("path")))


def strip_prefix(files: DataFrame, prefix: str) -> DataFrame:
    """The part of the catalog below ``prefix``, seen from there."""
    p = "/" + "/".join(x for x in prefix.split("/") if x)
    return files.where((F.col("path") == p) | F.col("path").startswith(p + "/")).withColumn("path", F.substr("path", F.lit(len(p) + 1)))


def java_replacement(text: str) -> str:
    """A replacement with ``$1a`` or ``${name}`` groups, where a name is as long as it can be, in Java's form."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            out.append("\\\\")
        elif c == "$" and text[i + 1 : i + 2] == "$":
            out.append("\\$")
            i += 1
        elif c == "$" and text[i + 1 : i + 2] == "{" and "}" in text[i:]:
            end = text.index("}", i)
            name = text[i + 2 : end]
            out.append(f"${name}" if name.isdigit() else f"${{{name}}}")
            i = end
        elif c == "$":
            end = i + 1
            while end < len(text) and (text[end].isalnum() or text[end] == "_"):
                end += 1
            name = text[i + 1 : end]
            if name.isdigit():
                out.append(f"${name}")
            elif name and not name[0].isdigit():
                out.append(f"${{{name}}}")  # a group of that name
            elif not name:
                out.append("\\$")
            i = end - 1
        else:
            out.append(c)
        i += 1
    return "".join(out)


def transform_paths(files: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Every full path rewritten by a regular expression and normalized; on a collision the later old path stays."""
    old = paths.join("path", "name")
    new = paths.normalize(F.regexp_replace(old, pattern, java_replacement(replacement)))
    rest = [c for c in files.columns if c not in MEMBER]
    moved = files.withColumn("_old", old).withColumn("_new", new).where(F.col("_new") != "/")
    moved = moved.withColumn("path", paths.parent("_new")).withColumn("name", paths.basename("_new"))
    return moved.groupBy("path", "name").agg(F.max_by(F.struct(*rest), "_old").alias("_row")).select("path", "name", "_row.*").select(*files.columns)


def missing_parents(files: DataFrame) -> DataFrame:
    """(path, name, mtime, uid, gid): directories that members imply but no row states, with the values seen first.

    "First" is by version key, then member path, so it does not depend on row order.
    """
    full = paths.join("path", "name")
    seen = files.select(F.explode(paths.ancestors(full)).alias("_dir"), F.struct(F.coalesce("version_key", F.lit(-1)), full).alias("_at"), F.struct("mtime", "uid", "gid").alias("_row"))
    made = seen.groupBy("_dir").agg(F.min_by("_row", "_at").alias("_row"))
    made = made.select(paths.parent("_dir").alias("path"), paths.basename("_dir").alias("name"), "_row.*")
    return made.join(files.select(*MEMBER).distinct(), list(MEMBER), "left_anti")


def synthesize_parents(files: DataFrame) -> DataFrame:
    """The catalog with a generated row for each missing parent directory (version key 0)."""
    made = missing_parents(files)
    fixed = {"version_key": F.lit(0).cast("long"), "header_offset": F.lit(0).cast("long"), "size": F.lit(0).cast("long"), "mode": F.lit(values.S_IFDIR | 0o755).cast("long"), "is_generated": F.lit(True), "is_tombstone": F.lit(False), "is_archive": F.lit(False), "is_sparse": F.lit(False)}
    kinds = {f.name: f.dataType for f in files.schema.fields}
    columns = [F.col(c) if c in (*MEMBER, "mtime", "uid", "gid") else fixed.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in files.columns]
    return files.unionByName(made.select(*columns))


def flatten_tree(children: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, path, depth) of a forest ``children(parent, node)`` below ``roots(node)``, one join a level up to ``depth``."""
    level = roots.select("node", F.concat(F.lit("/"), F.col("node")).alias("path"), F.lit(0).alias("depth"))
    out = level
    for d in range(1, depth + 1):
        level = level.select(F.col("node").alias("parent"), "path").join(children, "parent").select("node", F.concat("path", F.lit("/"), F.col("node")).alias("path"), F.lit(d).alias("depth"))
        out = out.unionByName(level)
    return out


def automount(files: DataFrame, open_archives: Callable[[DataFrame], DataFrame], *, depth: int = 64, strip: bool = False, only: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Nested archives expanded in place, level by level.

    ``open_archives(members)`` returns the rows of the given archive members with
    paths inside each, plus ``_owner`` (the member's full path).  ``only(path)``
    limits expansion to archives on those paths.  ``keep`` may write a level, so the
    next one does not scan it again.  An expanded archive becomes a directory.
    """
    done, front, out = 0, files, files
    while done < min(depth, 64):
        full = paths.join("path", "name")
        members = front.where(values.is_regular("mode") & paths.is_archive("name")).withColumn("_full", full)
        if only is not None:
            asked = only.select(F.explode(F.concat(paths.ancestors("path"), F.array("path"))).alias("_full")).distinct()
            members = members.join(asked, "_full", "left_semi")
        members = keep(members)
        if members.isEmpty():
            break
        inner = open_archives(members)
        at = F.concat(paths.parent("_owner"), F.lit("/"), paths.strip_archive(paths.basename("_owner"))) if strip else F.col("_owner")
        front = keep(inner.withColumn("path", F.concat(at, F.col("path"))).drop("_owner").select(*files.columns))
        opened = inner.select("_owner").distinct()
        mark = out.join(opened, paths.join("path", "name") == F.col("_owner"), "left")
        hit = F.col("_owner").isNotNull()
        shown = F.when(hit & F.lit(strip), paths.strip_archive("name")).otherwise(F.col("name"))
        out = mark.withColumn("name", shown).withColumn("mode", F.when(hit, F.lit(values.S_IFDIR | 0o755).cast("long")).otherwise(F.col("mode"))).withColumn("size", F.when(hit, F.lit(0).cast("long")).otherwise(F.col("size"))).select(*files.columns).unionByName(front)
        done += 1
    return out


def owning_mount(requests: DataFrame, mounts: DataFrame) -> DataFrame:
    """(path, mount): the longest of ``mounts(mount)`` that is the path or an ancestor; null if none.

    The request's ancestors meet the mounts by equality, so no prefix comparison of all pairs is made.
    """
    asked = requests.select("path").distinct()
    up = asked.select("path", F.explode(F.concat(F.array(F.lit("/")), paths.ancestors("path"), F.array("path"))).alias("mount"))
    best = up.join(mounts.select("mount").distinct(), "mount").groupBy("path").agg(F.max_by("mount", F.length("mount")).alias("mount"))
    return asked.join(best, "path", "left")


def attributes(keys: DataFrame, data: DataFrame) -> DataFrame:
    """(version_key, key, value) from a key dictionary ``keys(id, name)`` and ``data(version_key, keyid, value)``."""
    return data.join(keys, data["keyid"] == keys["id"]).select("version_key", F.col("name").alias("key"), "value")


def write_attributes(stored: DataFrame, new: DataFrame, ordinal: str) -> DataFrame:
    """Attributes after an upsert by (version_key, key): of equal new ones the last by ``ordinal`` stays."""
    last = new.groupBy("version_key", "key").agg(F.max_by("value", ordinal).alias("value"))
    return stored.join(last, ["version_key", "key"], "left_anti").unionByName(last)


def fold_attributes(rows: DataFrame) -> DataFrame:
    """One map of attributes for each version."""
    return rows.groupBy("version_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("xattrs"))
