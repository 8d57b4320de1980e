"""Operator semantics on small catalogs, against plain Python where the rule is a fold."""

import itertools

from pyspark.sql import functions as F

from cairn.functions.values import S_IFDIR, S_IFLNK, S_IFREG
from cairn.operators import layers, overlays, ranges, unions, versions

DIR, REG, LNK = S_IFDIR | 0o755, S_IFREG | 0o644, S_IFLNK | 0o777
FILES = "path string, name string, version_key long, size long, mode long, is_tombstone boolean"


def files(spark, rows):
    return spark.createDataFrame([(p, n, k, s, m, t) for p, n, k, s, m, t in rows], FILES)


def some(spark):
    return files(spark, [("/a", "x", 10, 1, REG, False), ("/a", "x", 30, 3, REG, False), ("/a", "x", 20, 2, REG, False), ("/a", "y", None, 9, REG, False), ("/a", "y", 5, 8, REG, False), ("", "a", 0, 0, DIR, False), ("/a", "z", 1, 1, REG, False), ("/a", "z", 2, 1, REG, True)])


def pick(df, *c):
    return sorted(map(tuple, df.select(*c).collect()), key=str)


def test_versions(spark):
    f = some(spark)
    assert pick(versions.latest(f), "name", "size") == [("a", 0), ("x", 3), ("y", 8), ("z", 1)]
    assert pick(versions.nth_version(f, 1), "name", "size") == [("a", 0), ("x", 1), ("y", 9), ("z", 1)]
    assert pick(versions.nth_version(f, 3), "name", "size") == [("x", 3)]
    assert pick(versions.nth_version(f, -2), "name", "size") == [("x", 1)]
    assert pick(versions.nth_version(f, -2, clamp=True), "name", "size") == [("a", 0), ("x", 1), ("y", 9), ("z", 1)]
    assert pick(versions.version_count(f), "name", "versions") == [("a", 1), ("x", 3), ("y", 2), ("z", 2)]


def test_lookup_batch(spark):
    asked = spark.createDataFrame([("/a", "x", 0), ("/a", "x", 2), ("/a", "x", -1), ("/a", "x", 9), ("/a", "q", 0)], "path string, name string, version long")
    assert pick(versions.lookup(some(spark), asked), "name", "version", "size") == [("x", -1, 2), ("x", 0, 3), ("x", 2, 2)]
    assert pick(versions.exists(some(spark), asked.select("path", "name").distinct()), "name") == [("x",)]


def test_tombstones_hide_all_versions(spark):
    assert pick(versions.visible(some(spark)), "name") == [("a",), ("x",), ("y",)]
    assert pick(versions.version_count(versions.visible_versions(some(spark))), "name", "versions") == [("a", 1), ("x", 3), ("y", 2)]


def test_version_paths_and_pages(spark):
    got = pick(versions.version_paths(some(spark)).where("path = '/a/x.versions'"), "name", "size")
    assert got == [("1", 1), ("2", 2), ("3", 3)]
    assert pick(versions.page(some(spark), "/a", after="x", limit=1), "name") == [("y",)]
    assert pick(versions.list_dirents(some(spark), ""), "name", "mode", "size") == [("a", DIR, 0)]


def fold_list(rows):
    """The listing rule as a loop over sources."""
    out = {}
    for r in rows:
        old = out.get(r[0])
        if old is None or not (old[1] & 0xF000 == S_IFDIR and r[1] & 0xF000 == S_IFLNK):
            out[r[0]] = r
    return out


def test_union_rules_match_folds(spark):
    rows = [(f"n{i}", m, s) for i, kinds in enumerate(itertools.product([DIR, REG, LNK, None], repeat=3)) for s, m in enumerate(kinds) if m is not None]
    df = spark.createDataFrame([("/n", n, 1, m, s) for n, m, s in rows], "path string, name string, version_key long, mode long, source_idx int")
    want = fold_list(rows)
    assert {r["name"]: r["source_idx"] for r in unions.union_list(df).collect()} == {n: r[2] for n, r in want.items()}
    last = {}
    for n, m, s in rows:
        dirs = [x[2] for x in rows if x[0] == n and x[1] == DIR]
        last[n] = max(dirs) if dirs else max(x[2] for x in rows if x[0] == n)
    assert {r["name"]: r["source_idx"] for r in unions.union_lookup(df).collect()} == last


def test_links(spark):
    chain = [(f"/c{i}", f"/c{i + 1}") for i in range(10)]
    loop = [("/l1", "/l2"), ("/l2", "/l1"), ("/self", "/self"), ("/ok", "/file"), ("/ok2", "/ok")]
    got = {r[0]: r[1] for r in unions.resolve_links(spark.createDataFrame(chain + loop, "link string, target string")).collect()}
    assert got["/ok"] == "/file" and got["/ok2"] == "/file"
    assert got["/l1"] is None and got["/l2"] is None and got["/self"] is None
    assert got["/c2"] == "/c10" and got["/c1"] is None and got["/c0"] is None


def test_overlay(spark):
    base = files(spark, [("/a", "x", 1, 1, REG, False), ("/a", "y", 1, 1, REG, False), ("/d", "k", 1, 1, REG, False), ("", "d", 0, 0, DIR, False), ("/d/e", "m", 1, 1, REG, False)]).drop("is_tombstone")
    overlay = spark.createDataFrame([("/a", "x", 2, 7, REG, 1.0, False), ("/a", "y", None, None, None, None, True), ("", "d", None, None, None, None, True), ("/n", "new", 3, 5, REG, 100.0, False), ("", "n", 0, 0, DIR, 1.0, False)], "path string, name string, version_key long, size long, mode long, mtime double, deleted boolean")
    view = overlays.apply_overlay(base, overlay)
    assert pick(view, "path", "name", "size") == [("", "n", 0), ("/a", "x", 7), ("/n", "new", 5)]
    plan = overlays.commit_plan(base, overlay)
    assert pick(plan, "action", "path", "name") == [("append", "/a", "x"), ("append", "/n", "new"), ("delete", "", "d"), ("delete", "/a", "x"), ("delete", "/a", "y")]
    idle = overlays.commit_plan(base, overlay, now=110.0, idle=30.0)
    assert ("append", "/n", "new") not in pick(idle, "action", "path", "name")
    gone = overlays.mark_deleted(overlay, base, spark.createDataFrame([("/a", "x"), ("/n", "new")], "path string, name string"))
    assert pick(gone.where("name in ('x', 'new')"), "name", "deleted") == [("x", True)]
    assert pick(overlays.non_empty_directories(base, spark.createDataFrame([("", "d"), ("", "n")], "path string, name string")), "name") == [("d",)]
    moved = overlays.rename(overlay, base, spark.createDataFrame([("/d", "k", "/z", "k2")], "path string, name string, new_path string, new_name string"))
    assert pick(moved.where("name = 'k2'"), "path", "deleted") == []  # hidden with its directory


def test_snapshot_whiteouts(spark):
    e = spark.createDataFrame([("/d", 1, "a"), ("/d", 1, "b"), ("/d", 2, "b"), ("/d", 3, "a"), ("/o", 1, "q")], "path string, snapshot long, name string")
    assert pick(overlays.snapshot_whiteouts(e), "path", "snapshot", "name") == [("/d", 2, "a"), ("/d", 3, "b")]


def test_transform_and_parents(spark):
    full = "archive_id string, path string, name string, version_key long, mtime double, mode long, uid long, gid long, is_generated boolean"
    f = spark.createDataFrame([("z", "/a/b", "x.txt", 7, 3.0, REG, 1, 2, False), ("z", "/a/c", "x.txt", 9, 4.0, REG, 1, 2, False), ("z", "", "top", 1, 1.0, REG, 0, 0, False)], full)
    moved = layers.transform_paths(f, "^/a/[bc]/(.*)$", "/m/../k/$1")
    assert pick(moved, "path", "name", "version_key") == [("", "top", 1), ("/k", "x.txt", 9)]
    whole = layers.synthesize_parents(f)
    assert pick(whole.where("is_generated"), "path", "name", "mtime", "version_key") == [("", "a", 3.0, 0), ("/a", "b", 3.0, 0), ("/a", "c", 4.0, 0)]
    assert pick(layers.strip_prefix(f, "/a"), "path") == [("/b",), ("/c",)]
    assert layers.java_replacement("$1_x-${2}-$$") == "${1_x}-$2-\\$" or layers.java_replacement("${1}_x-${2}-$$") == "$1_x-$2-\\$"


def test_mounts(spark):
    asked = spark.createDataFrame([("/m/a/b",), ("/m",), ("/mm/x",), ("/",)], "path string")
    got = dict(pick(layers.owning_mount(asked, spark.createDataFrame([("/m",), ("/m/a",)], "mount string")), "path", "mount"))
    assert got == {"/m/a/b": "/m/a", "/m": "/m", "/mm/x": None, "/": None}


def test_attributes(spark):
    stored = spark.createDataFrame([(1, "user.a", b"1"), (1, "user.b", b"2")], "version_key long, key string, value binary")
    new = spark.createDataFrame([(1, "user.a", b"z", 1), (1, "user.a", b"9", 2), (2, "user.a", b"3", 3)], "version_key long, key string, value binary, at long")
    assert [(a, b, bytes(c)) for a, b, c in pick(layers.write_attributes(stored, new, "at"), "version_key", "key", "value")] == [(1, "user.a", b"9"), (1, "user.b", b"2"), (2, "user.a", b"3")]
    assert layers.fold_attributes(stored).first()["xattrs"] == {"user.a": b"1", "user.b": b"2"}


def test_ranges(spark):
    seg = spark.createDataFrame([("m", 0, "data", 100, 10), ("m", 1, "hole", 0, 5), ("m", 2, "data", 500, 10)], "k string, ord int, kind string, file_offset long, len long")
    seg = ranges.segment_offsets(seg, "k", "ord", "len")
    reads = spark.createDataFrame([("m", 8, 10)], "k string, offset long, size long")
    assert pick(ranges.overlapping_segments(reads, seg, "k"), "ord", "file_offset", "len") == [(0, 108, 2), (1, 0, 5), (2, 500, 3)]
    blocks = spark.createDataFrame([("a", 0, 0), ("a", 50, 100), ("a", 90, 200)], "archive_id string, comp_offset long, data_offset long")
    assert pick(ranges.block_intervals(blocks), "data_offset", "data_end") == [(0, 100), (100, 200)]
    at = spark.createDataFrame([("a", 99), ("a", 100), ("a", 150), ("b", 3)], "archive_id string, off long")
    assert pick(ranges.block_of(at, blocks, "archive_id", "off", ["comp_offset"]), "archive_id", "off", "comp_offset") == [("a", 100, 50), ("a", 150, 50), ("a", 99, 0), ("b", 3, None)]
    assert ranges.broken_maps(blocks).count() == 0
    assert ranges.broken_maps(blocks.union(spark.createDataFrame([("a", 10, 300)], "a string, b long, c long"))).count() == 1
    w = spark.createDataFrame([(0,), (5,), (8,)], "n long").select("n", ranges.windows(F.col("n"), 4).alias("w"))
    assert [[tuple(x) for x in r["w"]] for r in w.orderBy("n").collect()] == [[], [(0, 3), (4, 4)], [(0, 3), (4, 7)]]


def test_islands_and_sessions(spark):
    v = spark.createDataFrame([("s", i) for i in (1, 2, 3, 5, 6)], "k string, n long")
    assert pick(ranges.volume_islands(v, "k", "n"), "first", "last", "parts") == [(1, 3, 3), (5, 6, 2)]
    c = spark.createDataFrame([("f", 0.0), ("f", 5.0), ("f", 100.0)], "k string, t double")
    assert pick(ranges.idle_sessions(c, "k", "t", 10), "session", "first_ts", "last_ts", "changes") == [(1, 0.0, 5.0, 2), (2, 100.0, 100.0, 1)]


def test_empty_catalog(spark):
    empty = files(spark, [])
    for made in (versions.latest(empty), versions.visible(empty), versions.version_paths(empty), versions.nth_version(empty, -1)):
        assert made.count() == 0


def test_newest_is_one_aggregation(spark):
    plan = versions.latest(some(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
    plan = versions.latest(some(spark).select("path", "name", "version_key", "size"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan


def test_offsets_of_one_huge_archive(spark):
    """One key with all rows: parts by quantiles give the same sums and blocks."""
    rows = spark.range(5000).select(F.lit("a").alias("k"), F.col("id").alias("ord"), (F.col("id") % 7 + 1).alias("len"))
    got = ranges.segment_offsets(rows, "k", "ord", "len").orderBy("ord").collect()
    at = 0
    for r in got:
        assert r["logical_offset"] == at
        at += r["len"]
    blocks = spark.range(0, 5000, 13).select(F.lit("a").alias("k"), (F.col("id") + 3).alias("data_offset"), F.col("id").alias("b"))
    found = {r["ord"]: r["b"] for r in ranges.block_of(rows.select("k", "ord"), blocks, "k", "ord", ["b"]).collect()}
    assert found == {i: (i - 3) // 13 * 13 if i >= 3 else None for i in range(5000)}
