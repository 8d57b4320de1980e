import datetime

from pyspark.sql import functions as F

from cairn.operators import ranges
from cairn.streaming import idle


def test_idle_commit_equals_batch(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    times = {"a": [0, 5, 100, 104], "b": [2, 50], "z": [100000]}  # the last moves the watermark past the others
    rows = [("/d", n, t0 + datetime.timedelta(seconds=s)) for n, ss in times.items() for s in ss]
    spark.createDataFrame(rows, "path string, name string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    changes = spark.readStream.schema("path string, name string, ts timestamp").parquet(str(tmp_path / "in"))
    query = idle.commit_stream(changes, "10 seconds", lambda df, n: seen.extend((r["name"], r["changes"], n) for r in df.collect()), checkpoint=str(tmp_path / "cp"), flush=True).start()
    query.awaitTermination(120)
    batch = ranges.idle_sessions(spark.createDataFrame(rows, "path string, name string, ts timestamp").select("name", F.unix_timestamp("ts").alias("t")), "name", "t", 10)
    want = sorted((r["name"], r["changes"]) for r in batch.where("name <> 'z'").collect())
    assert sorted((n, c) for n, c, _ in seen) == want


def test_hot_parents_stay(spark):
    gone = spark.createDataFrame([("", "d"), ("", "e")], "path string, name string")
    hot = spark.createDataFrame([("/d/x", "f")], "path string, name string")
    assert [r["name"] for r in idle.keep_hot_parents(gone, hot).collect()] == ["e"]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "generation long, v string")
    assert [r["v"] for r in idle.current_generation(rows).collect()] == ["b"]
