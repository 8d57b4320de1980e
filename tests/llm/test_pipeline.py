"""The corpus pipeline stage by stage on a small table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

RNG = random.Random(29)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(600)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    items = [(k, prose(25)) for k in range(5)]
    texts = [prose(RNG.randint(40, 90)) for _ in range(40)]
    texts[3] = texts[2]
    words = texts[4].split()
    words[20] = "changed"
    texts[5] = " ".join(words)
    texts[6] = prose(30) + " " + items[0][1] + " " + prose(30)
    texts[7], texts[8] = None, "123 ..."
    line = "this very line is on many pages"
    texts[10:30] = [t + "\n" + line for t in texts[10:30]]
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), rows, line


def test_stages(spark, tables):
    folder, rows, line = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {name: {r["doc_id"] for r in got} for name, got in seen.items()}
    every = {r[0] for r in rows}
    assert ids["language"] == every - {7, 8} == ids["lines"]
    texts = {r["doc_id"]: r["text"] for r in seen["lines"]}
    assert line in texts[10] and all(line not in texts[i] for i in range(11, 30))
    assert all(len(r["text"]) == r["n_chars"] for r in seen["lines"])
    assert ids["near_duplicates"] == every - {7, 8, 3, 5}
    assert ids["decontamination"] == every - {7, 8, 3, 5, 6} == ids["packing"]


def test_run_equals_the_stages(spark, tables):
    got = corpus_pipeline.run(spark, tables[0])
    assert got.count() >= 35 and {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(got.columns)


def test_edge_cases(spark, tables, tmp_path):
    """Null and repeated ids, equal rows, empty texts, more columns; and an empty table."""
    folder, rows, _ = tables
    a, b, c = prose(60), prose(60), prose(60)
    more = [(None, a), (None, b), (None, b), (900, c), (900, prose(50)), (901, c), (901, c), (902, ""), (903, None), (904, " \n")]
    docs = spark.createDataFrame([*rows, *[(i, t, "en", None, None) for i, t in more]], SCHEMA)
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    clash = docs
    for name in ("key", "node", "sign", "row", "_lines", "part", "root"):
        clash = clash.withColumn(name, F.lit(1))
    clash.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "a" / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.sum(F.when(F.col("start") == 0, 1).otherwise(0)).alias("docs")).collect()
    found = {r["doc_id"]: r["docs"] for r in got}
    assert found[None] == 2 and found[900] == 2 and not {901, 902, 903, 904} & set(found)
    clash.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "b" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
