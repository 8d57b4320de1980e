"""Every registered query against its SQL twin on the smallest tables, and the entry without optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from cairn.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in registry.oracles():
        assert rows
        return
    want = duck.execute(registry.oracles()[name])
    assert rows_of(got.columns, rows) == rows_of([d[0] for d in want.description], want.fetchall())


def same_on(spark, folder, name, texts):
    """The query and its SQL on documents of these texts."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    got, want = registry.queries()[name](spark, str(folder)), con.execute(registry.oracles()[name])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of([d[0] for d in want.description], want.fetchall())


def test_data_uri_decode_of_null_and_empty_texts(spark, tmp_path):
    same_on(spark, tmp_path, "data_uri_decode", ["a", None, "", " ", "\0", "é😀\n"])


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_optional_parts(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "cairn"), tmp_path / "cairn", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(n.startswith('op') for n in e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)


@needs_data
def test_scans_are_narrow_and_filters_reach_them(spark):
    plan = registry.queries()["html_links"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan
    plan = registry.queries()["list_dirents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderstatus" not in plan.split("ReadSchema")[1]
