import io
import os
import tarfile
import zipfile

import pytest

from cairn.functions import options
from cairn.operators import indexes
from cairn.plans.catalog import Catalog
from cairn.plans.schema import FILES
from cairn.sources import writers


def files(spark, rows):
    full = [("z", p, n, k, 0, 0, size, 1.0, mode, 0, "", 0, 0, False, False, False, gone, 0, "tar") for p, n, k, size, mode, gone in rows]
    return spark.createDataFrame(full, FILES)


REG, DIR = 0x81A4, 0x41ED


def test_layers_and_requests(spark):
    a = Catalog(files(spark, [("/d", "f", 1, 1, REG, False), ("/d", "f", 2, 2, REG, False), ("/d", "g", 1, 5, REG, True), ("", "d", 0, 0, DIR, False)]))
    b = Catalog(files(spark, [("/d", "f", 1, 9, REG, False), ("/e", "h", 1, 4, REG, False)]))
    assert [(r["name"], r["size"]) for r in a.list("/d").collect()] == [("f", 2)]
    assert sorted((r["path"], r["name"], r["size"]) for r in a.union(b).files.where("size > 0").collect()) == [("/d", "f", 9), ("/d", "g", 5), ("/e", "h", 4)]
    assert {(r["path"], r["name"]) for r in a.mount_under("m/n").files.where("is_generated").collect()} == {("", "m"), ("/m", "n")}
    changes = spark.createDataFrame([("/d", "f", 1.0, REG, 7, False)], "path string, name string, mtime double, mode long, size long, deleted boolean")
    assert [r["size"] for r in a.overlay(changes).files.where("name = 'f'").collect()] == [7]
    assert [r["name"] for r in a.transform("^/d", "/x").list("/x").collect()] == ["f"]
    asked = spark.createDataFrame([("/d", "f", -1)], "path string, name string, version long")
    assert a.lookup(asked).first()["size"] == 1 and a.exists(asked.select("path", "name")).count() == 1
    assert a.version(1).where("name = 'f'").first()["size"] == 1 and a.version_paths().count() == 4
    assert [r["name"] for r in a.page("/d", limit=5).collect()] == ["f", "g"]


def test_indexes(spark):
    meta = spark.createDataFrame([("backendName", "tar"), ("nestedMembers", '[{"path": "a.tar", "offset": 512, "size": 10}]')], "key string, value string")
    indexes.check_backend(meta, "tar")
    with pytest.raises(ValueError):
        indexes.check_backend(meta, "zip")
    assert tuple(indexes.nested_members(meta).first()) == ("a.tar", 512, 10)
    made = spark.createDataFrame([('{"size": 3, "mtime": 10.9, "prefix_sha256": "p"}',)], "j string").select(indexes.parse_fingerprint("j").alias("f"))
    assert made.first()["f"]["mtime"] == 10.0 and '"size":3' in made.select(indexes.fingerprint_json("f")).first()[0]
    kind = "struct<size:long,prefix_sha256:string,suffix_sha256:string,mid_sha256:string>"
    asked = spark.createDataFrame([("k1", (1, "p", "s", "")), ("k2", (1, "p", "s", "m"))], f"member_key string, fingerprint {kind}")
    stored = spark.createDataFrame([("k1", (1, "p", "s", "m"), 2, b"x"), ("k2", (1, "p", "s", "n"), 2, b"y"), ("k1", (1, "p", "s", "m"), 1, b"z")], f"member_key string, fingerprint {kind}, schema_version int, blob binary")
    assert [bytes(r["blob"]) for r in indexes.usable_nested(asked, stored, 2).collect()] == [b"x"]
    now = "struct<size:long,mtime:double,prefix_sha256:string,suffix_sha256:string,full_sha256:string>"
    one = spark.createDataFrame([("a", (1, 1.0, "p", "s", None)), ("b", (1, 1.0, "p", "s", None))], f"archive_id string, fingerprint {now}")
    two = spark.createDataFrame([("a", (2, 1.0, "p", "s", None)), ("c", (1, 1.0, "p", "s", None))], f"archive_id string, fingerprint {now}")
    assert {r["archive_id"]: r["state"] for r in indexes.stale_archives(one, two).collect()} == {"a": "size", "b": "fresh", "c": "fresh"}


def test_options(tmp_path):
    assert options.comma_list('["a", "b,c"]') == ["a", "b,c"] and options.comma_list(" a, b ,") == ["a", "b"]
    assert options.extensions(".TAR, zip,tar") == ["tar", "zip"]
    assert options.bind_address("[::1]:80") == ("::1", 80) and options.bind_address(":9") == ("127.0.0.1", 9) and options.bind_address("h") == ("h", 2049)
    with pytest.raises(ValueError):
        options.bind_address("h:99999")
    assert options.remote("s3://bucket/a/b%20c")["key"] == "a/b c" and options.remote("smb://u:p@h/share/x/y")["path"] == "x/y"
    assert options.remote("sftp://h:22/~/f")["path"] == "f" and options.remote("dropbox://a//b")["path"] == "/a/b"
    with pytest.raises(ValueError):
        options.remote("just/a/path")
    archive = str(tmp_path / "a.tar")
    places = options.index_candidates(archive, ["", str(tmp_path / "idx")])
    assert places[0] == archive + ".index.parquet" and places[1].endswith("_a.tar.index.parquet")
    os.mkdir(tmp_path / "idx")
    open(places[1], "w").close()
    assert options.index_place(archive, ["", str(tmp_path / "idx")]) == places[1]


def test_ssh_options():
    text = 'User all\n# x\nHost *.org !bad.org\n  Port 22\n  IdentityFile a\nHost h?.org\n  Port 23\n  IdentityFile "b"\n'
    assert options.ssh_options(text, "h1.org") == {"user": "all", "port": "22", "identityfile": ["a", "b"]}
    assert options.ssh_options(text, "bad.org") == {"user": "all"}


def test_empty_archives():
    assert tarfile.open(fileobj=io.BytesIO(writers.empty_archive())).getnames() == []
    assert zipfile.ZipFile(io.BytesIO(writers.empty_archive("zip"))).namelist() == []
    assert writers.version_triple("0.7.1-x") == (0, 7, 1)
