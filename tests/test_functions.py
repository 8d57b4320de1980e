import datetime

import pytest
from pyspark.sql import functions as F

from cairn.functions import html, paths, values


def one(spark, column, **literals):
    row = spark.createDataFrame([(1,)], "x int").select(*[F.lit(v).alias(k) for k, v in literals.items()], F.lit(0).alias("_z"))
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("", "/"), ("/", "/"), ("a", "/a"), ("./a//b/./c/", "/a/b/c"), ("/a/../b", "/b"), ("../../a", "/a"), ("a/..", "/"), ("/a/b/../../../c", "/c")],
)
def test_normalize(spark, raw, want):
    assert one(spark, paths.normalize("p"), p=raw) == want


def test_split_and_join(spark):
    assert one(spark, F.struct(paths.parent("p"), paths.basename("p")), p="/a/b") == ("/a", "b")
    assert one(spark, F.struct(paths.parent("p"), paths.basename("p")), p="/a") == ("", "a")
    assert one(spark, paths.join("d", "n"), d="", n="a") == "/a"
    assert one(spark, paths.join("d", "n"), d="/x", n="a") == "/x/a"
    assert one(spark, paths.ancestors("p"), p="/a/b/c") == ["/a", "/a/b"]
    assert one(spark, paths.ancestors("p"), p="/a") == []
    assert one(spark, paths.at_depth("p", 2), p="/a/b/c") == "/a/b"
    assert one(spark, paths.link_target("p", "t"), p="/a/b", t="../c") == "/c"
    assert one(spark, paths.link_target("p", "t"), p="/a/b", t="/d") == "/d"


@pytest.mark.parametrize(
    ("uri", "want"),
    [("http://h", "/h/index.html"), ("http://h/a/", "/h/a/index.html"), ("http://h/a?q=1#f", "/h/a?q=1"), ("https://h:8/x.html#top", "/h:8/x.html")],
)
def test_uri_to_path(spark, uri, want):
    assert one(spark, paths.uri_to_path("u"), u=uri) == want


@pytest.mark.parametrize(
    ("name", "stem", "kind"),
    [("a.tar.gz", "a", "archive"), ("a.tgz", "a", "archive"), ("a.txt.xz", "a.txt", "compressed"), ("a.001", "a.001", "split"), ("a.txt", "a.txt", "plain"), (".tar", ".tar", "archive")],
)
def test_suffixes(spark, name, stem, kind):
    assert one(spark, F.struct(paths.strip_archive("n"), paths.archive_class("n")), n=name) == (stem, kind)


def test_globs(spark):
    host = lambda h, *p: one(spark, paths.host_matches("h", list(p)), h=h)
    assert host("a.example.com", "*.example.com")
    assert not host("a.example.com", "*.example.com", "!a.*")
    assert host("h1", "h?") and not host("h12", "h?") and not host("axb", "a.b")
    assert one(spark, paths.ordered_backends("c", ["x", "y"]), c="y, z") == ["z", "y", "x"]


def test_number_fields(spark):
    assert one(spark, values.octal("t"), t="0000644\0") == 0o644
    assert one(spark, values.octal("t"), t=" ") == 0
    assert one(spark, values.octal("t"), t="64 8") is None
    assert one(spark, values.hexadecimal("t"), t="00ff") == 255
    assert one(spark, values.decimal("t"), t=" 42 ") == 42
    assert one(spark, values.is_directory("m"), m=0x41ED) and one(spark, values.is_symlink("m"), m=0xA1FF)


def test_digest_vectors(spark):
    got = one(spark, F.struct(*values.digests(F.encode("t", "UTF-8"))), t="abc")
    assert got == ("352441c2", "900150983cd24fb0d6963f7d28e17f72", "a9993e364706816aba3e25717850c26c9cd0d89d", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")


@pytest.mark.parametrize(("text", "want"), [("512", 512), ("4K", 4096), ("16MiB", 16 << 20), ("1 gb", 1 << 30), ("x", None), ("999999999999999999T", None)])
def test_byte_size(spark, text, want):
    assert one(spark, values.byte_size("t"), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("90", 90), ("90s", 90), ("5m", 300), ("2h", 7200), ("0", 0), ("1d", None)])
def test_duration(spark, text, want):
    assert one(spark, values.duration_seconds("t"), t=text) == want


def test_dates(spark):
    want = int(datetime.datetime(2021, 3, 4, 5, 6, 8, tzinfo=datetime.UTC).timestamp())
    assert one(spark, values.dos_timestamp("d", "t"), d=(41 << 9) | (3 << 5) | 4, t=(5 << 11) | (6 << 5) | 4) == want
    assert one(spark, values.dos_timestamp("d", "t"), d=0, t=0) is None
    assert one(spark, values.filetime_seconds("x"), x=0) == 0.0
    assert one(spark, values.filetime_seconds("x"), x=116444736000000000) == 0.0


def test_split_numbers(spark):
    assert one(spark, values.split_number("s"), s="001") == 1
    assert one(spark, values.split_number("s"), s="ab") == 1
    assert one(spark, values.number_letters("n", 2), n=27) == "bb"
    assert one(spark, values.parallelization("s"), s="4") == {"": "4"}
    assert one(spark, values.parallelization("s"), s="gzip:2,:3") == {"gzip": "2", "": "3"}


def test_html(spark):
    page = """<img src="data:image/png;base64,aGk+"><p style='background:url(data:,a%20b+c)'>"""
    assert one(spark, html.data_uris("h"), h=page) == ["data:image/png;base64,aGk+", "data:,a%20b+c"]
    assert bytes(one(spark, html.data_bytes("u"), u="data:image/png;base64,aGk+")) == b"hi>"
    assert bytes(one(spark, html.data_bytes("u"), u="data:,a%20b+c")) == b"a b+c"
    assert one(spark, html.media_extension("k"), k="image/x-icon") == "ico"
    assert one(spark, html.media_extension("k"), k="application/octet-stream") == ""
    assert one(spark, html.unescape("t"), t="a &lt;b&gt; &amp;amp;") == "a <b> &amp;"


def test_staleness(spark):
    base = {"size": 1, "mtime": 10.2, "prefix_sha256": "p", "suffix_sha256": "s", "full_sha256": None}
    kinds = "struct<size:long,mtime:double,prefix_sha256:string,suffix_sha256:string,full_sha256:string>"
    cases = [({}, "fresh"), ({"mtime": 10.9}, "fresh"), ({"size": 2}, "size"), ({"mtime": 11.0}, "mtime"), ({"prefix_sha256": "x"}, "content")]
    rows = [(base | change, base) for change, _ in cases] + [(None, base)]
    got = spark.createDataFrame(rows, f"a {kinds}, b {kinds}").select(values.staleness("a", "b")).collect()
    assert [r[0] for r in got] == [w for _, w in cases] + ["fresh"]
