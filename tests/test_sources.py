"""Archives made with the standard library, read back and compared with it."""

import base64
import bz2
import gzip
import hashlib
import io
import json
import lzma
import os
import sqlite3
import struct
import tarfile
import zipfile
import zlib

import pytest

from cairn.functions.values import S_IFDIR, S_IFLNK
from cairn.operators import layers, versions
from cairn.sources import archives, codecs, formats, tar, writers
from cairn.sources.records import FormatError, clean


def make_tar(members, fmt=tarfile.PAX_FORMAT):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=fmt) as t:
        for name, data, *more in members:
            info = tarfile.TarInfo(name)
            info.mtime = 1000
            for k, v in (more[0] if more else {}).items():
                setattr(info, k, v)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


TREE = [("d/", b"", {"type": tarfile.DIRTYPE}), ("d/a.txt", b"one"), ("d/a.txt", b"two!"), ("./d//b", b"x" * 1000), ("l", b"", {"type": tarfile.SYMTYPE, "linkname": "d/a.txt"}), ("é" * 120, b"long"), ("h", b"", {"type": tarfile.LNKTYPE, "linkname": "d/b"})]


@pytest.mark.parametrize("fmt", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT])
def test_tar_agrees_with_tarfile(fmt):
    raw = make_tar(TREE, fmt)
    got = list(tar.parse(io.BytesIO(raw)))
    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
        want = t.getmembers()
    assert [clean(e.name) for e in got] == [clean(m.name) for m in want]
    for e, m in zip(got, want, strict=True):
        assert e.mtime == m.mtime and (e.mode & 0xF000 == S_IFDIR) == m.isdir()
        if m.isreg():
            assert (e.size, raw[e.offset : e.offset + e.size]) == (m.size, raw[m.offset_data : m.offset_data + m.size])
    assert got[4].linkname == "d/a.txt" and got[4].mode & 0xF000 == S_IFLNK and got[6].linkname == "/d/b"


def test_tar_damage_and_zeros():
    raw = make_tar([("a", b"1" * 600), ("b", b"2" * 600)])
    assert [e.name for e in tar.parse(io.BytesIO(raw[: 512 + 1024 + 600]))] == ["a", "b"]
    with pytest.raises(FormatError):
        list(tar.parse(io.BytesIO(b"nothing here" * 100)))
    two = make_tar([("a", b"1")]) + make_tar([("b", b"2")])
    assert [e.name for e in tar.parse(io.BytesIO(two))] == ["a"]
    assert [e.name for e in tar.parse(io.BytesIO(two), ignore_zeros=True)] == ["a", "b"]


def test_tar_attributes_and_sparse():
    value = base64.b64encode(b"v2").rstrip(b"=").decode()
    raw = make_tar([("a", b"1", {"pax_headers": {"SCHILY.xattr.user.k": "v1", "LIBARCHIVE.xattr.user.k%20": value}})])
    assert next(tar.parse(io.BytesIO(raw))).xattrs == {"user.k": b"v1", "user.k ": b"v2"}
    raw = make_tar([("s", b"AAABBB", {"pax_headers": {"GNU.sparse.map": "2,3,10,3", "GNU.sparse.size": "16", "GNU.sparse.name": "real"}})])
    e = next(tar.parse(io.BytesIO(raw)))
    assert (e.name, e.size, [s[0] for s in e.segments]) == ("real", 16, ["hole", "data", "hole", "data", "hole"])
    assert archives.member_bytes(io.BytesIO(raw), e, "tar") == b"\0\0AAA" + b"\0" * 5 + b"BBB" + b"\0" * 3


def test_nested_tar():
    inner = make_tar([("in.txt", b"deep"), ("more.tar", make_tar([("x", b"y")]))])
    raw = make_tar([("o.tar", inner)])
    names = [e.name for e in tar.parse(io.BytesIO(raw))]
    assert names == ["o.tar", "o.tar/in.txt", "o.tar/more.tar"]
    deep = list(tar.parse(io.BytesIO(raw), nested=True))
    assert [e.name for e in deep][-1] == "o.tar/more.tar/x"
    assert raw[deep[-1].offset : deep[-1].offset + 1] == b"y"


def test_zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("d/", b"")
        z.writestr("d/a", b"hello" * 50, zipfile.ZIP_DEFLATED)
        z.writestr("s", b"stored")
        link = zipfile.ZipInfo("l")
        link.external_attr = (S_IFLNK | 0o777) << 16
        z.writestr(link, "d/a")
    got = {e.name: e for e in formats.zip_archive(out)}
    assert got["d/"].mode & 0xF000 == S_IFDIR and got["l"].linkname == "d/a" and got["d/a"].offset is None
    s = got["s"]
    assert out.getvalue()[s.offset : s.offset + s.size] == b"stored"
    assert formats.ZipBody(out).read(got["d/a"].header) == b"hello" * 50


def test_ar_and_cpio():
    def member(name, data, mode="100644"):
        return f"{name:<16}{'5':<12}{'1':<6}{'2':<6}{mode:<8}{len(data):<10}`\n".encode() + data + b"\n" * (len(data) & 1)

    raw = b"!<arch>\n" + member("/", b"symbols") + member("//", b"a_very_long_name.o/\n") + member("/0", b"abc") + member("b.o/", b"dd")
    assert [(e.name, raw[e.offset : e.offset + e.size]) for e in formats.ar(io.BytesIO(raw))] == [("a_very_long_name.o", b"abc"), ("b.o", b"dd")]

    def newc(name, data, mode):
        n = name.encode() + b"\0"
        head = b"070701" + b"".join(f"{x:08x}".encode() for x in (1, mode, 3, 4, 1, 99, len(data), 0, 0, 0, 0, len(n), 0))
        pad = lambda b: b + b"\0" * (-len(b) % 4)
        return pad(head + n) + pad(data)

    raw = newc("d", b"", S_IFDIR | 0o755) + newc("d/f", b"data", 0x81A4) + newc("l", b"d/f", S_IFLNK | 0o777) + newc("TRAILER!!!", b"", 0)
    got = list(formats.cpio(io.BytesIO(raw)))
    assert [(e.name, e.size, e.linkname) for e in got] == [("d", 0, ""), ("d/f", 4, ""), ("l", 0, "d/f")]
    assert raw[got[1].offset :][:4] == b"data"


def test_asar_xar_sqlar_ogg_html_warc():
    tree = json.dumps({"files": {"a": {"files": {"b": {"size": 2, "offset": "1"}}}, "l": {"link": "a/b"}}}).encode()
    size = len(tree) + -len(tree) % 4
    raw = struct.pack("<4I", 4, size + 8, size + 4, len(tree)) + tree + b"\0" * (size - len(tree)) + b"xyz"
    got = {e.name: e for e in formats.asar(io.BytesIO(raw))}
    assert raw[got["/a/b"].offset :][:2] == b"yz" and got["/l"].linkname == "a/b"

    toc = zlib.compress(b'<xar><toc><file id="1"><name>d</name><type>directory</type><file id="2"><name>f</name><type>file</type><data><length>3</length><offset>0</offset><size>3</size><encoding style="application/octet-stream"/></data></file></file></toc></xar>')
    raw = struct.pack(">4sHHQQI", b"xar!", 28, 1, len(toc), 0, 0) + toc + b"abc"
    got = {e.name: e for e in formats.xar(io.BytesIO(raw))}
    assert raw[got["/d/f"].offset :][:3] == b"abc"

    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE sqlar(name TEXT PRIMARY KEY, mode INT, mtime INT, sz INT, data BLOB)")
    db.executemany("INSERT INTO sqlar VALUES (?,?,?,?,?)", [("d", 0x41ED, 1, 0, None), ("d/f", 0x81A4, 2, 500, zlib.compress(b"q" * 500)), ("l", 0xA1FF, 3, -1, b"d/f"), ("./d/f", 0x81A4, 2, 1, b"z")])
    db.commit()
    got = {e.name: e for e in formats.sqlar(io.BytesIO(db.serialize()))}
    assert got["d/f"].data == b"q" * 500 and got["l"].linkname == "d/f" and "./d/f" not in got

    page = lambda serial, body: b"OggS" + bytes(10) + struct.pack("<I", serial) + bytes(8) + bytes([1, len(body)]) + body
    raw = page(1, b"\x01vorbis..") + page(2, b"OpusHead") + page(1, b"more")
    got = list(formats.ogg(io.BytesIO(raw)))
    assert [(e.name, len(e.segments)) for e in got] == [("vorbis-00000001.ogg", 2), ("opus-00000002.ogg", 1)]

    text = b'<html><img src="data:image/png;base64,aGk="><a style=\'x:url(data:text/plain,b%20c)\'></html>'
    assert [(e.name.rpartition(".")[2], e.data) for e in formats.html(io.BytesIO(text))] == [("png", b"hi"), ("txt", b"b c")]

    rec = lambda kind, uri, body: f"WARC/1.0\r\nWARC-Type: {kind}\r\n{'WARC-Target-URI: ' + uri + chr(13) + chr(10) if uri else ''}WARC-Record-ID: <urn:uuid:1-2>\r\nWARC-Date: 2020-01-02T03:04:05Z\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    raw = rec("warcinfo", "", "i") + rec("response", "http://h/a/", "one") + rec("response", "http://h/a/", "two")
    assert [e.name for e in formats.warc(io.BytesIO(raw))] == ["_warc/warcinfo/1-2", "h/a/index.html", "h/a/index.html-1"]


def test_cab_and_iso():
    body = b"hello cab"
    folder = struct.pack("<IHH", len(body), len(body), len(body))[:0] + struct.pack("<IHH", 0, len(body), len(body)) + body
    name = b"d\\f.txt\0"
    files_at, data_at = 36 + 8, 36 + 8 + 16 + len(name)
    raw = b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, data_at + len(folder), 0, files_at, 0, 3, 1, 1, 1, 0, 0, 0) + struct.pack("<IHH", data_at, 1, 0) + struct.pack("<IIHHHH", len(body), 0, 0, (40 << 9) | (1 << 5) | 2, 0, 0x20) + name + folder
    (e,) = formats.cab(io.BytesIO(raw))
    assert (e.name, e.data) == ("d/f.txt", body)

    def rec(name, extent, size, flags):
        n = 33 + len(name) + (1 - len(name) % 2)
        return bytes([n, 0]) + struct.pack("<I", extent) + struct.pack(">I", extent) + struct.pack("<I", size) + struct.pack(">I", size) + bytes([120, 1, 2, 3, 4, 5, 0, flags, 0, 0, 1, 0, 0, 1, len(name)]) + name + b"\0" * (1 - len(name) % 2)

    image = bytearray(22 * 2048)
    image[16 * 2048 : 16 * 2048 + 6] = b"\1CD001"
    image[16 * 2048 + 128 : 16 * 2048 + 130] = struct.pack("<H", 2048)
    root = rec(b"\0", 18, 2048, 2)
    image[16 * 2048 + 156 : 16 * 2048 + 156 + len(root)] = root
    image[17 * 2048 : 17 * 2048 + 6] = b"\xffCD001"
    entries = root + rec(b"\1", 18, 2048, 2) + rec(b"D", 19, 2048, 2) + rec(b"A.TXT;1", 20, 5, 0)
    image[18 * 2048 : 18 * 2048 + len(entries)] = entries
    inner = rec(b"\0", 19, 2048, 2) + rec(b"\1", 18, 2048, 2) + rec(b"B.;1", 21, 3, 0)
    image[19 * 2048 : 19 * 2048 + len(inner)] = inner
    image[20 * 2048 : 20 * 2048 + 5] = b"aaaaa"
    got = {e.name: e for e in formats.iso9660(io.BytesIO(bytes(image)))}
    assert set(got) == {"/D", "/A.TXT", "/D/B"} and got["/A.TXT"].size == 5 and got["/D"].mode & 0xF000 == S_IFDIR


def lzip(data):
    body = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16, "lc": 3, "lp": 0, "pb": 2}])
    body = lzma.compress(data, lzma.FORMAT_ALONE, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16, "lc": 3, "lp": 0, "pb": 2}])[13:]
    return b"LZIP\1\x10" + body + struct.pack("<IQQ", zlib.crc32(data), len(data), 6 + len(body) + 20)


def test_codecs():
    import zstandard

    data = os.urandom(3000) + b"text " * 20000
    z = zstandard.ZstdCompressor()
    packed = {"gzip": gzip.compress(data) + gzip.compress(b"tail"), "bzip2": bz2.compress(data) + bz2.compress(b"tail"), "xz": lzma.compress(data) + lzma.compress(b"tail"), "zlib": zlib.compress(data + b"tail"), "lzma": lzma.compress(data + b"tail", lzma.FORMAT_ALONE), "zstd": z.compress(data) + z.compress(b"tail"), "lzip": lzip(data) + lzip(b"tail")}
    for codec, raw in packed.items():
        assert codecs.detect(raw[:64], "x.lzma" if codec == "lzma" else "x") == codec
        assert b"".join(codecs.decompress(io.BytesIO(raw), codec)) == data + b"tail", codec
    assert codecs.lz4_block(bytes([0x1F]) + b"a" + b"\1\0" + b"\x05" + bytes([0x10]) + b"b") == b"a" * 25 + b"b"
    assert codecs.zstd_blocks(packed["zstd"])[1][1] == len(data)
    assert [d for _, d in codecs.lzip_blocks(packed["lzip"])] == [0, len(data), len(data) + 4]
    assert codecs.xz_blocks(lzma.compress(data))[-1][1] == len(data)
    big = b"".join(hashlib.sha256(bytes([i & 255, i >> 8])).digest() for i in range(9000))
    blocks = codecs.bzip2_blocks(bz2.compress(big, 1))
    assert blocks[0] == (32, 0) and len(blocks) >= 3 and blocks[-1][1] == len(big)


def test_scan_and_contents(spark, tmp_path):
    (tmp_path / "a.tar.gz").write_bytes(gzip.compress(make_tar(TREE)))
    (tmp_path / "plain.txt").write_bytes(b"just text")
    (tmp_path / "n.tar.bz2").write_bytes(bz2.compress(make_tar([("q.zip", zip_of({"z/1": b"in zip"}))])))
    raw = archives.binary(spark, str(tmp_path))
    rows = archives.scan(raw)
    assert rows.schema == archives.S.FILES
    tarred = rows.where("archive_id like '%a.tar.gz'")
    newest = {(r["path"], r["name"]): r["size"] for r in versions.latest(tarred).collect()}
    assert newest["/d", "a.txt"] == 4 and newest["/d", "b"] == 1000
    assert rows.where("archive_id like '%plain.txt'").first()["backend"] == "file"
    contents = archives.scan_contents(raw)
    got = {(r["name"], r["version_key"]): bytes(r["content"]) for r in contents.where("archive_id like '%a.tar.gz'").collect()}
    assert sorted(v for (n, _), v in got.items() if n == "a.txt") == [b"one", b"two!"]
    digest = {bytes(r["value"]).decode() for r in archives.scan_digests(raw, "SHA-256, crc32").where("key = 'user.sha256'").collect()}
    assert hashlib.sha256(b"two!").hexdigest() in digest
    nested = rows.where("archive_id like '%n.tar.bz2'")
    whole = layers.automount(nested, archives.open_nested(contents))
    assert {(r["path"], r["name"]) for r in whole.collect()} >= {("/q.zip/z", "1"), ("", "q.zip")}
    assert whole.where("name = 'q.zip'").first()["mode"] & 0xF000 == S_IFDIR


def zip_of(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


def test_data_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tar").write_bytes(make_tar(TREE))
    archives.register(spark)
    got = spark.read.format("cairn").load(str(tmp_path / "in"))
    assert got.where("name = 'a.txt'").count() == 2
    os.symlink("a.tar", tmp_path / "in" / "link")
    folder = spark.read.format("cairn-folder").load(str(tmp_path / "in"))
    assert {r["name"]: r["linkname"] for r in folder.collect()} == {"a.tar": "", "link": "a.tar"}


def test_blocks_segments_attributes(spark, tmp_path):
    (tmp_path / "x.tar.xz").write_bytes(lzma.compress(make_tar(TREE)))
    (tmp_path / "s.tar").write_bytes(make_tar([("s", b"AAA", {"pax_headers": {"GNU.sparse.map": "2,3", "GNU.sparse.size": "8", "SCHILY.xattr.user.k": "v"}})]))
    raw = archives.binary(spark, str(tmp_path))
    blocks = archives.scan_blocks(raw).orderBy("comp_offset").collect()
    assert blocks[0]["codec"] == "xz" and blocks[-1]["is_sentinel"]
    assert [(r["kind"], r["len"], r["logical_offset"]) for r in archives.scan_segments(raw).orderBy("ord").collect()] == [("hole", 2, 0), ("data", 3, 2), ("hole", 3, 5)]
    assert archives.scan_attributes(raw).first()["key"] == "user.k"


@pytest.mark.parametrize("kind", ["tar", "zip"])
def test_write_and_read_back(spark, tmp_path, kind):
    rows = [("out." + kind, "/d", "f", 0x81A4, 100.0, 1, 2, "", b"hello"), ("out." + kind, "", "d", S_IFDIR | 0o755, 100.0, 0, 0, "", None), ("out." + kind, "", "l", S_IFLNK | 0o777, 100.0, 0, 0, "d/f", None)]
    writers.write_archives(spark.createDataFrame(rows, writers.MEMBERS), str(tmp_path / "w"), kind)
    got = {r["name"]: r for r in archives.scan(archives.binary(spark, str(tmp_path / "w"))).collect()}
    assert got["f"]["size"] == 5 and got["l"]["linkname"] == "d/f" and got["d"]["mode"] & 0xF000 == S_IFDIR
    assert os.listdir(tmp_path / "w") == ["out." + kind]


def test_catalog_sink(spark, tmp_path):
    (tmp_path / "a.tar").write_bytes(make_tar(TREE))
    rows = archives.scan(archives.binary(spark, str(tmp_path / "a.tar")))
    assert not writers.write_catalog(rows, str(tmp_path / "c"), minimum=1000)
    assert writers.write_catalog(rows, str(tmp_path / "c"))
    assert writers.read_catalog(spark, str(tmp_path / "c")).count() == len(TREE)


def test_split_volumes(spark):
    names = [(n,) for n in ("v.001", "v.002", "v.003", "w.aa", "w.ab", "x.001", "y.005", "y.006")]
    got = {r["stem"]: (r["format"], r["first"], r["last"], r["parts"]) for r in archives.split_sets(spark.createDataFrame(names, "name string")).collect()}
    assert got == {"v": ("decimal", 1, 3, 3), "w": ("letters", 0, 1, 2)}
    parts = spark.createDataFrame([("v", 2, b"cd"), ("v", 1, b"ab"), ("v", 3, b"e")], "archive_id string, part long, content binary")
    assert bytes(archives.joined_parts(parts).first()["content"]) == b"abcde"


def test_damage_is_told_and_ends_no_job(spark):
    good, bad_member = zip_of({"a": b"1" * 900, "b": b"2"}), bytearray(zip_of({"a": b"1" * 900, "b": b"2"}))
    bad_member[35] ^= 0xFF
    files = [("good.zip", good), ("member.zip", bytes(bad_member)), ("cut.zip", good[:-30]), ("cut.tar.gz", gzip.compress(make_tar(TREE))[:60]), ("bad.tar.xz", b"\xfd7zXZ\0" + b"x" * 90), ("empty.tar", b"")]
    raw = spark.createDataFrame(files, "archive_id string, content binary")
    got = sorted((r["archive_id"], r["name"]) for r in archives.scan_contents(raw).where("archive_id like '%zip'").collect())
    assert got == [("good.zip", "a"), ("good.zip", "b"), ("member.zip", "b")]
    told = {(r["archive_id"], r["path"]) for r in archives.scan_damage(raw).collect()}
    assert told == {("member.zip", "/a"), ("cut.zip", None), ("cut.tar.gz", None), ("bad.tar.xz", None)}
    assert {r["archive_id"] for r in archives.scan_digests(raw).collect()} == {"good.zip", "member.zip"}


def test_incremental_prefix_equals_the_prefix_field():
    raw = bytearray(make_tar([("12345670123/d/f", b"x")], tarfile.USTAR_FORMAT))
    assert [e.name for e in tar.parse(io.BytesIO(bytes(raw)))] == ["12345670123/d/f"]
    raw[345:356] = b"12345670123"
    raw[257:265] = b"ustar  \0"
    raw[148:156] = b" " * 8
    raw[148:156] = f"{sum(raw[:512]):06o}\0 ".encode()
    assert [e.name for e in tar.parse(io.BytesIO(bytes(raw)))] == ["d/f"]
    assert [e.name for e in tar.parse(io.BytesIO(bytes(raw)), incremental=False)] == ["12345670123/d/f"]


def test_archives_of_one_base_name(spark, tmp_path):
    rows = [(f"{d}/a.tar", "", "f", 0x81A4, 100.0, 0, 0, "", d.encode()) for d in "xy"]
    writers.write_archives(spark.createDataFrame(rows, writers.MEMBERS), str(tmp_path / "w"))
    got = {bytes(r["content"]) for r in archives.scan_contents(archives.binary(spark, str(tmp_path / "w"))).collect()}
    assert got == {b"x", b"y"}


def test_bzip2_blocks_at_any_bit():
    data = b"".join(hashlib.sha256(bytes([i & 255, i >> 8])).digest() for i in range(9000)) + b"z" * 70000
    raw = bz2.compress(data, 1) + bz2.compress(b"tail") + bz2.compress(b"")
    blocks = codecs.bzip2_blocks(raw)
    assert blocks[0] == (32, 0) and blocks[-1][1] == len(data) + 4 and len(blocks) >= 5 and any(b % 8 for b, _ in blocks)
    assert codecs.xz_blocks(lzma.compress(data) + bytes(4) + lzma.compress(b"tail"))[-1][1] == len(data) + 4


def test_batches_end_by_bytes():
    """Large files do not meet in one batch, however few rows they are."""
    rows = [(str(i), bytes(3 << 20)) for i in range(7)] + [(str(i), b"") for i in range(7, 10)]
    got = list(archives.in_batches(iter(rows), archives.FILE))
    assert [b.num_rows for b in got] == [3, 3, 4]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == rows


def test_files_are_packed_by_the_pass_that_reads_them(spark):
    """One pass of Python workers, so images much larger than their files do not cross to the JVM and back."""
    from cairn.plans import builders as B

    listed = spark.createDataFrame([("a", ["x", ""]), ("b", None)], "archive_id string, content array<string>")
    load = lambda cell: B.fat([(f"{i}.TXT", t.encode()) for i, t in enumerate(cell.as_py() or [])])
    got = archives.scan_contents(listed, load=load)
    assert sorted((r["archive_id"], r["name"], bytes(r["content"])) for r in got.collect()) == [("a", "0.TXT", b"x"), ("a", "1.TXT", b"")]
    from cairn.plans import registry

    if os.path.isdir("/root/testdata/sf0.001"):
        for name, passes in (("format_fat", 1), ("format_detection", 15)):
            plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("MapInArrow") == passes


def test_contents_by_path(spark, tmp_path):
    """The same rows as from cells, and no archive in a cell of the plan of ``write_tar``."""
    from cairn.plans import builders as B

    for name, raw in {"a/o.tar": B.tar([("d/x", b"1"), ("y", b"22")]), "b/o.zip": B.zip_([("x", b"3")]), "cut.tar": B.tar([("x", b"4"), ("y", bytes(2000))])[:2000], "bad.zip": b"PK\3\4"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    rows = lambda df: sorted((r["archive_id"].removeprefix("file:"), r["path"], r["name"], r["version_key"], bytes(r["content"])) for r in df.collect())
    got = rows(archives.read_contents(spark, f"file://{tmp_path}"))
    assert got == rows(archives.scan_contents(archives.binary(spark, str(tmp_path)))) and len(got) == 5
    from cairn.plans import registry

    if os.path.isdir("/root/testdata/sf0.001"):
        plan = registry.queries()["write_tar"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "binaryFile" not in plan and "MapInArrow" not in plan
