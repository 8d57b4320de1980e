"""Images and richer containers: made by the system's tools where there are any, else by hand."""

import io
import lzma
import shutil
import struct
import subprocess
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from cairn.functions.values import S_IFDIR, S_IFLNK
from cairn.sources import archives, formats, images, remote


def number(n):
    assert n < 0x4000
    return bytes([n]) if n < 0x80 else bytes([0x80 | n >> 8, n & 255])


def seven_zip(files, links=()):
    """One LZMA folder with all files, a directory ``d`` in front."""
    data = b"".join(b for _, b in files)
    raw = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16}])
    names = ["d", *[n for n, _ in files]]
    n = len(files)
    packs = b"\x06" + number(0) + number(1) + b"\x09" + number(len(raw)) + b"\0"
    folders = b"\x07\x0b" + number(1) + b"\0" + number(1) + b"\x23\3\1\1" + number(5) + b"\x5d" + struct.pack("<I", 1 << 16) + b"\x0c" + number(len(data)) + b"\0"
    sub = b"\x08\x0d" + number(n) + b"\x09" + b"".join(number(len(b)) for _, b in files[:-1]) + b"\0"
    text = b"\0" + "".join(x + "\0" for x in names).encode("utf-16-le")
    bits = lambda flags: bytes(sum(f << (7 - i) for i, f in enumerate(flags[k : k + 8])) for k in range(0, len(flags), 8))
    empty = bits([1] + [0] * n)
    unix = b"\1\0" + b"".join(struct.pack("<I", 0x8000 | m << 16) for m in [S_IFDIR | 0o755, *[S_IFLNK | 0o777 if x in links else 0o100600 for x, _ in files]])
    times = b"\1\0" + struct.pack("<Q", 116444736000000000 + 10**7) * (n + 1)
    prop = lambda k, b: bytes([k]) + number(len(b)) + b
    head = b"\1\4" + packs + folders + sub + b"\0" + b"\5" + number(n + 1) + prop(14, empty) + prop(17, text) + prop(20, times) + prop(21, unix) + b"\0\0"
    start = struct.pack("<QQI", len(raw), len(head), zlib.crc32(head))
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(start)) + start + raw + head


def test_seven_zip():
    raw = seven_zip([("d/a", b"hello" * 40), ("d/b", b"bye"), ("l", b"d/a")], links=("l",))
    got = {e.name: e for e in images.seven_zip(io.BytesIO(raw))}
    assert got["d"].mode & 0xF000 == S_IFDIR and got["d/a"].data == b"hello" * 40 and got["d/b"].data == b"bye"
    assert got["l"].linkname == "d/a" and got["d/a"].mtime == 1.0 and got["d/b"].mode == 0o100600
    assert formats.detect(raw) == "7z"


@pytest.mark.skipif(not shutil.which("mke2fs"), reason="no mke2fs")
@pytest.mark.parametrize("kind", ["ext2", "ext4"])
def test_ext(tmp_path, kind):
    src = tmp_path / "src"
    (src / "d").mkdir(parents=True)
    (src / "d" / "f").write_bytes(b"data" * 30000)
    (src / "small").write_bytes(b"tiny")
    (src / "l").symlink_to("d/f")
    subprocess.run(["mke2fs", "-q", "-t", kind, "-d", str(src), str(tmp_path / "img"), "4M"], check=True)
    raw = (tmp_path / "img").read_bytes()
    f = io.BytesIO(raw)
    got = {e.name: e for e in images.ext(f)}
    assert archives.member_bytes(f, got["/d/f"], "ext4") == b"data" * 30000
    assert archives.member_bytes(f, got["/small"], "ext4") == b"tiny"
    assert got["/l"].linkname == "d/f" and got["/d"].mode & 0xF000 == S_IFDIR
    assert formats.detect(raw[:65536]) == "ext4"


@pytest.mark.skipif(not shutil.which("git"), reason="no git")
def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "d").mkdir()
    base = "".join(f"line {i}\n" for i in range(2000))
    (tmp_path / "d" / "f").write_text(base)
    (tmp_path / "l").symlink_to("d/f")
    run("add", ".")
    run("commit", "-qm", "one")
    run("tag", "-a", "v1", "-m", "t")
    (tmp_path / "d" / "f").write_text(base + "more\n")
    run("commit", "-qam", "two")
    loose = {e.name: e.data for e in images.git_tree(str(tmp_path), "main")}
    run("gc", "-q", "--aggressive", "--prune=now")
    packed = {e.name: e for e in images.git_tree(str(tmp_path), "main")}
    assert packed["/d/f"].data == loose["/d/f"] == (base + "more\n").encode() and packed["/l"].linkname == "d/f"
    assert {e.name: e.data for e in images.git_tree(str(tmp_path), "v1")}["/d/f"] == base.encode()
    archives.register(spark)
    rows = spark.read.format("cairn-git").option("ref", "main").load(str(tmp_path))
    assert {(r["path"], r["name"]) for r in rows.collect()} == {("", "d"), ("/d", "f"), ("", "l")}


def squash(tree):
    """A SquashFS image with one directory of small files, all metadata stored or deflated."""
    body, inodes, entries = b"", b"", []
    head = lambda kind, mode, n: struct.pack("<4HII", kind, mode, 0, 0, 50, n)
    for n, (name, data) in enumerate(sorted(tree.items()), 2):
        at = len(inodes)
        if isinstance(data, str):
            inodes += head(3, 0o777, n) + struct.pack("<II", 1, len(data)) + data.encode()
        else:
            raw = zlib.compress(data)
            inodes += head(2, 0o644, n) + struct.pack("<IIII", 96 + len(body), 0xFFFFFFFF, 0, len(data)) + struct.pack("<I", len(raw))
            body += raw
        entries.append((name, at, 3 if isinstance(data, str) else 2, n))
    listing = struct.pack("<III", len(entries) - 1, 0, 2) + b"".join(struct.pack("<HhHH", at, n - 2, kind, len(name) - 1) + name.encode() for name, at, kind, n in entries)
    root = len(inodes)
    inodes += head(1, 0o755, 1) + struct.pack("<IIHHI", 0, 2, len(listing) + 3, 0, 0)
    meta = lambda b: struct.pack("<H", len(zlib.compress(b))) + zlib.compress(b)
    inode_at = 96 + len(body)
    table = meta(inodes)
    dir_at = inode_at + len(table)
    end = dir_at + len(meta(listing))
    head_ = struct.pack("<5I6H8Q", 0x73717368, len(tree) + 1, 0, 131072, 0, 1, 17, 0, 1, 4, 0, root, end, end, 2**64 - 1, inode_at, dir_at, end, 2**64 - 1)
    return head_ + body + table + meta(listing)


def test_squashfs():
    got = {e.name: e for e in images.squashfs(io.BytesIO(squash({"a": b"alpha" * 100, "b": b"beta", "l": "a"})))}
    assert got["/a"].data == b"alpha" * 100 and got["/b"].data == b"beta" and got["/l"].linkname == "a" and got["/a"].mtime == 50


def test_pdf():
    inner = zlib.compress(b"attached")
    raw = b"%PDF-1.4\n1 0 obj << /Type /Filespec /F (a.txt) /EF << /F 2 0 R >> >> endobj\n"
    raw += b"2 0 obj << /Type /EmbeddedFile /Filter /FlateDecode /Length %d >> stream\n" % len(inner) + inner + b"\nendstream endobj\n"
    raw += b"3 0 obj << /Subtype /Image /Filter /DCTDecode /Length 4 >> stream\n\xff\xd8\xff\xd9\nendstream endobj\n%%EOF"
    got = {e.name: e for e in images.pdf(io.BytesIO(raw))}
    assert got["attachments/a.txt"].data == b"attached" and got["images/image-3.jpg"].header == (1 << 40) + 3


def fat12(files):
    boot = bytearray(512)
    boot[:3], boot[510:] = b"\xeb\x3c\x90", b"\x55\xaa"
    struct.pack_into("<HBHBHHBH", boot, 11, 512, 1, 1, 1, 16, 64, 0xF8, 1)
    boot[54:62] = b"FAT12   "
    table, root, data, cluster = bytearray(512), bytearray(512), b"", 2

    def put(c, v):
        i = c * 3 // 2
        x = struct.unpack_from("<H", table, i)[0]
        struct.pack_into("<H", table, i, (x & 0xF | v << 4) if c & 1 else (x & 0xF000 | v))

    for k, (name, body) in enumerate(files.items()):
        n = -(-len(body) // 512)
        stem, _, ext = name.partition(".")
        root[32 * k : 32 * k + 11] = f"{stem:<8}{ext:<3}".encode()
        struct.pack_into("<HHHI", root, 32 * k + 22, 0, (40 << 9) | 33, cluster, len(body))
        for i in range(n):
            put(cluster + i, 0xFFF if i == n - 1 else cluster + i + 1)
        data += body + b"\0" * (-len(body) % 512)
        cluster += n
    return bytes(boot + table + root) + data + b"\0" * 4096


def test_fat():
    raw = fat12({"A.TXT": b"a" * 1300, "B": b"bb"})
    f = io.BytesIO(raw)
    got = {e.name: e for e in formats.fat(f)}
    assert archives.member_bytes(f, got["/A.TXT"], "fat") == b"a" * 1300 and archives.member_bytes(f, got["/B"], "fat") == b"bb"
    assert formats.detect(raw) == "fat"


class _Files(BaseHTTPRequestHandler):
    data = bytes(range(256)) * 50

    def do_HEAD(self):
        self.send_response(200)
        self.send_header("Content-Length", str(len(self.data)))
        self.send_header("Accept-Ranges", "bytes")
        self.end_headers()

    def do_GET(self):
        asked = self.headers.get("Range", "")
        a, b = (int(x) for x in asked.removeprefix("bytes=").split("-"))
        part = self.data[a : b + 1]
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {a}-{a + len(part) - 1}/{len(self.data)}")
        self.end_headers()
        self.wfile.write(part)

    def do_PROPFIND(self):
        self.send_response(207)
        self.end_headers()
        self.wfile.write(b'<m xmlns="DAV:"><getcontentlength>77</getcontentlength></m>')

    def log_message(self, *a):
        pass


def test_http_ranges(spark):
    server = HTTPServer(("127.0.0.1", 0), _Files)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x"
    size, ok = remote.probe(url, {})
    assert (size, ok) == (len(_Files.data), True) and remote.webdav_size(url, {}) == 77
    parts = remote.read_windows(remote.windows(spark.createDataFrame([(url, size)], "url string, size long"), 1000))
    assert parts.count() == 13 and bytes(remote.read_files(parts).first()["content"]) == _Files.data
    assert remote.content_range("bytes 0-9/*") == (0, 9, None) and remote.content_range("x") is None
    assert remote.headers("u", "p", "c=1") == {"Authorization": "Basic dTpw", "Cookie": "c=1"}
    server.shutdown()
