"""Parsers of the simpler container formats.  Each takes a seekable binary file and yields entries."""

from __future__ import annotations

import base64
import calendar
import io
import json
import re
import sqlite3
import struct
import tempfile
import xml.etree.ElementTree as ET
import zipfile
import zlib
from hashlib import sha256

from cairn.functions import html as markup
from cairn.functions.values import S_IFDIR, S_IFLNK, S_IFREG
from cairn.sources.records import Entries, Entry, FormatError, clean, decode, directory, need, symlink


def dos_time(date: int, time: int) -> float:
    """Seconds since the epoch, taken as UTC; 0 if the fields are no date."""
    try:
        return float(calendar.timegm((1980 + (date >> 9), date >> 5 & 15, date & 31, time >> 11, time >> 5 & 63, (time & 31) * 2)))
    except ValueError:
        return 0.0


# ZIP ------------------------------------------------------------------------


def zip_archive(f, *, password: bytes | None = None) -> Entries:
    """Members in the order of the central directory; bytes are read through the decompressor."""
    try:
        z = zipfile.ZipFile(f)
    except zipfile.BadZipFile as e:
        raise FormatError(str(e)) from e
    for info in z.infolist():
        mode = info.external_attr >> 16
        kind = mode & 0xF000
        is_dir = info.filename.endswith("/") or kind == S_IFDIR
        f.seek(info.header_offset + 26)
        name, extra = struct.unpack("<HH", f.read(4))
        e = Entry(info.filename, header=info.header_offset, offset=info.header_offset + 30 + name + extra, size=info.file_size, mode=mode if kind else (S_IFDIR | 0o755 if is_dir else S_IFREG | 0o644), type_flag=info.compress_type)
        y, mo, d, h, mi, s = info.date_time
        e.mtime = dos_time((y - 1980) << 9 | mo << 5 | d, h << 11 | mi << 5 | s // 2)
        if is_dir:
            e.size = 0
        elif kind == S_IFLNK and info.file_size < 4096:
            e.linkname, e.size = decode(z.read(info, password)), 0
        elif info.compress_type != zipfile.ZIP_STORED or info.flag_bits & 1:
            e.offset = None  # not a plain byte range
        yield e


class ZipBody:
    """Member bytes of one archive, its directory read once."""

    def __init__(self, f, password: bytes | None = None):
        self.zip, self.password = zipfile.ZipFile(f), password
        self.by_header = {i.header_offset: i for i in self.zip.infolist()}

    def read(self, header: int) -> bytes:
        return self.zip.read(self.by_header[header], self.password)


# AR -------------------------------------------------------------------------


def ar(f) -> Entries:
    """Unix archive with GNU or BSD long names; symbol tables are skipped."""
    if f.read(8) != b"!<arch>\n":
        raise FormatError("no ar magic")
    long_names = b""
    while True:
        start = f.tell()
        head = f.read(60)
        if len(head) < 60:
            return
        if head[58:60] != b"`\n":
            raise FormatError("bad ar header")
        number = lambda a, b, base=10, head=head: int(head[a:b].strip() or b"0", base)
        size, raw = number(48, 58), head[:16].rstrip()
        body = f.tell()
        after = body + size + (size & 1)
        if raw == b"//":
            long_names = f.read(size)
        elif raw not in (b"/", b"/SYM64/") and not raw.startswith(b"__.SYMDEF"):
            if raw.startswith(b"#1/"):
                n = int(raw[3:])
                name = f.read(n).rstrip(b"\0")
                body, size = body + n, size - n
            elif re.fullmatch(rb"/\d+", raw):
                name = long_names[int(raw[1:]) :].split(b"\n", 1)[0].rstrip(b"/")
            else:
                name = raw.rstrip(b"/")
            if not name.startswith(b"__.SYMDEF"):
                yield Entry(decode(name), header=start, offset=body, size=size, mtime=float(number(16, 28)), uid=number(28, 34), gid=number(34, 40), mode=number(40, 48, 8) or S_IFREG | 0o644)
        f.seek(after)


# CPIO -----------------------------------------------------------------------


def cpio(f) -> Entries:
    """newc, crc, odc and both byte orders of the old binary form, up to the trailer."""
    while True:
        start = f.tell()
        magic = f.read(6)
        if magic in (b"070701", b"070702"):
            h = [int(need(f, 8), 16) for _ in range(13)]
            _, mode, uid, gid, _, mtime, size = h[:7]
            length, align, to = h[11], 4, 110
        elif magic == b"070707":
            d = need(f, 70)
            o = lambda a, b, d=d: int(d[a:b], 8)
            mode, uid, gid, mtime, length, size = o(12, 18), o(18, 24), o(24, 30), o(42, 53), o(53, 59), o(59, 70)
            align, to = 1, 76
        elif magic[:2] in (b"\xc7\x71", b"\x71\xc7"):
            order = "<" if magic[:2] == b"\xc7\x71" else ">"
            f.seek(start)
            w = struct.unpack(order + "13H", need(f, 26))
            mode, uid, gid, mtime, length, size = w[3], w[4], w[5], w[8] << 16 | w[9], w[10], w[11] << 16 | w[12]
            align, to = 2, 26
        else:
            if start == 0 or len(magic) == 6:
                raise FormatError("no cpio header")
            return
        name = need(f, length).rstrip(b"\0")
        body = start + -(-(to + length) // align) * align
        if name == b"TRAILER!!!":
            return
        e = Entry(decode(name), header=start, offset=body, size=size, mtime=float(mtime), mode=mode, uid=uid, gid=gid)
        if mode & 0xF000 == S_IFLNK and size < 4096:
            f.seek(body)
            e.linkname, e.size = decode(need(f, size)), 0
        elif mode & 0xF000 == S_IFDIR:
            e.size = 0
        yield e
        f.seek(body + -(-size // align) * align)


# ISO 9660 -------------------------------------------------------------------


def iso9660(f) -> Entries:
    """Directory records from the primary descriptor; versions and trailing dots of names go."""
    f.seek(16 * 2048)
    sector = f.read(2048)
    if sector[1:6] != b"CD001":
        raise FormatError("no iso9660 descriptor")
    while sector[0] != 1:
        if sector[0] == 255 or len(sector) < 2048:
            raise FormatError("no primary descriptor")
        sector = f.read(2048)
    size = struct.unpack_from("<H", sector, 128)[0]

    def record(raw: bytes):
        extent, length = struct.unpack_from("<I", raw, 2)[0], struct.unpack_from("<I", raw, 10)[0]
        y, mo, d, h, mi, s, zone = struct.unpack_from("<6Bb", raw, 18)
        try:
            when = calendar.timegm((1900 + y, mo, d, h, mi, s)) - zone * 900
        except ValueError:
            when = 0
        return extent, length, float(when), raw[25], raw[33 : 33 + raw[32]]

    seen, todo = set(), [("", *record(sector[156:190])[:2])]
    while todo:
        path, extent, length = todo.pop(0)
        if extent in seen:
            continue
        seen.add(extent)
        f.seek(extent * size)
        data, at = f.read(length), 0
        while at < len(data):
            n = data[at]
            if n < 34:  # records do not cross sectors
                at = (at // size + 1) * size
                continue
            where, big, when, flags, name = record(data[at : at + n])
            if name not in (b"\0", b"\1"):
                text = decode(name, "latin-1").split(";")[0].rstrip(".")
                full = f"{path}/{text}"
                if flags & 2:
                    yield directory(full, header=extent * size + at, mtime=when)
                    todo.append((full, where, big))
                else:
                    yield Entry(full, header=extent * size + at, offset=where * size, size=big, mtime=when)
            at += n


# WARC -----------------------------------------------------------------------


def uri_path(uri: str) -> str:
    """``host/path?query`` of a URI, without fragment; a directory gets ``index.html``."""
    rest = uri.split("#", 1)[0].split("://", 1)[-1]
    m = re.match(r"([^/?]*)([^?]*)(\?.*)?$", rest, re.S)
    path = m[2] or "/"
    return m[1] + (path + "index.html" if path.endswith("/") else path) + (m[3] or "")


def warc(f) -> Entries:
    """Records: those with a target under its host and path, the others under ``_warc/<type>/``."""
    seen: dict[str, int] = {}
    while True:
        start = f.tell()
        line = f.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise FormatError("no warc record")
        head = {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.partition(b":")
            head[key.strip().lower().decode("latin-1")] = decode(value.strip())
        size, body = int(head.get("content-length", 0)), f.tell()
        kind, uri = head.get("warc-type", "unknown"), head.get("warc-target-uri", "").strip("<>")
        if uri and kind in ("response", "resource", "conversion"):
            name = uri_path(uri)
        else:
            name = f"_warc/{kind}/" + re.sub(r"[^A-Za-z0-9._-]", "_", head.get("warc-record-id", "").strip("<>").removeprefix("urn:uuid:") or str(start))
        n = seen.get(name, 0)
        seen[name] = n + 1
        when = re.match(r"(\d+)-(\d+)-(\d+)T(\d+):(\d+):(\d+)", head.get("warc-date", ""))
        yield Entry(f"{name}-{n}" if n else name, header=start, offset=body, size=size, mtime=float(calendar.timegm(tuple(map(int, when.groups())))) if when else 0.0)
        f.seek(body + size)


# XAR ------------------------------------------------------------------------


def xar(f) -> Entries:
    """Entries of the compressed table of contents; bytes are in the heap behind it."""
    magic, size, _, packed, _ = struct.unpack(">4sHHQQ", need(f, 24))
    if magic != b"xar!":
        raise FormatError("no xar magic")
    f.seek(size)
    root = ET.fromstring(zlib.decompress(need(f, packed)))
    heap = size + packed

    def walk(node, path: str) -> Entries:
        for x in node.findall("file"):
            get = lambda k, d="", x=x: (x.findtext(k) or d).strip()
            full, kind = f"{path}/{get('name')}", get("type", "file")
            mode = int(get("mode", "0"), 8)
            when = re.match(r"(\d+)-(\d+)-(\d+)T(\d+):(\d+):(\d+)", get("mtime"))
            e = Entry(full, header=int(x.get("id", 0)), mtime=float(calendar.timegm(tuple(map(int, when.groups())))) if when else 0.0, uid=int(get("uid", "0")), gid=int(get("gid", "0")), mode=S_IFREG | (mode or 0o644))
            if kind == "directory":
                e.mode = S_IFDIR | (mode or 0o755)
            elif kind == "symlink":
                e.mode, e.linkname = S_IFLNK | 0o777, get("link")
            elif x.find("data") is not None:
                e.size, at, n = int(get("data/size", "0")), heap + int(get("data/offset", "0")), int(get("data/length", "0"))
                style = x.find("data/encoding")
                if style is None or style.get("style") == "application/octet-stream":
                    e.offset = at
                else:
                    f.seek(at)
                    raw = f.read(n)
                    e.data = zlib.decompress(raw) if "gzip" in style.get("style") else __import__("bz2").decompress(raw) if "bzip2" in style.get("style") else __import__("lzma").decompress(raw)
            for a in x.findall("ea"):
                f.seek(heap + int(a.findtext("offset") or 0))
                e.xattrs[(a.findtext("name") or "").strip()] = f.read(int(a.findtext("length") or 0))
            yield e
            yield from walk(x, full)

    yield from walk(root.find("toc"), "")


# CAB ------------------------------------------------------------------------


def cab(f) -> Entries:
    """Files of stored and MSZIP folders; other compressions give rows without bytes."""
    head = need(f, 36)
    if head[:4] != b"MSCF":
        raise FormatError("no cab magic")
    files_at, folders, files, flags = *struct.unpack_from("<I", head, 16), *struct.unpack_from("<HHH", head, 26)
    header_extra = folder_extra = block_extra = 0
    if flags & 4:
        header_extra, folder_extra, block_extra = struct.unpack("<HBB", need(f, 4))
        f.seek(header_extra, 1)
    for bit in (1, 2):
        if flags & bit:
            for _ in range(2):
                while need(f, 1) != b"\0":
                    pass
    table = []
    for _ in range(folders):
        table.append(struct.unpack("<IHH", need(f, 8)))
        f.seek(folder_extra, 1)
    unpacked: dict[int, bytes | None] = {}

    def folder(i: int) -> bytes | None:
        if i not in unpacked:
            at, blocks, kind = table[i]
            f.seek(at)
            out, last = [], b""
            for _ in range(blocks if kind & 15 < 2 else 0):
                _, n, _ = struct.unpack("<IHH", need(f, 8))
                f.seek(block_extra, 1)
                raw = need(f, n)
                if kind & 15 == 1:
                    if raw[:2] != b"CK":
                        raise FormatError("bad MSZIP block")
                    raw = last = zlib.decompressobj(-15, zdict=last).decompress(raw[2:])
                out.append(raw)
            unpacked[i] = b"".join(out) if kind & 15 < 2 else None
        return unpacked[i]

    f.seek(files_at)
    rows = []
    for _ in range(files):
        start = f.tell()
        size, offset, index, date, time, attributes = struct.unpack("<IIHHHH", need(f, 16))
        name = bytearray()
        while (c := need(f, 1)) != b"\0":
            name += c
        rows.append((start, size, offset, index, date, time, decode(bytes(name), "utf-8" if attributes & 0x80 else "cp1252").replace("\\", "/")))
    for start, size, offset, index, date, time, name in rows:
        data = folder(index) if index < folders else None
        yield Entry(name, header=start, size=size, mtime=dos_time(date, time), type_flag=table[index][2] & 15 if index < folders else 0, data=None if data is None else data[offset : offset + size])


# ASAR -----------------------------------------------------------------------


def asar(f) -> Entries:
    """Tree of a JSON header; offsets count from its end."""
    four, outer, _, length = struct.unpack("<4I", need(f, 16))
    if four != 4:
        raise FormatError("no asar header")
    try:
        tree = json.loads(need(f, length))
    except ValueError as e:
        raise FormatError("bad asar header") from e
    base = 8 + outer

    def walk(node: dict, path: str) -> Entries:
        for name, x in node.get("files", {}).items():
            full = f"{path}/{name}"
            if "files" in x:
                yield directory(full)
                yield from walk(x, full)
            elif "link" in x:
                yield symlink(full, x["link"])
            else:
                yield Entry(full, offset=None if x.get("unpacked") else base + int(x.get("offset", 0)), size=int(x.get("size", 0)), mode=S_IFREG | (0o755 if x.get("executable") else 0o644))

    yield from walk(tree, "")


# SQLAR and index files ------------------------------------------------------


def _database(f) -> sqlite3.Connection:
    """The file as a database, through a temporary copy on the worker that is gone with the connection."""
    f.seek(0)
    raw = f.read()
    if raw[:16] != b"SQLite format 3\0":
        raise FormatError("no sqlite database")
    db = sqlite3.connect(":memory:")
    db.deserialize(raw)
    return db


def sqlar(f) -> Entries:
    """Rows of table ``sqlar``: stored if the length fits, else deflated; size -1 is a link."""
    db = _database(f)
    try:
        rows = db.execute("SELECT rowid, name, mode, mtime, sz, data FROM sqlar ORDER BY rowid").fetchall()
    except sqlite3.Error as e:
        raise FormatError("no sqlar table") from e
    seen = set()
    for key, name, mode, mtime, size, data in rows:
        where = clean(name)
        if where in seen:
            continue  # of names that normalize alike the first stays
        seen.add(where)
        if size == -1:
            yield symlink(name, decode(data or b""), header=key, mtime=float(mtime or 0))
        elif data is None:
            yield directory(name, header=key, mtime=float(mtime or 0))
        else:
            if len(data) > size:
                raise FormatError("longer than its size")
            yield Entry(name, header=key, size=size, mtime=float(mtime or 0), mode=mode if mode & 0xF000 else S_IFREG | mode, data=data if len(data) == size else zlib.decompress(data))


def index_file(f) -> Entries:
    """Rows of an index database's ``files`` table in key order."""
    db = _database(f)
    try:
        rows = db.execute("SELECT path, name, offsetheader, offset, size, mtime, mode, type, linkname, uid, gid, issparse, isgenerated FROM files ORDER BY path, name, offsetheader").fetchall()
    except sqlite3.Error as e:
        raise FormatError("no files table") from e
    for path, name, header, offset, size, mtime, mode, kind, link, uid, gid, sparse, generated in rows:
        yield Entry(f"{path}/{name}", header=-1 if header is None else header, offset=offset, size=max(size or 0, 0), mtime=float(mtime or 0), mode=mode or 0, type_flag=int(kind or 0), linkname=link or "", uid=uid or 0, gid=gid or 0, sparse=bool(sparse), generated=bool(generated))


# OGG ------------------------------------------------------------------------


def ogg_pages(f):
    """(serial, offset, size, first body bytes) of each page."""
    while head := f.read(27):
        if head[:4] != b"OggS" or len(head) < 27:
            raise FormatError("no ogg page")
        at = f.tell() - 27
        lacing = need(f, head[26])
        body = f.tell()
        n = sum(lacing)
        start = f.read(min(n, 16))
        yield struct.unpack_from("<I", head, 14)[0], at, body + n - at, start
        f.seek(body + n)


def media_kind(start: bytes) -> str:
    marks = [(b"\x01vorbis", "vorbis"), (b"OpusHead", "opus"), (b"\x80theora", "theora"), (b"\x7fFLAC", "flac"), (b"Speex", "speex"), (b"fishead\0", "skeleton")]
    return next((k for m, k in marks if start.startswith(m)), "stream")


def ogg(f) -> Entries:
    """One entry per logical stream: its pages as segments, in order of first appearance."""
    streams: dict[int, Entry] = {}
    for serial, at, size, start in ogg_pages(f):
        e = streams.setdefault(serial, Entry(f"{media_kind(start)}-{serial:08x}.ogg", header=at, sparse=True))
        e.size += size
        e.segments.append(("data", at, size))
    yield from streams.values()


# HTML -----------------------------------------------------------------------


def html(f) -> Entries:
    """Data URIs, named by digest and media type; the same name again is numbered."""
    from urllib.parse import unquote_to_bytes

    text = decode(f.read())
    if not re.search(r"(?i)<(!doctype html|html|head|body)", text[:4096]):
        raise FormatError("no html")
    seen: dict[str, int] = {}
    for start, uri in markup.find_data_uris(text):
        meta, comma, packed = markup.unescape_text(uri).strip()[5:].partition(",")
        if not comma or not packed:
            continue
        body = unquote_to_bytes(packed)
        kind, *more = (x.strip() for x in meta.split(";"))
        if "base64" in [x.lower() for x in (kind, *more)]:
            try:
                body = base64.b64decode(re.sub(rb"\s", b"", body))
            except ValueError:
                continue
        if not body:
            continue
        extension = markup.extension_of(kind if "/" in kind else "text/plain")
        stem, end = sha256(body).hexdigest(), f".{extension}" if extension else ""
        n = seen.get(stem + end, 0)
        seen[stem + end] = n + 1
        yield Entry(f"{stem}-{n}{end}" if n else stem + end, header=start, size=len(body), data=body)


# FAT ------------------------------------------------------------------------


def fat(f) -> Entries:
    """FAT12, FAT16 and FAT32 with long names; a file's clusters are its segments."""
    boot = need(f, 512)
    if boot[510:512] != b"\x55\xaa" or boot[0] not in (0xEB, 0xE9):
        raise FormatError("no fat boot sector")
    sector, per, reserved, tables, roots, small = struct.unpack_from("<HBHBHH", boot, 11)
    table_size = struct.unpack_from("<H", boot, 22)[0] or struct.unpack_from("<I", boot, 36)[0]
    total = small or struct.unpack_from("<I", boot, 32)[0]
    if sector not in (512, 1024, 2048, 4096) or not per or not tables:
        raise FormatError("no fat boot sector")
    root_at = (reserved + tables * table_size) * sector
    data_at = root_at + -(-roots * 32 // sector) * sector
    count = (total * sector - data_at) // (per * sector)
    bits = 12 if count < 4085 else 16 if count < 65525 else 32
    f.seek(reserved * sector)
    table = need(f, table_size * sector)

    def after(c: int) -> int:
        if bits == 12:
            x = struct.unpack_from("<H", table, c * 3 // 2)[0]
            return x >> 4 if c & 1 else x & 0xFFF
        return struct.unpack_from("<H", table, 2 * c)[0] if bits == 16 else struct.unpack_from("<I", table, 4 * c)[0] & 0x0FFFFFFF

    def chain(c: int) -> list[int]:
        out, end = [], {12: 0xFF8, 16: 0xFFF8, 32: 0x0FFFFFF8}[bits]
        while 2 <= c < end and len(out) <= count:
            out.append(c)
            c = after(c)
        return out

    place = lambda c: data_at + (c - 2) * per * sector

    def read(c: int) -> bytes:
        out = []
        for x in chain(c):
            f.seek(place(x))
            out.append(f.read(per * sector))
        return b"".join(out)

    def walk(raw: bytes, path: str, seen: frozenset) -> Entries:
        long: dict[int, str] = {}
        for at in range(0, len(raw) - 31, 32):
            d = raw[at : at + 32]
            if d[0] == 0:
                return
            if d[0] == 0xE5:
                long = {}
                continue
            if d[11] == 0x0F:
                long[d[0] & 31] = (d[1:11] + d[14:26] + d[28:32]).decode("utf-16-le", "replace").split("\0")[0]
                continue
            stem, ext = decode(d[:8].replace(b"\x05", b"\xe5", 1) if d[0] == 5 else d[:8], "cp437").rstrip(), decode(d[8:11], "cp437").rstrip()
            name = "".join(long[k] for k in sorted(long)) or (f"{stem}.{ext}" if ext else stem)
            long = {}
            if d[11] & 8 or stem in (".", ".."):
                continue
            first = struct.unpack_from("<H", d, 26)[0] | (struct.unpack_from("<H", d, 20)[0] << 16 if bits == 32 else 0)
            size, when = struct.unpack_from("<I", d, 28)[0], dos_time(*struct.unpack_from("<HH", d, 22)[::-1])
            full = f"{path}/{name}"
            if d[11] & 16:
                yield directory(full, header=first, mtime=when)
                if first and first not in seen:
                    yield from walk(read(first), full, seen | {first})
            else:
                parts, left = [], size
                for c in chain(first):
                    if left > 0:
                        parts.append(("data", place(c), min(left, per * sector)))
                        left -= per * sector
                yield Entry(full, header=first, size=size, mtime=when, sparse=True, segments=parts)

    if bits == 32:
        yield from walk(read(struct.unpack_from("<I", boot, 44)[0]), "", frozenset())
    else:
        f.seek(root_at)
        yield from walk(f.read(roots * 32), "", frozenset())


# detection ------------------------------------------------------------------


def magic(head: bytes, at: int, mark: bytes) -> bool:
    return head[at : at + len(mark)] == mark


def detect(head: bytes) -> str | None:
    """Format by the first 64 KiB, in a fixed order."""
    from cairn.sources import tar

    tests = [
        ("7z", magic(head, 0, b"7z\xbc\xaf\x27\x1c")),
        ("zip", head[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")),
        ("asar", head[:4] == b"\4\0\0\0" and head[16:18] == b'{"'),
        ("ar", magic(head, 0, b"!<arch>\n")),
        ("cpio", head[:6] in (b"070701", b"070702", b"070707") or head[:2] in (b"\xc7\x71", b"\x71\xc7")),
        ("iso", magic(head, 32769, b"CD001")),
        ("warc", magic(head, 0, b"WARC/")),
        ("xar", magic(head, 0, b"xar!")),
        ("cab", magic(head, 0, b"MSCF")),
        ("sqlar", magic(head, 0, b"SQLite format 3\0")),
        ("squashfs", head[:4] in (b"hsqs", b"sqsh")),
        ("ext4", magic(head, 1080, b"\x53\xef")),
        ("fat", magic(head, 510, b"\x55\xaa") and (magic(head, 54, b"FAT") or magic(head, 82, b"FAT32"))),
        ("ogg", magic(head, 0, b"OggS")),
        ("pdf", magic(head, 0, b"%PDF-")),
        ("html", bool(re.match(rb"(?i)\s*<(!doctype html|html)", head[:512]))),
        ("tar", tar.looks_like(head)),
    ]
    return next((name for name, hit in tests if hit), None)


def as_file(raw: bytes) -> io.BytesIO:
    return io.BytesIO(raw)


def spool(chunks) -> tempfile.SpooledTemporaryFile:
    """A decoded stream as a seekable file: in memory up to 256 MiB, then in the worker's own temporary file."""
    f = tempfile.SpooledTemporaryFile(max_size=256 << 20)
    for c in chunks:
        f.write(c)
    f.seek(0)
    return f
