"""Archives and compressed files made of (name, bytes) pairs, for fixture catalogs and tests."""

from __future__ import annotations

import base64
import bz2
import gzip
import io
import json
import lzma
import sqlite3
import struct
import tarfile
import zipfile
import zlib

Pairs = list[tuple[str, bytes]]


def tar(files: Pairs, fmt: int = tarfile.PAX_FORMAT, headers=None, kinds=None, owner=None, encoding: str = "utf-8") -> bytes:
    """A TAR; ``headers(name, data)`` gives PAX records, ``kinds(name)`` a type flag, ``owner(name)`` user and group."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=fmt, encoding=encoding) as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(data), 1000
            if headers:
                info.pax_headers = headers(name, data)
            if owner:
                info.uid, info.gid = owner(name)
            if kinds and kinds(name):
                info.type = kinds(name)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def sparse_tar(files: Pairs) -> bytes:
    """Each file with a hole of 3 bytes before and one of 5 behind."""
    return tar(files, headers=lambda name, data: {"GNU.sparse.map": f"3,{len(data)}", "GNU.sparse.size": str(len(data) + 8), "GNU.sparse.name": name})


def dump_tar(first: list[str], second: list[str]) -> bytes:
    """Two incremental dumps of the directory ``d`` that list these names."""
    listing = lambda names: b"".join(b"Y" + n.encode() + b"\0" for n in names) + b"\0"
    return tar([("d/", listing(first)), ("d/", listing(second))], tarfile.GNU_FORMAT, kinds=lambda name: b"D")


def zip_(files: Pairs, method: int = zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files:
            z.writestr(zipfile.ZipInfo(name), data, method)
    return out.getvalue()


def locked_zip(files: Pairs, password: bytes) -> bytes:
    """Stored members under the old ZIP cipher."""

    def mix(keys: list[int], byte: int) -> None:
        crc = lambda c, b: table[(c ^ b) & 255] ^ c >> 8
        keys[0] = crc(keys[0], byte)
        keys[1] = ((keys[1] + (keys[0] & 255)) * 134775813 + 1) & 0xFFFFFFFF
        keys[2] = crc(keys[2], keys[1] >> 24)

    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)

    def lock(data: bytes) -> bytes:
        keys, out = [0x12345678, 0x23456789, 0x34567890], bytearray()
        for b in password:
            mix(keys, b)
        for b in bytes(11) + bytes([zlib.crc32(data) >> 24]) + data:
            k = keys[2] & 0xFFFF | 2
            out.append(b ^ (k * (k ^ 1) >> 8 & 255))
            mix(keys, b)
        return bytes(out)

    out, rows = b"", b""
    for name, data in files:
        raw, n = lock(data), name.encode()
        head = struct.pack("<HHHHHIIIHH", 20, 1, 0, 0, 33, zlib.crc32(data), len(raw), len(data), len(n), 0)
        rows += b"PK\1\2" + struct.pack("<H", 20) + head + struct.pack("<HHHII", 0, 0, 0, 0o100644 << 16, len(out)) + n
        out += b"PK\3\4" + head + n + raw
    return out + rows + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(files), len(files), len(rows), len(out), 0)


def ar(files: Pairs) -> bytes:
    """GNU: long names in a member of their own."""
    table, out = b"", b""
    for name, data in files:
        at = len(table)
        table += name.encode() + b"/\n"
        out += f"{f'/{at}':<16}{'5':<12}{'1':<6}{'2':<6}{'100644':<8}{len(data):<10}`\n".encode() + data + b"\n" * (len(data) & 1)
    return b"!<arch>\n" + f"{'//':<48}{len(table):<10}`\n".encode() + table + b"\n" * (len(table) & 1) + out


def cpio(files: Pairs) -> bytes:
    pad = lambda b: b + b"\0" * (-len(b) % 4)

    def member(name: str, data: bytes, mode: int) -> bytes:
        n = name.encode() + b"\0"
        return pad(b"070701" + b"".join(f"{x:08x}".encode() for x in (1, mode, 3, 4, 1, 99, len(data), 0, 0, 0, 0, len(n), 0)) + n) + pad(data)

    return b"".join(member(n, d, 0o100644) for n, d in files) + member("TRAILER!!!", b"", 0)


def iso(files: Pairs) -> bytes:
    """ISO 9660 with all files in the root."""

    def record(name: bytes, extent: int, size: int, flags: int) -> bytes:
        n = 33 + len(name) + (1 - len(name) % 2)
        return bytes([n, 0]) + struct.pack("<I", extent) + struct.pack(">I", extent) + struct.pack("<I", size) + struct.pack(">I", size) + bytes([120, 1, 2, 3, 4, 5, 0, flags, 0, 0, 1, 0, 0, 1, len(name)]) + name + b"\0" * (1 - len(name) % 2)

    sectors = 1 + len(files) // 30
    root = record(b"\0", 18, sectors * 2048, 2)
    body, listing, now = b"", b"", root + record(b"\1", 18, sectors * 2048, 2)
    for name, data in files:
        one = record(name.encode() + b";1", 18 + sectors + len(body) // 2048, len(data), 0)
        if len(now) + len(one) > 2048:  # records do not cross a sector
            listing, now = listing + now.ljust(2048, b"\0"), b""
        now += one
        body += data + b"\0" * (-len(data) % 2048)
    head = bytearray(18 * 2048)
    head[16 * 2048 : 16 * 2048 + 6], head[17 * 2048 : 17 * 2048 + 6] = b"\1CD001", b"\xffCD001"
    head[16 * 2048 + 128 : 16 * 2048 + 130] = struct.pack("<H", 2048)
    head[16 * 2048 + 156 : 16 * 2048 + 156 + len(root)] = root
    return bytes(head) + (listing + now).ljust(sectors * 2048, b"\0") + body


def warc(files: Pairs) -> bytes:
    """Response records of ``http://h/<name>``."""
    return b"".join(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://h/{n}\r\nWARC-Record-ID: <urn:uuid:{n}>\r\nWARC-Date: 2020-01-02T03:04:05Z\r\nContent-Length: {len(d)}\r\n\r\n".encode() + d + b"\r\n\r\n" for n, d in files)


def xar(files: Pairs) -> bytes:
    rows, heap = [], b""
    for i, (name, data) in enumerate(files):
        rows.append(f'<file id="{i + 1}"><name>{name}</name><type>file</type><data><length>{len(data)}</length><offset>{len(heap)}</offset><size>{len(data)}</size><encoding style="application/octet-stream"/></data></file>')
        heap += data
    toc = zlib.compress(f"<xar><toc>{''.join(rows)}</toc></xar>".encode())
    return struct.pack(">4sHHQQI", b"xar!", 28, 1, len(toc), 0, 0) + toc + heap


def cab(files: Pairs) -> bytes:
    """One stored folder."""
    data = b"".join(d for _, d in files)
    blocks = [data[i : i + 32768] for i in range(0, len(data), 32768)]
    folder = b"".join(struct.pack("<IHH", 0, len(b), len(b)) + b for b in blocks)
    rows, at = b"", 0
    for name, body in files:
        rows += struct.pack("<IIHHHH", len(body), at, 0, (40 << 9) | (1 << 5) | 2, 0, 0x20) + name.encode() + b"\0"
        at += len(body)
    start = 44 + len(rows)
    return b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, start + len(folder), 0, 44, 0, 3, 1, 1, len(files), 0, 0, 0) + struct.pack("<IHH", start, len(blocks), 0) + rows + folder


def asar(files: Pairs) -> bytes:
    tree, body = {}, b""
    for name, data in files:
        tree[name] = {"size": len(data), "offset": str(len(body))}
        body += data
    head = json.dumps({"files": tree}).encode()
    size = len(head) + -len(head) % 4
    return struct.pack("<4I", 4, size + 8, size + 4, len(head)) + head + b"\0" * (size - len(head)) + body


def sqlar(files: Pairs) -> bytes:
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE sqlar(name TEXT PRIMARY KEY, mode INT, mtime INT, sz INT, data BLOB)")
    db.executemany("INSERT INTO sqlar VALUES (?,?,?,?,?)", [(n, 0o100644, 2, len(d), min(d, zlib.compress(d), key=len)) for n, d in files])
    db.commit()
    return db.serialize()


def index_file(files: Pairs) -> bytes:
    """An index database of these files as one TAR's members."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE files(path, name, offsetheader, offset, size, mtime, mode, type, linkname, uid, gid, istar, issparse, isgenerated, recursiondepth)")
    at = 0
    for name, data in files:
        db.execute("INSERT INTO files VALUES ('/d', ?, ?, ?, ?, 7, 33188, 48, '', 1, 2, 0, 0, 0, 0)", (name, at, at + 512, len(data)))
        at += 512 + -(-len(data) // 512) * 512
    db.commit()
    return db.serialize()


def squashfs(files: Pairs) -> bytes:
    """One directory, deflated blocks of 128 KiB, metadata in blocks of 8 KiB."""
    size, body, inodes, entries = 131072, b"", b"", []
    head = lambda kind, mode, n: struct.pack("<4HII", kind, mode, 0, 0, 50, n)
    for n, (name, data) in enumerate(sorted(files), 2):
        blocks = [zlib.compress(data[i : i + size]) for i in range(0, len(data), size)]
        entries.append((name, len(inodes), n))
        inodes += head(2, 0o644, n) + struct.pack("<IIII", 96 + len(body), 0xFFFFFFFF, 0, len(data)) + b"".join(struct.pack("<I", len(b)) for b in blocks)
        body += b"".join(blocks)
    if len(inodes) > 8000:
        raise ValueError("more inodes than one metadata block holds")
    listing = struct.pack("<III", len(entries) - 1, 0, 2) + b"".join(struct.pack("<HhHH", at, n - 2, 2, len(name) - 1) + name.encode() for name, at, n in entries)
    root = len(inodes)
    inodes += head(1, 0o755, 1) + struct.pack("<IIHHI", 0, 2, len(listing) + 3, 0, 0)
    meta = lambda b: struct.pack("<H", len(zlib.compress(b))) + zlib.compress(b)
    at = 96 + len(body)
    table = meta(inodes)
    end = at + len(table) + len(meta(listing))
    return struct.pack("<5I6H8Q", 0x73717368, len(files) + 1, 0, size, 0, 1, 17, 0, 1, 4, 0, root, end, end, 2**64 - 1, at, at + len(table), end, 2**64 - 1) + body + table + meta(listing)


def fat(files: Pairs) -> bytes:
    """FAT16 with one-sector clusters and 8.3 names."""
    clusters = sum(-(-len(d) // 512) for _, d in files) + 4200  # enough not to be FAT12
    sectors, roots = -(-(clusters + 2) * 2 // 512), 512
    boot = bytearray(512)
    boot[:3], boot[510:] = b"\xeb\x3c\x90", b"\x55\xaa"
    total = 1 + sectors + roots * 32 // 512 + clusters
    struct.pack_into("<HBHBHHBH", boot, 11, 512, 1, 1, 1, roots, total if total < 65536 else 0, 0xF8, sectors)
    struct.pack_into("<I", boot, 32, total if total >= 65536 else 0)
    boot[54:62] = b"FAT16   "
    table, root, data, cluster = bytearray(sectors * 512), bytearray(roots * 32), [], 2
    for k, (name, body) in enumerate(files):
        n = -(-len(body) // 512)
        stem, _, ext = name.partition(".")
        root[32 * k : 32 * k + 11] = f"{stem:<8}{ext:<3}".encode()
        struct.pack_into("<HHHI", root, 32 * k + 22, 0, (40 << 9) | 33, cluster if n else 0, len(body))
        for i in range(n):
            struct.pack_into("<H", table, 2 * (cluster + i), 0xFFFF if i == n - 1 else cluster + i + 1)
        data.append(body + b"\0" * (-len(body) % 512))
        cluster += n
    raw = bytes(boot + table + root) + b"".join(data)
    return raw + bytes(total * 512 - len(raw))


def ogg(files: Pairs) -> bytes:
    """A stream for each file, its number as serial, pages of at most 200 bytes."""
    out = []
    for name, data in files:
        for i in range(0, max(len(data), 1), 200):
            part = data[i : i + 200]
            out.append(b"OggS" + bytes(10) + struct.pack("<I", int(name)) + bytes(8) + bytes([1, len(part)]) + part)
    return b"".join(out)


def html(files: Pairs) -> bytes:
    """Data URIs in the three forms, in turn."""
    forms = ['<img src="%s">', "<img src='%s'>", '<p style="background:url( %s )">']
    return ("<!doctype html><html>" + "".join(forms[i % 3] % ("data:text/plain;charset=utf-8;base64," + base64.b64encode(d).decode()) for i, (_, d) in enumerate(files)) + "</html>").encode()


def pdf(files: Pairs) -> bytes:
    """Attachments, deflated."""
    out = [b"%PDF-1.4\n"]
    for i, (name, data) in enumerate(files):
        raw = zlib.compress(data)
        out.append(b"%d 0 obj << /Type /Filespec /F (%s) /EF << /F %d 0 R >> >> endobj\n" % (2 * i + 1, name.encode(), 2 * i + 2))
        out.append(b"%d 0 obj << /Type /EmbeddedFile /Filter /FlateDecode /Length %d >> stream\n" % (2 * i + 2, len(raw)) + raw + b"\nendstream endobj\n")
    return b"".join(out) + b"%%EOF"


def seven_number(n: int) -> bytes:
    """A number of 7z: as many leading ones as bytes follow."""
    for more in range(8):
        if n < 1 << (7 * (more + 1)):
            high = n >> (8 * more)
            return bytes([(0xFF00 >> more) & 0xFF | high]) + (n & ((1 << (8 * more)) - 1)).to_bytes(more, "little")
    return b"\xff" + n.to_bytes(8, "little")


def seven_zip(files: Pairs) -> bytes:
    """One LZMA folder of files that are not empty."""
    number, data = seven_number, b"".join(b for _, b in files)
    raw = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16}])
    packs = b"\x06" + number(0) + number(1) + b"\x09" + number(len(raw)) + b"\0"
    folders = b"\x07\x0b" + number(1) + b"\0" + number(1) + b"\x23\3\1\1" + number(5) + b"\x5d" + struct.pack("<I", 1 << 16) + b"\x0c" + number(len(data)) + b"\0"
    sub = b"\x08\x0d" + number(len(files)) + b"\x09" + b"".join(number(len(b)) for _, b in files[:-1]) + b"\0"
    names = b"\0" + "".join(n + "\0" for n, _ in files).encode("utf-16-le")
    head = b"\1\4" + packs + folders + sub + b"\0" + b"\5" + number(len(files)) + bytes([17]) + number(len(names)) + names + b"\0\0"
    start = struct.pack("<QQI", len(raw), len(head), zlib.crc32(head))
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(start)) + start + raw + head


# one compressed file ----------------------------------------------------------


def lzip(data: bytes) -> bytes:
    body = lzma.compress(data, lzma.FORMAT_ALONE, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16, "lc": 3, "lp": 0, "pb": 2}])[13:]
    return b"LZIP\1\x10" + body + struct.pack("<IQQ", zlib.crc32(data), len(data), 6 + len(body) + 20)


def lz4(data: bytes, size: int = 60000) -> bytes:
    """A frame of blocks in turn stored and of literals only."""
    out = [b"\x04\x22\x4d\x18\x60\x40\0"]
    for k, i in enumerate(range(0, len(data), size)):
        part = data[i : i + size]
        if k % 2:
            out.append(struct.pack("<I", len(part) | 1 << 31) + part)
        else:
            more = len(part) - 15
            raw = (bytes([0xF0]) + b"\xff" * (more // 255) + bytes([more % 255]) if more >= 0 else bytes([len(part) << 4])) + part
            out.append(struct.pack("<I", len(raw)) + raw)
    return b"".join(out) + bytes(4)


def compress_z(data: bytes) -> bytes:
    """A ``.Z`` file of single bytes: nine bits a code, the table cleared before it needs ten."""
    bits = at = 0
    for i in range(0, len(data), 248):
        for b in data[i : i + 248]:
            bits |= b << at
            at += 9
        if i + 248 < len(data):
            bits |= 256 << at
            at += 9 + 9 * (-249 % 8)  # codes come in groups of eight
    return b"\x1f\x9d\x90" + bits.to_bytes(-(-at // 8), "little")


def zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


CODECS = {"gzip": ("gz", gzip.compress), "bzip2": ("bz2", bz2.compress), "xz": ("xz", lzma.compress), "zstd": ("zst", zstd), "lz4": ("lz4", lz4), "lzip": ("lz", lzip), "compress": ("Z", compress_z), "lzma": ("lzma", lambda d: lzma.compress(d, lzma.FORMAT_ALONE)), "zlib": ("zlib", zlib.compress)}


def in_blocks(pack, data: bytes, size: int = 1000) -> bytes:
    """Streams of ``size`` bytes each, one after the other."""
    return b"".join(pack(data[i : i + size]) for i in range(0, len(data), size))


def seekable_zstd(data: bytes, size: int = 1000) -> bytes:
    """Frames of ``size`` bytes and a seek table."""
    frames = [zstd(data[i : i + size]) for i in range(0, len(data), size)]
    rows = b"".join(struct.pack("<II", len(f), min(size, len(data) - i * size)) for i, f in enumerate(frames))
    table = rows + struct.pack("<IBI", len(frames), 0, 0x8F92EAB1)
    return b"".join(frames) + struct.pack("<II", 0x184D2A5E, len(table)) + table
