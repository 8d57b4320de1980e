"""TAR: ustar, GNU long names and sparse files, PAX records, incremental dumps, nested archives."""

from __future__ import annotations

import base64
import io
import re
from urllib.parse import unquote

from cairn.functions.values import S_IFDIR, S_IFLNK, S_IFREG
from cairn.sources.records import Entries, Entry, FormatError, clean, decode, octal

BLOCK = 512
#: Members up to this size are looked into without recursion being asked for.
NESTED_LIMIT = 64 << 20


def looks_like(head: bytes) -> bool:
    return head[257:262] == b"ustar" or (len(head) >= BLOCK and _checksum_fits(head[:BLOCK]))


def _checksum_fits(block: bytes) -> bool:
    try:
        stored = octal(block[148:156])
    except FormatError:
        return False
    return bool(block.strip(b"\0")) and stored == sum(block[:148]) + 8 * 32 + sum(block[156:])


def pax_records(raw: bytes) -> dict[str, bytes]:
    """``length key=value\\n`` records; values may hold any byte."""
    out, at = {}, 0
    while at < len(raw):
        space = raw.find(b" ", at)
        if space < 0 or not raw[at:space].isdigit():
            break
        n = int(raw[at:space])
        if n <= space - at or at + n > len(raw):
            break
        key, _, value = raw[space + 1 : at + n - 1].partition(b"=")
        out[key.decode("utf-8", "replace")] = value
        at += n
    return out


def pax_attributes(records: dict[str, bytes]) -> dict[str, bytes]:
    """Extended attributes; of both spellings the percent-encoded base64 one wins."""
    out = {k[len("SCHILY.xattr.") :]: v for k, v in records.items() if k.startswith("SCHILY.xattr.")}
    for k, v in records.items():
        if k.startswith("LIBARCHIVE.xattr."):
            v = v.rstrip(b"=")
            try:
                out[unquote(k[len("LIBARCHIVE.xattr.") :])] = base64.b64decode(v + b"=" * (-len(v) % 4))
            except ValueError:
                continue
    return out


def _sparse_numbers(parts: list[tuple[int, int]], at: int, size: int) -> list[tuple[str, int, int]]:
    """Data and hole segments of a sparse member in logical order."""
    out, logical = [], 0
    for start, length in parts:
        if start < logical:
            raise FormatError("sparse map is not in order")
        if start > logical:
            out.append(("hole", 0, start - logical))
        if length:
            out.append(("data", at, length))
        at += length
        logical = start + length
    if size > logical:
        out.append(("hole", 0, size - logical))
    return out


def _dumpdir(raw: bytes) -> list[str]:
    """Names that an incremental dump's directory still has (``Y`` and ``N``, and ``D`` directories)."""
    return [x[1:].decode("utf-8", "replace") for x in raw.split(b"\0") if x[:1] in (b"Y", b"N", b"D")]


def parse(f, *, ignore_zeros: bool = False, incremental: bool | None = None, encoding: str = "utf-8", nested: bool = False, depth: int = 0, most: int = 64, base: int = 0) -> Entries:
    """Members in file order; hashes of TAR members are of raw archive bytes, so offsets are absolute.

    A first block that is no header is an error; a later one ends the archive, as
    does a member that is cut.
    """
    f.seek(0, io.SEEK_END)
    end = f.tell()
    at, pax, world, long_name, long_link = 0, {}, {}, None, None
    listed: dict[str, set[str]] = {}
    zeros = 0
    while at + BLOCK <= end:
        f.seek(at)
        head = f.read(BLOCK)
        if not head.strip(b"\0"):
            zeros += 1
            at += BLOCK
            if zeros >= 2 and not ignore_zeros:
                break
            continue
        zeros = 0
        if not _checksum_fits(head):
            if at == 0:
                raise FormatError("no tar header")
            break
        start = at
        size, flag = octal(head[124:136]), head[156:157].decode("latin-1")
        body = at + BLOCK
        if flag in "xg":
            f.seek(body)
            (world if flag == "g" else pax).update(pax_records(f.read(size)))
            at = body + -(-size // BLOCK) * BLOCK
            continue
        if flag in "LK":
            f.seek(body)
            text = decode(f.read(size).split(b"\0", 1)[0], encoding)
            long_name, long_link = (text, long_link) if flag == "L" else (long_name, text)
            at = body + -(-size // BLOCK) * BLOCK
            continue
        records = world | pax
        if "size" in records:
            size = int(records["size"])
        name = decode(head[:100].split(b"\0", 1)[0], encoding)
        prefix = head[345:500].split(b"\0", 1)[0] if head[257:263] == b"ustar\0" else b""
        if prefix:
            name = decode(prefix, encoding) + "/" + name
        first, slash, rest = name.partition("/")
        if incremental is not False and slash and re.fullmatch("[0-7]+", first) and (head[345:500] + b"\0").startswith(first.encode() + b"\0"):
            name = rest  # some incremental dumps put the time in front, as it stands in the prefix field
        name, link = long_name or name, long_link or decode(head[157:257].split(b"\0", 1)[0], encoding)
        name = decode(records["path"], "utf-8") if "path" in records else name
        link = decode(records["linkpath"], "utf-8") if "linkpath" in records else link
        mtime = float(records.get("mtime", octal(head[136:148])))
        mode = octal(head[100:108]) & 0o7777
        entry = Entry(name, header=base + start, offset=base + body, size=size, mtime=mtime, mode=S_IFREG | mode, type_flag=ord(flag), uid=int(records.get("uid", octal(head[108:116]))), gid=int(records.get("gid", octal(head[116:124]))), xattrs=pax_attributes(records))
        stored = size
        if flag == "2":
            entry.mode, entry.linkname, entry.size, stored = S_IFLNK | mode, link, 0, 0
        elif flag == "1":
            entry.linkname, entry.size, stored = clean(link), 0, 0
        elif flag == "5" or (flag in "0\0" and name.endswith("/")):
            entry.mode, entry.size, stored = S_IFDIR | mode, 0, size if flag != "5" else 0
        elif flag == "D":
            entry.mode, entry.size = S_IFDIR | mode, 0
        elif flag in "346":
            entry.mode, entry.size, stored = {"3": 0x2000, "4": 0x6000, "6": 0x1000}[flag] | mode, 0, 0
        elif flag == "S":
            parts = []
            for i in range(4):
                raw = head[386 + 24 * i : 410 + 24 * i]
                if raw.strip(b"\0 "):
                    parts.append((octal(raw[:12]), octal(raw[12:])))
            more, real = head[482], octal(head[483:495])
            while more:
                f.seek(body)
                block = f.read(BLOCK)
                if len(block) < BLOCK:
                    return
                parts += [(octal(block[24 * i : 24 * i + 12]), octal(block[24 * i + 12 : 24 * i + 24])) for i in range(21) if block[24 * i : 24 * i + 24].strip(b"\0 ")]
                more = block[504]
                body += BLOCK
            entry.offset, entry.size, entry.sparse = base + body, real, True
            entry.segments = _sparse_numbers(parts, base + body, real)
        elif any(k.startswith("GNU.sparse.") for k in records):
            real = int(records.get("GNU.sparse.realsize", records.get("GNU.sparse.size", size)))
            entry.name = decode(records["GNU.sparse.name"], "utf-8") if "GNU.sparse.name" in records else entry.name
            data = body
            if "GNU.sparse.map" in records:
                numbers = [int(x) for x in records["GNU.sparse.map"].split(b",") if x]
            elif records.get("GNU.sparse.major") == b"1":
                f.seek(body)
                numbers, need_ = [], None
                while need_ is None or len(numbers) < need_:
                    numbers.append(int(f.readline(32)))
                    if need_ is None:
                        need_ = 2 * numbers.pop()
                data = body + -(-(f.tell() - body) // BLOCK) * BLOCK
            else:
                numbers = []
            entry.offset, entry.size, entry.sparse = base + data, real, True
            entry.segments = _sparse_numbers(list(zip(numbers[::2], numbers[1::2], strict=False)), base + data, real)
        pax, long_name, long_link = {}, None, None
        if body + stored > end and stored:
            entry.size = max(0, end - body) if not entry.sparse else entry.size
        own, regular = entry.name, not entry.sparse and flag in "0\0"  # the reader of this generator may change the entry
        has = entry.size
        yield entry
        if flag == "D" and incremental is not False:
            f.seek(body)
            now = set(_dumpdir(f.read(size)))
            where = clean(own)
            for gone in sorted(listed.get(where, set()) - now):
                yield Entry(f"{where}/{gone}", header=base + start, tombstone=True, mode=S_IFREG, mtime=mtime)
            listed[where] = now
        if regular and has and depth < most and own.lower().endswith(".tar") and (nested or size <= NESTED_LIMIT and depth == 0):
            f.seek(body)
            inner = io.BytesIO(f.read(size))
            if looks_like(inner.getvalue()[:BLOCK]):
                for e in parse(inner, ignore_zeros=ignore_zeros, incremental=incremental, encoding=encoding, nested=nested, depth=depth + 1, most=most, base=base + body):
                    e.name = own + "/" + clean(e.name)[1:]
                    yield e
        at = body + -(-stored // BLOCK) * BLOCK
