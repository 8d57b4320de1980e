"""Parsers of file system images and richer containers: 7z, SquashFS, ext2/3/4, git, PDF."""

from __future__ import annotations

import bz2
import io
import lzma
import os
import re
import struct
import zlib

from cairn.functions.values import S_IFDIR, S_IFLNK, S_IFREG
from cairn.sources.records import Entries, Entry, FormatError, decode, directory, need, symlink

# 7z -------------------------------------------------------------------------


class _Header:
    """Reader of 7z header numbers."""

    def __init__(self, raw: bytes):
        self.f = io.BytesIO(raw)

    def byte(self) -> int:
        return need(self.f, 1)[0]

    def number(self) -> int:
        first, mask, value = self.byte(), 0x80, 0
        for i in range(8):
            if not first & mask:
                return value | (first & (mask - 1)) << 8 * i
            value |= self.byte() << 8 * i
            mask >>= 1
        return value

    def bits(self, n: int) -> list[bool]:
        raw = need(self.f, -(-n // 8))
        return [bool(raw[i >> 3] >> (7 - i & 7) & 1) for i in range(n)]

    def defined(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)

    def skip(self) -> None:
        self.f.seek(self.number(), 1)


def _folder(h: _Header) -> dict:
    coders, ins, outs = [], 0, 0
    for _ in range(h.number()):
        flags = h.byte()
        method = need(h.f, flags & 15)
        a, b = (h.number(), h.number()) if flags & 16 else (1, 1)
        coders.append((method, need(h.f, h.number()) if flags & 32 else b"", a, b))
        ins, outs = ins + a, outs + b
    pairs = [(h.number(), h.number()) for _ in range(outs - 1)]
    packed = ins - len(pairs)
    streams = [h.number() for _ in range(packed)] if packed > 1 else [next((i for i in range(ins) if i not in {p for p, _ in pairs}), 0)]
    return {"coders": coders, "pairs": pairs, "packed": streams, "outs": outs, "sizes": [], "parts": 1}


def _streams(h: _Header) -> dict:
    out = {"pack": 0, "packs": [], "folders": [], "sizes": None}
    while (kind := h.byte()) != 0:
        if kind == 6:
            out["pack"], n = h.number(), h.number()
            while (k := h.byte()) != 0:
                if k == 9:
                    out["packs"] = [h.number() for _ in range(n)]
                else:
                    for d in h.defined(n):
                        h.f.seek(4 * d, 1)
        elif kind == 7:
            h.byte()
            n = h.number()
            if h.byte():
                raise FormatError("external folders")
            out["folders"] = [_folder(h) for _ in range(n)]
            while (k := h.byte()) != 0:
                if k == 12:
                    for fo in out["folders"]:
                        fo["sizes"] = [h.number() for _ in range(fo["outs"])]
                else:
                    for d in h.defined(n):
                        h.f.seek(4 * d, 1)
        elif kind == 8:
            k = h.byte()
            if k == 13:
                for fo in out["folders"]:
                    fo["parts"] = h.number()
                k = h.byte()
            sizes = []
            for fo in out["folders"]:
                own = [h.number() for _ in range(fo["parts"] - 1)] if k == 9 else []
                total = _final(fo)
                sizes.append(own + [total - sum(own)] if fo["parts"] else [])
            if k == 9:
                k = h.byte()
            out["sizes"] = sizes
            unknown = sum(fo["parts"] for fo in out["folders"])
            while k != 0:
                for d in h.defined(unknown):
                    h.f.seek(4 * d, 1)
                k = h.byte()
    if out["sizes"] is None:
        out["sizes"] = [[_final(fo)] for fo in out["folders"]]
    return out


def _final(folder: dict) -> int:
    bound = {b for _, b in folder["pairs"]}
    return next(s for i, s in enumerate(folder["sizes"]) if i not in bound)


def _unpack(f, base: int, streams: dict, index: int) -> bytes | None:
    """A folder's bytes: chains of copy, LZMA, LZMA2, BCJ (x86), delta, deflate and bzip2; else None."""
    folder = streams["folders"][index]
    first = sum(len(x["packed"]) for x in streams["folders"][:index])
    if len(folder["packed"]) != 1 or any(c[2] != 1 or c[3] != 1 for c in folder["coders"]):
        return None
    f.seek(base + streams["pack"] + sum(streams["packs"][:first]))
    data = need(f, streams["packs"][first])
    order, at = [], folder["packed"][0]
    while True:
        order.append(at)
        at = next((i for i, o in folder["pairs"] if o == at), None)
        if at is None:
            break
    filters = []
    for i in order:
        method, properties, _, _ = folder["coders"][i]
        size = folder["sizes"][i]
        if method == b"\0":
            continue
        if method == b"\x21":
            d = properties[0]
            filters = [{"id": lzma.FILTER_LZMA2, "dict_size": 0xFFFFFFFF if d == 40 else (2 | d & 1) << d // 2 + 11}]
        elif method == b"\3\1\1":
            p = properties[0]
            filters = [{"id": lzma.FILTER_LZMA1, "lc": p % 9, "lp": p // 9 % 5, "pb": p // 45, "dict_size": struct.unpack("<I", properties[1:5])[0]}]
        elif method == b"\4\1\x08":
            data = zlib.decompress(data, -15)
            continue
        elif method == b"\4\2\2":
            data = bz2.decompress(data)
            continue
        else:
            return None  # filters and ciphers that need more than the standard library
        data = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(data, size)
    return data


def seven_zip(f) -> Entries:
    """Files of a 7z archive; those of folders with unknown coders have rows without bytes."""
    head = need(f, 32)
    if head[:6] != b"7z\xbc\xaf\x27\x1c":
        raise FormatError("no 7z magic")
    at, size = struct.unpack_from("<QQ", head, 12)
    if not size:
        return
    f.seek(32 + at)
    h = _Header(need(f, size))
    kind = h.byte()
    while kind == 0x17:
        raw = _unpack(f, 32, _streams(h), 0)
        if raw is None:
            raise FormatError("header is enciphered or filtered")
        h = _Header(raw)
        kind = h.byte()
    streams: dict = {"folders": [], "sizes": [], "packs": [], "pack": 0}
    names, times, modes, empty, empty_file, n = [], {}, {}, [], [], 0
    while (kind := h.byte()) != 0:
        if kind == 2:
            while (k := h.byte()) != 0:
                h.skip()
        elif kind == 4:
            streams = _streams(h)
        elif kind == 5:
            n = h.number()
            while (k := h.byte()) != 0:
                size = h.number()
                end = h.f.tell() + size
                if k == 17:
                    h.byte()
                    names = need(h.f, size - 1).decode("utf-16-le", "replace").split("\0")[:-1]
                elif k == 14:
                    empty = h.bits(n)
                elif k == 15:
                    empty_file = h.bits(sum(empty))
                elif k in (20, 21):
                    known = h.defined(n)
                    h.byte()
                    for i, d in enumerate(known):
                        if d:
                            (times if k == 20 else modes)[i] = struct.unpack("<Q" if k == 20 else "<I", need(h.f, 8 if k == 20 else 4))[0]
                h.f.seek(end)
    sizes = [(i, s) for i, own in enumerate(streams["sizes"]) for s in own]
    bodies: dict[int, bytes | None] = {}
    empty = empty or [False] * n
    stream, void, offset, last = 0, 0, 0, -1
    for i in range(n):
        when = times.get(i, 0)
        attributes = modes.get(i, 0)
        mode = attributes >> 16 if attributes & 0x8000 else 0
        e = Entry(names[i], header=i, mtime=when / 1e7 - 11644473600.0 if when else 0.0, mode=mode or S_IFREG | 0o644)
        if empty[i]:
            is_file = void < len(empty_file) and empty_file[void]
            void += 1
            if not is_file or attributes & 16:
                e.mode = mode if mode & 0xF000 == S_IFDIR else S_IFDIR | 0o755
            e.data = b""
        else:
            folder, size = sizes[stream]
            stream += 1
            if folder != last:
                offset, last = 0, folder
            if folder not in bodies:
                bodies.clear()
                bodies[folder] = _unpack(f, 32, streams, folder)
            e.size = size
            if bodies[folder] is not None:
                e.data = bodies[folder][offset : offset + size]
                if e.mode & 0xF000 == S_IFLNK:
                    e.linkname, e.size, e.data = decode(e.data), 0, b""
            offset += size
        yield e


# SquashFS -------------------------------------------------------------------


def _squash_codec(kind: int):
    if kind == 1:
        return zlib.decompress
    if kind == 2:
        return lzma.decompress
    if kind == 4:
        return lambda b: lzma.decompress(b, lzma.FORMAT_XZ)
    if kind == 5:
        from cairn.sources.codecs import lz4_block

        return lz4_block
    if kind == 6:
        import zstandard

        return lambda b: zstandard.ZstdDecompressor().decompress(b, max_output_size=1 << 20)
    raise FormatError("unknown squashfs compression")


def squashfs(f) -> Entries:
    """Version 4 images, walked from the root inode; bytes of a file are its blocks and its fragment."""
    s = need(f, 96)
    magic, _, _, block, fragments, codec, block_log, _, _, major, _ = struct.unpack_from("<5I6H", s)
    if magic != 0x73717368 or major != 4:
        raise FormatError("no squashfs 4 image")
    root, _, _, _, inodes_at, dirs_at, fragments_at, _ = struct.unpack_from("<8Q", s, 32)
    unpack = _squash_codec(codec)
    cache: dict[int, tuple[bytes, int]] = {}

    def meta(at: int) -> tuple[bytes, int]:
        """A metadata block and where the next one starts."""
        if at not in cache:
            f.seek(at)
            n = struct.unpack("<H", need(f, 2))[0]
            raw = need(f, n & 0x7FFF)
            cache[at] = (raw if n & 0x8000 else unpack(raw), at + 2 + (n & 0x7FFF))
        return cache[at]

    def read(at: int, offset: int, size: int) -> tuple[bytes, int, int]:
        out = b""
        while len(out) < size:
            raw, after = meta(at)
            part = raw[offset : offset + size - len(out)]
            if not part and offset >= len(raw) and not raw:
                raise FormatError("cut short")
            out += part
            offset += len(part)
            if offset >= len(raw) and len(out) < size:
                at, offset = after, 0
        return out, at, offset

    def fragment(i: int) -> bytes:
        f.seek(fragments_at + i // 512 * 8)
        at = struct.unpack("<Q", need(f, 8))[0]
        start, size, _ = struct.unpack("<QII", read(at, i % 512 * 16, 16)[0])
        f.seek(start)
        raw = need(f, size & 0xFFFFFF)
        return raw if size & 1 << 24 else unpack(raw)

    def inode(at: int, offset: int):
        head, at, offset = read(at, offset, 16)
        kind, mode, _, _, mtime, number = struct.unpack("<4HII", head)
        get = lambda fmt: read(at, offset, struct.calcsize(fmt))
        if kind == 1:
            raw, _, _ = get("<IIHHI")
            start, _, size, where, _ = struct.unpack("<IIHHI", raw)
            return "dir", mode, mtime, number, (start, where, size)
        if kind == 8:
            raw, _, _ = get("<IIIIHHI")
            _, size, start, _, _, where, _ = struct.unpack("<IIIIHHI", raw)
            return "dir", mode, mtime, number, (start, where, size)
        if kind in (2, 9):
            fmt = "<IIII" if kind == 2 else "<QQQIIII"
            raw, at, offset = get(fmt)
            v = struct.unpack(fmt, raw)
            start, frag, where, size = (v[0], v[1], v[2], v[3]) if kind == 2 else (v[0], v[4], v[5], v[1])
            n = size // block if frag != 0xFFFFFFFF else -(-size // block)
            raw, _, _ = read(at, offset, 4 * n) if n else (b"", at, offset)
            return "file", mode, mtime, number, (start, struct.unpack(f"<{n}I", raw), frag, where, size)
        if kind in (3, 10):
            raw, at, offset = get("<II")
            size = struct.unpack("<II", raw)[1]
            return "link", mode, mtime, number, decode(read(at, offset, size)[0])
        return "other", mode, mtime, number, None

    def content(body) -> bytes:
        start, sizes, frag, where, size = body
        out, at = [], start
        for n in sizes:
            length = n & 0xFFFFFF
            if not length:
                out.append(bytes(min(block, size - sum(map(len, out)))))
                continue
            f.seek(at)
            raw = need(f, length)
            out.append(raw if n & 1 << 24 else unpack(raw))
            at += length
        if frag != 0xFFFFFFFF:
            out.append(fragment(frag)[where : where + size % block])
        return b"".join(out)

    def walk(path: str, body, seen: frozenset) -> Entries:
        start, where, size = body
        raw = read(dirs_at + start, where, size - 3)[0] if size > 3 else b""
        at = 0
        while at + 12 <= len(raw):
            count, table, _ = struct.unpack_from("<III", raw, at)
            at += 12
            for _ in range(count + 1):
                offset, _, _, n = struct.unpack_from("<HhHH", raw, at)
                name = decode(raw[at + 8 : at + 9 + n])
                at += 9 + n
                kind, mode, mtime, number, more = inode(inodes_at + table, offset)
                full = f"{path}/{name}"
                if kind == "dir":
                    yield directory(full, header=number, mtime=float(mtime))
                    if number not in seen:
                        yield from walk(full, more, seen | {number})
                elif kind == "file":
                    yield Entry(full, header=number, size=more[4], mtime=float(mtime), mode=S_IFREG | mode, data=content(more))
                elif kind == "link":
                    yield symlink(full, more, header=number, mtime=float(mtime))

    yield from walk("", inode(inodes_at + (root >> 16), root & 0xFFFF)[4], frozenset())


# ext2/3/4 -------------------------------------------------------------------


def ext(f) -> Entries:
    """Directories from inode 2 on; block maps and extents become segments, missing blocks holes."""
    f.seek(1024)
    s = need(f, 1024)
    if s[56:58] != b"\x53\xef":
        raise FormatError("no ext superblock")
    u32 = lambda o: struct.unpack_from("<I", s, o)[0]
    size, per_group, first, inode_size = 1024 << u32(24), u32(40), u32(20), struct.unpack_from("<H", s, 88)[0] if u32(76) else 128
    wide = struct.unpack_from("<H", s, 254)[0] if u32(96) & 0x80 else 32
    wide = wide or 32

    def inode(n: int) -> bytes:
        f.seek((first + 1) * size + (n - 1) // per_group * wide)
        d = need(f, wide)
        table = struct.unpack_from("<I", d, 8)[0] | (struct.unpack_from("<I", d, 40)[0] << 32 if wide >= 64 else 0)
        f.seek(table * size + (n - 1) % per_group * inode_size)
        return need(f, inode_size)

    def extents(raw: bytes):
        magic, count, _, depth = struct.unpack_from("<4H", raw)
        if magic != 0xF30A:
            raise FormatError("bad extent")
        for i in range(count):
            at = 12 + 12 * i
            if depth:
                low, high = struct.unpack_from("<IH", raw, at + 4)
                f.seek((low | high << 32) * size)
                yield from extents(need(f, size))
            else:
                logical, n, high, low = struct.unpack_from("<IHHI", raw, at)
                if n <= 32768:
                    yield logical, n, low | high << 32

    def mapped(raw: bytes):
        """(logical block, number of blocks, physical block)."""
        if struct.unpack_from("<I", raw, 32)[0] & 0x80000:
            yield from extents(raw[40:100])
            return
        pointers, per, logical = struct.unpack_from("<15I", raw, 40), size // 4, 0

        def level(block: int, depth: int, logical: int):
            if not block:
                return
            if depth == 0:
                yield logical, 1, block
                return
            f.seek(block * size)
            for i, p in enumerate(struct.unpack(f"<{per}I", need(f, size))):
                yield from level(p, depth - 1, logical + i * per ** (depth - 1))

        for p in pointers[:12]:
            yield from level(p, 0, logical)
            logical += 1
        for depth in (1, 2, 3):
            yield from level(pointers[11 + depth], depth, logical)
            logical += per**depth

    def segments(raw: bytes, length: int) -> list[tuple[str, int, int]]:
        out, at = [], 0
        for logical, n, physical in sorted(mapped(raw)):
            start = logical * size
            if start >= length:
                break
            if start > at:
                out.append(("hole", 0, start - at))
            part = min(n * size, length - start)
            out.append(("data", physical * size, part))
            at = start + part
        return out + ([("hole", 0, length - at)] if at < length else [])

    def read(raw: bytes, length: int) -> bytes:
        out = []
        for kind, at, n in segments(raw, length):
            f.seek(at)
            out.append(bytes(n) if kind == "hole" else need(f, n))
        return b"".join(out)

    def walk(n: int, path: str, seen: frozenset) -> Entries:
        raw = inode(n)
        data, at = read(raw, struct.unpack_from("<I", raw, 4)[0]), 0
        while at + 8 <= len(data):
            child, record, length = struct.unpack_from("<IHB", data, at)
            if record < 8:
                break
            name = decode(data[at + 8 : at + 8 + length])
            at += record
            if not child or name in (".", ".."):
                continue
            node = inode(child)
            mode, uid, low, _, _, mtime = struct.unpack_from("<HHIIII", node)
            full, length = f"{path}/{name}", low | struct.unpack_from("<I", node, 108)[0] << 32
            more = {"header": child, "mtime": float(mtime), "uid": uid, "gid": struct.unpack_from("<H", node, 24)[0]}
            if mode & 0xF000 == S_IFDIR:
                yield Entry(full, mode=mode, **more)
                if child not in seen:
                    yield from walk(child, full, seen | {child})
            elif mode & 0xF000 == S_IFLNK:
                target = node[40 : 40 + low] if low < 60 and not struct.unpack_from("<I", node, 28)[0] else read(node, low)
                yield symlink(full, decode(target), **more)
            elif mode & 0xF000 == S_IFREG:
                if struct.unpack_from("<I", node, 32)[0] & 0x10000000:
                    yield Entry(full, mode=mode, size=length, data=node[40 : 40 + min(length, 60)], **more)
                else:
                    yield Entry(full, mode=mode, size=length, sparse=True, segments=segments(node, length), **more)
            else:
                yield Entry(full, mode=mode, **more)

    yield from walk(2, "", frozenset({2}))


# git ------------------------------------------------------------------------


class GitStore:
    """Objects of a repository folder: loose ones and packs, with offset and reference deltas."""

    def __init__(self, folder: str):
        self.root = os.path.join(folder, ".git") if os.path.isdir(os.path.join(folder, ".git")) else folder
        self.packs = []
        where = os.path.join(self.root, "objects", "pack")
        for n in sorted(os.listdir(where)) if os.path.isdir(where) else ():
            if n.endswith(".idx"):
                with open(os.path.join(where, n), "rb") as f:
                    self.packs.append((self._index(f.read()), os.path.join(where, n[:-3] + "pack")))

    @staticmethod
    def _index(raw: bytes) -> dict[str, int]:
        if raw[:8] != b"\xfftOc\0\0\0\2":
            raise FormatError("old pack index")
        n = struct.unpack_from(">I", raw, 8 + 255 * 4)[0]
        at = 8 + 1024
        names = [raw[at + 20 * i : at + 20 * i + 20].hex() for i in range(n)]
        at += 24 * n
        small = struct.unpack_from(f">{n}I", raw, at)
        at += 4 * n
        return {k: struct.unpack_from(">Q", raw, at + 8 * (o & 0x7FFFFFFF))[0] if o >> 31 else o for k, o in zip(names, small, strict=True)}

    def ref(self, name: str) -> str:
        """Object name of a branch, tag, ``HEAD`` or full hash."""
        if re.fullmatch("[0-9a-f]{40}", name):
            return name
        for path in (name, f"refs/heads/{name}", f"refs/tags/{name}", f"refs/remotes/{name}"):
            full = os.path.join(self.root, path)
            if os.path.isfile(full):
                with open(full) as f:
                    text = f.read().strip()
                return self.ref(text[5:]) if text.startswith("ref: ") else text
        packed = os.path.join(self.root, "packed-refs")
        if os.path.isfile(packed):
            with open(packed) as f:
                for line in f:
                    key, _, path = line.strip().partition(" ")
                    if path in (name, f"refs/heads/{name}", f"refs/tags/{name}", f"refs/remotes/{name}"):
                        return key
        raise FormatError(f"no ref {name}")

    def get(self, name: str) -> tuple[str, bytes]:
        loose = os.path.join(self.root, "objects", name[:2], name[2:])
        if os.path.isfile(loose):
            with open(loose, "rb") as f:
                head, _, body = zlib.decompress(f.read()).partition(b"\0")
            return head.split(b" ")[0].decode(), body
        for index, path in self.packs:
            if name in index:
                with open(path, "rb") as f:
                    return self._packed(f, index[name])
        raise FormatError(f"no object {name}")

    def _packed(self, f, at: int) -> tuple[str, bytes]:
        f.seek(at)
        b = need(f, 1)[0]
        kind, more = b >> 4 & 7, b & 0x80
        while more:
            more = need(f, 1)[0] & 0x80
        if kind == 6:
            b = need(f, 1)[0]
            back = b & 127
            while b & 0x80:
                b = need(f, 1)[0]
                back = (back + 1 << 7) | b & 127
            delta = self._inflate(f)
            name, base = self._packed(f, at - back)
            return name, self._apply(base, delta)
        if kind == 7:
            base_name = need(f, 20).hex()
            delta = self._inflate(f)
            name, base = self.get(base_name)
            return name, self._apply(base, delta)
        return {1: "commit", 2: "tree", 3: "blob", 4: "tag"}[kind], self._inflate(f)

    @staticmethod
    def _inflate(f) -> bytes:
        d, out = zlib.decompressobj(), []
        while not d.eof:
            raw = f.read(65536)
            if not raw:
                raise FormatError("pack is cut")
            out.append(d.decompress(raw))
        return b"".join(out)

    @staticmethod
    def _apply(base: bytes, delta: bytes) -> bytes:
        at, out = 0, []
        for _ in range(2):
            while delta[at] & 0x80:
                at += 1
            at += 1
        while at < len(delta):
            op = delta[at]
            at += 1
            if op & 0x80:
                start = size = 0
                for i in range(4):
                    if op >> i & 1:
                        start |= delta[at] << 8 * i
                        at += 1
                for i in range(3):
                    if op >> 4 + i & 1:
                        size |= delta[at] << 8 * i
                        at += 1
                out.append(base[start : start + (size or 0x10000)])
            else:
                out.append(delta[at : at + op])
                at += op
        return b"".join(out)


def git_tree(folder: str, ref: str = "HEAD", contents: bool = True) -> Entries:
    """Files of a commit's tree; all have the commit's time."""
    store = GitStore(folder)
    kind, body = store.get(store.ref(ref))
    while kind == "tag":
        kind, body = store.get(re.match(rb"object ([0-9a-f]{40})", body)[1].decode())
    when = float(re.search(rb"\ncommitter .*> (\d+) ", body)[1])

    def walk(name: str, path: str) -> Entries:
        raw, at = store.get(name)[1], 0
        while at < len(raw):
            space, zero = raw.index(b" ", at), raw.index(b"\0", at)
            mode, title, child = int(raw[at:space], 8), decode(raw[space + 1 : zero]), raw[zero + 1 : zero + 21].hex()
            at, full = zero + 21, f"{path}/{title}"
            if mode == 0o40000:
                yield directory(full, mtime=when)
                yield from walk(child, full)
            elif mode == 0o120000:
                yield symlink(full, decode(store.get(child)[1]), mtime=when)
            elif mode == 0o160000:
                yield directory(full, mtime=when)  # a submodule
            else:
                data = store.get(child)[1]
                yield Entry(full, size=len(data), mtime=when, mode=mode, data=data if contents else None)

    yield from walk(re.match(rb"tree ([0-9a-f]{40})", body)[1].decode(), "")


# PDF ------------------------------------------------------------------------


def pdf(f) -> Entries:
    """Embedded files and JPEG images of a PDF whose objects are plain or in object streams."""
    raw = f.read()
    if raw[:5] != b"%PDF-":
        raise FormatError("no pdf")
    objects: dict[int, tuple[bytes, bytes | None]] = {}
    for m in re.finditer(rb"(?:^|[\r\n\s])(\d+)\s+\d+\s+obj\b", raw):
        end = raw.find(b"endobj", m.end())
        body = raw[m.end() : end if end >= 0 else len(raw)]
        head, mark, data = body.partition(b"stream")
        if mark and not head.rstrip().endswith(b"end"):
            start = m.end() + len(head) + 6
            start += 2 if raw[start : start + 2] == b"\r\n" else 1
            n = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
            stop = start + int(n[1]) if n else raw.find(b"endstream", start)
            objects[int(m[1])] = (head, raw[start:stop])
        else:
            objects[int(m[1])] = (body, None)

    def data(head: bytes, body: bytes) -> bytes:
        if b"/FlateDecode" in head:
            try:
                return zlib.decompress(body)
            except zlib.error:
                return zlib.decompressobj().decompress(body)
        return body

    for head, body in list(objects.values()):
        if body is not None and b"/ObjStm" in head:
            inner = data(head, body)
            n, first = int(re.search(rb"/N\s+(\d+)", head)[1]), int(re.search(rb"/First\s+(\d+)", head)[1])
            numbers = list(map(int, inner[:first].split()[: 2 * n]))
            for k in range(n):
                stop = first + numbers[2 * k + 3] if k + 1 < n else len(inner)
                objects.setdefault(numbers[2 * k], (inner[first + numbers[2 * k + 1] : stop], None))
    seen: dict[str, int] = {}
    for number, (head, _) in sorted(objects.items()):
        ref = re.search(rb"/EF\s*<<[^>]*?/U?F\s+(\d+)\s+\d+\s+R", head)
        if b"/Filespec" not in head and not ref or not ref or int(ref[1]) not in objects:
            continue
        name = re.search(rb"/UF\s*\(((?:\\.|[^\\)])*)\)", head) or re.search(rb"/F\s*\(((?:\\.|[^\\)])*)\)", head)
        title = decode(re.sub(rb"\\(.)", rb"\1", name[1])) if name else f"attachment-{number}"
        n = seen.get(title, 0)
        seen[title] = n + 1
        own, body = objects[int(ref[1])]
        content = data(own, body or b"")
        yield Entry("attachments/" + title.replace("/", "_") + (f"-{n}" if n else ""), header=int(ref[1]), size=len(content), data=content)
    for number, (head, body) in sorted(objects.items()):
        if body is not None and re.search(rb"/Subtype\s*/Image", head) and b"/DCTDecode" in head and b"/FlateDecode" not in head:
            yield Entry(f"images/image-{number}.jpg", header=(1 << 40) + number, size=len(body), data=body)
