"""Outer compression: detection, decoding in chunks, and block maps of what can be sought in."""

from __future__ import annotations

import bisect
import bz2
import lzma
import struct
import zlib
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20


def detect(head: bytes, name: str = "") -> str | None:
    """Codec by magic, then, for formats without one, by the name's suffix."""
    for codec, mark in (("gzip", b"\x1f\x8b"), ("bzip2", b"BZh"), ("xz", b"\xfd7zXZ\0"), ("zstd", b"\x28\xb5\x2f\xfd"), ("lz4", b"\x04\x22\x4d\x18"), ("lzip", b"LZIP"), ("lzo", b"\x89LZO\0\r\n\x1a\n"), ("lrzip", b"LRZI"), ("compress", b"\x1f\x9d")):
        if head.startswith(mark):
            return codec
    if len(head) >= 4 and head[:4] in (b"\x50\x2a\x4d\x18", b"\x5e\x2a\x4d\x18"):
        return "zstd"
    if name.lower().endswith(".lzma") or head[:3] == b"\x5d\0\0" and len(head) > 13:
        return "lzma"
    if len(head) > 2 and head[0] == 0x78 and (head[0] << 8 | head[1]) % 31 == 0:
        return "zlib"
    return None


def _members(f, make, unused) -> Iterator[bytes]:
    """Chunks of concatenated streams that each end by themselves."""
    raw = f.read(CHUNK)
    while raw:
        d = make()
        while raw and not d.eof:
            out = d.decompress(raw)
            if out:
                yield out
            raw = unused(d) if d.eof else f.read(CHUNK)
        if not d.eof:
            raise EOFError("compressed stream is cut")
        raw = (raw or b"") or f.read(CHUNK)
        if not raw.strip(b"\0"):
            raw = b""


def _zstd(f) -> Iterator[bytes]:
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True, closefd=False) as r:
        while chunk := r.read(CHUNK):
            yield chunk


def lz4_block(src: bytes, window: bytes = b"") -> bytes:
    """One LZ4 block: literals and matches into the bytes before."""
    out, i, base = bytearray(window), 0, len(window)
    while i < len(src):
        token = src[i]
        i += 1
        n = token >> 4
        if n == 15:
            while True:
                n += src[i]
                i += 1
                if src[i - 1] != 255:
                    break
        out += src[i : i + n]
        i += n
        if i >= len(src):
            break
        back = src[i] | src[i + 1] << 8
        i += 2
        n = token & 15
        if n == 15:
            while True:
                n += src[i]
                i += 1
                if src[i - 1] != 255:
                    break
        n += 4
        at = len(out) - back
        if back == 0 or at < 0:
            raise ValueError("bad lz4 match")
        out += out[at : at + n] if back >= n else (bytes(out[at:]) * (n // back + 1))[:n]
    return bytes(out[base:])


def _lz4(f) -> Iterator[bytes]:
    while (mark := f.read(4)) == b"\x04\x22\x4d\x18":
        flags, _ = f.read(2)
        f.read((8 if flags & 8 else 0) + (4 if flags & 1 else 0) + 1)
        window = b""
        while (size := struct.unpack("<I", f.read(4))[0]) != 0:
            raw = f.read(size & 0x7FFFFFFF)
            out = raw if size >> 31 else lz4_block(raw, window if not flags & 32 else b"")
            if flags & 16:
                f.read(4)
            window = (window + out)[-65536:]
            yield out
        if flags & 4:
            f.read(4)
    if mark:
        raise ValueError("bytes behind the lz4 frames")


def _lzip(f) -> Iterator[bytes]:
    while (head := f.read(6)) and head[:4] == b"LZIP":
        size = 1 << (head[5] & 31)
        size -= size // 16 * (head[5] >> 5)
        d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": size, "lc": 3, "lp": 0, "pb": 2}])
        raw = b""
        while not d.eof:
            raw = f.read(CHUNK)
            if not raw:
                raise EOFError("lzip member is cut")
            if out := d.decompress(raw):
                yield out
        f.seek(-len(d.unused_data), 1)
        f.read(20)


def unlzw(raw: bytes) -> bytes:
    """Body of a ``.Z`` file: codes of 9 to 16 bits in groups of eight, with a clear code in block mode."""
    if raw[:2] != b"\x1f\x9d":
        raise ValueError("no .Z magic")
    most, block = raw[2] & 31, raw[2] & 128
    table = [bytes([i]) for i in range(256)] + ([b""] if block else [])
    out, width, at, used, last = [], 9, 3 * 8, 0, b""
    total = len(raw) * 8
    while at + width <= total:
        byte = at >> 3
        code = int.from_bytes(raw[byte : byte + 4], "little") >> (at & 7) & ((1 << width) - 1)
        at += width
        used += 1
        if block and code == 256:
            at += (8 - used % 8) % 8 * width
            table, width, used, last = table[:257], 9, 0, b""
            continue
        if code < len(table):
            word = table[code]
        elif last and code == len(table):
            word = last + last[:1]
        else:
            raise ValueError("bad .Z code")
        out.append(word)
        if last and len(table) < 1 << most:
            table.append(last + word[:1])
        last = word
        if len(table) == 1 << width and width < most:
            at += (8 - used % 8) % 8 * width
            width, used = width + 1, 0
    return b"".join(out)


def decompress(f, codec: str) -> Iterator[bytes]:
    """Decoded chunks of a stream."""
    if codec == "gzip":
        yield from _members(f, lambda: zlib.decompressobj(31), lambda d: d.unused_data)
    elif codec == "zlib":
        yield from _members(f, lambda: zlib.decompressobj(15), lambda d: d.unused_data)
    elif codec == "bzip2":
        yield from _members(f, bz2.BZ2Decompressor, lambda d: d.unused_data)
    elif codec == "xz":
        yield from _members(f, lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ), lambda d: d.unused_data)
    elif codec == "lzma":
        yield lzma.decompress(f.read(), lzma.FORMAT_ALONE)
    elif codec == "zstd":
        yield from _zstd(f)
    elif codec == "lz4":
        yield from _lz4(f)
    elif codec == "lzip":
        yield from _lzip(f)
    elif codec == "compress":
        yield unlzw(f.read())
    else:
        raise ValueError(f"no decoder for {codec}")


# block maps: (compressed offset, data offset), closed by a row for the end --------


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if not b & 128:
            return n, at


def xz_blocks(raw: bytes) -> list[tuple[int, int]]:
    """From the indexes of all streams, the last one first."""
    end, streams = len(raw), []
    while end > 0:
        while end >= 4 and raw[end - 4 : end] == bytes(4):
            end -= 4  # padding between streams
        back = (struct.unpack_from("<I", raw, end - 8)[0] + 1) * 4
        at = end - 12 - back
        if raw[end - 2 : end] != b"YZ" or raw[at] != 0:
            raise ValueError("no xz index")
        count, at = _varint(raw, at + 1)
        sizes = []
        for _ in range(count):
            packed, at = _varint(raw, at)
            size, at = _varint(raw, at)
            sizes.append((-(-packed // 4) * 4, size))
        start = end - 24 - back - sum(p for p, _ in sizes)
        streams.append((start, sizes))
        end = start
    data, out, comp = 0, [], 0
    for start, sizes in reversed(streams):
        comp = start + 12
        for packed, size in sizes:
            out.append((comp, data))
            comp, data = comp + packed, data + size
    return [*out, (comp, data)]


def _shifted(raw: bytes, by: int) -> bytes:
    """The bytes read from ``by`` bits behind the start."""
    x = np.frombuffer(raw + b"\0", dtype=np.uint8).astype(np.uint16)
    return ((x[:-1] << by | x[1:] >> (8 - by)) & 255).astype(np.uint8).tobytes()


def _bit_places(raw: bytes, mark: bytes) -> list[int]:
    """Bit offsets of a mark, at any alignment."""
    out = []
    for by in range(8):
        shifted, at = _shifted(raw, by), -1
        while (at := shifted.find(mark, at + 1)) >= 0:
            out.append(at * 8 + by)
    return sorted(out)


def bzip2_blocks(raw: bytes) -> list[tuple[int, int]]:
    """Bit offsets of the blocks; data offsets need decoding, each block as a stream of its own."""
    marks, ends = _bit_places(raw, b"\x31\x41\x59\x26\x53\x59"), _bit_places(raw, b"\x17\x72\x45\x38\x50\x90")
    edges = sorted([*marks, *ends])
    data, out = 0, []
    for m in marks:
        stop = edges[bisect.bisect_right(edges, m)]
        body = _shifted(raw[m // 8 : stop // 8 + 2], m % 8)
        whole, rest = divmod(stop - m, 8)
        tail = body[whole] >> (8 - rest) if rest else 0
        tail = (tail << 80 | 0x177245385090 << 32 | int.from_bytes(body[6:10], "big")) << -rest % 8
        stream = b"BZh9" + body[:whole] + tail.to_bytes(10 + (rest > 0), "big")
        out.append((m, data))
        data += len(bz2.decompress(stream))
    return [*out, (ends[-1] if ends else len(raw) * 8, data)]


def _seek_table(raw: bytes) -> list[tuple[int, int]] | None:
    """(compressed, decoded) sizes of the frames from a seek table at the end, if there is one."""
    if len(raw) < 17 or raw[-4:] != b"\xb1\xea\x92\x8f":
        return None
    count, flags = struct.unpack_from("<IB", raw, len(raw) - 9)
    row = 12 if flags & 128 else 8
    start = len(raw) - 9 - count * row
    if start < 8 or struct.unpack_from("<II", raw, start - 8) != (0x184D2A5E, count * row + 9):
        return None
    return [struct.unpack_from("<II", raw, start + i * row) for i in range(count)]


def zstd_blocks(raw: bytes) -> list[tuple[int, int]]:
    """One row for each frame: from the seek table, else from the frames, decoded in turn."""
    import zstandard

    at, data, out = 0, 0, []
    table = _seek_table(raw)
    if table is not None:
        for packed, size in table:
            out.append((at, data))
            at, data = at + packed, data + size
        return [*out, (at, data)]
    view = memoryview(raw)
    while at < len(raw):
        if raw[at + 1 : at + 4] == b"\x2a\x4d\x18" and raw[at] >> 4 == 5:  # a frame to skip
            at += 8 + struct.unpack_from("<I", raw, at + 4)[0]
            continue
        d, start = zstandard.ZstdDecompressor().decompressobj(), at
        out.append((at, data))
        while not d.eof and at < len(raw):
            data += len(d.decompress(view[at : at + CHUNK]))
            at += CHUNK
        at = min(at, len(raw)) - len(d.unused_data)
        if at <= start:
            raise ValueError("zstd frame is cut")
    return [*out, (len(raw), data)]


def lzip_blocks(raw: bytes) -> list[tuple[int, int]]:
    """From the members' trailers, last to first."""
    end, members = len(raw), []
    while end > 0:
        size, member = struct.unpack_from("<QQ", raw, end - 16)
        members.append((end - member, size))
        end -= member
    out, data = [], 0
    for at, size in reversed(members):
        out.append((at, data))
        data += size
    return [*out, (len(raw), data)]


def gzip_blocks(raw: bytes) -> list[tuple[int, int]]:
    """One row for each member, as block compressors write them."""
    at, data, out, view = 0, 0, [], memoryview(raw)
    while at < len(raw) and raw[at : at + 2] == b"\x1f\x8b":
        d, place = zlib.decompressobj(31), at
        out.append((at, data))
        while not d.eof and place < len(raw):
            data += len(d.decompress(view[place : place + CHUNK]))
            place += CHUNK
        if not d.eof:
            raise EOFError("gzip member is cut")
        at = min(place, len(raw)) - len(d.unused_data)
    return [*out, (len(raw), data)]


def lz4_blocks(raw: bytes) -> list[tuple[int, int]]:
    """One row for each block of frames whose blocks do not need the ones before."""
    at, data, out = 0, 0, []
    while raw[at : at + 4] == b"\x04\x22\x4d\x18":
        flags = raw[at + 4]
        if not flags & 32:
            raise ValueError("blocks of this lz4 frame need the ones before")
        at += 7 + (8 if flags & 8 else 0) + (4 if flags & 1 else 0)
        while (size := struct.unpack_from("<I", raw, at)[0]) != 0:
            out.append((at, data))
            n = size & 0x7FFFFFFF
            data += n if size >> 31 else len(lz4_block(raw[at + 4 : at + 4 + n]))
            at += 4 + n + (4 if flags & 16 else 0)
        at += 4 + (4 if flags & 4 else 0)
    return [*out, (at, data)]


BLOCK_MAPS = {"gzip": (gzip_blocks, "byte"), "lz4": (lz4_blocks, "byte"), "xz": (xz_blocks, "byte"), "bzip2": (bzip2_blocks, "bit"), "zstd": (zstd_blocks, "byte"), "lzip": (lzip_blocks, "byte")}
