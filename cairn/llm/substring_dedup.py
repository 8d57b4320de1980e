"""Operator 3: exact removal of repeated 50-byte strings by suffix arrays of shards.

A byte of a document goes if a 50-byte string over it also starts in a document
with a smaller doc_id.  Two equal windows of 50 bytes have the same anchor: the
leftmost least hash of their 16-byte grams.  So windows can be dealt by anchor:

1. Copies of a whole text are found by two 64-bit hashes; all but the one with the
   least doc_id go whole and take no further part.
2. Each text's anchors are dealt by hash, packed in blocks; an anchor that at
   least two different texts have is a candidate, and its texts are told.
3. Texts with candidates deal the bytes around these anchors, at most 84 each, to
   shards by hash.  A shard puts equal contexts in once, builds its suffix array by
   induced sorting and the permuted common prefixes, and runs with 50 bytes in
   common are the classes of equal windows.  The least doc_id of a class decides which
   of its windows are covered, and the covered byte ranges go back to the texts.

Work is in arrays over bounded blocks; hot passages are sent once per block and
text, never in pairs.

Cases: null text is empty; texts under 50 bytes keep all bytes; rows with equal
doc_id are no smaller than each other; null doc_ids are the smallest; texts of any
length are whole (cut into overlapping pieces only to bound memory).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import discard, materialize, release_memory, text_of
from cairn.llm.suffix_array import low_bytes, permuted_prefixes, suffix_array, words_at

WIDTH, GRAM = 50, 16
SPAN = WIDTH - GRAM + 1
PLACE, PIECE = 17, 100_000  # windows handled at once, and the bits of a place among them
BLOCK = 24_000_000  # bytes of text whose anchors are dealt together
SHARD = 1_000_000  # bytes of contexts in one suffix array, unless one anchor has more
BUCKET = 64_000_000  # bytes of text whose anchors and contexts are a bucket's share
NULL_ID = -(1 << 63)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from each place on."""
    n = len(data) - GRAM + 1
    words = words_at(data)
    h = (words[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ (words[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _leftmost_least(h: np.ndarray) -> np.ndarray:
    """Place of the leftmost least of each SPAN neighbours, by the upper bits of the hash; the lower ones take the place."""
    low = np.uint64((1 << PLACE) - 1)
    value, span = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while span < SPAN:
        step = min(span, SPAN - span)
        value = np.minimum(value[:-step], value[step:])
        span += step
    return (value & low).astype(np.int64)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window, text) of each run of windows with one anchor, text by text.

    Short texts are read together as one string; windows that cross from one into
    the next are left out.  Long ones are read in overlapping pieces.
    """
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    a = 0
    while a < len(texts):
        b, total = a + 1, size[a]
        while b < len(texts) and total + size[b] <= PIECE:
            total += size[b]
            b += 1
        base = np.cumsum(size[a:b]) - size[a:b]
        raw = np.frombuffer(texts[a] if b == a + 1 else b"".join(texts[a:b]), dtype=np.uint8)
        for low in range(0, max(len(raw) - WIDTH + 1, 0), PIECE):
            h = gram_hashes(raw[low : low + PIECE + WIDTH - 1])
            at = _leftmost_least(h)
            owner = np.searchsorted(base, np.arange(low, low + len(at)), side="right") - 1 if b == a + 1 else np.repeat(np.arange(b - a), size[a:b])[: len(at)]
            whole = np.nonzero(np.arange(low + WIDTH, low + WIDTH + len(at)) <= (base + size[a:b])[owner])[0]
            if not len(whole):
                continue
            place = at[whole]
            start = np.concatenate([[0], np.nonzero(place[1:] != place[:-1])[0] + 1])
            of = owner[whole[start]]
            last = whole[np.concatenate([start[1:] - 1, [len(whole) - 1]])]
            out.append((h[place[start]], low + whole[start] - base[of], low + last - base[of], a + of))
        a = b
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _dump(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed."""
    parts = []
    for x in arrays:
        raw = np.ascontiguousarray(x)
        parts.append(np.array([len(raw)], dtype="<i8").tobytes())
        parts.append(np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), -1).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _load(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        size, n = np.dtype(kind).itemsize, int(np.frombuffer(raw, "<i8", 1, at)[0])
        at += 8
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * size
    return out


def _bucket(h: np.ndarray, count: int) -> np.ndarray:
    """Shard of an anchor, by the low half of its hash: anchors are least hashes, so the high half is not even."""
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.concatenate([[0], np.nonzero(sorted_[1:] != sorted_[:-1])[0] + 1])


def _short(h: np.ndarray) -> np.ndarray:
    """What tells an anchor from the others of its text."""
    return (h >> np.uint64(20)).astype(np.uint32)


def _told(text: np.ndarray, h: np.ndarray, count: int):
    """(group, block) of pairs: each text's anchors in short form, dealt by text."""
    group = text % count
    order = np.lexsort((text, group))
    group, text, h = group[order], text[order], _short(h[order])
    start = _runs(group)
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(group)], strict=True):
        first = _runs(text[a:b])
        yield int(group[a]), _dump(text[a:b][first], np.diff(np.concatenate([first, [b - a]])).astype(np.uint32), h[a:b])


_BLOCK = pa.schema([("bucket", pa.int32()), ("told", pa.bool_()), ("blob", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _deal_anchors(batches, count: int):
    """Blocks of (anchor, text) for the buckets; anchors that a block shows to be shared are told at once."""
    seen: set[tuple] = set()
    names, raws, size = [], [], 0

    def close():
        h, _, _, own = anchors(raws)
        t = np.array(names, dtype=np.int64)[own]
        order = np.argsort(h, kind="stable")
        h, t = h[order], t[order]
        once = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])  # texts come in order
        h, t = h[once], t[once]
        start = _runs(h)
        low, high = np.minimum.reduceat(t, start), np.maximum.reduceat(t, start)
        shared = low != high
        many = np.repeat(shared, np.diff(np.concatenate([start, [len(h)]])))
        rows = []
        if many.any():
            rows += [(group, True, blob) for group, blob in _told(t[many], h[many], count)]
        # a shared anchor has two witnesses, no answer needed; another one its text, which waits for one
        key = np.concatenate([h[start], h[start][shared]])
        text, wait = np.concatenate([low, high[shared]]), np.concatenate([~shared, np.zeros(int(shared.sum()), bool)])
        where = _bucket(key, count)
        order = np.lexsort((key, where))
        key, text, wait, where = key[order], text[order], wait[order], where[order]
        begin = _runs(where)
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(key)], strict=True):
            known, index = np.unique(text[a:b], return_inverse=True)
            rows.append((int(where[a]), False, _dump(np.diff(key[a:b], prepend=np.uint64(0)), known, index.astype(np.uint32), wait[a:b].view(np.uint8))))
        return _rows(rows, _BLOCK)

    for batch in batches:
        signs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        texts = batch.column(2)
        for i, sign in enumerate(signs):
            if sign in seen:
                continue
            seen.add(sign)
            names.append(sign[0])
            raws.append(texts[i].as_py().encode())
            size += len(raws[-1])
            if size >= BLOCK:
                yield close()
                seen.clear()
                names, raws, size = [], [], 0
    if raws:
        yield close()


def _shared_anchors(batches, count: int):
    """From a shard's blocks: blocks, dealt by text, of the anchors that another text has too."""
    release_memory()
    key, text, wait = [], [], []
    for batch in batches:
        passed = []
        for bucket, told, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if told:
                passed.append((bucket, True, blob))
                continue
            step, names, index, waits = _load(blob, "<u8", "<i8", "<u4", "u1")
            key.append(np.cumsum(step, dtype=np.uint64))
            text.append(names[index])
            wait.append(waits)
        if passed:
            yield _rows(passed, _BLOCK)
    if key:
        h, t, w = np.concatenate(key), np.concatenate(text), np.concatenate(wait).astype(bool)
        key = text = wait = None
        order = np.argsort(h, kind="stable")
        h, t, w = h[order], t[order], w[order]
        start = _runs(h)
        many = np.repeat(np.minimum.reduceat(t, start) != np.maximum.reduceat(t, start), np.diff(np.concatenate([start, [len(h)]]))) & w
        if many.any():
            yield _rows([(group, True, blob) for group, blob in _told(t[many], h[many], count)], _BLOCK)


_TOLD = pa.schema([("sign", pa.int64()), ("own", pa.binary())])


def _by_text(batches):
    """(sign, own): the shared anchors of each text, in short form."""
    texts, hashes = [], []
    for batch in batches:
        for blob in batch.column(2).to_pylist():
            names, times, own = _load(blob, "<i8", "<u4", "<u4")
            texts.append(np.repeat(names, times))
            hashes.append(own)
    if not texts:
        return
    t, h = np.concatenate(texts), np.concatenate(hashes)
    order = np.argsort(t, kind="stable")
    t, h = t[order], h[order]
    start = _runs(t)
    stop = [*start[1:].tolist(), len(t)]
    for a in range(0, len(start), 20_000):
        yield _rows([(int(t[i]), h[i:j].tobytes()) for i, j in zip(start[a : a + 20_000].tolist(), stop[a : a + 20_000], strict=True)], _TOLD)


_STATE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_sha256", pa.string()), ("sign", pa.int64()), ("text", pa.binary()), ("own", pa.binary())])
_ZIP = zstandard.ZstdCompressor(level=3)
_STATE_DDL = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept_sha256 string, sign long, text binary, own binary"
_OUT = ["doc_id", "n_bytes", "spans", "kept_sha256", "sign"]


def _judge(batches):
    """Copies and texts without candidates are finished; the others wait with their candidates."""
    empty = hashlib.sha256().hexdigest()
    for batch in batches:
        rows, size = [], 0
        cols = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            doc, text, sign, second, firsts, own = (c[i].as_py() for c in cols)
            raw = text.encode()
            n = len(raw)
            first = next(f["first"] for f in firsts if f["second"] == second)
            if first < doc and n >= WIDTH:
                rows.append((doc, n, [{"start": 0, "stop": n}], empty, sign, None, None))
            elif first < doc or not own:
                rows.append((doc, n, [], hashlib.sha256(raw).hexdigest(), sign, None, None))
            else:
                rows.append((doc, n, None, None, sign, _ZIP.compress(raw), own))
                size += n
            if size > 16_000_000:
                yield _rows(rows, _STATE)
                rows, size = [], 0
        if rows:
            yield _rows(rows, _STATE)


def _unzip(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


_CONTEXT = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def _deal_contexts(batches, count: int):
    """Bytes around the candidate anchors, in blocks for the shards."""
    release_memory()
    raws, owns, ids, signs, size = [], [], [], [], 0

    def close():
        h, start, length, doc = anchors(raws)
        length += WIDTH - start
        own = np.concatenate(owns).astype(np.int64) | np.repeat(np.arange(len(owns)), [len(x) for x in owns]) << 32
        own.sort()
        key = _short(h).astype(np.int64) | doc << 32
        pick = own[np.minimum(np.searchsorted(own, key), len(own) - 1)] == key
        h, start, length, doc = h[pick], start[pick], length[pick], doc[pick]
        base = np.cumsum([0] + [len(x) for x in raws])
        raw = np.frombuffer(b"".join(raws), dtype=np.uint8)
        of, sign = np.array(ids), np.array(signs)
        where = _bucket(h, count)
        order = np.lexsort((h, where))
        where = where[order]
        begin, rows = _runs(where), []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
            own = order[a:b]
            docs, index = np.unique(doc[own], return_inverse=True)
            size = length[own]
            flat = np.repeat(base[doc[own]] + start[own] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            rows.append((int(where[a]), _dump(h[own], of[docs], sign[docs], index.astype(np.uint32), start[own], size.astype(np.uint8), raw[flat])))
        return _rows(rows, _CONTEXT)

    for batch in batches:
        for doc, sign, text, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            raws.append(_unzip(text))
            owns.append(np.frombuffer(own, dtype=np.uint32))
            ids.append(doc)
            signs.append(sign)
            size += len(raws[-1])
            if size >= BLOCK:
                yield close()
                raws, owns, ids, signs, size = [], [], [], [], 0
    if raws:
        yield close()


_RANGES = pa.schema([("sign", pa.int64()), ("doc_id", pa.int64()), ("ranges", pa.binary())])


def _distinct(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one index of each distinct context, the number of each context's): copies told by a hash and by all their bytes."""
    words = words_at(data)
    h = size.astype(np.uint64)
    steps = range(0, int(size.max()), 8)
    part = lambda own, j: words[np.minimum(begin[own] + j, len(data))] & low_bytes(np.clip(size[own] - j, 0, 8))
    every = np.arange(len(size))
    for j in steps:
        h = (h ^ part(every, j)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    a, b = order[:-1], order[1:]
    same = (h[a] == h[b]) & (size[a] == size[b])
    alike = np.nonzero(same)[0]
    for j in steps:
        equal = part(a[alike], j) == part(b[alike], j)
        same[alike[~equal]] = False
        alike = alike[equal]
    first = np.concatenate([[True], ~same])
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(first) - 1
    return order[first], number


def covered_windows(data: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For contexts in ``data``: of each of their windows, in order, the least doc that has its 50 bytes.

    Equal contexts are put in once.  Windows that are neighbours in the suffix
    array are of one class while no common prefix between them is under 50.
    """
    pick, number = _distinct(data, begin, size)
    least = np.full(len(pick), np.iinfo(np.int64).max)
    np.minimum.at(least, number, doc)
    u_size = size[pick]
    windows = u_size - WIDTH + 1
    start, w_start = np.cumsum(u_size) - u_size, np.cumsum(windows) - windows
    text = np.ascontiguousarray(data[np.repeat(begin[pick] - start, u_size) + np.arange(int(u_size.sum()))])
    window = np.full(len(text), -1, dtype=np.int32)
    window[np.repeat(start - w_start, windows) + np.arange(int(windows.sum()))] = np.arange(int(windows.sum()), dtype=np.int32)
    order = suffix_array(text)
    fresh = np.cumsum(permuted_prefixes(text, order, WIDTH)[order] < WIDTH, dtype=np.int32)
    ranked = window[order]
    fresh, ranked = fresh[ranked >= 0], ranked[ranked >= 0]
    classes = _runs(fresh)
    owner = np.repeat(least, windows)
    result = np.empty(len(ranked), dtype=np.int64)
    result[ranked] = np.repeat(np.minimum.reduceat(owner[ranked], classes), np.diff(np.concatenate([classes, [len(ranked)]])))
    count = windows[number]
    return result[np.repeat(w_start[number] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]


def _cover(batches):
    """From a shard's contexts: the byte ranges of each text that windows of smaller documents cover."""
    release_memory()
    parts = []
    for batch in batches:
        for blob in batch.column(1).to_pylist():
            h, ids, signs, index, start, size, raw = _load(blob, "<u8", "<i8", "<i8", "<u4", "<i8", "u1", "u1")
            parts.append((h, ids[index], signs[index], start, size.astype(np.int64), raw))
    if not parts:
        return
    h, doc, sign, start, size, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts = None
    begin = np.cumsum(size) - size
    order = np.argsort(h, kind="stable")
    groups = _runs(h[order])
    sums = np.cumsum(size[order])
    a = 0
    edges = [*groups[1:].tolist(), len(order)]
    cuts, last = [], 0
    for e in edges:
        if sums[e - 1] - last >= SHARD:
            cuts.append(e)
            last = sums[e - 1]
    if not cuts or cuts[-1] != len(order):
        cuts.append(len(order))
    for b in cuts:
        own = order[a:b]
        a = b
        count = size[own]
        at = np.cumsum(count) - count
        least = covered_windows(raw[np.repeat(begin[own] - at, count) + np.arange(int(count.sum()))], at, count, doc[own])
        count = count - WIDTH + 1
        owner = np.repeat(np.arange(len(own)), count)
        hit = least < doc[own][owner]
        if not hit.any():
            continue
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        # a run must not pass from one context into the next
        new = np.concatenate([[True], owner[1:] != owner[:-1]])
        first = np.nonzero(hit & (new | np.concatenate([[True], ~hit[:-1]])))[0]
        end = np.concatenate([new[1:], [True]])
        final = np.nonzero(hit & (end | np.concatenate([~hit[1:], [True]])))[0]
        who = own[owner[first]]
        low, high = start[who] + at[first], start[who] + at[final] + WIDTH
        by = np.lexsort((low, doc[who], sign[who]))
        who, low, high = who[by], low[by], high[by]
        same = np.concatenate([[0], np.nonzero((sign[who][1:] != sign[who][:-1]) | (doc[who][1:] != doc[who][:-1]))[0] + 1])
        rows = []
        for i, j in zip(same.tolist(), [*same[1:].tolist(), len(who)], strict=True):
            rows.append((int(sign[who[i]]), int(doc[who[i]]), np.stack([low[i:j], high[i:j]], axis=1).astype("<i8").tobytes()))
        yield _rows(rows, _RANGES)


def _merge(ranges: np.ndarray) -> np.ndarray:
    """Maximal runs of the union of (start, stop) ranges."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    cut = np.nonzero(ranges[1:, 0] > reach[:-1])[0] + 1
    return np.stack([ranges[np.concatenate([[0], cut]), 0], reach[np.concatenate([cut - 1, [len(ranges) - 1]])]], axis=1)


def kept_bytes(raw: bytes, spans: list) -> bytes:
    out, at = [], 0
    for s in spans:
        out.append(raw[at : s["start"]])
        at = s["stop"]
    return b"".join([*out, raw[at:]])


_FINISHED = pa.schema([_STATE.field(n) for n in _OUT])


def _finish(batches):
    for batch in batches:
        rows = []
        for doc, text, ranges, sign in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            raw, spans = _unzip(text), []
            if ranges:
                spans = [{"start": a, "stop": b} for a, b in _merge(np.frombuffer(b"".join(ranges), dtype="<i8").reshape(-1, 2)).tolist()]
            rows.append((doc, len(raw), spans, hashlib.sha256(kept_bytes(raw, spans)).hexdigest(), sign))
        yield _rows(rows, _FINISHED)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256, sign): the maximal removed byte runs of each document; ``sign`` is a hash of its text."""
    # a bucket is a partition: as many as keep each one small, whatever the size of the table
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_of().alias("text")).withColumn("sign", F.xxhash64("text")).withColumn("second", F.xxhash64(F.lit(7), "text"))
    firsts = rows.groupBy("sign", "second").agg(F.min("doc_id").alias("first")).groupBy("sign").agg(F.collect_list(F.struct("second", "first")).alias("firsts"))
    block = "bucket int, told boolean, blob binary"
    dealt = rows.where(F.octet_length("text") >= WIDTH).select("sign", "second", "text").mapInArrow(lambda b: _deal_anchors(b, count), block)
    shared = dealt.repartitionById(count, F.col("bucket")).mapInArrow(lambda b: _shared_anchors(b, count), block)
    told = shared.repartitionById(count, F.col("bucket")).mapInArrow(_by_text, "sign long, own binary")
    known = materialize(firsts.join(told, "sign", "left"), "anchors")
    state = materialize(rows.join(known, "sign").select("doc_id", "text", "sign", "second", "firsts", "own").mapInArrow(_judge, _STATE_DDL), "state")
    discard(known)
    open_ = state.where(F.col("text").isNotNull())
    contexts = open_.select("doc_id", "sign", "text", "own").mapInArrow(lambda b: _deal_contexts(b, count), "bucket int, blob binary")
    ranges = contexts.repartitionById(count, F.col("bucket")).mapInArrow(_cover, "sign long, doc_id long, ranges binary").groupBy("sign", "doc_id").agg(F.collect_list("ranges").alias("ranges"))
    finished = open_.select("sign", "doc_id", "text").join(ranges, ["sign", "doc_id"], "left").select("doc_id", "text", "ranges", "sign").mapInArrow(_finish, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept_sha256 string, sign long")
    out = state.where(F.col("text").isNull()).select(*_OUT).unionByName(finished)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans, kept): each text, its removed byte runs and its remaining bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = repeated_spans(rows).select(F.col("doc_id").alias("_id"), "spans", "sign").dropDuplicates(["_id", "sign"])
    met = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(rows["text"]) == found["sign"])).select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            kept = [kept_bytes(t.encode(), s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.binary())], names=["doc_id", "text", "spans", "kept"])

    return met.mapInArrow(run, "doc_id long, text string, spans array<struct<start:long,stop:long>>, kept binary")


def digest(spans: DataFrame) -> DataFrame:
    """Counts from the spans of ``repeated_spans``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return spans.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
