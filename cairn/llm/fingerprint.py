"""Operator 1: context-triggered piecewise hashing.

A polynomial hash rolls over seven bytes.  Where it is ``-1`` modulo the block
size a chunk ends, and the chunk's hash gives one of 64 characters.  The block
size is the smallest 3 * 2^k whose 64 blocks cover the text, halved while the
signature has under 32 characters.  A fingerprint is ``block:sig:sig2`` with the
signatures at the block size and at its double; past 64 (32) characters the
rest is one chunk.  Two fingerprints are compared where their block sizes are
equal or one is the double of the other, by the share of characters that stay
under an insert-delete edit distance, if they have a run of characters in common.

Cases: null is the empty text, whose fingerprint is ``3::``; equal texts have
equal fingerprints and likeness 1; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize, text_of

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, LEAST, LONG, RUN = 7, 3, 64, 5


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the seven bytes that end at each place (fewer at the start)."""
    x = data.astype(np.uint32) + np.uint32(1)
    h = x.copy()
    factor = 1
    for j in range(1, min(WINDOW, len(x))):
        factor = factor * 0x01000193 & 0xFFFFFFFF
        h[j:] += x[:-j] * np.uint32(factor)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def _signature(raw: bytes, ends: np.ndarray, most: int) -> str:
    """A character for each chunk; the last takes all that is left."""
    cuts = ends[: most - 1].tolist()
    out, start = [], 0
    for e in cuts:
        out.append(ALPHABET[zlib.crc32(raw[start : e + 1]) % 64])
        start = e + 1
    if start < len(raw):
        out.append(ALPHABET[zlib.crc32(raw[start:]) % 64])
    return "".join(out)


def fingerprint(raw: bytes) -> str:
    block = LEAST
    while block * LONG < len(raw):
        block *= 2
    if not raw:
        return f"{block}::"
    h = rolling(np.frombuffer(raw, dtype=np.uint8))
    b = np.uint32(block)
    ends = np.nonzero(h % b == b - np.uint32(1))[0]
    while len(ends) < LONG // 2 and block > LEAST:
        block //= 2
        b = np.uint32(block)
        ends = np.nonzero(h % b == b - np.uint32(1))[0]
    twice = np.uint32(2 * block)
    return f"{block}:{_signature(raw, ends, LONG)}:{_signature(raw, ends[h[ends] % twice == twice - np.uint32(1)], LONG // 2)}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    if not a or not b:
        return 0
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & place.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - bin(row).count("1")


def _score(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(RUN, len(a), len(b))
    if not run:
        return 0.0
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in runs for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1: the best score over the block sizes that both have."""
    if one == other:
        return 1.0
    (a, a1, a2), (b, b1, b2) = one.split(":"), other.split(":")
    a, b = int(a), int(b)
    if a == b:
        return max(_score(a1, b1), _score(a2, b2))
    if a == 2 * b:
        return _score(a1, b2)
    if b == 2 * a:
        return _score(a2, b1)
    return 0.0


def edited(text: str, after: str) -> str:
    """The last half of ``text`` replaced by as many characters from the start of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t.encode()) for t in texts])], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_ROW = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(doc_id, text: str, mark: str, after: str, after_mark: str) -> tuple:
    new = edited(text, after).encode()
    new_mark = fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new).hexdigest(), mark, new_mark, likeness(mark, new_mark), likeness(mark, after_mark)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _ROW, strict=True)], names=[n for n, _ in _ROW])


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, and its likeness to its edited text and to the next document's.

    One range shuffle by doc_id and hash brings neighbours together.  What crosses a
    partition's edge, its first and last document, is written with the rows and
    joined afterwards; the last document of all meets the first (alone: itself).
    Equal ids are ordered by a hash of their text; null ids come first.
    """
    edge = [("kind", pa.string()), ("part", pa.int32()), ("text", pa.string())]
    schema = pa.schema([*_ROW, *edge])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("sign", F.xxhash64("text")).repartitionByRange(n, "doc_id", "sign")  # many rows of one id are no one task's
    dealt = ranged.sortWithinPartitions("doc_id", "sign", "text").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        part, last, out = TaskContext.get().partitionId(), None, []
        blank = (None, None, None)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mark = fingerprint(text.encode())
                if last is None:
                    out.append((doc_id, None, None, mark, None, None, None, "first", part, text))
                else:
                    out.append((*_compare(*last, text, mark), *blank))
                last = doc_id, text, mark
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((last[0], None, None, last[2], None, None, None, "last", part, last[1]), schema, strict=True)], schema=schema)

    made = materialize(dealt.mapInArrow(run, f"{_DDL}, kind string, part int, text string"), "fingerprints")
    # Two rows a partition: the order of the partitions that have rows, without their texts.
    order = Window.orderBy("part")
    parts = made.where("kind = 'last'").select("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("next_part"))
    ends = made.where("kind = 'last'").select("part", F.col("doc_id").alias("d"), F.col("text").alias("t"), F.col("fingerprint").alias("m"))
    heads = made.where("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("nt"), F.col("fingerprint").alias("nm"))
    met = ends.join(after, "part").join(heads, "next_part").select("d", "t", "m", "nt", "nm")

    def close(batches):
        for batch in batches:
            got = [_compare(r["d"], r["t"], r["m"], r["nt"], r["nm"]) for r in batch.to_pylist()]
            if got:
                yield _batch(got)

    return made.where("kind is null").select(*[n for n, _ in _ROW]).unionByName(met.mapInArrow(close, _DDL))
