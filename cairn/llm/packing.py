"""Operator 2: packing by concatenate and cut.

Pass one tokenizes every document once and writes its ids with the partition
they were made in and their offset there.  The partitions' totals, one row
each, get prefix sums; adding them gives every document its global offset.
Pass two cuts at the multiples of the sequence length: a document that crosses
a boundary leaves a record on both sides.  Only the last sequence can be short.

Control strings of the tokenizer in a text give their ids, as encoding the whole text does.

Cases: null text is empty; an empty text is the end id alone; equal rows are
packed each; a text of any length is one document in many pieces; an empty table
gives no pieces.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize, release_memory, text_of

#: Marks that end a word and are a token run of their own behind letters.
MARKS = ".,;:!?|*&%#$"
#: Letters whose lower case is one letter too.
PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: Most cores that a worker keeps in each of two generations.
CACHE_CORES = 300_000


class WordEncoder:
    """Ids of texts, word by word, for a tokenizer that never joins across white space.

    A word of plain letters is its lower-cased core and the marks behind it; any
    other word is taken whole.  Each distinct core is encoded once while one of
    two generations of the cache holds it; words are told apart and put together
    in arrays.  The result equals that of encoding the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # texts with a control string of the tokenizer are encoded as they are
        special = list(self.tok.get_added_tokens_decoder().values())
        self.folded = any(t.normalized for t in special)  # looked for in the normalised text
        self.special = "|".join(re.escape(t.content) for t in special)
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.cores: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, missing: list[str]) -> None:
        """Encode cores: runs of letters as one text with one word end each, the others apart."""
        plain = [w for w in missing if w.isalpha()]
        for a in range(0, len(plain), 5000):
            part = plain[a : a + 5000]
            ids = np.array(self.tok.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            cut = np.nonzero(self.ends[ids])[0] + 1
            if len(cut) != len(part):  # a letter to Python that is none to the tokenizer
                for w in part:
                    self.cores[w] = self._whole(w)
                continue
            data, start = ids.tobytes(), 0
            for w, stop in zip(part, (cut * 4).tolist(), strict=True):
                self.cores[w] = data[start:stop]
                start = stop
        for w in missing:
            if not w.isalpha():
                self.cores[w] = self._whole(w)

    def _resolve(self, distinct: list[str]) -> list[bytes]:
        """Ids of each distinct core, as bytes."""
        if len(self.cores) > CACHE_CORES:
            self.older, self.cores = self.cores, {}
        found = list(map(self.cores.get, distinct))
        absent = [w for w, x in zip(distinct, found, strict=True) if x is None]
        if not absent:
            return found
        for w, x in zip(absent, map(self.older.get, absent), strict=True):
            if x is not None:
                self.cores[w] = x
        self._learn([w for w in absent if w not in self.cores])
        return list(map(self.cores.__getitem__, distinct))

    def encode(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each with ``end``; where each starts, and the end of all)."""
        marked = pc.match_substring_regex(texts, self.special, ignore_case=self.folded).to_numpy(zero_copy_only=False) if self.special else np.zeros(len(texts), dtype=bool)
        if not marked.any():
            return self._encode(texts, end)
        flat, edge = self._encode(pc.if_else(pa.array(marked), "", texts), end)
        tail = np.array(end, dtype="<u4").tobytes()
        parts = [self._whole(texts[i].as_py()) + tail if m else flat[edge[i] : edge[i + 1]].tobytes() for i, m in enumerate(marked.tolist())]
        return np.frombuffer(b"".join(parts), dtype="<u4"), np.cumsum([0] + [len(p) // 4 for p in parts])

    def _encode(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without a control string."""
        split = pc.ascii_split_whitespace(texts)  # other white space stays inside words, which then are taken whole
        edge = split.offsets.to_numpy().astype(np.int64)
        edge -= edge[0]
        coded = split.flatten().dictionary_encode()
        word = coded.dictionary
        bare = pc.utf8_rtrim(word, characters=MARKS)
        plain = pc.match_substring_regex(bare, PLAIN)
        core = pc.if_else(plain, pc.utf8_lower(bare), word).dictionary_encode()
        # marks are the rest of a plain word: empty for the others
        rest = pc.if_else(plain, pc.binary_length(word), 0).to_numpy() - pc.if_else(plain, pc.binary_length(bare), 0).to_numpy()
        marks = np.zeros(len(word), dtype=np.int64)
        tail = np.nonzero(rest)[0]
        tails = [w[-n:] for w, n in zip(word.take(pa.array(tail)).to_pylist(), rest[tail].tolist(), strict=True)]
        names = {m: i + 1 for i, m in enumerate(dict.fromkeys(tails))}
        marks[tail] = [names[m] for m in tails]
        pieces = self._resolve(core.dictionary.to_pylist() + list(names))
        known = len(core.dictionary)
        pieces = [b"", *pieces[known:], *pieces[:known], np.array(end, dtype="<u4").tobytes()]
        size = np.fromiter(map(len, pieces), dtype=np.int32, count=len(pieces)) // 4
        ids = np.frombuffer(b"".join(pieces), dtype="<u4")
        start = np.cumsum(size, dtype=np.int32) - size
        at = coded.indices.to_numpy()
        first = core.indices.to_numpy() + np.int32(len(names) + 1)
        order = np.stack([first[at], marks[at].astype(np.int32)], axis=1).ravel()  # a core and its marks for each word
        order = np.insert(order, 2 * edge[1:], len(pieces) - 1)
        length = size[order]
        stop = np.cumsum(length)  # 32 bits do for where a piece is, not for a very long text
        where = np.repeat((start[order] - stop + length), length)
        where += np.arange(len(where))
        flat = ids[where]
        return flat, np.concatenate([[0], stop[2 * edge[1:] + np.arange(len(texts))]])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _chunks(column: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text, so one batch of long texts stays small."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        size += n or 0
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(column):
        yield start, len(column)


def tokenize(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1) -> DataFrame:
    """(doc_id, part, local, n_tokens, ids): ids with the end id, and the place in their partition."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        release_memory()
        part, local, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer_path)
        for batch in batches:
            for a, b in _chunks(batch.column(1)):
                flat, edge = enc.encode(batch.column(1).slice(a, b - a), [end_id])
                n = np.diff(edge)
                ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((edge * 4).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([part] * len(n), pa.int32()), pa.array(local + edge[:-1]), pa.array(n), ids], schema=schema)
                local += int(edge[-1])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, part int, local long, n_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, *, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    made = materialize(tokenize(docs, tokenizer_path, end_id=end_id), "tokens")
    totals = made.groupBy("part").agg(F.max(F.col("local") + F.col("n_tokens")).alias("total"))
    # One row for each partition of pass one: its number bounds both the window and the broadcast.
    before = totals.select("part", (F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("n_tokens") - 1) / length)
    cut = made.join(F.broadcast(before), "part").withColumn("at", F.col("before") + F.col("local")).withColumn("sequence_id", F.explode(F.sequence(first, last)))
    start = F.greatest(F.lit(0).cast("long"), F.col("sequence_id") * length - F.col("at"))
    stop = F.least(F.col("n_tokens"), (F.col("sequence_id") + 1) * length - F.col("at"))
    return cut.select(
        "doc_id",
        start.alias("start"),
        (stop - start).alias("length"),
        F.col("n_tokens").alias("doc_tokens"),
        "sequence_id",
        (F.col("at") + start - F.col("sequence_id") * length).alias("offset"),
        F.substring("ids", (start * 4 + 1).cast("int"), ((stop - start) * 4).cast("int")).alias("ids"),
    )
