"""Operator 5: benchmark decontamination by seeds and local alignment.

The benchmark is taken in blocks of bounded size.  For a block, one pass finds
the word n-grams of its items in each document, cuts the passage around them and
aligns it with the item by Smith-Waterman over words (match 1, mismatch and gap
-1).  A pair is contaminated if the score reaches ``min_score`` of the item's
words, so edited, cut and paraphrased copies are found.  All n-grams of an item
are seeds, however many documents hold them; what common ones find is dropped
before alignment by exact bounds on the words in common.

Cases: null and empty texts and items contain nothing; an item shorter than the
n-gram is its own seed; repeated rows are judged each; equal items each match.
Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import release_memory, text_of, words

#: Most benchmark bytes held by a task at once; a larger benchmark takes more blocks.
BLOCK_BYTES = 8_000_000
PAIR = "doc_id long, item_id long, score double, start_word long, stop_word long, item_words long"


def align(item: list, passage: list) -> tuple[int, int, int]:
    """Best local alignment: (score, start, stop) with the passage's words from start to stop.

    Row by row over the item; gaps inside a row are closed by a running maximum.
    """
    if not item or not passage:
        return 0, 0, 0
    code = {w: i for i, w in enumerate(dict.fromkeys(item))}
    p = np.array([code.get(w, -1) for w in passage])
    m = len(p)
    step = np.arange(1, m + 1)
    row, begin = np.zeros(m + 1, dtype=np.int64), np.arange(m + 1)
    best = (0, 0, 0)
    for w in item:
        diag = row[:-1] + np.where(p == code[w], 1, -1)
        up = row[1:] - 1
        new = np.maximum(np.maximum(diag, up), 0)
        src = np.where(diag >= up, begin[:-1], begin[1:])
        src = np.where(new == 0, step, src)
        # a gap in the item: new[j] = max over i <= j of new[i] - (j - i)
        key = new + step
        run = np.maximum.accumulate(key)
        at = np.maximum.accumulate(np.where(key == run, step, 0)) - 1
        gap = run - step
        src = np.where(gap > new, src[at], src)
        new = np.maximum(new, gap)
        row = np.concatenate([[0], new])
        begin = np.concatenate([[0], src])
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(begin[j]), j)
    return best


def ngrams(w: list[str], n: int) -> list[tuple]:
    return [tuple(w)] if 0 < len(w) < n else list(zip(*(w[i:] for i in range(n)), strict=False))


def _blocks(benchmark: DataFrame):
    """Items in blocks of at most BLOCK_BYTES (or one item), streamed one partition at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", text_of().alias("text")).toLocalIterator():
        w = words(r["text"])
        if w:
            if block and size + len(r["text"]) > BLOCK_BYTES:
                yield block
                block, size = [], 0
            block.append((r["item_id"], w))
            size += len(r["text"])
    if block:
        yield block


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, *, n: int = 3, min_score: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, start_word, stop_word, item_words) for each document that holds an item."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = spark.createDataFrame([], PAIR)
    for block in _blocks(benchmark):
        out = out.unionByName(_block_pairs(rows, block, n, min_score))
    return out


def seeds_of(block: list[tuple[int, list[str]]], n: int) -> dict[tuple, list[int]]:
    """Seed n-gram -> places of its items in the block."""
    seeds = defaultdict(list)
    for k, (_, w) in enumerate(block):
        for g in dict.fromkeys(ngrams(w, n)):
            seeds[g].append(k)
    return dict(seeds)


def _may_reach(passage: list[str], bag: dict[str, int], need: float, size: int) -> bool:
    """Whether an alignment of ``need`` can be in the passage: the score can't be above the words in common."""
    left, shared = dict(bag), 0
    for x in passage:
        n = left.get(x, 0)
        if n:
            left[x] = n - 1
            shared += 1
    if shared < need:
        return False
    span = int(2 * size - need) + 1  # at most size matches, and as many words between them as keep the score
    if len(passage) <= span:
        return True
    total = np.concatenate([[0], np.cumsum(np.fromiter((x in bag for x in passage), dtype=np.int64, count=len(passage)))])
    return int((total[span:] - total[:-span]).max()) >= need


def match_document(w: list[str], block, seeds: dict, bags: list[dict], sizes: list[int], min_score: float) -> list[tuple]:
    """(place in block, score, start, stop) of the best alignment of each item found in the document's words."""
    hits = defaultdict(list)
    get = seeds.get
    for k in sizes:
        for i, g in enumerate(zip(*(w[j:] for j in range(k)), strict=False)):
            for item in get(g, ()):
                hits[item].append(i)
    found, known = [], set(w) if hits else ()
    for k, at in hits.items():
        item = block[k][1]
        need, reach, best = min_score * len(item), 2 * len(item), None
        if sum(c for x, c in bags[k].items() if x in known) < need:
            continue
        at.sort()
        group = [at[0], at[0]]
        for i in [*at[1:], None]:
            if i is not None and i - group[1] <= reach:
                group[1] = i
                continue
            low = max(0, group[0] - reach)
            passage = w[low : group[1] + reach]
            if _may_reach(passage, bags[k], need, len(item)):
                score, a, b = align(item, passage)
                if score >= need and (best is None or score > best[0]):
                    best = (score, low + a, low + b)
            if i is not None:
                group = [i, i]
        if best:
            found.append((k, *best))
    return found


def _prepare(rows: DataFrame, block, n: int):
    """(broadcast of block, seeds and word counts; n-gram sizes)."""
    seeds = seeds_of(block, n)
    bags = [{x: w.count(x) for x in set(w)} for _, w in block]
    return rows.sparkSession.sparkContext.broadcast((block, seeds, bags)), sorted({len(g) for g in seeds})  # BLOCK_BYTES bounds it


def _block_pairs(rows: DataFrame, block, n: int, min_score: float) -> DataFrame:
    shared, sizes = _prepare(rows, block, n)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("stop_word", pa.int64()), ("item_words", pa.int64())])

    def run(batches):
        block, seeds, bags = shared.value
        for batch in batches:
            got = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, score, a, b in match_document(words(text), block, seeds, bags, sizes, min_score):
                    item, w = block[k]
                    got.append((doc, item, score / len(w), a, b, len(w)))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), schema.types, strict=True)], schema=schema)

    return rows.mapInArrow(run, PAIR)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 3, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item; no shuffle of texts."""
    out = docs
    for block in _blocks(benchmark):
        shared, sizes = _prepare(docs, block, n)

        def run(batches, shared=shared, sizes=sizes):
            release_memory()
            block, seeds, bags = shared.value
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                keep = [not match_document(words(t), block, seeds, bags, sizes, min_score) for t in texts]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
