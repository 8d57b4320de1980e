"""Operator 10: near-duplicate documents by Order MinHash and banded alignment.

The shingles of a text are its runs of five words, labelled with their
occurrence (first, second, ...).  Each of ``SKETCHES`` sketches takes, under its own
permutation, the ``ORDER`` least labelled shingles and keeps them in text order, so
it agrees only between texts that share them in that order.  Two texts with a
likeness of 0.8 agree in a sketch with probability about 0.41, and in none of 30
with 1.3e-7.

Equal texts are one node.  In each bucket of agreeing sketches all nodes are
compared with the least one, its hub, so a bucket of n costs n comparisons.  A pair
is linked if its shingle sets have a Jaccard likeness of 0.8 and the words an edit
similarity of 0.8 by banded alignment.

Members of one bucket can be linked to each other and not to the hub.  A bucket of
several components is compared with a second hub, its node with the most links so
far.  What then still has several components is finished by a complete step: each
node outside the bucket's largest component meets all nodes of other components.
The step is exact, so classes are the components of all similar pairs that agree in
a sketch.  It runs in blocks: shingles are counted in ``CELLS`` cells, and only
pairs whose cells can hold enough common shingles are compared word by word.

A node is a text, told by two hashes, whatever the ids of its rows; copies meet their
node by hash and a salt, so a large group of copies is not one task's.

Cases: null and empty texts are equal texts, one class; texts without a word are
linked to equal texts only; a text under five words has one shingle, all its
words; every row counts by its text, so rows with equal or null doc_ids are in one
class only if their texts are; a class without any id has the class_id null.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import discard, materialize, release_memory, text_of, words
from cairn.llm.components import components

SHINGLE, SKETCHES, ORDER, LIKE = 5, 30, 4, 0.8
#: Complete step: nodes and bytes of text in a block, nodes that meet it in one part, cells of the counts.
BLOCK, BLOCK_BYTES, PART, CELLS = 512, 32_000_000, 2000, 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_ADD = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_MUL = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)


class Codes:
    """Hash of each word, kept while there are not too many."""

    def __init__(self, most: int = 200_000):
        self.known, self.most = {}, most

    def of(self, text: str | None) -> np.ndarray:
        w = words(text)
        known = self.known
        if len(known) > self.most:
            known.clear()
        for x in set(w).difference(known):
            known[x] = xxhash.xxh3_64_intdigest(x)
        return np.fromiter(map(known.__getitem__, w), dtype=np.uint64, count=len(w))


def shingle(codes: np.ndarray) -> np.ndarray:
    """Hash of each run of five words; of all words where there are fewer."""
    if not len(codes):
        return codes
    size = min(SHINGLE, len(codes))
    n = len(codes) - size + 1
    h = _mix(codes[:n] + np.uint64(size))
    for j in range(1, size):
        h = _mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + codes[j : j + n])
    return h


def label(h: np.ndarray) -> np.ndarray:
    """The hashes with their occurrence number mixed in."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return h
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(h)
    out[order] = np.where(nth == 0, s, _mix(s + nth.astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)))
    return out


def sketches(codes: np.ndarray) -> list[int]:
    """The text's ordered sketches as 64-bit keys; none without a word."""
    if not len(codes):
        return []
    h = label(shingle(codes))
    k = min(ORDER, len(h))
    step = max(1, 2_000_000 // len(h))
    out = []
    for a in range(0, SKETCHES, step):
        v = (h[None, :] ^ _ADD[a : a + step, None]) * _MUL[a : a + step, None]
        v ^= v >> np.uint64(32)
        at = np.argpartition(v, k - 1, axis=1)[:, :k] if k < len(h) else np.tile(np.arange(k), (len(v), 1))
        at.sort(axis=1)
        picked = h[at]
        key = _ADD[a : a + step].copy()
        for j in range(k):
            key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + picked[:, j])
        out += key.view(np.int64).tolist()
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _reach(a: np.ndarray, b: np.ndarray, x: int, y: int) -> int:
    """How far a from x and b from y agree."""
    n, done, step = min(len(a) - x, len(b) - y), 0, 16
    while done < n:
        m = min(step, n - done)
        differ = a[x + done : x + done + m] != b[y + done : y + done + m]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done += m
        step *= 4
    return n


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two word sequences if it is at most ``most``, else None.

    Only the diagonals within the current distance are followed, each to the
    furthest place it reaches, and of them only those from which the last one can
    still be reached with the edits that are left.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    goal, start = n - m, _reach(a, b, 0, 0)
    if goal == 0 and start == n:
        return 0
    edge = np.iinfo(np.int32).min // 2
    low, far = 0, np.array([start], dtype=np.int32)  # furthest places in a, by diagonal from low on
    for e in range(1, most + 1):
        left = most - e
        first, last = max(-e, -m, goal - left), min(e, n, goal + left)
        size = last - first + 1
        old = np.full(size + 2, edge, dtype=np.int32)  # diagonals first - 1 to last + 1
        i, j = max(low, first - 1), min(low + len(far) - 1, last + 1)
        if i <= j:
            old[i - first + 1 : j - first + 2] = far[i - low : j - low + 1]
        d = np.arange(first, last + 1, dtype=np.int32)
        new = np.maximum(np.maximum(old[1:-1], old[:-2]) + 1, old[2:])
        np.minimum(new, np.minimum(n, m + d), out=new)
        new[new < np.maximum(0, d)] = edge
        alive = np.nonzero((new >= 0) & (new < n) & (new - d < m))[0]
        while len(alive):
            x = new[alive]
            alive = alive[a[x] == b[x - d[alive]]]
            if len(alive) <= 4:
                for k in alive.tolist():
                    x = int(new[k])
                    new[k] = x + _reach(a, b, x, x - int(d[k]))
                break
            new[alive] += 1
            x = new[alive]
            alive = alive[(x < n) & (x - d[alive] < m)]
        if first <= goal <= last and new[goal - first] == n:
            return e
        low, far = first, new
    return None


def similar(a: np.ndarray, b: np.ndarray, like: float = LIKE) -> bool:
    """Word sequences with shingle likeness and edit similarity of at least ``like``."""
    if jaccard(shingle(a), shingle(b)) < like:
        return False
    longest = max(len(a), len(b))
    return banded_distance(a, b, int((1 - like) * longest + 1e-9)) is not None


#: Parts of a group of copies when its rows meet their node.
SALTS = 256
NO_ID = -(1 << 63)


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, of, h1, h2, text): ``of`` is the id, or a number for null; two hashes tell texts apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("of"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")


def sketch_table(texts: DataFrame) -> DataFrame:
    """(doc_id, of, h1, h2, keys): the sketches of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("of", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        release_memory()
        codes = Codes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                seen: dict[tuple, list] = {}
                keys = []
                for *h, t in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    if tuple(h) not in seen:
                        seen[tuple(h)] = sketches(codes.of(t))
                    keys.append(seen[tuple(h)])
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(keys, schema.field(4).type)], schema=schema)

    return texts.mapInArrow(run, "doc_id long, of long, h1 long, h2 long, keys array<long>")


def verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, like: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar."""
    known = pairs
    for side in "ab":
        known = known.join(nodes.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("h1", "h2", "of"))), side)
    for side in "ba":
        known = known.join(texts.select(*(F.col(c).alias(f"{c}_{side}") for c in ("h1", "h2", "of")), F.col("text").alias(f"t{side}")), [f"{c}_{side}" for c in ("h1", "h2", "of")])
    both = known.select("a", "b", "ta", "tb")

    def run(batches):
        release_memory()
        codes, last = Codes(), (None, None)
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            out = []
            for i in range(len(a)):
                x = a[i].as_py()
                if last[0] != x:
                    last = (x, codes.of(ta[i].as_py()))
                if similar(last[1], codes.of(tb[i].as_py()), like):
                    out.append((x, b[i].as_py()))
            if out:
                yield _links(out)

    return both.mapInArrow(run, "a long, b long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class Block:
    """Nodes that others are compared with; components that a link joins count as one from then on."""

    def __init__(self):
        self.nodes, self.roots, self.codes, self.rows, self.joined = [], [], [], [], {}
        self.counts = self.sizes = None

    @staticmethod
    def count(codes: np.ndarray) -> np.ndarray:
        return np.bincount((np.unique(shingle(codes)) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).astype(np.int32)

    def add(self, node: int, root: int, codes: np.ndarray) -> None:
        self.nodes.append(node)
        self.roots.append(root)
        self.codes.append(codes)
        self.rows.append(self.count(codes))

    def find(self, root: int) -> int:
        while root in self.joined:
            root = self.joined[root]
        return root

    def links(self, node: int, root: int, rest: bool, codes: np.ndarray, like: float):
        """Links of a node to the block; of two nodes outside the largest component the greater one is asked."""
        if self.rows:
            self.counts, self.rows = np.stack(self.rows), []
            self.sizes = self.counts.sum(axis=1)
        if self.counts is None:
            return
        own = self.count(codes)
        # no cell has more common shingles than the lesser count
        most = np.minimum(self.counts, own).sum(axis=1)
        for i in np.nonzero(most >= like / (1 + like) * (self.sizes + own.sum()) - 1e-6)[0]:
            x, y = self.find(self.roots[i]), self.find(root)
            if x != y and not (rest and self.nodes[i] >= node) and similar(self.codes[i], codes, like):
                self.joined[x] = y
                yield self.nodes[i], node


def _least(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with, in ``value``, its least of all rows with their keys; in parts by ``salt``, so none is large."""
    part = rows.groupBy(*keys, "salt").agg(F.min(value).alias("_part"))
    whole = part.groupBy(*keys).agg(F.min("_part").alias("_least"))
    return rows.drop(value).join(part.join(whole, keys).select(*keys, "salt", F.col("_least").alias(value)), [*keys, "salt"])


def _classes(docs: DataFrame, like: float) -> tuple[DataFrame, DataFrame]:
    """((doc_id, of, h1, h2, salt) of all rows, (h1, h2, of, node, root, class_id) of all texts)."""
    texts = _texts(docs)
    table = materialize(sketch_table(texts), "sketches")
    if not table.groupBy("h1", "h2", "of").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():  # rows equal in id and text
        texts = texts.groupBy("h1", "h2", "of").agg(F.first("text").alias("text"))
    rows = table.select("doc_id", "of", "h1", "h2", F.pmod(F.xxhash64("of", "h1"), F.lit(SALTS)).alias("salt"))
    part = rows.groupBy("h1", "h2", "salt").agg(F.min("doc_id").alias("first"))
    # nodes are numbered in order of their ids, null last: a bucket's hub and a class's root is the text of the least id
    order = [F.col("first").asc_nulls_last(), F.col("h1"), F.col("h2")]
    node = part.groupBy("h1", "h2").agg(F.min("first").alias("first")).repartitionByRange(*order).sortWithinPartitions(*order)
    nodes = materialize(node.select("h1", "h2", "first", F.coalesce("first", F.lit(NO_ID)).alias("of"), F.monotonically_increasing_id().alias("node")), "nodes")
    keys = table.join(nodes, ["h1", "h2", "of"]).select("node", F.explode("keys").alias("key"))
    hub = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("most")).where("hub <> most").select("key", "hub")
    bucket = materialize(keys.join(hub, "key").select("key", "hub", "node").distinct(), "buckets")
    star = materialize(verify(bucket.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), nodes, texts, like), "star")
    root = components(star)
    for step in (lambda known: verify(_second_hub(known, star), nodes, texts, like), lambda known: _complete(known, nodes, texts, like)):
        open_ = _open(bucket, root)
        found = materialize(step(open_).distinct(), "links")
        if not found.isEmpty():
            old, root = root, components(root.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(found))
            discard(old)
        discard(open_, found)
    known = nodes.join(root.withColumnRenamed("id", "node"), "node", "left").select("h1", "h2", "of", "node", F.coalesce("root", "node").alias("root"), F.pmod("node", F.lit(SALTS)).alias("salt"), F.col("first").alias("class_id"))
    classes = materialize(_least(known, ["root"], "class_id"), "classes")
    discard(bucket, star, root, nodes)
    return rows, classes


def near_duplicates(docs: DataFrame, *, like: float = LIKE) -> DataFrame:
    """(doc_id, class_id) for each row: class_id is the least doc_id of its class."""
    rows, known = _classes(docs, like)
    salted = rows.select("h1", "h2", "salt").distinct().join(known.select("h1", "h2", "class_id"), ["h1", "h2"])
    return rows.join(salted, ["h1", "h2", "salt"]).select("doc_id", "class_id")


def _open(bucket: DataFrame, root: DataFrame) -> DataFrame:
    """(key, hub, node, root) of the buckets that have several components; of buckets with the same nodes one stands for all."""
    known = bucket.join(root.withColumnRenamed("id", "node"), "node", "left").select("key", "hub", "node", F.coalesce("root", "node").alias("root"))
    nodes = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    several = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), *nodes).where("low <> high")
    return materialize(known.join(several.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key"), "open")


def _second_hub(known: DataFrame, star: DataFrame) -> DataFrame:
    """Pairs of nodes of different components, one of them the bucket's node with most links that is not its hub."""
    linked = star.select("a").unionByName(star.select(F.col("b").alias("a"))).groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("a", "node")
    second = known.where("node <> hub").join(linked, "node", "left").groupBy("key").agg(F.max(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.col("node")).alias("order"), "node", "root")).alias("second"))
    met = known.join(second, "key").where("root <> second.root")
    return met.select(F.least("node", "second.node").alias("a"), F.greatest("node", "second.node").alias("b")).distinct()


def _complete(known: DataFrame, nodes: DataFrame, texts: DataFrame, like: float) -> DataFrame:
    """Links (a, b) of every two components of a bucket between which any is.

    The nodes outside its largest component are dealt to blocks, all its nodes
    to parts, and each part meets each block.
    """
    open_ = nodes.join(known.select("node").distinct(), "node").select("node", "h1", "h2", "of")
    text = materialize(texts.join(open_, ["h1", "h2", "of"]).select("node", "text"), "texts")
    sized = known.join(text.select("node", F.length("text").alias("size")), "node")
    largest = sized.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).groupBy("key").agg(F.max(F.struct("n", "root", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks = F.ceil(F.greatest((F.col("n") - F.col("top.n")) / BLOCK, (F.col("size") - F.col("top.size")) / BLOCK_BYTES, F.lit(1.0)))
    dealt = known.join(largest.select("key", F.col("top.root").alias("top"), blocks.alias("blocks"), F.ceil(F.col("n") / PART).alias("parts")), "key").withColumn("rest", F.col("root") != F.col("top"))
    number = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))
    one = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)) + 1
    held = dealt.where("rest").select("key", one("blocks", 1).alias("block"), number("parts").alias("part"), F.lit(0).alias("side"), "node", "root", "rest")
    asked = dealt.select("key", number("blocks").alias("block"), one("parts", 2).alias("part"), F.lit(1).alias("side"), "node", "root", "rest")
    met = held.unionByName(asked).join(text, "node").select("key", "block", "part", "side", "node", "root", "rest", "text")

    def run(batches):
        release_memory()
        codes, group, block = Codes(), None, None
        for batch in batches:
            out = []
            for *at, side, node, root, rest, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != group:
                    group, block = at, Block()
                if side:
                    out += block.links(node, root, rest, codes.of(t), like)
                else:
                    block.add(node, root, codes.of(t))
            if out:
                yield _links(out)

    return met.repartition("key", "block", "part").sortWithinPartitions("key", "block", "part", "side").mapInArrow(run, "a long, b long").distinct()


def keep_representatives(docs: DataFrame, *, like: float = LIKE) -> DataFrame:
    """The rows of ``docs``, all columns: of each class one row, of its text with the least doc_id."""
    _, known = _classes(docs, like)
    least = known.where("node = root").select("h1", "h2", F.col("of").alias("_of"))
    packed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_of"), F.xxhash64(text_of()).alias("h1"), F.xxhash64(F.lit(7), text_of()).alias("h2"))
    met = packed.join(least, ["h1", "h2", "_of"], "left_semi")
    # what is left are rows equal in id and text: one of them
    single = met.groupBy("h1", "h2", "_of").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return met.select("row.*") if single else met.groupBy("h1", "h2", "_of").agg(F.first("row").alias("row")).select("row.*")
