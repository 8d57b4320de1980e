"""Operator 4: line dedup by a log-template tree.

A line goes down a tree of fixed depth: its token count, then its ``DEPTH`` leading
tokens, tokens with a digit, an ``@`` or ``://`` being a variable field ``<*>``.
The leaf that it reaches is open if ``min_docs`` documents have a line there.  An
open leaf generalises its lines position by position: a token stays a constant of
the leaf if ``min_docs`` documents have it at that position, else it is a variable
field.  So lines that differ in any number of fields, marked or not, share a
template, and none of this depends on the order of lines or gathers a leaf: leaves,
constants and templates are counts by key.

A template in ``min_docs`` documents or more is recurring if at least ``CONSTANT`` of
its tokens are constants.  A line of ``REPEATED`` or more words that are not variable
says enough by itself: without generalisation, it is recurring from ``TWO`` documents
on.  Recurring lines are dropped from all documents but the one with the smallest
doc_id, so copies of a whole document never lose its content altogether.  Lines that
fewer than ``min_docs`` documents have stay where they are more than half of the
document's words: that is a copy of a document, which near-dedup finds as long as it
is whole, and no passage repeated in another text.

Cases: null text stays null and has no lines; an empty text has one empty line;
lines with fewer than ``min_tokens`` tokens (with the default: empty ones) are always
kept; the same line twice in a document counts once; rows with equal doc_id count as
documents of their own but all keep lines as the first one; documents with a null
doc_id come behind all others, by a hash of their text, and equal ones of them keep the
same lines (a line that only they hold needs ``min_docs``).  Lines of any length are
parsed whole.  Other columns pass through; the counts are in a struct behind them,
named ``_lines`` with as many underscores more as make it a new name.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import materialize, release_memory

DEPTH, CONSTANT, FIELD = 3, 0.6, "<*>"
#: Words of a line that recurs as it is from TWO documents on.
REPEATED, TWO = 20, 2
VARIABLE = re.compile(r"[\d@]|://")
#: Leaves, constants and templates that may be broadcast; beyond, documents are joined with their own.
BROADCAST_KEYS = 500_000
_M = (1 << 64) - 1


def mask(line: str) -> list[str]:
    """The line's tokens with variable ones replaced."""
    tokens = line.split()
    if VARIABLE.search(line):
        tokens = [FIELD if VARIABLE.search(t) else t for t in tokens]
    return tokens


def _signed(x: int, bit: int) -> int:
    """A 64-bit key; its lowest bit tells whole lines from nodes of the tree."""
    x = x & ~1 | bit
    return x - (1 << 64) if x >> 63 else x


def leaf_of(tokens: list[str]) -> int:
    return _signed(xxhash.xxh3_64_intdigest("\x1f".join(tokens[:DEPTH]), seed=len(tokens)), 0)


def whole_line(tokens: list[str]) -> int | None:
    """Key of a line that says enough by itself."""
    if len(tokens) < REPEATED or len(tokens) - tokens.count(FIELD) < REPEATED:
        return None
    return _signed(xxhash.xxh3_64_intdigest("\x1f".join(tokens)), 1)


def constants_of(tokens: list[str], leaf: int) -> list[int]:
    """One key for each position behind the leading tokens."""
    h = xxhash.xxh3_64_intdigest
    return [_signed(h(t, seed=(leaf + j) & _M), 0) for j, t in enumerate(tokens[DEPTH:])]


def template_of(tokens: list[str], leaf: int, constants) -> tuple[int, list[str]] | None:
    """(key, tokens) of the line's template at its leaf; None if too little of it is constant."""
    tail = [t if t == FIELD or k in constants else FIELD for t, k in zip(tokens[DEPTH:], constants_of(tokens, leaf), strict=True)]
    out = tokens[:DEPTH] + tail
    if len(out) - out.count(FIELD) < CONSTANT * len(out):
        return None
    return _signed(xxhash.xxh3_64_intdigest("\x1f".join(tail), seed=leaf & _M), 0), out


class Known:
    """What is known of the tree: open leaves, constants, and the first document of what recurs."""

    def __init__(self, leaves=(), constants=(), lines=(), templates=()):
        self.leaves, self.constants = frozenset(leaves), frozenset(constants)
        self.lines, self.templates = dict(lines), dict(templates)

    def recurs(self, tokens: list[str], doc: int | None, sign: int) -> int:
        """2 if the line's template recurs, 1 if only the line itself does, 0 if neither or the document is the first one."""
        leaf = leaf_of(tokens)
        found = template_of(tokens, leaf, self.constants) if leaf in self.leaves else None
        first = self.templates.get(found[0]) if found else None
        if first is not None and first != ((doc, None) if doc is not None else (None, sign)):
            return 2
        whole = whole_line(tokens)
        first = self.lines.get(whole) if whole is not None else None
        return int(first is not None and first != (doc, None))


def _nodes(tokens: list[str], known: Known) -> list[int]:
    whole = whole_line(tokens)
    return [leaf_of(tokens)] if whole is None else [leaf_of(tokens), whole]


def _constants(tokens: list[str], known: Known) -> list[int]:
    leaf = leaf_of(tokens)
    return constants_of(tokens, leaf) if leaf in known.leaves else []


def _templates(tokens: list[str], known: Known) -> list[int]:
    leaf = leaf_of(tokens)
    found = template_of(tokens, leaf, known.constants) if leaf in known.leaves else None
    return [found[0]] if found else []


_PARTS = ("leaves", "constants", "lines", "templates")


def _known(batch: pa.RecordBatch, shared):
    """What is known, for each row: shared by all, or the row's own."""
    if shared is not None:
        return lambda i: shared
    parts = {n: batch.column(batch.schema.get_field_index(n)) for n in _PARTS if n in batch.schema.names}
    pairs = lambda x: [(h["key"], (h["first_doc"], h["first_sign"])) for h in x or ()]
    keys = lambda x: [h["key"] for h in x or ()]
    return lambda i: Known(**{n: (keys if n in _PARTS[:2] else pairs)(c[i].as_py()) for n, c in parts.items()})


def _emit(rows: DataFrame, step, shared, min_tokens: int) -> DataFrame:
    """(key, doc_id, sign) once for each key of each document."""

    def run(batches):
        release_memory()
        tree = shared.value if shared is not None else None
        for batch in batches:
            known = _known(batch, tree)
            found, owner, sign = [], [], []

            def block():
                return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(owner, pa.int64()), pa.array(sign, pa.int64())], names=["key", "doc_id", "sign"])

            for i, (doc, text, s) in enumerate(zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True)):
                if text is None:
                    continue
                own, tree_of = set(), known(i)
                for line in set(text.split("\n")):
                    tokens = mask(line)
                    if tokens and len(tokens) >= min_tokens:
                        own.update(step(tokens, tree_of))
                found += own
                owner += [doc] * len(own)
                sign += [s] * len(own)
                if len(found) > 200_000:
                    yield block()
                    found, owner, sign = [], [], []
            yield block()

    return rows.mapInArrow(run, "key long, doc_id long, sign long")


def _count(emitted: DataFrame) -> DataFrame:
    """(key, docs, first_doc, first_sign): documents without an id come last, by their sign."""
    found = emitted.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"), F.min(F.when(F.col("doc_id").isNull(), F.col("sign"))).alias("_sign"))
    return found.select("key", "docs", "first_doc", F.when(F.col("first_doc").isNull(), F.col("_sign")).alias("first_sign"))


class Tree:
    """The tree of a table: its parts as tables of keys, and what a scan of documents needs of them."""

    def __init__(self, docs: DataFrame, min_docs: int, min_tokens: int):
        self.min_tokens = min_tokens
        # what tells documents without an id apart; joins need it for all
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("sign"))
        self.parts, self.steps = {}, {}
        slim = self.docs.withColumn("sign", F.when(F.col("doc_id").isNull(), F.col("sign")))
        long = (F.col("key").bitwiseAND(F.lit(1).cast("long")) == 1) & F.col("first_doc").isNotNull()
        nodes = materialize(_count(_emit(slim, _nodes, docs.sparkSession.sparkContext.broadcast(Known()), min_tokens)).where(F.col("docs") >= F.when(long, min(TWO, min_docs)).otherwise(min_docs)), "nodes")
        whole = F.col("key").bitwiseAND(F.lit(1).cast("long")) == 1
        self._add("leaves", nodes.where(~whole), _nodes)
        self._add("lines", nodes.where(whole), _nodes)
        # the lines of open leaves are written, so that the steps at the leaves do not read whole texts
        lines = materialize(self._open_lines(*self.rows(slim)), "lines")
        for name, step in (("constants", _constants), ("templates", _templates)):
            rows, shared = self.rows(lines)
            self._add(name, materialize(_count(_emit(rows, step, shared, min_tokens)).where(F.col("docs") >= min_docs), name), step)

    def _open_lines(self, rows: DataFrame, shared) -> DataFrame:
        """The documents with their distinct lines of open leaves only, as masked tokens."""
        min_tokens = self.min_tokens

        def run(batches):
            release_memory()
            tree = shared.value if shared is not None else None
            for batch in batches:
                known = _known(batch, tree)
                keep, texts = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    if text is None:
                        continue
                    leaves = known(i).leaves
                    own = [" ".join(t) for t in map(mask, set(text.split("\n"))) if t and len(t) >= min_tokens and leaf_of(t) in leaves]
                    if own:
                        keep.append(i)
                        texts.append("\n".join(own))
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(texts, pa.string()), batch.column(2).take(at)], names=["doc_id", "text", "sign"])

        return rows.mapInArrow(run, "doc_id long, text string, sign long")

    def _add(self, name: str, keys: DataFrame, step) -> None:
        self.parts[name], self.steps[name] = keys, step

    def rows(self, docs: DataFrame) -> tuple[DataFrame, object]:
        """(documents, what is known as a broadcast), or documents with their own share of it where it is too much for one."""
        parts = {n: self.parts[n] for n in _PARTS if n in self.parts}
        if sum(p.count() for p in parts.values()) <= BROADCAST_KEYS:
            got = {n: [(r["key"], (r["first_doc"], r["first_sign"])) for r in p.collect()] for n, p in parts.items()}
            return docs, docs.sparkSession.sparkContext.broadcast(Known(**{n: x if n in _PARTS[2:] else [k for k, _ in x] for n, x in got.items()}))
        out, base = docs, {}
        for name in ("leaves", "lines", "constants", "templates"):
            if name not in parts:
                continue
            step = self.steps[name]
            if step not in base:
                base[step] = _emit(out, step, docs.sparkSession.sparkContext.broadcast(Known()) if step is _nodes else None, self.min_tokens)
            own = base[step].join(parts[name].drop("docs"), "key").groupBy(F.col("doc_id").alias("_id"), F.col("sign").alias("_of")).agg(F.collect_set(F.struct("key", "first_doc", "first_sign")).alias(name))
            out = out.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("sign").eqNullSafe(F.col("_of")), "left").drop("_id", "_of")
        return out, None


def recurring_templates(docs: DataFrame, *, min_docs: int = 10, min_tokens: int = 1) -> DataFrame:
    """(key, docs, first_doc, first_sign) of the recurring templates and, with odd keys, of the recurring long lines."""
    tree = Tree(docs, min_docs, min_tokens)
    return tree.parts["lines"].unionByName(tree.parts["templates"])


def dedup_lines(docs: DataFrame, *, min_docs: int = 10, min_tokens: int = 1) -> DataFrame:
    """The rows of ``docs``, text without recurring lines, with ``n_lines`` and ``n_dropped`` in a struct behind them.

    Up to BROADCAST_KEYS leaves, constants and templates go to all tasks and texts are
    not shuffled; beyond that, each document is joined with its own.
    """
    tree = Tree(docs, min_docs, min_tokens)
    name = "_lines"
    while name in docs.columns:
        name = "_" + name
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))])
    rows, shared = tree.rows(tree.docs)
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sign"))
    if shared is None:
        own = rows.drop("text").dropDuplicates(["doc_id", "sign"]).withColumnsRenamed({"doc_id": "_id", "sign": "_of"})
        packed = packed.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("sign").eqNullSafe(F.col("_of")), "left").drop("_id", "_of")
    return packed.mapInArrow(lambda batches: _apply(batches, shared, min_tokens, name), schema)


def _apply(batches, shared, min_tokens: int, name: str):
    release_memory()
    tree = shared.value if shared is not None else None
    for batch in batches:
        known = _known(batch, tree)
        names, columns = [f.name for f in batch.column(0).type], batch.column(0).flatten()
        at, texts, counts = names.index("text"), [], []
        for i, (text, doc, sign) in enumerate(zip(columns[at].to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if text is None:
                texts.append(None)
                counts.append({"n_lines": 0, "n_dropped": 0})
                continue
            lines, of, kinds, total, few = text.split("\n"), known(i), [], 0, 0
            for line in lines:
                tokens = mask(line)
                kind = of.recurs(tokens, doc, sign) if tokens and len(tokens) >= min_tokens else 0
                kinds.append(kind)
                total += len(tokens)
                few += len(tokens) if kind == 1 else 0
            least = 2 if 2 * few > total else 1
            kept = [line for line, kind in zip(lines, kinds, strict=True) if kind < least]
            texts.append(text if len(kept) == len(lines) else "\n".join(kept))
            counts.append({"n_lines": len(lines), "n_dropped": len(lines) - len(kept)})
        columns[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64())]))], names=[*names, name])


def digest(batches):
    """(doc_id, n_lines, n_dropped, kept_chars, kept_sha256) of deduplicated rows, the counts in their last column."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_chars", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        rows, counts = batch.to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        yield pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "n_lines": c["n_lines"], "n_dropped": c["n_dropped"], "kept_chars": len(r["text"] or ""), "kept_sha256": hashlib.sha256((r["text"] or "").encode()).hexdigest()} for r, c in zip(rows, counts, strict=True)], schema=schema)
