"""Operator 8: language identification by a bidirectional recurrent network over bytes.

Two gated recurrent layers read the UTF-8 bytes of a text forwards and backwards;
a softmax over both states labels every position, and a document's
probabilities are the normalised geometric mean of its positions'.  Training is
backpropagation through time in numpy with Adam, on the driver, from a bounded
sample of labelled documents (``per_language`` documents of each language, the
smallest by a hash of doc_id; from each up to ``windows_per_doc`` windows).
Prediction streams whole texts: they are cut into segments with ``OVERLAP`` bytes
of context on both sides, so that all segments of a batch run as one matrix and
memory does not depend on the length of a text.  The network has one class more, of
made-up scripts; ``identify`` leaves it out, ``keep_languages`` drops what it wins.

Cases: null texts and texts without a letter are ``und`` with score 0; documents
without a language teach nothing; without any labelled document all others are
``und`` too; equal texts have equal predictions.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT, OVERLAP = 224, 16
#: Segments that run together.
LANES = 1024


def held_out(doc_id: Column) -> Column:
    """The documents that no training reads: crc32 of the id as text is 2 modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiGRU:
    """Parameters: per direction a table of input terms (256, 3H), recurrent (H, 3H); output (2H, C) and bias."""

    def __init__(self, hidden: int, classes: int, seed: int = 0):
        g = np.random.default_rng(seed)
        h = self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = (g.standard_normal((256, 3 * h)) * 0.3).astype(np.float32)
            self.p[f"u{d}"] = (g.standard_normal((h, 3 * h)) / np.sqrt(h)).astype(np.float32)
        self.p["o"] = (g.standard_normal((2 * h, classes)) / np.sqrt(h)).astype(np.float32)
        self.p["c"] = np.zeros(classes, dtype=np.float32)

    def _run(self, x: np.ndarray, d: str, keep: list | None = None, rest: list[int] | None = None) -> np.ndarray:
        """States (T, B, H) over bytes x (T, B) in the order given; ``rest[t]`` leading lanes have not begun at t."""
        table, u, h = self.p[f"x{d}"], self.p[f"u{d}"], self.hidden
        state = np.zeros((x.shape[1], h), dtype=np.float32)
        out = np.empty((*x.shape, h), dtype=np.float32)
        ug, uc = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        for t in range(len(x)):
            term = table[x[t]]
            gates = state @ ug
            gates += term[:, : 2 * h]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            update, reset = gates[:, :h], gates[:, h:]
            cand = (reset * state) @ uc
            cand += term[:, 2 * h :]
            np.tanh(cand, out=cand)
            if keep is not None:
                keep.append((state, update, reset, cand))
            new = out[t]
            np.subtract(state, cand, out=new)
            new *= update
            new += cand
            if rest is not None and rest[t]:
                new[: rest[t]] = 0
            state = new
        return out

    def positions(self, x: np.ndarray, length: np.ndarray | None = None) -> np.ndarray:
        """Log probabilities (T, B, C) of each position of bytes x (T, B).

        With ``length``, not falling by lane, a lane is read backwards from its own
        end, so what is beside it and how wide the batch is has no effect.
        """
        f = self._run(x, "f")
        rest = None if length is None else np.searchsorted(length, np.arange(len(x))[::-1], side="right").tolist()
        b = self._run(x[::-1], "b", rest=rest)[::-1]
        z = f @ self.p["o"][: self.hidden]
        z += b @ self.p["o"][self.hidden :]
        z += self.p["c"]
        z -= z.max(axis=2, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=2, keepdims=True))
        return z

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean loss and gradients for bytes x (T, B) and languages y (B), by backpropagation through time."""
        h, kept = self.hidden, {"f": [], "b": []}
        f, b = self._run(x, "f", kept["f"]), self._run(x[::-1], "b", kept["b"])[::-1]
        both = np.concatenate([f, b], axis=2)
        z = both @ self.p["o"] + self.p["c"]
        z -= z.max(axis=2, keepdims=True)
        e = np.exp(z)
        e /= e.sum(axis=2, keepdims=True)
        t, n = x.shape
        loss = -float(np.log(np.maximum(e[:, np.arange(n), y], 1e-9)).mean())
        dz = e
        dz[:, np.arange(n), y] -= 1
        dz /= t * n
        flat = dz.reshape(-1, dz.shape[2])
        g = {"o": both.reshape(-1, 2 * h).T @ flat, "c": flat.sum(axis=0)}
        dboth = dz @ self.p["o"].T
        for d in "fb":
            seq = x if d == "f" else x[::-1]
            into = dboth[:, :, :h] if d == "f" else dboth[::-1, :, h:]
            u, du, dx, carry = self.p[f"u{d}"], np.zeros_like(self.p[f"u{d}"]), np.zeros_like(self.p[f"x{d}"]), np.zeros((n, h), dtype=np.float32)
            for i in range(t - 1, -1, -1):
                state, update, reset, cand = kept[d][i]
                dh = into[i] + carry
                dc = dh * (1 - update) * (1 - cand * cand)
                du_gate = dh * (state - cand) * update * (1 - update)
                drs = dc @ u[:, 2 * h :].T
                dr = drs * state * reset * (1 - reset)
                gates = np.concatenate([du_gate, dr], axis=1)
                carry = dh * update + drs * reset + gates @ u[:, : 2 * h].T
                du[:, : 2 * h] += state.T @ gates
                du[:, 2 * h :] += (reset * state).T @ dc
                np.add.at(dx, seq[i], np.concatenate([gates, dc], axis=1))
            g[f"u{d}"], g[f"x{d}"] = du, dx
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, *, epochs: int, batch: int, rate: float, seed: int = 0) -> None:
        """Adam over windows x (N, T) with languages y (N)."""
        g = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = g.permutation(len(x))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                _, grad = self.gradients(np.ascontiguousarray(x[own].T), y[own])
                step += 1
                for k, dk in grad.items():
                    m[k] += 0.1 * (dk - m[k])
                    v[k] += 0.001 * (dk * dk - v[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def foreign_windows(count: int, window: int, seed: int) -> np.ndarray:
    """Windows of words in random letters of scripts beyond the Latin ones: what the network learns as no language."""
    g = np.random.default_rng([seed, 1])
    out = []
    for _ in range(count):
        script = int(g.integers(0x370, 0xA000))  # neighbouring letters, as in a real script
        letters = np.where(g.random(window) < 0.15, 32, script + g.integers(0, 64, window))
        out.append(np.frombuffer("".join(map(chr, letters.tolist())).encode()[:window], dtype=np.uint8))
    return np.stack(out)


class Model:
    """A trained network with its languages; one output more than languages stands for none of them."""

    def __init__(self, languages: list[str], net: BiGRU | None):
        self.languages, self.net = languages, net

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """Best language and its probability among the languages for each text (bytes of UTF-8)."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
        """The same, and whether none of the languages is likelier than any of them."""
        if self.net is None or not texts:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        where, start = [], []
        for i, t in enumerate(texts):
            n = len(t)
            where += [i] * max(1, -(-n // SEGMENT))
            start += range(0, max(n, 1), SEGMENT)
        owner, start = np.array(where), np.array(start)
        raw = [np.frombuffer(t, dtype=np.uint8) for t in texts]
        length = np.array([len(t) for t in texts], dtype=np.int64)
        total = np.zeros((len(texts), len(self.net.p["c"])))
        width = SEGMENT + 2 * OVERLAP
        # segments of like length run together
        size = np.minimum(length[owner] - start, SEGMENT)
        order = np.argsort(size, kind="stable")
        for a in range(0, len(order), LANES):
            own = order[a : a + LANES]
            wide = int(size[own].max()) + 2 * OVERLAP if len(own) else width
            x = np.full((len(own), wide), 32, dtype=np.uint8)
            for k, j in enumerate(own.tolist()):
                s, r = start[j], raw[owner[j]]
                low = max(0, s - OVERLAP)
                piece = r[low : s - OVERLAP + wide]
                x[k, OVERLAP - (s - low) : OVERLAP - (s - low) + len(piece)] = piece
            z = self.net.positions(np.ascontiguousarray(x.T), size[own] + 2 * OVERLAP)[OVERLAP:-OVERLAP]
            z[np.arange(len(z))[:, None] >= size[own][None, :]] = 0
            np.add.at(total, owner[own], z.sum(axis=0))
        total /= np.maximum(length, 1)[:, None]
        known = len(self.languages)
        foreign = (total[:, known:].max(axis=1) > total[:, :known].max(axis=1)).tolist() if total.shape[1] > known else [False] * len(texts)
        total = total[:, :known]
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        # products of another shape are summed in another order: digits beyond the fourth are not the text's own
        return [self.languages[i] for i in best.tolist()], np.round(p[np.arange(len(p)), best], 4).tolist(), foreign


def fit(docs: DataFrame, *, per_language: int = 300, windows_per_doc: int = 4, foreign: int = 400, window: int = 64, hidden: int = 8, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 0) -> Model:
    """Train on a bounded sample of the labelled documents that are not held out.

    The sample has at most ``per_language`` documents a language, whatever the
    size of the table, chosen without reading their texts, and ``foreign`` windows
    of made-up scripts.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # the least of the least of groups of partitions: no task gets the rows of all partitions
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"), (F.spark_partition_id() % 997).alias("_p"))
    for keys in (("lang", "_p"), ("lang",)):
        ids = ids.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "doc_id"))).where(F.col("_r") <= per_language).drop("_r")
    ids = ids.select("doc_id", "lang").distinct()
    # at most per_language ids a language: a bounded broadcast; only the windows come back
    texts = rows.where(F.octet_length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").join(F.broadcast(ids.withColumn("doc_id", F.col("doc_id").cast("long"))), ["doc_id", "lang"])

    def cut(batches):
        for batch in batches:
            out = []
            for doc, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw, g = text.encode(), np.random.default_rng([seed, doc & (1 << 63) - 1])
                for k in range(windows_per_doc):
                    at = int(g.integers(0, max(1, len(raw) - window + 1)))
                    out.append((lang, doc, k, raw[at : at + window].ljust(window)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["lang", "doc_id", "k", "raw"])

    chosen = sorted(tuple(r) for r in texts.mapInArrow(cut, "lang string, doc_id long, k long, raw binary").collect())
    languages = sorted({r[0] for r in chosen})
    x = [np.frombuffer(r[3], dtype=np.uint8) for r in chosen]
    y = [languages.index(r[0]) for r in chosen]
    if not x:
        return Model([], None)
    net = BiGRU(hidden, len(languages) + (foreign > 0), seed)
    if foreign:
        x += list(foreign_windows(foreign, window, seed))
        y += [len(languages)] * foreign
    net.train(np.stack(x), np.array(y), epochs=epochs, batch=batch, rate=rate, seed=seed)
    return Model(languages, net)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for ids, held, lang, score, _ in _predict(batch, shared.value):
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def _predict(batch: pa.RecordBatch, model: Model, text: int = 2):
    """Predictions for runs of rows of about two megabytes of text."""
    column = batch.column(text)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size < 2_000_000 and i + 1 < len(sizes):
            continue
        part = column.slice(start, i + 1 - start)
        letters = pc.fill_null(pc.match_substring_regex(part, r"\pL"), False).to_pylist()
        raw = [t.encode() for t, ok in zip(part.to_pylist(), letters, strict=True) if ok]
        got = iter(zip(*model.judge(raw), strict=True))
        both = [next(got) if ok else ("und", 0.0, True) for ok in letters]
        yield batch.column(0).slice(start, i + 1 - start), batch.column(1).slice(start, i + 1 - start), *map(list, zip(*both, strict=True))
        start, size = i + 1, 0


def keep_languages(docs: DataFrame, model: Model, *, min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is likelier in a learned language, with at least ``min_score``, than in none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            pair = pa.RecordBatch.from_arrays([column, column, column], names=["a", "b", "text"])
            keep = [lang != "und" and score >= min_score and not none for _, _, *got in _predict(pair, shared.value) for lang, score, none in zip(*got, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
