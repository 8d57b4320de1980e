"""Operator 6: chat formatting in budgeted, turn-aligned windows.

Rows of a conversation are dealt to one task by ``conv_id`` and arrive sorted by
turn; a streaming pass keeps only the open window and the system turn in
memory.  The running sum of turn tokens decides where a window ends: it takes
whole turns while system turn, repeated history and new turns fit the budget.
A later window repeats the system turn and up to ``history_turns`` of the turns
before it; repeated turns are masked, so each assistant text is a training
target once.  A turn that alone is over the budget gets a window of its own
(``over_budget``), never a cut.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Inside roles and
texts a backslash precedes every backslash and the bar of every ``<|``; a role
also has its line breaks written as ``\\n``.  So no control string can appear
inside a text and reading back is exact.

Cases: null role and null text are empty; null turns come first; rows with equal
turns are ordered by role, then text; a null ``conv_id`` is one conversation of
its own.  A system turn is one with role ``system`` that comes before all other
roles; later ones are ordinary turns.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
WINDOW = "conv_id long, window long, first_turn long, n_turns long, n_repeated long, tokens long, over_budget boolean, formatted string, loss_spans array<struct<start:long,stop:long>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def count_tokens(texts: list[str], tokenizer_path: str | None) -> list[int]:
    """Tokens of each formatted turn; without a tokenizer, its words and marks."""
    if tokenizer_path is None:
        return [len(re.findall(r"\w+|[^\w\s]", t)) for t in texts]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tok = _LOADED.get(tokenizer_path)
    if tok is None:
        tok = _LOADED[tokenizer_path] = Tokenizer.from_file(tokenizer_path)
    return [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


_LOADED: dict = {}


class _Window:
    """The open window of one conversation."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: list = []
        self.context: list = []  # repeated turns in front of the new ones
        self.fresh: list = []
        self.number = self.seen = 0

    def add(self, role: str, marked: str, tokens: int) -> Iterator[dict]:
        if self.fresh and self._used() + tokens > self.budget:
            yield self.close()
        while self.context and self._used() + tokens > self.budget:
            self.context.pop(0)  # new turns go before repeated history
        self.fresh.append((role, marked, tokens))
        self.seen += 1

    def _used(self) -> int:
        return sum(t[2] for t in [*self.system, *self.context, *self.fresh])

    def close(self) -> dict:
        lead = [*self.system, *self.context]
        spans, at = [], sum(len(t[1]) for t in lead)
        for role, marked, _ in self.fresh:
            if role == "assistant":
                spans.append({"start": at + marked.index("\n") + 1, "stop": at + len(marked) - len(END)})
            at += len(marked)
        tokens = sum(t[2] for t in [*lead, *self.fresh])
        row = {"conv_id": self.conv_id, "window": self.number, "first_turn": self.seen - len(self.fresh), "n_turns": len(self.fresh), "n_repeated": len(lead), "tokens": tokens, "over_budget": tokens > self.budget, "formatted": "".join(t[1] for t in [*lead, *self.fresh]), "loss_spans": spans}
        if self.number == 0:
            for t in self.fresh:
                if t[0] != "system":
                    break
                self.system.append(t)
        self.context = []
        room = self.budget // 4  # history never takes more than a quarter
        past = [t for t in (self.fresh if self.number or not self.system else self.fresh[len(self.system) :])][-self.history :] if self.history else []
        for t in reversed(past):
            if t[2] > room:
                break
            room -= t[2]
            self.context.insert(0, t)
        self.fresh, self.number = [], self.number + 1
        return row


def format_conversations(conversations: DataFrame, *, budget: int = 2048, history_turns: int = 2, tokenizer_path: str | None = None) -> DataFrame:
    """Windows of ``conversations(conv_id, turn, role, text)``, sorted within each partition by conversation and window."""
    names = WINDOW
    schema = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("window", "first_turn", "n_turns", "n_repeated", "tokens")], ("over_budget", pa.bool_()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    def run(batches):
        open_: _Window | None = None
        out: list[dict] = []
        size = 0
        for batch in batches:
            rows = batch.to_pydict()
            roles, texts = rows["role"], rows["text"]
            marked = [f"{START}{escape_role(r)}\n{escape(t)}{END}" for r, t in zip(roles, texts, strict=True)]
            for conv, role, text, tokens in zip(rows["conv_id"], roles, marked, count_tokens(marked, tokenizer_path), strict=True):
                if open_ is None or open_.conv_id != conv:
                    if open_ is not None:
                        out.append(open_.close())
                    open_ = _Window(conv, budget, history_turns)
                out.extend(open_.add(role, text, tokens))
                size += len(text)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        if open_ is not None:
            out.append(open_.close())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, names)


def parse_window(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    return [(unescape_role(r), unescape(t)) for r, t in TURN.findall(formatted)]


def digest_windows(windows: DataFrame) -> DataFrame:
    """Read conversations back from their windows: one row each with digests.

    Takes the partitions as ``format_conversations`` leaves them, all windows of
    a conversation together and in order, and keeps hashes only.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64()), ("max_tokens", pa.int64())])

    def run(batches):
        conv, state = None, None
        done: list[dict] = []

        def close():
            n, turns, chars, loss, size, k, most = state
            done.append({"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size, "n_windows": k, "max_tokens": most})

        for batch in batches:
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != conv:
                    if state is not None:
                        close()
                    conv, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                text = r["formatted"]
                for role, said in parse_window(text)[r["n_repeated"] :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in r["loss_spans"]:
                    said = unescape(text[span["start"] : span["stop"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
                state[5] += 1
                state[6] = max(state[6], r["tokens"])
            if len(done) > 5000:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if state is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long, max_tokens long")
