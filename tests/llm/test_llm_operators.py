"""The training-data operators against brute force and plain references, and on their edge cases."""

import collections
import hashlib
import random
import time
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import chat_format, components, decontaminate, fingerprint, language_id, license_scan, line_dedup, near_dedup, packing, queries, substring_dedup, suffix_array, url_filter

DOCS = "doc_id long, text string"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(800)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def clash(df):
    """Extra columns with the names that operators use inside."""
    return df.withColumn("key", F.lit("k")).withColumn("row", F.lit(1)).withColumn("sign", F.lit(2)).withColumn("part", F.lit(3)).withColumn("n", F.lit(4)).withColumn("a", F.lit(5)).withColumn("node", F.lit(6)).withColumn("_kept", F.lit(7))


EDGE = [(1, None), (2, ""), (3, "x"), (4, "x"), (4, "x"), (5, " \n\n "), (6, "é" * 3), (7, "word " * 30_000), (None, "no id")]


def everything(spark, docs):
    """Every operator on one table of documents."""
    d = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    bench = spark.createDataFrame([(1, "word word word word"), (2, None), (3, ""), (4, "zz")], "item_id long, text string")
    model = language_id.fit(d, epochs=1)
    yield "fingerprint", fingerprint.neighbour_fingerprints(clash(docs))
    yield "fingerprints", fingerprint.fingerprints(clash(docs))
    yield "packing", packing.pack(clash(docs), WORD_BPE)
    yield "substrings", substring_dedup.repeated_spans(clash(docs))
    yield "remove", substring_dedup.remove_repeats(clash(docs))
    yield "lines", line_dedup.dedup_lines(clash(docs), min_docs=2, min_tokens=1)
    yield "pairs", decontaminate.contaminated_pairs(clash(docs), bench)
    yield "clean", decontaminate.decontaminate(clash(docs), bench)
    yield "language", language_id.identify(clash(d), model)
    yield "keep", language_id.keep_languages(clash(d), model)
    yield "license", license_scan.scan_licenses(clash(docs))
    yield "near", near_dedup.near_duplicates(clash(docs))
    yield "representatives", near_dedup.keep_representatives(clash(docs))


def test_edge_cases_run_on_every_operator(spark):
    n = {}
    for name, out in everything(spark, frame(spark, EDGE)):
        n[name] = out.count()
    assert n["fingerprint"] == n["fingerprints"] == n["substrings"] == n["remove"] == n["lines"] == n["language"] == n["near"] == len(EDGE)
    assert n["representatives"] == len({t or "" for _, t in EDGE})
    for name, out in everything(spark, spark.createDataFrame([], DOCS)):
        assert out.count() == 0, name


# 1 --------------------------------------------------------------------------


def test_fingerprint_rolling_is_local():
    x = np.frombuffer(bytes(RNG.randrange(256) for _ in range(300)), dtype=np.uint8)
    h = fingerprint.rolling(x)
    assert h[100] == fingerprint.rolling(x[94:101])[-1]


def test_fingerprint_likeness():
    a = prose(900)
    w = a.split()
    w[450] = "changed"
    same, near, far = (fingerprint.fingerprint(t.encode()) for t in (a, " ".join(w), prose(900)))
    assert fingerprint.likeness(same, same) == 1 and fingerprint.likeness(same, near) > 0.85 and fingerprint.likeness(same, far) < 0.3
    assert fingerprint.fingerprint(b"") == "3::"
    block, one, two = same.split(":")
    assert len(one) <= 64 and len(two) <= 32 and int(block) % 3 == 0
    assert fingerprint.common_length("abcbdab", "bdcaba") == 4


def plain_fingerprint(raw):
    """Byte by byte, in Python's numbers."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def rolled(i):
        h = 0
        for j in range(min(7, i + 1)):
            h += (raw[i - j] + 1) * 0x01000193**j
        h &= 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x85EBCA6B & 0xFFFFFFFF
        return h ^ h >> 13

    hashes = [rolled(i) for i in range(len(raw))]

    def signature(size, most):
        out, start = "", 0
        for i, h in enumerate(hashes):
            if h % size == size - 1 and len(out) < most - 1:
                out += letters[zlib.crc32(raw[start : i + 1]) % 64]
                start = i + 1
        return out + (letters[zlib.crc32(raw[start:]) % 64] if start < len(raw) else "")

    size = 3
    while size * 64 < len(raw):
        size *= 2
    while raw and size > 3 and sum(h % size == size - 1 for h in hashes) < 32:
        size //= 2
    return f"{size}:{signature(size, 64)}:{signature(2 * size, 32)}"


def test_fingerprint_against_plain_bytes():
    rng = random.Random(53)
    for n in (0, 1, 2, 6, 7, 8, 50, 191, 192, 193, 700, 5000):
        for raw in (bytes(rng.randrange(256) for _ in range(n)), prose(n // 5, rng).encode(), b"a" * n):
            assert fingerprint.fingerprint(raw) == plain_fingerprint(raw), n


def test_fingerprint_query_against_loop(spark):
    rows = [(i, prose(RNG.randint(0, 60))) for i in range(40)] + [(50, None), (51, "äöü€𝄞 " * 9)]
    got = {r["doc_id"]: r for r in fingerprint.neighbour_fingerprints(frame(spark, rows)).collect()}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        mark = [fingerprint.fingerprint(t.encode()) for t in (text, new, after)]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), hashlib.sha256(new.encode()).hexdigest(), mark[0], mark[1])
        assert (r["near_edited"], r["near_next"]) == (fingerprint.likeness(mark[0], mark[1]), fingerprint.likeness(mark[0], mark[2]))
    alone = fingerprint.neighbour_fingerprints(frame(spark, [(1, "only one here")])).first()
    assert alone["near_next"] == 1.0


# 2 --------------------------------------------------------------------------


def test_word_encoder_equals_whole_texts():
    tok = Tokenizer.from_file(WORD_BPE)
    texts = ["", "a\x1cb", "ΑΣ ΣΑΣ. don't it's <|endoftext|>x", "a <|endoftext|> b", "<|startoftext|><|ENDOFTEXT|>", "x<|endoftext|>. <|endoftext|", "<| endoftext |> <|", "İstanbul ǅ ﬁ ⅷ", "日本語 x\u0085y z", "a.b.c|d *** ||| x%", prose(50) + ".,"]
    texts += ["".join(chr(RNG.choice([RNG.randrange(32, 127), RNG.randrange(0x80, 0x3000)])) for _ in range(40)) for _ in range(300)]
    import pyarrow as pa

    flat, edge = packing.WordEncoder(WORD_BPE).encode(pa.array(texts), [1])
    for t, a, b in zip(texts, edge[:-1], edge[1:], strict=True):
        assert flat[a:b].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1], t


def test_packing_round_trip(spark):
    rows = [(i, prose(RNG.randint(0, 90))) for i in range(120)] + [(200, None), (201, prose(3000)), (202, ""), (202, "")]
    pieces = packing.pack(frame(spark, rows), WORD_BPE, length=256).collect()
    tok = Tokenizer.from_file(WORD_BPE)
    want = collections.Counter(tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in rows)
    sequences = collections.defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], dtype="<u4")
        assert len(ids) == p["length"] > 0
        sequences[p["sequence_id"]].append((p["offset"], ids, p))
    assert sorted(sequences) == list(range(len(sequences)))
    stream = []
    for k in sorted(sequences):
        at = 0
        for offset, ids, _ in sorted(sequences[k], key=lambda x: x[0]):
            assert offset == at
            at += len(ids)
            stream += ids.tolist()
        assert at == 256 or k == max(sequences)
    docs, own = collections.Counter(), []
    for t in stream:
        own.append(t)
        if t == 1:
            docs[tuple(own)] += 1
            own = []
    assert docs == want
    starts = collections.defaultdict(list)
    for p in pieces:
        starts[p["doc_id"]].append((p["start"], p["length"], p["doc_tokens"]))
    at = 0
    for start, length, total in sorted(starts[201]):
        assert start == at
        at += length
    assert at == total


# 3 --------------------------------------------------------------------------


def test_suffix_array_against_sort():
    g = np.random.default_rng(1)
    for trial in range(120):
        n = int(g.integers(1, 60))
        a = g.integers(97, 97 + int(g.integers(1, 5)), n).astype(np.uint8)
        if trial % 3 == 0:
            a = np.tile(a[:5], 12)[:n]
        raw = a.tobytes()
        want = sorted(range(len(a)), key=lambda i: raw[i:])
        assert suffix_array.suffix_array(a).tolist() == want
        common = suffix_array.permuted_prefixes(a, np.array(want), 50, lane=7)
        for i in range(1, n):
            x, y = raw[want[i - 1] :], raw[want[i] :]
            k = next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))
            assert common[want[i]] == min(k, 50)


def brute_repeats(rows):
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        for k in range(len(raw) - 49):
            first.setdefault(raw[k : k + 50], i)
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    shared = [prose(RNG.randint(8, 30), rng) for _ in range(6)] + ["aaaa" * 40, "ab" * 60, "é" * 60]
    rows = []
    for i in range(150):
        parts = [prose(rng.randint(0, 25), rng) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 3), rng.choice(shared)[: rng.randint(20, 400)])
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 30, 3)] + [(300, None), (301, ""), (302, "x" * 49), (303, "x" * 50), (304, "x" * 51)]
    monkeypatch.setattr(substring_dedup, "SHARD", 2000)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.digest(substring_dedup.repeated_spans(frame(spark, rows))).collect()}
    assert got == brute_repeats(rows)


def test_a_passage_in_every_document(spark, monkeypatch):
    """A hot passage, with many buckets and shards of one anchor each."""
    rng = random.Random(41)
    passage = prose(20, rng)
    rows = [(i, f"{prose(rng.randint(0, 6), rng)} {passage}{passage[: rng.randint(0, 90)]} {prose(rng.randint(0, 6), rng)}") for i in range(400)]
    monkeypatch.setattr(substring_dedup, "SHARD", 100)
    monkeypatch.setattr(substring_dedup, "BUCKET", 3000)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.digest(substring_dedup.repeated_spans(frame(spark, rows))).collect()}
    assert got == brute_repeats(rows)


def test_long_texts_are_cut_without_effect(monkeypatch):
    texts = [prose(n).encode() for n in (400, 3, 0, 30, 9, 90, 8)] + [b"", b"z" * 300, b"x" * 50]
    expand = lambda x: sorted((t, w, h) for h, a, b, t in zip(*(c.tolist() for c in x), strict=True) for w in range(a, b + 1))
    whole = expand(substring_dedup.anchors(texts))
    assert [(t, w) for t, w, _ in whole] == [(t, w) for t, x in enumerate(texts) for w in range(len(x) - 49)]
    assert whole == sorted((k, w, h) for k, x in enumerate(texts) for _, w, h in expand(substring_dedup.anchors([x])))
    monkeypatch.setattr(substring_dedup, "PIECE", 500)
    assert expand(substring_dedup.anchors(texts)) == whole


# 4 --------------------------------------------------------------------------


def brute_lines(rows, min_docs):
    """The tree with dictionaries: open leaves, constants by position, templates; long lines from two documents on."""

    def parse(line):
        return tuple("<*>" if any(c.isdigit() or c == "@" for c in t) or "://" in t else t for t in line.split())

    def words(t):
        return len(t) - t.count("<*>")

    docs = [(i, sorted({parse(x) for x in text.split("\n")} - {()})) for i, text in rows if text is not None]
    leaves = collections.Counter(n for _, own in docs for n in {(len(t), t[:3]) for t in own})
    places = collections.Counter(p for _, own in docs for p in {(len(t), t[:3], j, t[j]) for t in own for j in range(3, len(t))})

    def template(t):
        if leaves[len(t), t[:3]] < min_docs:
            return None
        out = t[:3] + tuple(x if x == "<*>" or places[len(t), t[:3], j, x] >= min_docs else "<*>" for j, x in enumerate(t) if j >= 3)
        return out if words(out) >= 0.6 * len(out) else None

    lines, found, first = collections.Counter(), collections.Counter(), {}
    for i, own in docs:
        lines.update(t for t in own if words(t) >= 20)
        made = {template(t) for t in own} - {None}
        found.update(made)
        for t in [*made, *(("line", t) for t in own)]:
            first[t] = min(first.get(t, i), i)

    def by_template(i, t):
        made = template(t) if t else None
        return made is not None and found[made] >= min_docs and first[made] != i

    def by_line(i, t):
        return bool(t) and lines[t] >= 2 and first["line", t] != i

    out = {}
    for i, text in rows:
        own = [] if text is None else text.split("\n")
        parsed = [parse(x) for x in own]
        few = sum(len(t) for t in parsed if by_line(i, t) and not by_template(i, t))
        copy = 2 * few > sum(map(len, parsed))
        kept = [x for x, t in zip(own, parsed, strict=True) if not (by_template(i, t) or by_line(i, t) and not copy)]
        out[i] = (None if text is None else "\n".join(kept), len(own), len(own) - len(kept))
    return out


@pytest.mark.parametrize("few", [0, 10**9])
def test_line_dedup_against_brute_force(spark, monkeypatch, few):
    rng = random.Random(5)
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", few)
    rows = []
    for i in range(60):
        lines = [prose(rng.randint(1, 14), rng) for _ in range(4)]
        lines.insert(rng.randint(0, 4), f"page {i} of {rng.randint(1, 99)} printed today")
        if i % 2:
            # differs in places of two fifths of the line, in words without a mark
            lines.append(f"all of the words {rng.choice(VOCABULARY)} are the same but {rng.choice(VOCABULARY)} in the places that may change")
        if i % 3 == 0:
            lines += ["menu", "read more"]
        if i % 4 == 0:
            lines.append(f"one two three {prose(6, rng)}")
        rows.append((i, "\n".join(lines)))
    rows += [(90, None), (91, ""), (92, "\n\n"), (93, rows[7][1])]
    rows += [(94, prose(70, rng)), (95, f"{prose(25, rng)}\n{prose(30, rng)}")]
    rows += [(96, rows[-2][1]), (97, rows[-1][1] + "\nand some more"), (98, f"{rows[-2][1]}\n{prose(90, rng)}")]
    out = line_dedup.dedup_lines(clash(frame(spark, rows)).withColumn("_lines", F.lit(8)).withColumn("_hits", F.lit(9)), min_docs=8)
    assert out.columns[-3:] == ["_lines", "_hits", "__lines"] and {r["_lines"] + r["_hits"] for r in out.collect()} == {17}
    got = {r["doc_id"]: (r["text"], r["__lines"]["n_lines"], r["__lines"]["n_dropped"]) for r in out.collect()}
    assert got == brute_lines(rows, 8)
    assert got[1][2] == 1 and got[5][2] == 2 and got[6][2] == 3  # documents 0 and 1 keep the first ones
    assert "one two three" in got[8][0]  # a leaf, but no template
    assert (got[96][2], got[97][2], got[98][2]) == (0, 0, 1)  # a copy, a near copy, a passage in another text


@pytest.mark.parametrize("few", [0, 10**9])
def test_lines_of_documents_without_an_id(spark, monkeypatch, few):
    """One of them keeps a recurring line, unless a document with an id does."""
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", few)
    rows = [(None, f"own text {chr(97 + i)}\nshared by all of them") for i in range(16)]
    got = [r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()]
    assert len(got) == 16 and sum("shared" in t for t in got) == 1
    got = line_dedup.dedup_lines(frame(spark, [*rows, (4, rows[0][1])])).collect()
    assert [r["doc_id"] for r in got if "shared" in r["text"]] == [4]
    again = line_dedup.dedup_lines(frame(spark, rows + rows)).collect()
    assert sum("shared" in r["text"] for r in again) == 2  # equal rows


@pytest.mark.parametrize("few", [0, 10**9])
def test_long_lines_recur_from_two_documents_on(spark, monkeypatch, few):
    """Lines of 60 words in two and in nine documents go; short lines, numbers and lines changed in a word stay."""
    rng = random.Random(37)
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", few)
    two, nine, short = (" ".join(f"{x}{rng.choice(VOCABULARY)}" for _ in range(n)) for x, n in (("two", 60), ("nine", 60), ("short", 12)))
    rows, want = [], {}
    for i in range(9):
        changed = two.split()
        changed[30] = f"{'abcdefghi'[i]}changed"
        own = [prose(30, rng), short, " ".join(str(rng.randrange(1000)) for _ in range(30)), " ".join(changed)]
        rows.append((i, "\n".join([*own, *([two] if i in (4, 7) else []), nine])))
        want[i] = "\n".join([*own, *([two] if i == 4 else []), *([nine] if i == 0 else [])])
    lost = prose(40, rng)
    rows += [(None, "one line\n" + lost), (None, lost)]
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] is not None} == want
    assert sorted(r["text"] for r in got if r["doc_id"] is None) == sorted(t for i, t in rows if i is None)


# 5 --------------------------------------------------------------------------


def slow_align(item, passage):
    best, row = 0, [0] * (len(passage) + 1)
    for w in item:
        new = [0]
        for j, x in enumerate(passage):
            new.append(max(0, row[j] + (1 if w == x else -1), row[j + 1] - 1, new[j] - 1))
            best = max(best, new[-1])
        row = new
    return best


def test_alignment_score_against_table():
    rng = random.Random(9)
    for _ in range(200):
        words = VOCABULARY[: rng.randint(2, 12)]
        a, b = ([rng.choice(words) for _ in range(rng.randint(1, 15))] for _ in range(2))
        score, start, stop = decontaminate.align(a, b)
        assert score == slow_align(a, b)
        if score:
            assert slow_align(a, b[start:stop]) == score


def test_decontamination_finds_planted_copies(spark, monkeypatch):
    rng = random.Random(11)
    items = [(k, prose(rng.randint(15, 40), rng)) for k in range(12)]
    rows, want = [(i, prose(200, rng)) for i in range(80)], set()
    for i in range(0, 80, 4):
        k = rng.randrange(len(items))
        w = items[k][1].split()
        if i % 3 == 1:
            for j in range(0, len(w), 9):
                w[j] = "edited"
        elif i % 3 == 2:
            del w[len(w) // 2]
        body = rows[i][1].split()
        rows[i] = (i, " ".join([*body[:50], *w, *body[50:]]).upper().replace(" ", ", ", 3))
        want.add((i, k))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (8_000_000, 400):  # one block, many blocks
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        pairs = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(frame(spark, rows), bench).collect()}
        assert pairs == want
        kept = {r["doc_id"] for r in decontaminate.decontaminate(frame(spark, rows), bench).collect()}
        assert kept == {i for i, _ in rows} - {i for i, _ in want}


@pytest.mark.parametrize("edited", [False, True])
def test_decontamination_of_a_part_that_many_documents_hold(spark, edited):
    """The first half of an item in over 20 documents."""
    rng = random.Random(31)
    item = [f"item{i}" for i in range(40)]
    rows, want = [], set()
    for i in range(150):
        part = []
        if i % 3:
            part = item[: 21 + edited]
            if edited:
                part[rng.randrange(1, 21)] = "edited"
            want.add(i)
        rows.append((i, " ".join([prose(100, rng), *part, prose(100, rng)])))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated_pairs(frame(spark, rows), bench).collect()} == want
    assert {r["doc_id"] for r in decontaminate.decontaminate(frame(spark, rows), bench).collect()} == {i for i, _ in rows} - want


def test_decontamination_against_all_pairs(spark):
    """Every document is aligned with every item; what is not found has no word 3-gram in common."""
    rng = random.Random(59)
    few = VOCABULARY[:40]
    items = [(k, " ".join(rng.choice(few) for _ in range(rng.randint(2, 25)))) for k in range(20)] + [(50, None), (51, ""), (52, "one"), (53, items_ := "two same words"), (54, items_)]
    rows = []
    for i in range(60):
        w = [rng.choice(few) for _ in range(rng.randint(0, 60))]
        if i % 2:
            own = items[rng.randrange(20)][1].split()
            for _ in range(rng.randint(0, len(own) // 3)):
                own[rng.randrange(len(own))] = "edited"
            at = rng.randint(0, len(w))
            w[at:at] = own
        rows.append((i, " ".join(w)))
    rows += [(80, "One"), (81, "has two same, words."), (82, None), (83, ""), (81, "has two same, words.")]
    got = collections.Counter((r["doc_id"], r["item_id"], round(r["score"] * r["item_words"])) for r in decontaminate.contaminated_pairs(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect())
    want, apart = collections.Counter(), set()
    for i, text in rows:
        for k, item in items:
            a, b = (item or "").lower().split(), decontaminate.words(text)
            score = slow_align(a, b) if a and b else 0
            if a and score >= 0.5 * len(a) and score:
                n = min(3, len(a))
                common = {tuple(a[j : j + n]) for j in range(len(a) - n + 1)} & {tuple(b[j : j + n]) for j in range(len(b) - n + 1)}
                if common:
                    want[i, k, score] += 1
                else:
                    apart.add((i, k))
    assert got == want and len(want) > 20 and apart


# 6 --------------------------------------------------------------------------


def test_escape_is_reversible():
    for text in ["", "\\", "<|im_end|>", "\\<|", "<\\|", "<|" * 3, "a\\n\nb", "<|im_end|>\n<|im_start|>assistant\nok"]:
        assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
        assert chat_format.unescape_role(chat_format.escape_role(text)) == text and "\n" not in chat_format.escape_role(text)


@pytest.mark.parametrize("budget", [30, 120, 100_000])
def test_chat_windows_round_trip(spark, budget):
    rng = random.Random(13)
    talks = {-1: [("user", queries.CONTROL_TEXT), ("assistant", queries.CONTROL_TEXT)], 5: [("assistant", "")], 6: [(None, None), ("user", None)]}
    for c in range(20):
        talks[c + 10] = ([("system", prose(4, rng))] if c % 3 == 0 else []) + [(("user", "assistant")[k % 2], prose(rng.randint(0, 60), rng) + "\n\\<|x|>") for k in range(rng.randint(1, 12))]
    rows = [(c, t, r, x) for c, turns in talks.items() for t, (r, x) in enumerate(turns)]
    df = frame(spark, rows, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit(1))
    windows = chat_format.format_conversations(df, budget=budget)
    got = {r["conv_id"]: r for r in chat_format.digest_windows(windows).collect()}
    for c, turns in talks.items():
        said = "".join(x or "" for r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a or ''}\n{b or ''}\n" for a, b in turns).encode()).hexdigest()
    for w in windows.collect():
        assert not w["over_budget"] or w["n_turns"] == 1
        if w["window"] and talks[w["conv_id"]][0][0] == "system":
            assert chat_format.parse_window(w["formatted"])[0][0] == "system"
        for s in w["loss_spans"]:
            assert "<|" not in w["formatted"][s["start"] : s["stop"]]


# 7 --------------------------------------------------------------------------


def test_url_rules_and_reputation(spark):
    pages = [(i, f"http://bad.site.org/p{i}") for i in range(30)] + [(100 + i, f"https://Good.Site.com/x{i}?a#b") for i in range(30)]
    pages += [(200, "http://a.example.com/en/7x"), (201, "http://example.com/en/8"), (202, "http://EXAMPLE.net/de/81"), (203, "ftp://x.net/de/"), (204, None), (205, "no scheme"), (206, "http://xexample.com/en/7"), (207, "http://new.site.org"), (208, "http://co.uk/a"), (208, "http://co.uk/a")]
    labels = [(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)] + [(100, None)]
    out = url_filter.filter_urls(clash(spark.createDataFrame(pages, "page_id long, url string")), spark.createDataFrame(labels, "page_id long, bad int"), spark.createDataFrame([*queries.URL_RULES, (None, "/x", "block")], "rule_host string, rule_path string, action string"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert out.count() == len(pages)
    assert got[0] == ("bad.site.org", "/p0", None, "block") and got[100] == ("good.site.com", "/x0", None, "allow")
    assert got[200] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[201][2:] == ("com/en/", "block")
    assert got[202][2:] == ("example.net/de/8", "block") and got[203][2:] == ("net/de/", "allow")
    assert got[204][:3] == ("", "", None) == got[205][:3] and got[206][2:] == ("com/en/", "block")
    assert got[207][3] == "block"  # an unknown host of a bad domain
    empty = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int"), spark.createDataFrame([], "rule_host string, rule_path string, action string"))
    assert {r["verdict"] for r in empty.collect()} <= {"allow", "block"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "PythonUDF" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# 8 --------------------------------------------------------------------------


def test_gradients_against_differences():
    g = np.random.default_rng(0)
    net = language_id.BiGRU(3, 3, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = g.integers(0, 256, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grad = net.gradients(x, y)
    for k, i in (("uf", (1, 2)), ("ub", (2, 7)), ("xf", (int(x[2, 1]), 4)), ("o", (1, 2)), ("uf", (0, 8)), ("c", (1,))):
        net.p[k][i] += 1e-3
        up = net.gradients(x, y)[0]
        net.p[k][i] -= 2e-3
        down = net.gradients(x, y)[0]
        net.p[k][i] += 1e-3
        assert abs(grad[k][i] - (up - down) / 2e-3) < 2e-5


def test_language_held_out_accuracy(spark):
    rng = random.Random(17)
    forms = {"aa": "abcde", "bb": "vwxyz", "cc": "éèçàü"}
    rows = [(i, " ".join("".join(rng.choice(forms[lang] + "nst") for _ in range(5)) for _ in range(rng.randint(3, 200))), lang) for i in range(240) for lang in [list(forms)[i % 3]]]
    rows += [(900, None, "aa"), (901, "123 !?", "bb"), (902, "abcab", None), (903, "これは学習されていない言語の文章です。" * 4, None), (904, "Это русский текст, которого нет среди языков. " * 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, per_language=40)
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2 and r[0] < 900]
    assert all(got[r[0]]["held_out"] for r in held) and sum(r["held_out"] for r in got.values()) >= len(held) > 30
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.97
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] in forms
    kept = {r["doc_id"] for r in language_id.keep_languages(df, model).collect()}
    assert kept == {r[0] for r in rows} - {900, 901, 903, 904}


def test_long_text_runs_in_segments():
    net = language_id.BiGRU(4, 2, 3)
    model = language_id.Model(["a", "b"], net)
    text = prose(400).encode()
    _, (score,) = model.predict([text])
    p = net.positions(np.frombuffer(text, dtype=np.uint8)[:, None])[:, 0].mean(axis=0)
    p = np.exp(p - p.max())
    assert abs(score - (p / p.sum()).max()) < 0.02
    assert model.predict([text, b"x", text])[1][0] == model.predict([text])[1][0]


def test_predictions_do_not_depend_on_the_batch():
    rng = random.Random(47)
    forms = {"aa": "abcde", "bb": "abcxy", "cc": "cdexy"}
    net = language_id.BiGRU(8, 3, 0)
    x = np.stack([np.frombuffer("".join(rng.choice(forms[k]) for _ in range(40)).encode(), dtype=np.uint8) for k in list(forms) * 60])
    net.train(x, np.array([0, 1, 2] * 60), epochs=4, batch=32, rate=0.02)
    model = language_id.Model(list(forms), net)
    texts = ["".join(rng.choice("abcdexy ") for _ in range(rng.choice([1, 2, 3, 40, 223, 224, 225, 500]))).encode() for _ in range(120)]
    alone = [tuple(v[0] for v in model.predict([t])) for t in texts]
    for beside in ([], [b"a" * 224], [b"b" * 700] * 3):
        names, scores = model.predict([*texts, *beside])
        assert names[: len(texts)] == [n for n, _ in alone]
        assert np.allclose(scores[: len(texts)], [s for _, s in alone], atol=1.01e-4)


# 9 --------------------------------------------------------------------------


def test_license_scan(spark):
    t = license_scan.TEMPLATES
    rows = [(i, prose(RNG.randint(0, 400)) + " " + (list(t.values())[i % len(t)] if i % 2 else "") + " " + prose(RNG.randint(0, 400))) for i in range(60)]
    mit = t["MIT-grant"].split()
    mit[20] = "changed"
    rows += [(100, " ".join(mit)), (101, None), (102, "license"), (103, t["MIT"].lower().replace(" ", "\n"))]
    got = collections.defaultdict(set)
    for r in license_scan.scan_licenses(frame(spark, rows)).collect():
        got[r["doc_id"]].add(r["license"])
    words = {k: license_scan.words(v) for k, v in t.items()}
    for i, text in rows:
        w = license_scan.words(text)
        have = {tuple(w[j : j + 3]) for j in range(len(w) - 2)}
        want = {k for k, v in words.items() if len({tuple(v[j : j + 3]) for j in range(len(v) - 2)} & have) / len({tuple(v[j : j + 3]) for j in range(len(v) - 2)}) >= 0.8}
        assert got[i] == want, i


# 10 -------------------------------------------------------------------------


def brute_classes(rows):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        first.setdefault(t or "", i)
    codes = near_dedup.Codes()
    w = {i: codes.of(t) for t, i in first.items()}
    root = {i: i for i in w}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(w)
    for a in ids:
        for b in ids:
            if a < b and len(w[a]) and len(w[b]) and near_dedup.similar(w[a], w[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(first[t or ""]) for i, t in rows}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(19)
    rows = []
    for g in range(12):
        base = prose(rng.randint(30, 150), rng).split()
        for k in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            rows.append((g * 10 + k, " ".join(w)))
            base = w if rng.random() < 0.3 else base
    rows += [(500, rows[0][1]), (501, None), (502, ""), (503, "one two three"), (504, "One, two three!"), (505, "...")]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)
    kept = {r["doc_id"] for r in near_dedup.keep_representatives(frame(spark, rows)).collect()}
    assert kept == set(got.values())


def test_near_copies_of_a_base_with_a_middle_id(spark, monkeypatch):
    """Copies that are linked to their base only, and the base is no hub; with small blocks and parts too."""
    rng = random.Random(29)
    base = [f"w{i}" for i in range(200)]
    rows = [(600, " ".join(base))]
    for i in [*range(600), *range(601, 1200)]:
        w = list(base)
        for j in rng.sample(range(200), rng.randint(1, 6)):
            w[j] = f"x{i}y{j}"
        rows.append((i, " ".join(w)))
    codes = {i: near_dedup.Codes().of(t) for i, t in rows}
    sets = {i: np.unique(near_dedup.shingle(c)) for i, c in codes.items()}
    ids = sorted(sets)
    place = {h: k for k, h in enumerate(np.unique(np.concatenate([*sets.values()])).tolist())}
    # each shingle of the base has a column; those that a copy has alone are in no other
    shared = np.zeros((len(ids), 196), dtype=np.float32)
    column = {place[h]: k for k, h in enumerate(sets[600].tolist())}
    for r, i in enumerate(ids):
        shared[r, [column[place[h]] for h in sets[i].tolist() if place[h] in column]] = 1
    both, size = shared @ shared.T, np.array([len(sets[i]) for i in ids])
    close = np.argwhere(np.triu(both >= 4 / 9 * (size[:, None] + size[None, :]) - 0.5, 1))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in close.tolist():
        a, b = find(ids[x]), find(ids[y])
        if a != b and near_dedup.similar(codes[ids[x]], codes[ids[y]]):
            root[max(a, b)] = min(a, b)
    want = {i: find(i) for i in ids}
    assert 1 < len(set(want.values())) < 700
    for block, part in [(near_dedup.BLOCK, near_dedup.PART), (40, 100)]:
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "PART", part)
        assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, rows)).collect()} == want


def test_near_duplicates_with_null_and_repeated_ids(spark):
    """Rows count by their texts, whatever their ids."""
    rng = random.Random(43)
    one, two, three, four = (prose(60, rng) for _ in range(4))
    near = " ".join([*one.split()[:30], "changed", *one.split()[31:]])
    rows = [(None, one), (None, two), (None, two), (5, near), (7, three), (7, four), (7, three), (8, four), (9, one)]
    docs = clash(frame(spark, rows))
    got = collections.Counter((r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == {(None, 5): 1, (None, None): 2, (5, 5): 1, (7, 7): 3, (8, 7): 1, (9, 5): 1}
    kept = near_dedup.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(5, near), (None, two), (7, three), (7, four)], key=str)


def test_families_that_drift_against_all_pairs(spark):
    """Each version changes a random earlier one, so links are chains beside the hub."""
    rng = random.Random(4)
    families = []
    for _ in range(25):
        versions = [[rng.choice(VOCABULARY) for _ in range(160)]]
        while len(versions) < 15:
            w = list(rng.choice(versions))
            for j in rng.sample(range(160), rng.randint(1, 3)):
                w[j] = rng.choice(VOCABULARY)
            versions.append(w)
        families.append(versions)
    ids = list(range(25 * 15))
    rng.shuffle(ids)
    rows = [(ids[f * 15 + k], " ".join(w)) for f, versions in enumerate(families) for k, w in enumerate(versions)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    want = {}
    for f in range(25):
        want |= brute_classes(rows[f * 15 : (f + 1) * 15])
    assert got == want


def test_long_texts_are_aligned_in_time():
    g = np.random.default_rng(5)
    a = g.integers(0, 5000, 100_000).astype(np.uint64)
    b = a.copy()
    b[g.choice(100_000, 300, replace=False)] = 5001
    began = time.perf_counter()
    assert near_dedup.banded_distance(a, b, 20_000) == 300 and time.perf_counter() - began < 1
    half = np.concatenate([a[1500:3000], a[:1500]])
    began = time.perf_counter()
    assert near_dedup.banded_distance(a[:3000], half, 600) is None and time.perf_counter() - began < 1


def test_banded_distance_against_table():
    rng = random.Random(23)
    for _ in range(300):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randint(0, 14))], dtype=np.uint64) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        most = rng.randint(0, 14)
        assert near_dedup.banded_distance(a, b, most) == (row[-1] if row[-1] <= most else None)


def test_occurrence_labels_tell_repeats_apart():
    h = np.array([5, 9, 5, 5, 9], dtype=np.uint64)
    out = near_dedup.label(h)
    assert len(set(out.tolist())) == 5 and out[0] == 5 and out[1] == 9


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(300, 300)]
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[200 + i] for i in range(30)} == {100}

