"""Suffix arrays of byte strings by induced sorting, in whole-array steps.

Suffixes are smaller (S) or larger (L) than their right neighbour.  The leftmost
S ones of each run are sorted first: one induction orders the substrings between
them and equal ones get equal names.  Where names repeat, the string of names is
sorted in the same way, by recursion on its own leftmost S suffixes.  A second
induction from their order places all L, then all S suffixes, each in the bucket
of its first byte; a bucket is handled as an array, again for each repetition of
its own byte.  A string of names has too many letters for buckets: there, what
follows from the leftmost S suffixes is ordered by letters and types up to the
next one of them, and then by its rank.
"""

from __future__ import annotations

import numpy as np


def classify(data: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last is larger."""
    n = len(data)
    kind = np.zeros(n, dtype=np.int8)
    step = np.sign(np.diff(data.astype(np.int64))).astype(np.int8)
    kind[:-1] = step
    kind[n - 1] = -1
    at = np.where(kind != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return kind[at] > 0


def _spread(parts: list[list], places: np.ndarray, chars: np.ndarray) -> None:
    """Append places to the bucket of their byte, in order."""
    if not len(places):
        return
    order = np.argsort(chars, kind="stable")
    places, chars = places[order], chars[order]
    cut = np.nonzero(chars[1:] != chars[:-1])[0] + 1
    start = 0
    for stop in [*cut.tolist(), len(places)]:
        parts[chars[start]].append(places[start:stop])
        start = stop


def induce(data: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the order of the leftmost S suffixes."""
    letters = int(data.max()) + 1
    large: list[list] = [[] for _ in range(letters)]
    first: list[list] = [[] for _ in range(letters)]
    _spread(first, seeds, data[seeds])
    large[data[-1]].append(np.array([len(data) - 1], dtype=np.int32))

    def push(parts, places, kind):
        p = places - 1
        p = p[p >= 0]
        p = p[small[p] == kind]
        _spread(parts, p, data[p])

    for c in range(letters):
        own, i = large[c], 0
        while i < len(own):  # grows while the bucket's own letter repeats
            waiting, i = own[i:], len(own)
            push(large, np.concatenate(waiting), False)
        if first[c]:
            push(large, np.concatenate(first[c]), False)
    less: list[list] = [[] for _ in range(letters)]  # each bucket from its end
    for c in range(letters - 1, -1, -1):
        own, i = less[c], 0
        while i < len(own):
            waiting, i = own[i:], len(own)
            push(less, np.concatenate(waiting), True)
        if large[c]:
            push(less, np.concatenate(large[c])[::-1], True)
    out = []
    for c in range(letters):
        out += large[c]
        out += [p[::-1] for p in reversed(less[c])]
    return np.concatenate(out)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros behind the end."""
    n = len(data) + 72
    padded = np.concatenate([data, np.zeros(96, dtype=np.uint8)])
    out = np.empty(-(-n // 8) * 8, dtype="<u8")
    for k in range(8):
        out[k::8] = padded[k : k + len(out)].view("<u8")
    return out[:n]


def _names(data: np.ndarray, sorted_lms: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rank of each leftmost-S substring in sorted order; equal ones share it."""
    words, wide = words_at(data.view(np.uint8)), data.itemsize
    a, b = sorted_lms[:-1].astype(np.int64) * wide, sorted_lms[1:].astype(np.int64) * wide
    size = length[sorted_lms] * wide
    same = size[:-1] == size[1:]
    alive = np.nonzero(same)[0]
    at = 0
    while len(alive):
        left = size[alive] - at
        alive, left = alive[left > 0], left[left > 0]
        if not len(alive):
            break
        differ = ((words[a[alive] + at] ^ words[b[alive] + at]) & low_bytes(left)) != 0
        same[alive[differ]] = False
        alive = alive[~differ]
        at += 8
    return np.concatenate([[0], np.cumsum(~same)])


def low_bytes(n: np.ndarray) -> np.ndarray:
    """Masks of the first ``n`` bytes of a word, of all from eight on."""
    return np.where(n >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.minimum(n, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1))


def _refine(letter: np.ndarray, at: np.ndarray, stop: np.ndarray, rank: np.ndarray | None) -> np.ndarray:
    """For each place: how many have less letters from it up to its ``stop`` and, behind that, a lower ``rank`` of the stop."""
    n = len(letter)

    def column(k: np.ndarray, j: int) -> np.ndarray:
        i, end = at[k] + j, stop[k]
        inside = (i <= end) & (i < n)
        out = np.where(inside, letter[np.minimum(i, n - 1)], 0)
        return out if rank is None else np.where((i == end + 1) & (end < n), rank[np.minimum(end, n - 1)], out)

    group, alive, j = np.zeros(len(at), dtype=np.int64), np.arange(len(at)), 0
    while len(alive):
        if j:
            key = group[alive] << 32 | column(alive, j)
        else:  # no groups yet: two columns at once
            key = column(alive, 0) << 32 | column(alive, 1)
        by = np.argsort(key)
        key, alive = key[by], alive[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.nonzero(new)[0]
        number = np.cumsum(new) - 1
        old = group[alive]
        if j:
            # places of an old group stand together: count from its first one
            first = np.nonzero(np.concatenate([[True], old[1:] != old[:-1]]))[0]
            base = np.repeat(first, np.diff(np.concatenate([first, [len(old)]])))
            group[alive] = old + start[number] - base
        else:
            group[alive] = start[number]
        many = np.diff(np.concatenate([start, [len(alive)]]))[number] > 1
        j += 1 if j else 2
        # behind the stop and its rank nothing is left to tell places apart
        alive = alive[many & (at[alive] + j <= np.minimum(stop[alive] + (rank is not None), n))]
    return group


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by recursion."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    if n < 2 or (np.diff(names[order]) > 0).all():
        return order
    small = classify(names)
    lms = np.nonzero(small[1:] & ~small[:-1])[0] + 1
    letter = names.astype(np.int64) * 2 + small + 1
    after = np.full(n, n, dtype=np.int64)  # the next leftmost S place
    after[lms - 1] = lms
    after = np.minimum.accumulate(after[::-1])[::-1]
    rank = np.zeros(n, dtype=np.int64)
    if len(lms):
        group = _refine(letter, lms, after[lms], None)
        part = np.unique(group, return_inverse=True)[1]
        rank[lms[_sort_names(part)]] = np.arange(1, len(lms) + 1)
    out = np.empty(n, dtype=np.int64)
    out[_refine(letter, np.arange(n), after, rank)] = np.arange(n)
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``data`` (uint8)."""
    n = len(data)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = classify(data)
    lms = (np.nonzero(small[1:] & ~small[:-1])[0] + 1).astype(np.int32)
    if len(lms) < 2:
        return induce(data, small, lms)
    order = induce(data, small, lms)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    by_part = order[is_lms[order]]
    length = np.zeros(n, dtype=np.int32)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = n + 1 - lms[-1]  # up to the end, unlike any other
    name = np.zeros(n, dtype=np.int32)
    name[by_part] = _names(data, by_part, length)
    names = name[lms]
    if int(names.max()) + 1 == len(lms):
        return induce(data, small, by_part)
    return induce(data, small, lms[_sort_names(names)])


def permuted_prefixes(data: np.ndarray, order: np.ndarray, cap: int, lane: int = 128) -> np.ndarray:
    """By place in the text: the common prefix of a suffix with the one before it in ``order``, at most ``cap``; the first has 0.

    In text order a length is at least the one before it less one, so only what
    goes beyond is compared.  The text is cut into lanes that run side by side.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int32)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, dtype=np.int32)
    words, starts = words_at(data), np.arange(0, n, lane)
    length = np.zeros(len(starts), dtype=np.int64)
    for t in range(min(lane, n)):
        i = starts + t
        if i[-1] >= n:
            i, length = i[:-1], length[:-1]
            starts = starts[:-1]
        j = before[i].astype(np.int64)
        length = np.where(j >= 0, np.maximum(length - 1, 0), 0)
        most = np.where(j >= 0, np.minimum(n - np.maximum(i, j), cap), 0)
        alive = np.nonzero(length < most)[0]
        while len(alive):
            x = words[i[alive] + length[alive]] ^ words[j[alive] + length[alive]]
            rest = x & (~x + np.uint64(1))  # the lowest bit that differs
            step = np.full(len(alive), 8, dtype=np.int64)
            some = rest != 0
            step[some] = np.log2(rest[some].astype(np.float64)).astype(np.int64) // 8
            length[alive] += step
            alive = alive[(step == 8) & (length[alive] < most[alive])]
        length = np.minimum(length, most)
        out[i] = length
    return out
