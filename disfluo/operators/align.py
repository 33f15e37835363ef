"""Longest-block-first alignment of many pairs of word lists at once, and their word-level edit distances.

Both work on a batch's pairs together, as flat arrays of word numbers. The aligner lists all places at which a pair's words
agree, by window and diagonal. Runs along diagonals are found by one sort; every window takes its longest run (the first on the
left side, then on the right side, of equal ones) and leaves two windows beside it, until no window has an agreement left.
So the rounds are as many as the blocks nest, whatever the number of pairs. Agreements of one pair are as many as the products
of its words' counts; batches are cut so that few are held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Agreements held at a time, unless one pair has more.
AGREEMENTS = 2_000_000


def numbered(left: list, right: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of words as one array of numbers for each side, with each list's length: equal words have equal numbers."""
    n, m = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (left, right))
    codes, _ = pd.factorize(np.array([w for side in (left, right) for words in side for w in words], dtype=object), use_na_sentinel=False)
    return codes[: n.sum()], n, codes[n.sum() :], m


def _expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def agreements(left: list, right: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, i, j) of all places with equal words, some pairs at a time."""
    a, n, b, m = numbered(left, right)
    kinds = int(max(a.max(initial=0), b.max(initial=0))) + 1
    pair_a, pair_b = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
    key_b = pair_b * kinds + b
    by = np.argsort(key_b, kind="stable")
    sorted_b = key_b[by]
    key_a = pair_a * kinds + a
    low, high = np.searchsorted(sorted_b, key_a, "left"), np.searchsorted(sorted_b, key_a, "right")
    in_a, in_b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n), np.arange(len(b)) - np.repeat(np.cumsum(m) - m, m)
    total = np.concatenate(([0], np.cumsum(high - low)))
    ends = np.concatenate(([0], np.cumsum(n)))  # a pair's words end here
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(total[ends], total[ends[first]] + AGREEMENTS, "right")) - 1)
        s = slice(ends[first], ends[last])
        count = (high - low)[s]
        yield np.repeat(pair_a[s], count), np.repeat(in_a[s], count), in_b[by[_expand(low[s], count)]]
        first = last


def _places(key: np.ndarray, wide: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rest, i = np.divmod(key, wide)
    pair, diagonal = np.divmod(rest, 2 * wide)
    return pair + first, i, i + diagonal - wide


def blocks(left: list, right: list) -> np.ndarray:
    """Rows (pair, i, j, size) of all matching blocks, in order."""
    found = []
    for pair, i, j in agreements(left, right):
        wide = int(max(i.max(initial=0), j.max(initial=0))) + 2  # a place is one number: window, diagonal, place on the left
        first = int(pair[0]) if len(pair) else 0
        key = np.sort(((pair - first) * 2 * wide + (j - i + wide)) * wide + i)
        pair, i, j = _places(key, wide, first)
        window = pair
        while len(window):
            new = np.concatenate(([True], (window[1:] != window[:-1]) | (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)))
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(window)))
            best = np.lexsort((j[at], i[at], -size, window[at]))
            best = best[np.concatenate(([True], window[at][best][1:] != window[at][best][:-1]))]
            row = np.stack((pair[at], i[at], j[at], size), axis=1)[best]
            found.append(row)
            own = np.cumsum(np.concatenate(([False], window[1:] != window[:-1])))  # windows are in order, and each has its block
            bi, bj, bk = row[own, 1], row[own, 2], row[own, 3]
            before, after = (i < bi) & (j < bj), (i >= bi + bk) & (j >= bj + bk)
            keep = np.flatnonzero(before | after)
            window = (2 * own + after)[keep]
            by = np.argsort(window, kind="stable")  # the order within a window stays
            keep = keep[by]
            pair, i, j, window = pair[keep], i[keep], j[keep], window[by]
    if not found:
        return np.zeros((0, 4), dtype=np.int64)
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]


def _stretches(found: np.ndarray, left: list, right: list) -> list[list[tuple[int, int, int, int]]]:
    between: list[list[tuple[int, int, int, int]]] = [[] for _ in right]
    at = [(0, 0)] * len(right)
    for pair, i, j, k in found.tolist():
        i0, j0 = at[pair]
        if i > i0 or j > j0:
            between[pair].append((i0, i, j0, j))
        at[pair] = (i + k, j + k)
    for pair, (i0, j0) in enumerate(at):
        if len(left[pair]) > i0 or len(right[pair]) > j0:
            between[pair].append((i0, len(left[pair]), j0, len(right[pair])))
    return between


def stretches_of(left: list, right: list) -> list[list[tuple[int, int, int, int]]]:
    """For each pair the stretches (i, i2, j, j2) between blocks where either side has words. Where the right side is the left one's
    beginning, all of it is the longest block."""
    other = [k for k, (a, b) in enumerate(zip(left, right)) if a[: len(b)] != b]
    out = [[(len(b), len(a), len(b), len(b))] if len(a) > len(b) else [] for a, b in zip(left, right)]
    some = [left[k] for k in other], [right[k] for k in other]
    for k, found in zip(other, _stretches(blocks(*some), *some)):
        out[k] = found
    return out


def gaps(left: list, right: list) -> tuple[list[list], list[list[tuple[int, int, int, int]]]]:
    """For each pair its alignment (of each word on the right the one on the left, or None), and the stretches (i, i2, j, j2)
    between blocks where either side has words."""
    found = blocks(left, right)
    alignment = [[None] * len(b) for b in right]
    for pair, i, j, k in found.tolist():
        alignment[pair][j : j + k] = range(i, i + k)
    return alignment, _stretches(found, left, right)


def edits(left: list, right: list) -> list[int]:
    """Word-level edit distance of each pair, bit-parallel: a column of the table is two whole numbers with a bit for each word on
    the left, whose differences downwards are +1 or -1, and a word on the right moves all of them at once."""
    out = []
    for x, y in zip(left, right):
        n = len(x)
        if not n:
            out.append(len(y))
            continue
        where: dict = {}
        for k, w in enumerate(x):
            where[w] = where.get(w, 0) | 1 << k
        whole, last = (1 << n) - 1, 1 << (n - 1)
        up, down, score = whole, 0, n
        for w in y:
            same = where.get(w, 0)
            flat = (((same & up) + up) ^ up) | same | down
            rise, fall = down | ~(flat | up) & whole, up & flat
            score += (rise & last > 0) - (fall & last > 0)
            rise, fall = (rise << 1 | 1) & whole, fall << 1 & whole
            up, down = fall | ~(flat | rise) & whole, rise & flat
        out.append(score)
    return out
