"""Suffix order of a symbol array by two-stage sorting, and common prefixes of neighbours.

Stage one sorts directly the suffixes that are smaller than their successors, by the pieces
between them and doubling along these pieces. Stage two induces all others by one scan of
the buckets of first symbols in ascending order: scanning suffix i puts i - 1 at the next
free place of its bucket if it is larger than i.
"""

from __future__ import annotations

import numpy as np

PER_WORD = 6  # ten-bit symbols in a 64-bit sort key


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether suffix i is smaller than suffix i + 1; equal symbols take the answer of the next place."""
    n = len(text)
    rise = np.empty(n, np.int8)
    rise[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    rise[-1] = -1
    at = np.where(rise != 0, np.arange(n), n)
    return rise[np.minimum.accumulate(at[::-1])[::-1]] > 0


class _Ranks:
    """Ranks of items, refined by further keys; items of equal rank are tied."""

    def __init__(self, key: np.ndarray) -> None:
        self.rank = np.zeros(len(key), np.int64)
        self.tied = np.arange(len(key))
        self.refine(key)

    def refine(self, key: np.ndarray) -> None:
        """Split ties by `key`, given for the tied items in their present order."""
        items, rank = self.tied, self.rank[self.tied]
        if len(items) and int(key.max()) >> 32:  # dense numbers in place of long keys
            order = np.argsort(key)
            new = np.zeros(len(items), np.int64)
            new[1:] = key[order[1:]] != key[order[:-1]]
            dense = np.empty(len(items), np.int64)
            dense[order] = np.cumsum(new)
            key = dense
        order = np.argsort((rank << 32) | key.astype(np.int64))
        items, rank, key = items[order], rank[order], key[order]
        group = np.ones(len(items), bool)
        group[1:] = rank[1:] != rank[:-1]
        part = group.copy()
        part[1:] |= key[1:] != key[:-1]
        at = np.arange(len(items))
        new = rank + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        self.rank[items] = new
        alone = part.copy()
        alone[:-1] &= part[1:]
        self.tied = items[~alone]


def sort_smaller(text: np.ndarray, smaller: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes smaller than their successors, ordered by `depth` symbols at least."""
    n, places = len(text), np.flatnonzero(smaller)
    if not len(places):
        return places
    symbols = np.zeros(n + PER_WORD, np.uint64)
    symbols[:n] = 2 * (text.astype(np.uint64) + np.uint64(1)) + smaller
    until = np.append(places[1:] + 1, n)  # a piece ends with the next such place

    def word(items: np.ndarray, skip: int) -> np.ndarray:
        key = np.zeros(len(items), np.uint64)
        for j in range(skip, skip + PER_WORD):
            at = places[items] + j
            key = (key << np.uint64(10)) | np.where(at < until[items], symbols[np.minimum(at, n)], np.uint64(0))
        return key

    ranks = _Ranks(word(np.arange(len(places)), 0))
    skip, longest = PER_WORD, int((until - places).max())
    while skip < longest and len(ranks.tied):
        ranks.refine(word(ranks.tied, skip))
        skip += PER_WORD
    step = 1
    while len(ranks.tied):
        ahead = ranks.tied + step
        inside = ahead < len(places)
        covered = np.where(inside, places[np.minimum(ahead, len(places) - 1)], n + depth) - places[ranks.tied]
        if covered.min() >= depth:
            break
        ranks.refine(np.where(inside, ranks.rank[np.minimum(ahead, len(places) - 1)] + 1, 0))
        step *= 2
    return places[np.argsort(ranks.rank, kind="stable")]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of `text` (symbols 0 to 500), in order by `depth` symbols at least."""
    if not len(text):
        return np.zeros(0, np.int64)
    direct = sort_smaller(text, smaller_than_next(text), depth)
    first = text[direct]
    waiting: dict[int, list[np.ndarray]] = {int(text[-1]): [np.array([len(text) - 1])]}
    out = []
    for c in np.flatnonzero(np.bincount(text)).tolist():
        bucket = waiting.pop(c, [])
        last = np.concatenate(bucket) if bucket else np.zeros(0, np.int64)
        while len(last):  # runs of one symbol stay in the bucket that is scanned
            last = last[last > 0] - 1
            last = last[text[last] == c]
            if len(last):
                bucket.append(last)
        bucket.append(direct[np.searchsorted(first, c, "left") : np.searchsorted(first, c, "right")])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[text[before] > c]
        symbol = text[before]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        cuts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
        for part in np.split(before, cuts) if len(before) else []:
            waiting.setdefault(int(text[part[0]]), []).append(part)
    return np.concatenate(out)


def share_prefix(window_hash: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each suffix in `order` and the one before it have a common prefix of the hashed length.

    `window_hash` holds the hash of that many symbols from each place of `order`; in an order
    by at least so many symbols, suffixes that share such a prefix stand side by side.
    """
    out = np.zeros(len(order), bool)
    out[1:] = window_hash[order[1:]] == window_hash[order[:-1]]
    return out
