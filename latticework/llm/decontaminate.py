"""Benchmark decontamination by SimHash windows and exact weighted-shingle similarity.

A window has as many words as the benchmark item it is held against; a text with fewer
words is one window as a whole, verified without a fingerprint. A window's SimHash is the
sign of summed shingle bits, computed for sliding windows from prefix sums. Item fingerprints
lie in a multi-index: 8 blocks of 8 bits, each listed under all values within 2 bits, so
every fingerprint within RADIUS = 23 bits shares a block entry. Entries within the radius
are verified by weighted Jaccard of shingle counts; a shingle weighs less the more items
hold it. Windows that share no shingle with any item have similarity 0 and are left out
before any fingerprint is made.

The benchmark is the stated query set: it goes through the documents in blocks of bounded
size, so what a task holds never grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from latticework.llm import textops

WORDS = 5
SIMILARITY = 0.8
BLOCKS, WITHIN = 8, 2
RADIUS = BLOCKS * (WITHIN + 1) - 1
ITEM_BLOCK = 4096
BREAKS = ~textops.byte_mask(bytes([*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]))
NEAR = (np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= WITHIN)
BITS = np.arange(64, dtype=np.uint64)
TABLE_BITS = 22


def word_spans(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, textops.Spans, np.ndarray]]:
    """Slices of lower-cased texts with their words: letters, digits and all beyond ASCII."""
    for row, end, offsets, data in textops.slices(pc.utf8_lower(pc.cast(column, pa.large_string()))):
        yield row, end, data, textops.words(offsets, data, BREAKS), offsets


def _sign_sums(hashes: np.ndarray) -> np.ndarray:
    return ((hashes[:, None] >> BITS) & np.uint64(1)).astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << BITS).sum(axis=1, dtype=np.uint64)


def _item_shingles(spans: textops.Spans, row: int, k: int) -> np.ndarray:
    """Shingles of one item in order; fewer than k words make one."""
    own = textops.Spans(*(x[spans.row == row] for x in (spans.starts, spans.ends, spans.row, spans.hash)))
    if 0 < len(own) < k:
        return textops.windows(own, len(own))[0]
    return textops.windows(own, k)[0]


class Items:
    """One block of benchmark items: shingles, weights and the multi-index, by item size in words."""

    def __init__(self, rows: list[tuple[int, str]], k: int, shared: tuple[np.ndarray, np.ndarray]) -> None:
        self.k = k
        self.shared, self.holding = shared
        ids, sets, sizes = [], [], []
        for row, end, _, spans, _ in word_spans(pa.array([t for _, t in rows], pa.string())):
            for i in range(end - row):
                shingles, n = _item_shingles(spans, i, k), int((spans.row == i).sum())
                if n:
                    ids.append(rows[row + i][0])
                    sets.append(shingles)
                    sizes.append(n)
        self.ids, self.sizes = np.array(ids, np.int64), np.array(sizes, np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        pair = np.unique(np.stack([flat.view(np.int64), owner], axis=1), axis=0) if len(flat) else np.zeros((0, 2), np.int64)
        order = np.argsort(pair[:, 0].view(np.uint64) if len(pair) else pair[:, 0], kind="stable")
        self.hash, self.owner = pair[order, 0].copy().view(np.uint64), pair[order, 1]
        self.seen = np.zeros(1 << TABLE_BITS, bool)
        self.seen[(self.hash >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        self.shingles = [np.unique(s, return_counts=True) for s in sets]
        prints = [fingerprints(_sign_sums(s).sum(axis=0, keepdims=True))[0] for s in sets]
        self.prints = np.array(prints, np.uint64)

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        """1 / (items of the whole benchmark that hold the shingle), 1 for shingles of no item."""
        if not len(self.shared):
            return np.ones(len(hashes))
        at = np.minimum(np.searchsorted(self.shared, hashes), len(self.shared) - 1)
        return np.where(self.shared[at] == hashes, 1.0 / self.holding[at], 1.0)

    def holders(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, item) for all positions whose shingle occurs in an item."""
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        low, high = np.searchsorted(self.hash, hashes[maybe], "left"), np.searchsorted(self.hash, hashes[maybe], "right")
        at = np.repeat(maybe, high - low)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        return at, self.owner[np.repeat(low, high - low) + inside]

    def within(self, prints: np.ndarray, items: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) with fingerprints within the radius, candidates by the multi-index."""
        listed = np.zeros((len(prints), len(items)), bool)
        for b in range(BLOCKS):
            index = NEAR[:, ((self.prints[items] >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)]
            listed |= index[((prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)]
        window, item = np.nonzero(listed)
        good = np.bitwise_count(prints[window] ^ self.prints[items[item]]) <= RADIUS
        return list(zip(window[good].tolist(), items[item[good]].tolist()))

    def similarity(self, window: np.ndarray, item: int) -> float:
        a, na = np.unique(window, return_counts=True)
        b, nb = self.shingles[item]
        every, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        counts = np.zeros((2, len(every)))
        counts[0, at[: len(a)]], counts[1, at[len(a) :]] = na, nb
        weights = self.weights(every)
        return float((counts.min(axis=0) * weights).sum() / (counts.max(axis=0) * weights).sum())

    def matches(self, spans: textops.Spans, least: float) -> list[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, end word) of the best window of every leaked item."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for k in sorted({min(int(n), self.k) for n in self.sizes}):  # shorter items are one shingle of their own size
            hashes, first = textops.windows(spans, k)
            at, item = self.holders(hashes)
            sizes = self.sizes[item]
            for size in np.unique(sizes[(sizes >= k) if k == self.k else (sizes == k)]):
                self._windows(spans, hashes, first, np.unique(at[sizes == size]), k, int(size), least, best)
            if k == self.k:
                self._short_texts(spans, hashes, first, at, item, least, best)
        return [(row, item, *value) for (row, item), value in sorted(best.items())]

    def _short_texts(
        self, spans: textops.Spans, hashes: np.ndarray, first: np.ndarray, at: np.ndarray, item: np.ndarray, least: float,
        best: dict[tuple[int, int], tuple[float, int, int]],
    ) -> None:
        """Hold every text against the longer items with which it shares a shingle, as one window."""
        row = spans.row[first]
        words = np.bincount(spans.row, minlength=int(spans.row.max(initial=-1)) + 1)
        short = words[row[at]] < self.sizes[item]
        for r, i in np.unique(np.stack([row[at[short]], item[short]], axis=1), axis=0).tolist():
            begin, end = np.searchsorted(row, [r, r + 1])
            value = self.similarity(hashes[begin:end], i)
            if value >= least:
                best[r, i] = (value, int(first[begin]), int(first[begin] + words[r]))

    def _windows(
        self, spans: textops.Spans, hashes: np.ndarray, first: np.ndarray, hits: np.ndarray, k: int, words: int, least: float,
        best: dict[tuple[int, int], tuple[float, int, int]],
    ) -> None:
        """Hold all windows of `words` words over a hit against the items of that size, run by run."""
        span = words - k + 1
        items = np.flatnonzero(self.sizes == words)
        low = np.maximum(hits - span + 1, 0)
        cuts = np.flatnonzero(np.concatenate([[True], low[1:] > hits[:-1] + 1]))
        for begin, stop in zip(cuts, [*cuts[1:], len(hits)]):
            starts = np.arange(low[begin], min(hits[stop - 1], len(hashes) - span) + 1)
            starts = starts[spans.row[first[starts]] == spans.row[first[starts + span - 1]]]  # within one text
            for at in range(0, len(starts), 4096):
                some = starts[at : at + 4096]
                part = hashes[some[0] : some[-1] + span]
                sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_sign_sums(part), axis=0, dtype=np.int32)])
                off = some - some[0]
                for w, item in self.within(fingerprints(sums[off + span] - sums[off]), items):
                    value = self.similarity(part[off[w] : off[w] + span], item)
                    word = int(first[some[w]])
                    key = (int(spans.row[word]), item)
                    if value >= least and value > best.get(key, (0.0,))[0]:
                        best[key] = (value, word, word + words)


def shared_shingles(benchmark: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that two or more items of the whole benchmark hold, in order, and how many items do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, _, spans, _ in word_spans(batch.column(0)):
                every = [np.unique(_item_shingles(spans, i, k)) for i in range(end - row)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(every).view(np.int64))], ["hash"])

    counted = benchmark.select("text").mapInArrow(run, "hash long").groupBy("hash").count().filter("count > 1").toPandas()
    hashes, n = counted["hash"].to_numpy(np.int64).view(np.uint64), counted["count"].to_numpy(np.float64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def item_blocks(benchmark: DataFrame, k: int, block: int = ITEM_BLOCK) -> Iterator[Items]:
    """The items with a text, in blocks of at most `block` by hash of their ids.

    Weights come from all items, so results don't depend on the blocks.
    """
    benchmark = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    n = benchmark.count()
    shared = shared_shingles(benchmark, k)
    parts = -(-n // max(1, block // 2)) if n > block else 1
    for part in range(parts):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        yield Items([(r[0], r[1]) for r in rows], k, shared)


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = WORDS, least: float = SIMILARITY, block: int = ITEM_BLOCK) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, similarity, first_word, end_word of the best window.

    Null and empty texts and items match nothing; repeated rows give repeated results; a
    null doc_id stays null. Items of fewer than k words are one shingle. Other columns are ignored.
    """
    schema = "doc_id long, item_id long, similarity double, first_word long, end_word long"
    names = [x.split()[0] for x in schema.split(", ")]
    spark = docs.sparkSession

    def search(items: Items) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out: list[list] = [[] for _ in names]
                for row, end, _, spans, _ in word_spans(batch.column(1)):
                    base = np.searchsorted(spans.row, np.arange(end - row))
                    for r, item, value, first, last in shared.value.matches(spans, least):
                        found = (ids[row + r], int(shared.value.ids[item]), value, first - int(base[r]), last - int(base[r]))
                        for column, x in zip(out, found):
                            column.append(x)
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [search(items) for items in item_blocks(benchmark, k, block)])


def clean(docs: DataFrame, benchmark: DataFrame, k: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """`docs` without the documents that hold a benchmark item; rows with a null doc_id stay."""
    found = leaks(docs.filter("doc_id is not null"), benchmark, k, least).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
