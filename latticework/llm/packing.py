"""Sequence packing by non-negative least squares over length combinations.

Texts are tokenised and cut into full windows and one remainder. The histogram of
remainder lengths (at most `window` numbers) meets a list of shallow combinations of
two or three lengths that fill a window exactly; non-negative least squares finds how
often to repeat each, rounded down within the histogram. Remainders that no combination
takes are laid end to end and cut at window borders, so only the last sequence can be short.

Every remainder gets its place from its rank among those of its length, which is counted
per (length, bucket) of hashed rows: no length, however common, is ordered by one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from latticework.llm.tables import stored

WINDOW = 2048
END = 1
DEPTH3 = 4096
BUCKET_ROWS = 20_000
SPECIAL = "<|endoftext|>"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


class Encoder:
    """Token ids of the tokenizer file; byte-level BPE files run on the faster of two equal libraries.

    The ids are those of `tokenizers` for the same file: its vocabulary, read as ranks, and its
    split pattern give `tiktoken` the same merges. Texts that hold a special token's string are
    left to `tokenizers` itself.
    """

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {
            bytes(byte_of[c] for c in token): rank
            for token, rank in model["model"]["vocab"].items() if token not in self.special
        }
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Full windows and remainder of every text's ids with the end id; ids of remainders as 16- or 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encoder.ids(text or ""), END], "<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    for column, value in zip(out, (
                        doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids),
                        None if len(part) == window else _narrow(part),
                    )):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in out[:5]), pa.array(out[5], pa.binary())], [p.split()[0] for p in PIECE.split(", ")]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


def _narrow(ids: np.ndarray) -> bytes:
    return ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else ids.tobytes()


def _wide(packed: bytes, length: int) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if len(packed) == 2 * length else "<u4").astype("<u4")


def combinations(counts: np.ndarray, window: int, most3: int = DEPTH3) -> np.ndarray:
    """Pairs and triples of occurring lengths that fill the window, as rows of three (0 for none).

    All pairs are listed; triples take the lengths that occur most, at most `most3` of them.
    """
    have = np.flatnonzero(counts)
    found = [(a, window - a, 0) for a in have if a <= window - a and counts[window - a]]
    common = sorted(have, key=lambda n: (-counts[n], n))[: int(np.sqrt(2 * most3))]
    for i, a in enumerate(common):
        for b in common[i:]:
            c = window - a - b
            if c > 0 and counts[c] and len(found) < most3 + window:
                found.append(tuple(sorted((int(a), int(b), int(c)))))
    return np.array(sorted(set(found)), np.int64).reshape(-1, 3)


def repeats(counts: np.ndarray, rows: np.ndarray, steps: int = 400) -> np.ndarray:
    """Whole repeat counts of the combinations: projected gradient for min |Ax - h|, x >= 0, then rounded within h."""
    if not len(rows):
        return np.zeros(0, np.int64)
    x = np.zeros(len(rows))
    h = counts.astype(float)
    scale = 1 / max(1.0, h.max())
    use = np.bincount(rows[rows > 0], minlength=len(counts))
    rate = 1 / (3.0 * np.maximum(use[rows], 1) * (rows > 0)).sum(axis=1)
    momentum, before = 1.0, x
    for _ in range(steps):
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = x + (momentum - 1) / following * (x - before)
        fit = np.bincount(rows.ravel(), weights=np.repeat(y, 3), minlength=len(counts))
        fit[0] = 0
        gap = (fit - h) * scale
        before, x = x, np.maximum(0, y - rate * (gap[rows] * (rows > 0)).sum(axis=1) / scale)
        momentum = following
    left, whole = counts.copy(), np.zeros(len(rows), np.int64)
    for i in np.argsort(-x, kind="stable"):
        lengths, each = np.unique(rows[i][rows[i] > 0], return_counts=True)
        whole[i] = max(0, min(int(np.round(x[i])), int((left[lengths] // each).min())))
        left[lengths] -= whole[i] * each
    for i in np.argsort(-rows.max(axis=1), kind="stable"):  # what rounding left over
        lengths, each = np.unique(rows[i][rows[i] > 0], return_counts=True)
        more = int((left[lengths] // each).min())
        whole[i] += more
        left[lengths] -= more * each
    return whole


class Layout:
    """Where the k-th remainder of a length goes; of fixed size, whatever the number of remainders."""

    def __init__(self, counts: np.ndarray, window: int) -> None:
        self.window = window
        rows = combinations(counts, window)
        times = repeats(counts, rows)
        first = np.concatenate([[0], np.cumsum(times)])
        slots: dict[int, list[tuple[int, int, int]]] = {}
        taken = np.zeros(len(counts), np.int64)
        for row, n, sequence in zip(rows, times, first):
            offset = 0
            for length in row[row > 0]:
                if n:
                    slots.setdefault(int(length), []).append((int(taken[length]), int(sequence), offset))
                    taken[length] += n
                offset += int(length)
        self.slots = {n: np.array(v, np.int64).reshape(-1, 3) for n, v in slots.items()}
        self.taken, self.sequences = taken, int(first[-1])
        rest = (counts - taken) * np.arange(len(counts))
        self.base = np.concatenate([[0], np.cumsum(rest)])[:-1]

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, length, sequence, offset) of its parts; more than one if it is cut."""
        if rank < self.taken[length]:
            slots = self.slots[length]
            first, sequence, offset = slots[np.searchsorted(slots[:, 0], rank, "right") - 1]
            return [(0, length, int(sequence + rank - first), int(offset))]
        at, parts, start = int(self.base[length] + (rank - self.taken[length]) * length), [], 0
        while start < length:
            size = min(length - start, self.window - (at + start) % self.window)
            parts.append((start, size, self.sequences + (at + start) // self.window, (at + start) % self.window))
            start += size
        return parts


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed once each; a null
    doc_id stays null. Sequence ids are gapless; full windows come after the combined ones.
    An empty table gives no piece. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, window), "pieces")
    full, rest = cut.filter(F.col("length") == window), cut.filter(F.col("length") < window)
    histogram = np.zeros(window + 1, np.int64)
    for row in rest.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `window` rows
        histogram[row["length"]] = row["n"]
    layout = Layout(histogram, window)
    buckets = int(max(8, histogram.sum() // BUCKET_ROWS))
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counted = rest.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    sums = counted.withColumn("before", F.expr(
        "coalesce(sum(n) over (partition by length order by bucket rows between unbounded preceding and 1 preceding), 0)"
    ))
    dealt = rest.join(F.broadcast(sums) if buckets <= 64 else sums, ["length", "bucket"])
    dealt = dealt.repartition("length", "bucket").sortWithinPartitions("length", "bucket", "doc_id", "ids_crc32")
    shared = spark.sparkContext.broadcast(layout)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = None, 0
        for batch in batches:
            out: list[list[int]] = [[] for _ in names]
            for doc_id, start, length, crc, tokens, ids, bucket, before in zip(*(c.to_pylist() for c in batch.columns)):
                rank = rank + 1 if (length, bucket) == last else before
                last = (length, bucket)
                parts = shared.value.place(length, rank)
                for at, size, sequence, offset in parts:
                    if len(parts) > 1:
                        crc = zlib.crc32(_wide(ids, length)[at : at + size].tobytes())
                    for column, value in zip(out, (doc_id, start + at, size, crc, tokens, sequence, offset)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    schema = ", ".join(f"{n} long" for n in names)
    placed = dealt.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "bucket", "before").mapInArrow(place, schema)
    after = layout.sequences + -(-int(layout.base[-1] + (histogram[-1] - layout.taken[-1]) * window) // window)
    return placed.unionByName(_numbered(full, after).select(*names))


def _numbered(full: DataFrame, first: int) -> DataFrame:
    """Full windows as sequences of their own, numbered from `first` by (bucket, rank)."""
    buckets = 4096
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets))
    full = full.withColumn("bucket", bucket)
    sums = full.groupBy("bucket").agg(F.count("*").alias("n")).withColumn(
        "before", F.expr("coalesce(sum(n) over (order by bucket rows between unbounded preceding and 1 preceding), 0)")
    )  # at most `buckets` rows
    rank = F.expr("row_number() over (partition by bucket order by doc_id, start, ids_crc32) - 1")
    return full.drop("ids").join(F.broadcast(sums), "bucket").withColumn("sequence_id", F.lit(first) + F.col("before") + rank).withColumn(
        "offset", F.lit(0).cast("long")
    )
