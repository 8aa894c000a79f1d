"""Periodic runs of words by a dictionary of basic factors.

For every power of two L, the factors of L words get names (a factor of 2 L is the pair of
the names of its halves), and each occurrence is linked to its successor, the next one of
the same name in the text. Successors at most 2 L away that repeat with the same distance
form arithmetic progressions; the distance is a proposed period. A run of period q and at
least 4 q words holds three successive occurrences, q apart, of its first factor of L words,
where L is the power of two from q to below 2 q, so every run is proposed. Proposals are
extended to both sides as far as words q apart are equal; stretches proposed by several
periods keep the smallest, which is the period of the run.

Names are 64-bit hashes. Factors that occur once in their text are left out of all longer
lengths, so ordinary prose ends after a few lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from latticework.llm import textops

LEAST_WORDS, LEAST_EXPONENT = 6, 4
RUNS, COLLAPSED = "runs", "collapsed"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _successors(name: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by name and place, and the distance to the next place of the same name (0: none) in that order."""
    order = np.argsort(name, kind="stable")
    step = np.zeros(len(at), np.int64)
    if len(at):
        same = name[order[1:]] == name[order[:-1]]
        step[:-1] = np.where(same, at[order[1:]] - at[order[:-1]], 0)
    return order, step


def proposals(value: np.ndarray, row: np.ndarray, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Distinct (row, place, period) of the first terms of arithmetic progressions; rows are in order."""
    n = len(value)
    end = np.searchsorted(row, row, "right")
    longest = (end - np.searchsorted(row, row, "left")) // least_exponent
    with np.errstate(over="ignore"):
        name = textops.mix(value + row.astype(np.uint64) * np.uint64(textops.ODD))
    at, size, out = np.arange(n), 1, [np.zeros((0, 3), np.int64)]
    while len(at):
        order, step = _successors(name, at)
        places = at[order]
        # three terms: the step repeats; the first: the step before differs
        again = np.zeros(len(at), bool)
        again[:-1] = (step[:-1] > 0) & (step[:-1] <= 2 * size) & (step[1:] == step[:-1])
        before = np.concatenate([[0], step[:-1]])
        first = again & (before != step) & (step <= longest[places])
        out.append(np.stack([row[places[first]], places[first], step[first]], 1))
        held = (step > 0) | (before > 0)
        alive = np.zeros(len(at), bool)
        alive[order[held]] = True
        alive &= size // 2 < longest[at]
        at, name = at[alive], name[alive]
        half = np.searchsorted(at, at + size)
        half[half == len(at)] = 0
        both = (at[half] == at + size) & (at + 2 * size <= end[at]) if len(at) else np.zeros(0, bool)
        with np.errstate(over="ignore"):
            name = textops.mix(name[both] * np.uint64(0xA24BAED4963EE407 | 1) + textops.mix(name[half[both]]))
        at, size = at[both], 2 * size
    return np.unique(np.concatenate(out), axis=0)


def find_runs(
    value: np.ndarray, row: np.ndarray, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT
) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start within the row, length, period) of each row that has any, by start and period."""
    proposed = proposals(value, row, least_exponent)
    out: dict[int, dict[tuple[int, int], int]] = {}
    cuts = np.flatnonzero((np.diff(proposed[:, 0]) != 0)) + 1 if len(proposed) else []
    for part in np.split(proposed, cuts) if len(proposed) else []:
        r = int(part[0, 0])
        begin, stop = np.searchsorted(row, [r, r + 1])
        text = value[begin:stop]
        found: dict[tuple[int, int], int] = {}
        for q in np.unique(part[:, 2]).tolist():
            breaks = np.concatenate([[-1], np.flatnonzero(text[:-q] != text[q:]), [len(text) - q]])
            place = part[part[:, 2] == q, 1] - begin
            k = np.unique(np.searchsorted(breaks, place))  # extended to the breaks on both sides
            for s, e in zip((breaks[k - 1] + 1).tolist(), (breaks[k] + q).tolist()):
                if e - s >= max(least_words, least_exponent * q):
                    found.setdefault((s, e - s), q)  # periods come in ascending order
        if found:
            out[r] = found
    return {r: sorted((s, length, q) for (s, length), q in found.items()) for r, found in out.items()}


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words of no run after its first period, joined by one space."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def with_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """`docs` with runs (array of start, length, period in words) and collapsed (the text without repeats).

    Words are what stands between white space. Null and empty texts have no runs and collapse to
    an empty text; repeated rows are judged alike; columns called runs or collapsed are replaced,
    all others stay. A text is handled whole in one task, whatever its length.
    """
    docs = docs.drop(RUNS, COLLAPSED)
    names = docs.columns
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, offsets, data in textops.slices(batch.column(where)):
                words = textops.words(offsets, data)
                found = find_runs(words.hash, words.row, least_words, least_exponent)
                raw = data.tobytes()
                texts = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                flat = [b" ".join(t) if i not in found else _collapse(t, found[i]) for i, t in enumerate(texts)]
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in found.get(i, ())] for i in range(end - start)]
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(runs, pa.list_(RUN)), pa.array(flat, pa.binary()).cast(pa.string())], [*names, RUNS, COLLAPSED]
                )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *T._parse_datatype_string(
        f"{RUNS} array<struct<start:long,length:long,period:long>>, {COLLAPSED} string"
    ).fields]))


def planted(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) where a tenth of the texts, told by the crc32 of doc_id, end in a repeated stretch.

    With h = crc32 and g = h // 10, word i from a = g % n on becomes word a + (i - a) % p, where
    p = 1 + (n - a) // (3 + g % 8). Texts of rows with a null doc_id stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                h = crc32(str(doc_id).encode()) if doc_id is not None else 1
                if h % 10 or not texts[k]:
                    continue
                words = texts[k].encode().split()
                if words:
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[k] = b" ".join([*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests of all runs and of the collapsed text, per row of `with_runs`."""
    best = F.array_max(F.transform(RUNS, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("a"), (-r["period"]).alias("b"))))
    listed = F.array_join(F.transform(RUNS, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size(RUNS) > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit(""))
    return docs.withColumn("_best", best).select(
        "doc_id", F.size(RUNS).cast("long").alias("n_runs"), (-F.col("_best.a")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.b")).alias("period"), F.expr("1000 * _best.length div -_best.b").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(COLLAPSED, 256).alias("collapsed_sha256"),
    )
