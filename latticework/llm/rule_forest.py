"""Quality rules judged by an isolation forest.

Rule statistics of every text (sizes, symbol, repetition and line shares) are points; trees of
random splits over small subsamples isolate unusual points on short paths. The cut-off on
the anomaly score is calibrated on labelled texts of both kinds: best F1 of finding the bad ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from latticework.llm import textops
from latticework.llm.tables import labelled, labelled_sample

TREES = 100
SUBSAMPLE = 256
FIT_ROWS = 20_000
KEEP_GOOD = 0.995
STEPS = 10_000
SYMBOLS = textops.byte_mask(b"#*$%&|<>")
STOPS = textops.byte_mask(b".!?")
DIGITS = textops.byte_mask(b"0123456789")
CONTINUED = textops.byte_mask(bytes(range(128, 192)))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct", "n_stops", "n_digits")


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])


def _later_copies(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True where the same value occurs earlier in the row."""
    order = np.lexsort((np.arange(len(row)), value, row))
    same = np.zeros(len(row), bool)
    if len(row) > 1:
        a, b = order[:-1], order[1:]
        same[b[(row[a] == row[b]) & (value[a] == value[b])]] = True
    return same


def statistics(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every text of a slice."""
    rows = len(offsets) - 1
    words, lines = textops.words(offsets, data), textops.lines(offsets, data)
    count = lambda row, mask=None: np.bincount(row if mask is None else row[mask], minlength=rows)
    inside = np.concatenate([[0], np.cumsum(~textops.SPACE_MASK[data])])
    full = inside[lines.ends] > inside[lines.starts]
    full_row, full_hash = lines.row[full], lines.hash[full]
    window, at = textops.windows(words, 3)
    again = _later_copies(words.row[at], window)
    twice = np.zeros(len(words), bool)
    if again.any():
        key = np.stack([words.row[at], window.view(np.int64)], axis=1)
        repeated = key[again]
        both = np.unique(np.concatenate([repeated, key]), axis=0, return_inverse=True)[1].ravel()
        hit = at[np.isin(both[len(repeated) :], both[: len(repeated)])]
        for j in range(3):
            twice[hit + j] = True
    return {
        "n_words": count(words.row), "word_chars": per_row(~textops.SPACE_MASK[data] & ~CONTINUED[data], offsets),
        "n_symbols": per_row(SYMBOLS[data], offsets), "n_dup_lines": count(full_row[_later_copies(full_row, full_hash)]),
        "n_repeat_words": count(words.row, twice), "n_lines": count(full_row),
        "n_distinct": count(words.row, ~_later_copies(words.row, words.hash)),
        "n_stops": per_row(STOPS[data], offsets), "n_digits": per_row(DIGITS[data], offsets),
    }


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def points(s: dict[str, np.ndarray]) -> np.ndarray:
    """Coordinates of the forest; texts without words are all zero but for the first."""
    n = np.maximum(s["n_words"], 1)
    return np.column_stack([
        np.log1p(s["n_words"]), np.minimum(s["word_chars"] / n, 40), s["n_symbols"] / np.maximum(s["word_chars"], 1),
        s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / n, s["n_distinct"] / n**0.9,
        np.minimum(s["n_stops"] / n, 2), s["n_digits"] / np.maximum(s["word_chars"], 1), np.log1p(n / np.maximum(s["n_lines"], 1)),
    ])


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


@dataclass
class Forest:
    """Trees as node tables: coordinate (-1 in leaves), split, left child (right is next), path length at leaves."""

    coordinate: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    size: int
    cut: float = 1.0

    @classmethod
    def grow(cls, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        size, depth = min(subsample, len(x)), int(np.ceil(np.log2(max(2, min(subsample, len(x))))))
        tables = []
        for _ in range(trees):
            nodes: list[list[float]] = [[-1, 0, 0, 0]]
            jobs = [(0, x[rng.choice(len(x), size, replace=False)], 0)]
            while jobs:
                node, own, level = jobs.pop()
                spread = own.max(axis=0) - own.min(axis=0) if len(own) else np.zeros(x.shape[1])
                if level == depth or len(own) < 2 or not spread.any():
                    nodes[node] = [-1, 0, 0, level + float(_mean_path(len(own)))]
                    continue
                c = int(rng.choice(np.flatnonzero(spread)))
                at = rng.uniform(own[:, c].min(), own[:, c].max())
                nodes[node] = [c, at, len(nodes), 0]
                nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
                low = own[:, c] < at
                jobs += [(len(nodes) - 2, own[low], level + 1), (len(nodes) - 1, own[~low], level + 1)]
            tables.append(np.array(nodes))
        most = max(map(len, tables))
        whole = np.stack([np.pad(t, ((0, most - len(t)), (0, 0))) for t in tables])
        return cls(whole[:, :, 0].astype(int), whole[:, :, 1], whole[:, :, 2].astype(int), whole[:, :, 3], size)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores 0 to 1, higher for points on short paths."""
        total = np.zeros(len(x))
        for coordinate, split, left, path in zip(self.coordinate, self.split, self.left, self.path):
            node = np.zeros(len(x), int)
            while True:
                c = coordinate[node]
                inner = np.flatnonzero(c >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = left[at] + (x[inner, c[inner]] >= split[at])
            total += path[node]
        return 2.0 ** (-total / len(self.path) / max(float(_mean_path(self.size)), 1e-9))


def best_cut(good: np.ndarray, bad: np.ndarray, n_good: np.ndarray | None = None, n_bad: np.ndarray | None = None) -> float:
    """Score up to which texts are kept, of best F1 for the bad ones; of equal ones that in the widest gap of scores.

    `n_good` and `n_bad` tell how many texts have each score (else one).
    """
    at = np.unique(np.concatenate([[0.0], good, bad]))
    n_good, n_bad = (np.ones(len(s), int) if n is None else n for s, n in ((good, n_good), (bad, n_bad)))

    def beyond(score: np.ndarray, n: np.ndarray) -> np.ndarray:
        order = np.argsort(score)
        upto = np.concatenate([[0], np.cumsum(n[order])])
        return upto[-1] - upto[np.searchsorted(score[order], at, "right")]

    lost, found = beyond(good, n_good), beyond(bad, n_bad)
    f1 = 2 * found / (found + lost + n_bad.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    above = np.append(at, 1.0)
    widest = best[np.argmax(above[best + 1] - at[best])]
    return float((at[widest] + above[widest + 1]) / 2)


def _measured(column: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    for row, end, offsets, data in textops.slices(column):
        yield row, end, statistics(offsets, data)


def _calibrated(docs: DataFrame, labels: DataFrame, forest: Forest, keep_good: float, label: str) -> float:
    """Cut-off from every labelled text that passes the base rules.

    Tasks count the texts of each label per step of 1 / STEPS of the score, so the driver gets
    at most that many numbers; a step is given by its upper end.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for row, end, s in _measured(batch.column(0)):
                step = np.ceil(model.score(points(s)) * STEPS).astype(np.int64)
                both = pa.RecordBatch.from_arrays([pa.array(step), batch.column(1).slice(row, end - row)], ["step", "y"])
                yield both.filter(pa.array(~base_failed(s)))

    known = labelled(docs, labels, label).select("text", F.col("label").cast("int"))
    got = known.mapInArrow(run, "step long, y int").groupBy("step", "y").count().toArrow()
    step, y, n = (got.column(name).to_numpy() for name in ("step", "y", "count"))
    good, bad = y == 1, y == 0
    if good.any() and bad.any():
        between = best_cut(step[good] / STEPS, step[bad] / STEPS, n[good], n[bad])
        # within a step nothing is known: the cut lies at the end of one
        return float(np.floor(between * STEPS + 1e-6)) / STEPS
    if good.any():
        order = np.argsort(step[good])
        upto = np.cumsum(n[good][order])
        return float(step[good][order][np.searchsorted(upto, np.ceil(keep_good * upto[-1]))]) / STEPS
    return 1.0


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, keep_good: float = KEEP_GOOD, label: str = "quality") -> Forest | None:
    """Forest and cut-off from the labelled texts that pass the base rules; None without any.

    The trees draw their subsamples from at most `rows` of them, the cut-off comes from all.
    Without a bad text among them the cut keeps the share `keep_good` of the good ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, s in _measured(batch.column(0)):
                x = points(s)
                found = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([found, batch.column(1).slice(row, end - row)], ["x", "y"]).filter(pa.array(~base_failed(s)))

    sample = labelled_sample(docs, labels, label, rows).select("text", F.col("label").cast("int"))
    got = sample.mapInArrow(run, "x array<double>, y int").toArrow()
    if not len(got):
        return None
    x, y = np.array(got.column("x").to_pylist()), got.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # the sample comes in any order
    forest = Forest.grow(x[order])
    forest.cut = _calibrated(docs, labels, forest, keep_good, label)
    return forest


def judged(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """`docs` with the counts, base_failed, kept and anomaly (0 to 1).

    Null and empty texts have no words and fail the base rules. Without a forest (no labelled
    text) only the base rules decide. Columns of the added names are replaced, others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    added = [*COUNTS, "base_failed", "kept", "anomaly"]
    docs = docs.drop(*added)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for row, end, s in _measured(batch.column(at)):
                score = model.score(points(s)) if model else np.zeros(end - row)
                failed = base_failed(s)
                kept = ~failed & (score <= (model.cut if model else 1.0))
                yield pa.RecordBatch.from_arrays([
                    *(c.slice(row, end - row) for c in batch.columns), *(pa.array(s[n].astype(np.int64)) for n in COUNTS),
                    pa.array(failed), pa.array(kept), pa.array(score),
                ], [*names, *added])

    kinds = [*[T.LongType()] * len(COUNTS), T.BooleanType(), T.BooleanType(), T.DoubleType()]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(added, kinds))]))
