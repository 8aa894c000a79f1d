"""Quality classification by attention-based multiple-instance learning.

A text is a bag of passages. Every passage is encoded from its surface statistics, gated
attention weighs the encodings, and the weighted sum gives the text's score. Encoder,
attention and classifier are trained together on document labels only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from latticework.llm import textops
from latticework.llm.rule_forest import CONTINUED, DIGITS, STOPS, SYMBOLS, _later_copies
from latticework.llm.tables import labelled_sample

PASSAGE_WORDS = 64
TRAIN_ROWS = 8_000
HIDDEN, GATE = 24, 12
THRESHOLD = 0.3
UPPER = textops.byte_mask(bytes(range(65, 91)))
LETTERS = textops.byte_mask(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


def passages(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and features of every passage; a text has at least one, without words an empty one."""
    rows = len(offsets) - 1
    words = textops.words(offsets, data)
    counts = np.bincount(words.row, minlength=rows)
    pieces = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(pieces)])
    place = np.arange(len(words)) - np.concatenate([[0], np.cumsum(counts)])[words.row]
    # passages of nearly equal size
    own = first[words.row] + place * pieces[words.row] // np.maximum(counts[words.row], 1)
    n, row = int(first[-1]), np.repeat(np.arange(rows), pieces)
    within = lambda mask: np.diff(np.stack([(sums := np.concatenate([[0], np.cumsum(mask)]))[words.starts], sums[words.ends]]), axis=0)[0]
    total = lambda value: np.bincount(own, weights=value, minlength=n)
    size = np.maximum(total(np.ones(len(words))), 1)
    chars = within(~CONTINUED[data])
    letters, symbols, digits = within(LETTERS[data] & ~CONTINUED[data]), within(SYMBOLS[data]), within(DIGITS[data])
    new = ~_later_copies(own, words.hash)
    same = np.zeros(len(words))
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (own[1:] == own[:-1])
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    breaks = np.zeros(len(words))
    breaks[1:] = (newline[words.starts[1:]] - newline[words.ends[:-1]]) * (words.row[1:] == words.row[:-1])
    known = np.bincount(words.row, weights=~_later_copies(words.row, words.hash), minlength=rows) / np.maximum(counts, 1) ** 0.9
    mean = total(chars) / size
    x = np.column_stack([
        np.log1p(total(np.ones(len(words)))), np.minimum(mean, 30) / 5, np.sqrt(np.maximum(total(chars**2) / size - mean**2, 0)).clip(0, 30) / 5,
        total(symbols > 0) / size, total(letters == 0) / size, np.minimum(total(symbols) / size, 5), total(digits > 0) / size,
        total(new) / size, total(same) / size, total(STOPS[data[words.ends - 1]]) / size, total(UPPER[data[words.starts]]) / size,
        np.minimum(total(breaks) / size, 3), total(chars <= 3) / size, total(chars >= 10) / size,
        np.log1p(counts)[row] / 3, known[row],
    ])
    return row, x


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, x: np.ndarray, seed: int = 5) -> Model:
        rng, d = np.random.default_rng(seed), x.shape[1]
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        return cls(x.mean(axis=0), x.std(axis=0) + 1e-6, {
            "w": draw(d, HIDDEN), "b": np.zeros(HIDDEN), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE),
            "a": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1),
        })

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        """Encodings, gates, attention and probability; passages of a bag are adjacent."""
        p = self.weights
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        starts = np.searchsorted(bag, np.arange(bags))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        weight = e / np.add.reduceat(e, starts)[bag]
        pooled = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        return {"z": z, "h": h, "t": t, "g": g, "weight": weight, "pooled": pooled, "starts": starts,
                "p": 1 / (1 + np.exp(-np.clip(pooled @ p["c"] + p["d"], -30, 30)))}

    def gradients(self, f: dict[str, np.ndarray], bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        p, out = self.weights, (f["p"] - y) / len(y)
        d_pooled = out[:, None] * p["c"]
        share = (f["h"] * d_pooled[bag]).sum(axis=1)
        d_e = f["weight"] * (share - np.add.reduceat(f["weight"] * share, f["starts"])[bag])
        d_t, d_g = d_e[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2), d_e[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        d_h = (f["weight"][:, None] * d_pooled[bag] + d_t @ p["v"].T + d_g @ p["u"].T) * (1 - f["h"] ** 2)
        return {"w": f["z"].T @ d_h, "b": d_h.sum(axis=0), "v": f["h"].T @ d_t, "u": f["h"].T @ d_g,
                "a": (f["t"] * f["g"]).T @ d_e, "c": f["pooled"].T @ out, "d": np.array([out.sum()])}


def train(x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 5e-3, decay: float = 1e-4) -> Model:
    """Adam over shuffled batches of bags."""
    model, rng = Model.start(x), np.random.default_rng(11)
    first, second = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
    bounds, step = np.searchsorted(bag, np.arange(len(y) + 1)), 0
    for epoch in range(epochs):
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            rows = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in some])
            own = np.repeat(np.arange(len(some)), bounds[some + 1] - bounds[some])
            f = model.forward(x[rows], own, len(some))
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, g in model.gradients(f, own, y[some]).items():
                g = g + decay * model.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.weights[k] = model.weights[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", where: Column | None = None, rows: int = TRAIN_ROWS) -> Model | None:
    """Train on at most `rows` labelled texts that satisfy `where`; None without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, offsets, data in textops.slices(batch.column(1)):
                of, x = passages(offsets, data)
                bounds = np.searchsorted(of, np.arange(end - row + 1)) * x.shape[1]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, end - row),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.ravel())), batch.column(2).slice(row, end - row),
                ], ["doc_id", "x", "y"])

    labels = labels if where is None else labels.filter(where)
    sample = labelled_sample(docs, labels, label, rows).select(F.col("doc_id").cast("long"), "text", F.col("label").cast("int"))
    got = sample.mapInArrow(run, "doc_id long, x array<double>, y int").toArrow().sort_by("doc_id")
    if not len(got):
        return None
    bags = [np.array(v) for v in got.column("x").to_pylist()]
    width = passages(np.array([0, 0]), np.zeros(0, np.uint8))[1].shape[1]
    sizes = [len(b) // width for b in bags]
    return train(np.concatenate(bags).reshape(-1, width), np.repeat(np.arange(len(bags)), sizes), got.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with quality_score (0 to 1), n_passages, top_attention and good (score >= threshold).

    Null and empty texts are one empty passage. Without a model (no labelled text) scores are
    0.5. Columns of the added names are replaced, others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["quality_score", "n_passages", "top_attention"]
    docs = docs.drop(*added, "good")
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, offsets, data in textops.slices(batch.column(at)):
                of, x = passages(offsets, data)
                n = end - row
                if shared.value is None:
                    value, top = np.full(n, 0.5), np.ones(n)
                else:
                    f = shared.value.forward(x, of, n)
                    value, top = f["p"], np.maximum.reduceat(f["weight"], f["starts"])
                yield pa.RecordBatch.from_arrays([
                    *(c.slice(row, n) for c in batch.columns), pa.array(value), pa.array(np.bincount(of, minlength=n).astype(np.int64)), pa.array(top),
                ], [*names, *added])

    kinds = (T.DoubleType(), T.LongType(), T.DoubleType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(added, kinds))])
    return docs.mapInArrow(run, schema).withColumn("good", F.col("quality_score") >= threshold)
