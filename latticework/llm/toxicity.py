"""Toxicity by a weighted finite-state pattern grammar over clauses.

Insult lexemes (whole words and word stems) and their weights are log odds learned
from labelled texts; threats, targets, negations and verbs of speech are fixed short
lists. Per clause, the composed transducers find the best path through its words, so a
denied or quoted insult counts less and an aimed one more. A logistic curve over a
text's clause scores, fitted on lexicons that have not seen the text, gives 0 to 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from latticework.llm import transducers as fst
from latticework.llm.tables import labelled_sample, stored

TRAIN_ROWS = 20_000
STEMS = range(4, 9)
MOST_LEXEMES = 20_000
THRESHOLD = 0.3
ADDED = ("toxic_score", "toxic_clauses")

# fixed values: closed word classes of English, German, French, Spanish
WORD_CLASSES = {
    fst.THREAT: "kill hurt destroy beat burn shoot strangle töten umbringen schlagen vernichten tuer frapper brûler "
                "détruire matar golpear quemar destruir",
    fst.TARGET: "you your yours yourself he she they them her him du dich dir dein euch ihr sie tu te toi vous votre "
                "elle ils usted tú ti ustedes ella ellos",
    fst.NEGATION: "not no never nobody isn't aren't don't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún",
    fst.REPORT: "said says called quoted wrote claimed sagte sagt schrieb nannte dit disait écrit appelait dijo dice "
                "escribió llamó",
}
CLASS_OF = {word: kind for kind, words in WORD_CLASSES.items() for word in words.split()}
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;\n|]")


@dataclass
class Model:
    """Lexeme weights (a stem ends with *), and the curve over a text's clause scores."""

    lexicon: dict[str, float]
    curve: tuple[float, float, float] = (-4.0, 2.0, 1.0)


class Scorer:
    """Finds clauses with an insult or threat and scores them; built once per task."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.machine = fst.grammar()
        self.words = {w: x for w, x in lexicon.items() if not w.endswith("*")}
        self.stems = {w[:-1]: x for w, x in lexicon.items() if w.endswith("*")}
        self.search = ahocorasick.Automaton()
        for word in {*self.words, *self.stems, *WORD_CLASSES[fst.THREAT].split()}:
            self.search.add_word(word, len(word))
        self.search.make_automaton()

    def token(self, word: str) -> tuple[str, float]:
        weight = self.words.get(word)
        if weight is None and self.stems:
            weight = next((self.stems[word[:n]] for n in reversed(STEMS) if word[:n] in self.stems), None)
        if weight is not None:
            return fst.INSULT, weight
        return CLASS_OF.get(word, fst.OTHER), 1.0

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """Bounds and scores of the clauses that hold a lexeme, over the whole text."""
        low, found, end = text.lower(), [], 0
        if len(low) != len(text):
            text = low
        for last, size in self.search.iter(low):
            start = last - size + 1
            if start < end or (start and low[start - 1].isalpha()):
                continue
            first = start
            while first > end and not CLAUSE_END.match(low[first - 1]):
                first -= 1
            stop = CLAUSE_END.search(low, last)
            end = stop.start() if stop else len(low)
            score = self.machine.best([self.token(m.group()) for m in WORD.finditer(low, first, end)])
            if score > 0:
                found.append((first, end, score))
        return found

    def features(self, text: str) -> tuple[float, float, int]:
        scores = [s for _, _, s in self.clauses(text)]
        return float(np.log1p(sum(scores))), float(np.log1p(max(scores, default=0.0))), len(scores)


def remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string")) % of


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of toxic texts with their neighbours at the first place in the text, by fold."""
    for batch in batches:
        word, context, fold = [], [], []
        for text, half in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = WORD.findall((text or "").lower())
            met: set[str] = set()
            for before, it, after in zip(["", *tokens], tokens, [*tokens[1:], ""]):
                if it not in met:
                    met.add(it)
                    word.append(it)
                    context.append(f"{before} {after}")
                    fold.append(half)
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(context, pa.string()), pa.array(fold, pa.int32())], ["word", "context", "fold"])


def _log_odds(pos: float, neg: float, texts: tuple[int, int], smooth: float = 5.0) -> float:
    """Log odds against the share of toxic texts, smoothed towards it so that a rare word can't weigh much."""
    prior = (texts[0] + 1) / (sum(texts) + 2)
    return float(np.log((pos + smooth * prior) / (neg + smooth * (1 - prior))) - np.log(prior / (1 - prior)))


def _chosen(vocabulary: DataFrame) -> list[tuple]:
    """(lexeme, p0, p1, n0, n1) of words that toxic texts favour and of stems that many such words share."""
    favoured = F.expr("p0 + p1 >= 3 and n0 + n1 <= 0.5 * (p0 + p1)")
    value = F.expr("p0 + p1 - n0 - n1")
    counts = ["p0", "p1", "n0", "n1"]
    words = vocabulary.filter(favoured).orderBy(F.desc(value), "word").limit(MOST_LEXEMES)
    stems = vocabulary.select(F.explode(F.array(*[F.substring("word", 1, n) for n in STEMS])).alias("stem"), "word", *counts)
    stems = stems.filter(F.length("word") > F.length("stem")).groupBy("stem").agg(
        *[F.sum(c).alias(c) for c in counts], F.sum(F.expr("int(p0 + p1 >= 2 and n0 + n1 = 0)")).alias("pure")
    ).filter("pure >= 5 and n0 + n1 <= 0.05 * (p0 + p1)").orderBy(F.desc(value), "stem").limit(MOST_LEXEMES)
    words = words.select(F.col("word").alias("lexeme"), *counts)
    return [tuple(r) for r in words.unionByName(stems.select(F.concat("stem", F.lit("*")).alias("lexeme"), *counts)).collect()]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", train: Column | None = None,
    train_rows: int = TRAIN_ROWS, least: float = 2.0, at_least: int = 3,
) -> Model:
    """Learn lexemes and curve from at most `train_rows` labelled rows that satisfy `train`.

    Words are counted by distinct neighbours in toxic texts, so copies of one text
    don't make its words lexemes. Without toxic labels the lexicon is empty and scores are low.
    """
    labels = labels if train is None else labels.filter(train)
    sample = labelled_sample(docs, labels, label, train_rows)
    sample = stored(sample.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")), "toxic-sample")
    totals = {(r["label"], r["fold"]): r["n"] for r in sample.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    toxic = sample.filter("label = 1").select("text", "fold").mapInArrow(_pairs, "word string, context string, fold int")
    by_fold = [F.sum(F.when(F.col("fold") == f, 1).otherwise(0)) for f in (0, 1)]
    seen = toxic.distinct().groupBy("word").agg(by_fold[0].alias("p0"), by_fold[1].alias("p1"))
    clean = sample.filter("label = 0").select(
        "fold", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+(?:['’][\p{L}]+)?)")))).alias("word")
    ).groupBy("word").agg(by_fold[0].alias("n0"), by_fold[1].alias("n1"))
    rows = _chosen(stored(seen.join(clean, "word", "full").fillna(0, ["p0", "p1", "n0", "n1"]), "toxic-words"))

    def lexicon(folds: tuple[int, ...]) -> dict[str, float]:
        texts = tuple(sum(totals.get((label, f), 0) for f in folds) for label in (1, 0))
        sums = [(r[0], sum(r[1 + f] for f in folds), sum(r[3 + f] for f in folds)) for r in rows]
        weights = {lexeme: _log_odds(pos, neg, texts) for lexeme, pos, neg in sums if pos >= at_least}
        return {lexeme: weight for lexeme, weight in weights.items() if weight >= least}

    halves = [lexicon((1,)), lexicon((0,))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(x) for x in halves]
        for batch in batches:
            got = [scorers[fold].features(text or "")[:2] for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), batch.column(2)], ["total", "most", "label"])

    measured = sample.select("text", "fold", F.col("label").cast("int")).mapInArrow(measure, "total double, most double, label int").toArrow()
    model = Model(lexicon((0, 1)))
    y = measured.column("label").to_numpy()
    if 0 < y.sum() < len(y):
        x = np.column_stack([measured.column("total").to_numpy(), measured.column("most").to_numpy()])
        w = _logistic(x, y)
        if w[1] >= 0 and w[2] >= 0:
            model.curve = tuple(float(v) for v in w)
        else:
            w = _logistic(x[:, :1], y)
            model.curve = (float(w[0]), max(0.0, float(w[1])), 0.0)
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with toxic_score (0 to 1), toxic_clauses and toxic (score >= threshold).

    A null or empty text has no clause and gets the lowest score. All columns and rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, (a, b, c) = Scorer(shared.value.lexicon), shared.value.curve
        for batch in batches:
            got = [scorer.features(text or "") for text in batch.column(at).to_pylist()]
            value = [float(1 / (1 + np.exp(-(a + b * x + c * y)))) for x, y, _ in got]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(value, pa.float64()), pa.array([n for _, _, n in got], pa.int64())],
                [*batch.schema.names, *ADDED],
            )

    kept = docs.drop(*ADDED, "toxic")
    at = kept.columns.index("text")
    schema = T.StructType([*kept.schema.fields, T.StructField(ADDED[0], T.DoubleType()), T.StructField(ADDED[1], T.LongType())])
    return kept.mapInArrow(run, schema).withColumn("toxic", F.col(ADDED[0]) >= threshold)
