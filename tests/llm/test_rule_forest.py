import collections
import os
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from latticework.llm import rule_forest, textops
from latticework.llm.queries import QUERIES
from latticework.llm.tables import read_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n#|", max_size=60), min_size=1, max_size=6))
def test_counts(texts):
    for row, end, offsets, data in textops.slices(pa.array(texts)):
        s = rule_forest.statistics(offsets, data)
        for i in range(end - row):
            assert tuple(int(s[n][i]) for n in rule_forest.COUNTS) == plain(texts[row + i])


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (2000, 4)), rng.normal(8, 0.5, (20, 4))])
    score = rule_forest.Forest.grow(x).score(x)
    assert score[2000:].min() > np.quantile(score[:2000], 0.99)


def test_cut_uses_both_labels():
    good, bad = np.linspace(0.3, 0.5, 100), np.array([0.49, *np.linspace(0.6, 0.7, 9)])
    assert 0.5 < rule_forest.best_cut(good, bad) < 0.6
    assert rule_forest.best_cut(np.array([0.6]), np.array([0.4])) < 0.4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables not present")
def test_bad_texts_go_and_good_ones_stay(spark):
    folder = "/root/testdata/sf0.01"
    known = {r.doc_id: r.quality for r in read_table(spark, folder, "labels").collect()}
    rows = [r for r in QUERIES["op6_rule_forest"](spark, folder).collect() if not r.base_failed]
    share = lambda label: np.mean([r.kept for r in rows if known.get(r.doc_id) == label])
    assert share(1) >= 0.95 and share(0) <= 0.25


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    for docs in (edge_docs, no_docs):
        for known in (labels, labels.limit(0)):
            got = rule_forest.judged(docs, rule_forest.fit(docs, known)).collect()
            assert len(got) == docs.count()
            assert all(r.base_failed and not r.kept for r in got if r.n_words < 50)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables not present")
def test_cut_comes_from_all_labelled_texts(spark):
    """With trees from few texts the cut is still the best one for all of them."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (read_table(spark, folder, name) for name in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    forest = rule_forest.fit(docs, labels, rows=40)
    rows = [r for r in rule_forest.judged(docs, forest).collect() if not r.base_failed and r.doc_id in known]
    score, bad = np.array([r.anomaly for r in rows]), np.array([known[r.doc_id] == 0 for r in rows])
    f1 = lambda cut: 2 * (bad & (score > cut)).sum() / ((score > cut).sum() + bad.sum())
    assert len(rows) > 300 and f1(forest.cut) >= max(map(f1, np.arange(10_001) / 10_000)) - 1e-9
