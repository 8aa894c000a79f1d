import random
import re

import numpy as np
import pytest

from latticework.llm import ngram_join
from latticework.llm.count_rtree import CountTree, needed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, k, part, whole):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and whole * len(a & b) >= part * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def family(rng, n, copies, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(n)]
    out = [" ".join(base)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(n)] = f"w{rng.randrange(400)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("k", "part", "chunk", "frequent"), [(4, 85, 2048, 64), (5, 80, 8, 4)])
def test_against_brute_force(make_docs, monkeypatch, k, part, chunk, frequent):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng = random.Random(3)
    texts = ["common line of words here", "", None, "one", "One", "two words"]
    for n, copies, edits in ((60, 40, 3), (120, 15, 6), (30, 10, 1), (8, 6, 1), (300, 4, 12)):
        texts += [t + "\nthe very same closing line in all of them" for t in family(rng, n, copies, edits)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = ngram_join.jaccard_classes(make_docs([t for _, t in rows], [i for i, _ in rows]), k, part, frequent=frequent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k, part, 100)


def test_edges(edge_docs, no_docs):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.jaccard_classes(edge_docs).collect()}
    assert got[0, 0] == 0 and got[1, 0] == 1 and got[2, 0] == 2
    assert got[4, 3] == got[5, 3] == 4
    assert got[None, 1] is None
    assert got[7, 1] == 7 and got[8, 1] == 8
    assert ngram_join.jaccard_classes(edge_docs).count() == edge_docs.count()
    assert ngram_join.jaccard_classes(no_docs).count() == 0


def test_one_stays(edge_docs):
    kept = ngram_join.one_per_component(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 4 in ids and 5 not in ids and None in ids and ids.count(8) == 2


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(1)
    points = rng.poisson(2.0, (500, 16)).astype(np.int32)
    points[250:] = points[:250] + (rng.random((250, 16)) < 0.05)
    sizes = points.sum(axis=1)
    tree = CountTree(points, sizes, leaf=8)
    for i in range(0, 500, 17):
        bound = np.minimum(points[i], points).sum(axis=1)
        assert set(tree.search(points[i], sizes[i], 85, 100)[0]) == set(np.flatnonzero(bound >= needed(sizes[i], sizes, 85, 100)))
