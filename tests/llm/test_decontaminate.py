import collections
import random
import re

import numpy as np

from latticework.llm import decontaminate as dc


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def brute(docs, items, k=5, least=0.8):
    own, out = collections.defaultdict(set), {}
    lists = {i: words(t) for i, t in items}
    grams = lambda w: [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)]
    for i, w in lists.items():
        for g in grams(w) if w else ():
            own[g].add(i)
    for d, t in docs:
        w = words(t)
        for i, item in lists.items():
            if not item or len(w) < len(item):
                continue
            b, best = collections.Counter(grams(item)), 0.0
            for s in range(len(w) - len(item) + 1):
                a = collections.Counter(grams(w[s : s + len(item)]))
                weight = {g: 1 / max(1, len(own.get(g, ()))) for g in a | b}
                best = max(best, sum(min(a[g], b[g]) * weight[g] for g in weight) / sum(max(a[g], b[g]) * weight[g] for g in weight))
            if best >= least:
                out[d, i] = round(best, 9)
    return out


def test_against_brute_force(spark, make_docs):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 4, 5, 8, 20, 20, 45, 60, 120])] + [(9, ""), (10, None)]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randrange(2, 150))]
        if d % 2:
            item = words(items[rng.randrange(9)][1])
            for _ in range(rng.randrange(3)):
                item[rng.randrange(len(item))] = word()
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() if rng.random() < 0.2 else x for x in item]
        docs.append((d, ", ".join(w)))
    docs += [(60, None), (61, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (dc.ITEM_BLOCK, 2):  # results don't depend on how the items are cut into blocks
        got = dc.leaks(make_docs([t for _, t in docs]), benchmark, block=block).collect()
        assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == brute(docs, items)


def test_shared_shingles_weigh_alike_in_every_block(spark, make_docs):
    common = " ".join(f"c{i}" for i in range(20))
    items = [(i, f"{common} " + " ".join(f"own{i}x{j}" for j in range(12))) for i in range(9)]
    text = f"{common} " + " ".join(f"own3x{j}" for j in range(9)) + " and then more of it"
    docs, benchmark = make_docs([text]), spark.createDataFrame(items, "item_id long, text string")
    found = [{(r.item_id, r.similarity) for r in dc.leaks(docs, benchmark, least=0.1, block=b).collect()} for b in (dc.ITEM_BLOCK, 4, 2)]
    assert found[0] == found[1] == found[2] and len(found[0]) >= 1


def brute_short(docs, items, k=5, least=0.8):
    """As `brute`, for texts of fewer words than the item, taken as one window."""
    own, out = collections.defaultdict(set), {}
    grams = lambda w: [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)]
    lists = {i: words(t) for i, t in items}
    for i, w in lists.items():
        for g in grams(w):
            own[g].add(i)
    for d, t in docs:
        for i, item in lists.items():
            if 0 < len(words(t)) < len(item):
                a, b = collections.Counter(grams(words(t))), collections.Counter(grams(item))
                weight = {g: 1 / max(1, len(own.get(g, ()))) for g in a | b}
                value = sum(min(a[g], b[g]) * weight[g] for g in weight) / sum(max(a[g], b[g]) * weight[g] for g in weight)
                if value >= least:
                    out[d, i] = round(value, 9)
    return out


def test_texts_shorter_than_an_item(spark, make_docs):
    rng = random.Random(15)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(n))) for i, n in enumerate([3, 6, 12, 20, 40, 60])]
    items.append((6, items[5][1] + " one more"))
    docs = []
    for _, text in items:
        w = words(text)
        docs += [w[:-1], w[1:], w[: int(0.9 * len(w))], w[: int(0.75 * len(w))], w[2:-2], w[:4], [*w[: len(w) - 3], "x", "y"]]
    docs = [(d, " ".join(w)) for d, w in enumerate(docs)]
    short = brute_short(docs, items)
    got = dc.leaks(make_docs([t for _, t in docs]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(short) >= 10
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == brute(docs, items) | short
    sizes = {d: len(words(t)) for d, t in docs}
    assert all((r.first_word, r.end_word) == (0, sizes[r.doc_id]) for r in got if (r.doc_id, r.item_id) in short)


def test_multi_index_lists_all_within_the_radius():
    rng = np.random.default_rng(2)
    items = dc.Items([(i, " ".join(f"x{rng.integers(1000)}" for _ in range(12))) for i in range(40)], 5, (np.zeros(0, np.uint64), np.zeros(0)))
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for n in range(300):  # flip 0 to 24 bits of an item's fingerprint
        flips = rng.choice(64, rng.integers(0, 25), replace=False).astype(np.uint64)
        prints[n] = items.prints[n % 40] ^ np.bitwise_or.reduce(np.uint64(1) << flips, initial=np.uint64(0))
    want = {(w, i) for w in range(300) for i in range(40) if int(prints[w] ^ items.prints[i]).bit_count() <= dc.RADIUS}
    assert set(items.within(prints, np.arange(40))) == want


def test_edges(spark, edge_docs, no_docs):
    benchmark = spark.createDataFrame([(1, "two three four five six"), (1, "two three four five six"), (None, "x"), (2, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.leaks(edge_docs, benchmark).collect()} == {(4, 1), (5, 1)}
    kept = dc.clean(edge_docs, benchmark)
    assert kept.columns == edge_docs.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 6, 7, 8, None}
    assert dc.leaks(no_docs, benchmark).count() == 0
    assert dc.leaks(edge_docs, benchmark.limit(0)).count() == 0
