import random
from collections import Counter

import numpy as np
import pytest

from latticework.llm import suffix_dedup, two_stage


def symbols(rng):
    k = rng.choice([1, 2, 3, 5])
    if rng.random() < 0.6:
        return np.array([rng.randrange(k) for _ in range(rng.randint(1, 60))], np.int16)
    return np.array([rng.randrange(k) for _ in range(rng.randint(1, 6))] * rng.randint(1, 9), np.int16)


def test_two_stage_order_against_sorted_suffixes():
    rng = random.Random(1)
    for _ in range(1500):
        text = symbols(rng)
        n = len(text)
        smaller = two_stage.smaller_than_next(text)
        assert [bool(x) for x in smaller] == [list(text[i:]) < list(text[i + 1 :]) for i in range(n)]
        assert two_stage.suffix_order(text, 10**9).tolist() == sorted(range(n), key=lambda i: list(text[i:]))
        depth = rng.randint(1, 8)
        order = two_stage.suffix_order(text, depth).tolist()
        heads = [list(text[i : i + depth]) for i in order]
        assert sorted(order) == list(range(n)) and heads == sorted(heads)
    assert len(two_stage.suffix_order(np.zeros(0, np.int16), 4)) == 0


def brute(texts, length):
    """(removed ranges, bytes kept) of each text."""
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if counts[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate([[False], gone]).astype(int))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)).tolist()))
        out.append((spans, bytes(np.frombuffer(r, np.uint8)[~gone[:-1]])))
    return out


def test_every_window_is_in_one_piece(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 50)
    rng = random.Random(2)
    for _ in range(200):
        raws = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 90))).encode() for _ in range(4)]
        data = np.frombuffer(b"".join(raws), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
        start, windows, *_ = suffix_dedup.pieces(offsets, data, 12, 4)
        seen = sorted(i for s, n in zip(start.tolist(), windows.tolist()) for i in range(s, s + n))
        assert seen == [int(o) + i for o, r in zip(offsets, raws) for i in range(len(r) - 11)]


def shared_texts(rng, n):
    """Copies, a passage in ever other surroundings, periodic stretches and prose of few letters."""
    passage = "".join(rng.choice("abcdefgh ") for _ in range(30))
    texts = ["ab" * 30, "a" * 50, "x" + "a" * 20, passage, passage, "", None, "é" * 25 + "\0" * 14]
    for i in range(n):
        text = "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(0, 40)))
        at = rng.randint(0, 30)
        texts.append(text + passage[at : at + rng.randint(0, 30)] + "".join(rng.choice("klmnopq\n") for _ in range(rng.randint(0, 40))))
        if rng.random() < 0.3:
            texts.append(texts[-1])
    return texts


@pytest.mark.parametrize(("gram", "group"), [(4, 2048), (3, 4)])
def test_against_brute_force(make_docs, gram, group):
    texts = shared_texts(random.Random(gram), 150)
    docs = make_docs(texts, [None if i % 40 == 39 else i // 2 for i in range(len(texts))])
    rows = suffix_dedup.without_repeats(docs, length=12, gram=gram, group=group).select("text", "removed", "kept").collect()
    want = Counter((t, tuple(spans), kept) for t, (spans, kept) in zip(texts, brute(texts, 12)))
    assert Counter((r.text, tuple((x.start, x.length) for x in r.removed), bytes(r.kept)) for r in rows) == want


def test_edges(edge_docs, no_docs):
    clash = edge_docs.withColumnsRenamed({"lang": "spans", "source": "sig"}).withColumn("sig2", edge_docs.n_chars).withColumn("kept", edge_docs.n_chars)
    clash = clash.unionByName(clash.filter("doc_id = 3"))  # a repeated row loses all
    out = suffix_dedup.without_repeats(clash)
    assert out.columns == ["doc_id", "text", "spans", "sig", "n_chars", "sig2", "kept", "removed"]
    for r in out.collect():
        raw = (r.text or "").encode()
        assert bytes(r.kept) == (b"" if r.doc_id == 3 else raw) and [tuple(x) for x in r.removed] == ([(0, len(raw))] if r.doc_id == 3 else [])
    assert suffix_dedup.without_repeats(no_docs).count() == 0


def test_long_text(make_docs):
    rng = random.Random(5)
    half = " ".join(f"w{rng.randrange(10**6)}" for _ in range(180_000))
    texts = [half + " middle " + half, half[:500_000], "alone " * 10]
    rows = {r.doc_id: r for r in suffix_dedup.without_repeats(make_docs(texts)).collect()}
    assert len(half) > suffix_dedup.SEGMENT and bytes(rows[0].kept) == b" middle "
    assert rows[1].kept == b"" and bytes(rows[2].kept).decode() == texts[2]
