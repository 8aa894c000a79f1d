import hashlib
import random
import re
from zlib import crc32

import numpy as np

from latticework.llm import periodic_runs as pr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least_words=6, least_exponent=4):
    """All maximal stretches with their smallest period, by trying every start and period."""
    n, found = len(words), {}
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least_words, least_exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def brute(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def random_words(rng):
    """Prose with planted repeats, nested ones too."""
    words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 30))]
    for _ in range(rng.randint(0, 3)):
        piece = words[-rng.randint(1, 12) :] or ["x"]
        words += piece * rng.randint(1, 6) + piece[: rng.randint(0, len(piece))] + [rng.choice("abcxyz") for _ in range(rng.randint(0, 6))]
    return words


def test_find_runs_against_brute_force():
    rng = random.Random(13)
    for _ in range(60):
        texts = [random_words(rng) for _ in range(50)]
        value = np.array([ord(w) for t in texts for w in t], np.uint64)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        found = pr.find_runs(value, row)
        for i, words in enumerate(texts):
            assert found.get(i, []) == brute_runs(words)


def test_other_bounds():
    rng = random.Random(14)
    texts = [random_words(rng) for _ in range(400)]
    for words in texts:
        value = np.array([ord(w) for w in words], np.uint64)
        assert pr.find_runs(value, np.zeros(len(words), np.int64), 9, 5).get(0, []) == brute_runs(words, 9, 5)


def found(df):
    return sorted((str(r.doc_id), (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)) for r in df.collect())


def test_documents(make_docs, edge_docs, no_docs):
    rng = random.Random(15)
    rows = [(i, rng.choice([" ", "\n", "  ", "\t\x0b"]).join(random_words(rng))) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, "a b " * 9), (900, None), (None, None), (902, ""), (903, "  \n"), (904, "x " * 20_000)]
    rows += [(10_000 + i, " ".join(f"w{j}" for j in range(2_000))) for i in range(12)]
    docs = make_docs([t for _, t in rows], [i for i, _ in rows])
    want = sorted((str(i), brute(i, t)) for i, t in rows if i != 904)
    assert [r for r in found(pr.digests(pr.with_runs(pr.planted(docs)))) if r[0] != "904"] == want
    long = pr.with_runs(docs.filter("doc_id = 904")).first()
    assert [tuple(r) for r in long.runs] == [(0, 20_000, 1)] and long.collapsed == "x"
    assert pr.with_runs(no_docs).count() == 0
    clash = edge_docs.withColumnsRenamed({"lang": "runs", "source": "collapsed"})
    out = pr.with_runs(clash)
    assert out.columns == ["doc_id", "text", "n_chars", "runs", "collapsed"]
    for r in out.collect():
        words = WORD.findall(r.text or "")
        assert r.runs == [] and r.collapsed == " ".join(words)
