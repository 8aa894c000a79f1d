import random
import re
from collections import Counter
from zlib import crc32

from latticework.llm import spelling_variants as sv

LOWER = str.maketrans(sv.UPPER, sv.UPPER.lower())


def vocabulary(rows, least_symbols=5, least_n=3, of=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % of == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_symbols and n >= least_n}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=2):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def random_words(rng, n, letters, least=3, most=9):
    return {"".join(rng.choice(letters) for _ in range(rng.randint(least, most))): rng.choice([1, 2, 3, 5, 8, 20, 50, 300]) for _ in range(n)}


def test_against_brute_force(spark):
    rng = random.Random(11)
    for letters, n, common, most in (("ab", 500, 0, 1 << 18), ("abcé", 700, 3, 40), ("abcdefghij", 300, 10**9, 10)):
        words = random_words(rng, n, letters, least=1)
        df = spark.createDataFrame(list(words.items()), "word string, n long")
        assert found(sv.variants(df, common=common, most=most)) == brute(words)


def test_every_near_word_is_found_by_its_grams():
    rng = random.Random(12)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        at = rng.randrange(len(word) + 1)
        other = word[:at] + rng.choice("abcd") + word[at + rng.randrange(2) :]
        if not one_edit(word, other):
            continue
        short, long = sorted((word, other), key=lambda w: (len(w), w))
        padded = [f"^{w}$" for w in (short, long)]
        lists = {m: {i: {p[j : j + k]: rng.randint(5, 99) for p in padded for j in range(len(p)) for k in range(1, 9) if rng.random() < 0.6}
                     for i in range(15)} for m in range(15)}
        keys = set(sv.index_keys(padded[1], lists))
        hits = [q for q in sv.query_keys(padded[0], lists) if q[2] == len(long) and q[:2] in keys]
        assert sum((padded[1][q[4] : q[4] + len(q[5])] == q[5]) == q[3] for q in hits) == 1


def test_documents(make_docs, edge_docs, no_docs):
    rng = random.Random(13)
    texts = [" ".join(rng.choice(["Theory", "theori", "théory", "straße", "ÀB×cdé", "x1theory2theory", "abcde"]) for _ in range(40)) for _ in range(60)]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[1]), (5, None), (6, ""), (None, None)]
    docs = make_docs([t for _, t in rows], [i for i, _ in rows])
    assert found(sv.spelling_variants(docs)) == brute(vocabulary(rows))
    # a hub word with very many near words, and ties of frequency
    hub = Counter({"abcdefgh": 90} | {"abcdefgh"[:i] + c + "abcdefgh"[i + 1 :]: 3 for i in range(8) for c in "qrstuvwxyz"})
    text = " ".join(w for w, n in hub.items() for _ in range(n))
    assert found(sv.spelling_variants(make_docs([text], [1]))) == brute(vocabulary([(1, text)]))
    assert sv.spelling_variants(no_docs).count() == 0
    edge = [(r.doc_id, r.text) for r in edge_docs.collect()]
    clash = edge_docs.withColumnsRenamed({"lang": "word", "source": "form"})
    assert found(sv.spelling_variants(clash)) == brute(vocabulary(edge))
