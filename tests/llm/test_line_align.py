import random

import numpy as np

import corpus_pipeline
from latticework.llm import line_align as la


def plain(text):
    raw = text.encode()
    found, words = la.units(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
    return [raw[s:e].decode() for s, e in zip(found.starts, found.ends)], list(words), list(found.hash)


def test_units():
    texts, words, hashes = plain("One two. Three!  Four\n\n five six\nThree!")
    assert texts == ["One two.", "Three!", "Four", "five six", "Three!"]
    assert words == [2, 1, 1, 2, 1]
    assert hashes[1] == hashes[4] != hashes[2]
    assert plain("  \n") == ([], [], [])


def test_patience():
    assert la.patience(list("abcxd"), list("zabcd")) == [(0, 1), (1, 2), (2, 3), (4, 4)]
    assert la.patience([], [1]) == [] and la.patience([1, 1], [1]) == [(0, 0)]
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(9))] for _ in range(2))
        found = la.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))


def test_blocks_that_moved():
    earlier, later = [1, 2, 3, 4, 5, 6], [9, 4, 5, 6, 8, 1, 2, 3]
    assert sorted(la.common_blocks(earlier, later, [10] * 8)) == [(1, 4), (5, 8)]
    assert la.common_blocks(earlier, later, [5] * 8) == []


def test_passages_that_an_alignment_does_not_take():
    lost = lambda *a: {i for r in la.common_blocks(*a) for i in range(*r)}
    short, long = [1, 2, 3, 4, 5], [11, 12, 13]
    assert lost(short + long, long + short, [20] * 3 + [4] * 5) == {0, 1, 2}  # short lines outnumber the passage
    assert lost([8, *long, 9, *long, 7], [5, *long, 6, *long, 4], [1, *[10] * 3] * 2 + [1]) == {1, 2, 3, 5, 6, 7}  # nothing is unique
    rng = random.Random(14)
    for _ in range(200):
        sizes = [rng.choice([1, 4, 9, 15, 26]) for _ in range(6)]
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        w = [sizes[x] for x in b]
        same = {
            i for f in range(len(b)) for e in range(f + 1, len(b) + 1) for i in range(f, e)
            if sum(w[f:e]) >= 25 and any(a[j : j + e - f] == b[f:e] for j in range(len(a)))
        }
        assert same <= lost(a, b, w)


def test_later_documents_lose_the_passage(make_docs):
    rng = random.Random(4)
    sentence = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)).capitalize() + "."
    passage = "\n".join(sentence(9) for _ in range(7))
    closing = sentence(8)
    texts = [f"{sentence(30)}\n{passage}\n{sentence(20)}\n{closing}", f"{sentence(30)} {passage} {sentence(12)}\n{closing}", f"{sentence(40)}\n{closing}"]
    texts += [texts[0], passage, f"{sentence(5)}\n{passage}"]
    got = {r.doc_id: r for r in la.deduplicated(make_docs(texts)).collect()}
    assert got[0].text == texts[0] and got[2].text == texts[2]
    assert passage.split("\n")[3] not in got[1].text and closing in got[1].text and got[1].removed_words == 63
    assert got[3].emptied and got[4].emptied and got[4].text == ""
    assert got[5].text == texts[5].split("\n")[0] + "\n" and not got[5].emptied


def test_many_copies_of_one_passage(make_docs):
    passage = " ".join(f"p{i}" for i in range(60)) + "."
    texts = [f"start {i} of its own text here.\n{passage}" for i in range(300)]
    got = la.deduplicated(make_docs(texts)).collect()
    assert sorted(r.doc_id for r in got if r.removed_words == 0) == [0]
    assert sum(r.removed_words for r in got) == 299 * 60


def test_copies_can_be_left_whole(make_docs):
    rng = random.Random(6)
    sentence = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)).capitalize() + "."
    passage = [sentence(10) for _ in range(6)]
    own = [sentence(10) for _ in range(12)]
    copy = [*own[:5], sentence(10), *own[6:]]
    texts = [" ".join(own), " ".join(copy), " ".join([*passage, sentence(60)]), " ".join([sentence(60), *passage])]
    got = {r.doc_id: r for r in la.deduplicated(make_docs(texts), copy_share=0.65).collect()}
    assert got[1].text == texts[1] and got[3].removed_words == 60
    assert {r.doc_id: r.removed_words for r in la.deduplicated(make_docs(texts)).collect()}[1] == 110


def test_runs_reach_every_unit_of_a_block():
    rng = random.Random(11)
    for _ in range(50):
        words = np.array([rng.choice([1, 2, 5, 12, 30]) for _ in range(rng.randrange(1, 30))])
        row = np.sort(np.array([rng.randrange(3) for _ in words]))
        hashes = np.array([rng.randrange(5) for _ in words], np.uint64)
        first, end, value = la.runs(row, hashes, words, 25)
        seen = {}
        for f, e, v in zip(first, end, value):
            assert row[f] == row[e - 1] and words[f:e].sum() >= 25 > min(words[f + 1 : e].sum(), words[f : e - 1].sum())
            assert seen.setdefault(v, tuple(hashes[f:e])) == tuple(hashes[f:e])
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                if row[a] == row[b - 1] and words[a:b].sum() >= 25:
                    assert set(range(a, b)) <= {i for f, e in zip(first, end) if a <= f and e <= b for i in range(f, e)}


def test_units_that_point_to_several_documents(make_docs):
    rng = random.Random(12)
    sentence = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)).capitalize() + "."
    passage = [sentence(n) for n in (12, 18, 9, 11, 10, 2)]
    others = [f"{sentence(30)} {passage[i]} {sentence(30)}" for i in (0, 2, 3, 4)]  # single sentences, earlier
    texts = [*others, f"{sentence(40)} {' '.join(passage)} {sentence(8)}", f"{sentence(35)} {' '.join(passage)}"]
    got = {r.doc_id: r for r in la.deduplicated(make_docs(texts)).collect()}
    assert [got[i].removed_words for i in range(6)] == [0] * 5 + [62]


def test_passages_of_short_units(make_docs):
    rng = random.Random(13)
    shouts = [f"Shout{i}!" for i in range(50)]
    lines = [f"item {i}" for i in range(13)]
    texts = [" ".join(shouts), "\n".join(["own", *lines]), "Other start. " + " ".join(shouts), "\n".join([*lines, "end"]), "\n".join(lines[:12])]
    got = {r.doc_id: r.removed_words for r in la.deduplicated(make_docs(texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 50, 3: 26, 4: 0}


def test_only_pairs_that_the_next_stage_joins_stay_whole(make_docs):
    rng = random.Random(8)
    sentence = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)).capitalize() + "."
    own, other = [sentence(10) for _ in range(20)], [sentence(10) for _ in range(20)]
    part = [*own[:16], *(sentence(10) for _ in range(4))]  # 80 % of the words, Jaccard 0.66
    copy = [*own[:19], sentence(10)]  # Jaccard 0.9
    passage = [sentence(10) for _ in range(3)]
    pulled = [*passage, *other], [sentence(40), *other, *passage, sentence(10)], [sentence(15), *passage]
    texts = [" ".join(x) for x in (own, part, copy, pulled[2], pulled[0], [*pulled[0][:-1], sentence(10)], pulled[1])]
    got = {r.doc_id: r for r in la.deduplicated(make_docs(texts), similar=(5, 80, 100)).collect()}
    assert got[1].removed_words == 160 and got[2].text == texts[2] and got[0].text == texts[0]
    # both of a pair of copies lose the passage of an earlier text and are still joined; the last is not alike
    assert got[4].removed_words == got[5].removed_words == 30 and la.alike(got[4].text, got[5].text, 5, 80, 100)
    assert got[6].removed_words == 230
    assert not la.alike(texts[0], texts[1], 5, 80, 100) and la.alike(texts[0], texts[2].upper(), 5, 80, 100)


def test_pipeline_cuts_pairs_that_are_no_near_duplicates(spark, make_docs):
    rng = random.Random(10)
    sentence = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)).capitalize() + "."
    own = [sentence(10) for _ in range(20)]
    docs = make_docs([" ".join(own), " ".join([*own[:16], *(sentence(10) for _ in range(4))])])
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert got[0] == " ".join(own) and own[3] not in got[1]


def test_copies_pulled_apart_by_other_cuts_are_cut(make_docs):
    rng = random.Random(9)
    sentence = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)).capitalize() + "."
    passage, rest = [sentence(10) for _ in range(12)], [sentence(10) for _ in range(3)]
    changed = [*passage[:11], sentence(10)]
    texts = [" ".join([sentence(30), *passage]), " ".join([*passage, *rest]), " ".join([*rest, *changed])]
    assert la.alike(texts[1], texts[2], 5, 80, 100)
    got = {r.doc_id: r for r in la.deduplicated(make_docs(texts), similar=(5, 80, 100)).collect()}
    assert got[1].removed_words == 120 and rest[2] not in got[2].text and got[2].removed_words == 140


def test_edges(edge_docs, no_docs):
    got = la.deduplicated(edge_docs)
    assert got.columns[: len(edge_docs.columns)] == edge_docs.columns
    assert sorted(map(str, (r.text for r in got.collect()))) == sorted(map(str, (r.text for r in edge_docs.collect())))
    assert la.deduplicated(no_docs).count() == 0
