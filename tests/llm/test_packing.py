import collections
import random
import zlib

import numpy as np
import pytest

from latticework.llm import packing

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, window):
    whole = tokenizers.Tokenizer.from_file(PATH)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(docs)
    for i, text in docs.items():
        ids, at = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    padding = 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
        padding += window - end
    return padding


def test_round_trip(make_docs):
    rng = random.Random(2)
    texts = [None, "", "<|endoftext|> is text", "  spaces \n\n and\ttabs ", "naïve 漢字 🙂", "long text " * 9_000]
    texts += [" ".join(rng.choice(["the", "of", "quixotic", "und"]) for _ in range(int(rng.expovariate(0.01)))) for _ in range(150)]
    rows = packing.packed(make_docs(texts), PATH, window=256).collect()
    assert check(rows, dict(enumerate(texts)), 256) < 256


@pytest.mark.parametrize("seed", range(6))
def test_layout_fills_windows(seed):
    rng = np.random.default_rng(seed)
    window = 64
    lengths = rng.integers(1, window, 3_000) if seed % 2 else np.minimum(window - 1, rng.geometric(0.05, 3_000))
    counts = np.bincount(lengths, minlength=window + 1)
    layout, filled, cut = packing.Layout(counts, window), collections.Counter(), 0
    for length in range(1, window):
        for rank in range(counts[length]):
            parts = layout.place(length, rank)
            cut += len(parts) > 1
            assert sum(p[1] for p in parts) == length
            for _, size, sequence, offset in parts:
                filled.update((sequence, offset + i) for i in range(size))
    assert set(filled.values()) == {1}
    assert len(filled) == int((counts * np.arange(window + 1)).sum())
    assert max(s for s, _ in filled) * window < len(filled)
    assert layout.sequences > 0 and cut < 1_200


def test_least_squares_stays_within_the_histogram():
    counts = np.zeros(65, np.int64)
    counts[[10, 54, 20, 24, 30]] = [7, 5, 6, 6, 3]
    rows = packing.combinations(counts, 64)
    times = packing.repeats(counts, rows)
    used = np.bincount(rows.ravel(), weights=np.repeat(times, 3), minlength=65)
    assert (used[1:] <= counts[1:]).all() and times.sum() >= 8


def test_edges(edge_docs, no_docs):
    got = packing.packed(edge_docs, PATH).collect()
    assert sum(r.length for r in got if r.doc_id == 8) == 4 and any(r.doc_id is None for r in got)
    assert packing.packed(no_docs, PATH).count() == 0
