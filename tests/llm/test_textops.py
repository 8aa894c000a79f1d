import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from latticework.llm import textops

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t|.", max_size=40)), max_size=12)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_sets(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.sampled_from([5, 50, 10**6]))
def test_sets_words_and_lines(texts, limit):
    seen = {}
    for row, end, offsets, data in textops.slices(pa.array(texts, pa.string()), limit):
        words, lines = textops.words(offsets, data, fold=True), textops.lines(offsets, data)
        bounds, sets = textops.shingle_sets(words, end - row, 3)
        for i in range(end - row):
            text = texts[row + i]
            assert (words.row == i).sum() == len(WORD.findall(text or ""))
            assert (lines.row == i).sum() == len((text or "").split("\n"))
            own = plain_sets(text, 3)
            got = sets[bounds[i] : bounds[i + 1]]
            assert len(got) == len(own)
            assert seen.setdefault(frozenset(own), tuple(got)) == tuple(got)
    assert len({v for k, v in seen.items()}) == len(seen)


def test_hash_does_not_depend_on_the_place():
    data = np.frombuffer("ab cd ab".encode(), np.uint8)
    words = textops.words(np.array([0, 8]), data)
    assert words.hash[0] == words.hash[2] != words.hash[1]
