"""Spelling variants by a variable-length gram index.

Words are padded with `^` and `$`; lists are kept per gram, position and length of the word.
The frequency-pruned dictionary holds the grams whose list has more than `common` words.
A word's variable gram at a position is the shortest one that is not in the dictionary (or
ends with the word or at QMAX symbols), so the lists of frequent grams are read only where
nothing better is left. As a variable gram depends on the symbols it covers alone, an edit
affects it only by touching it.

Affected-gram bound: of a set of grams of a word one edit affects at most as many as cover
one place, and a set with more members keeps one in every near word. The smallest such sets
are two grams that do not overlap (bound 1, so one common gram is enough); each word asks
with the two of the shortest lists, once among words of its length and once among those one
symbol longer. Such a pair always exists: beginnings of the word that are in the dictionary
are listed too, and variable grams may reach the end. The two lists are merged without
repeats: a pair found by the left gram is taken there, one found by the right gram only if
the other word lacks the left one. Levenshtein distance verifies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from latticework.llm.tables import stored

LETTERS = "[a-zA-ZÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_SYMBOLS, LEAST_N = 5, 3
QMAX = 8
COMMON = 32
# bound of the broadcast dictionary; the longest lists stay, fewer only make lists longer
DICTIONARY = 1 << 18


def occurrences(docs: DataFrame) -> DataFrame:
    """One row `word` for every run of letters, A-Z lower-cased; null texts have none."""
    text = F.translate("text", UPPER, UPPER.lower())
    return docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("word"))


def without_hashed_symbol(doc_id: Column, word: Column, of: int = 97) -> Column:
    """The word less one symbol if `of` divides the crc32 of `doc_id:word`; as it is where doc_id is null."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word))
    cut = (h % F.char_length(word)).cast("int")
    shorter = F.concat(F.substring(word, F.lit(1), cut), F.substring(word, cut + 2, F.char_length(word)))
    return F.when(h % of == 0, shorter).otherwise(word)


def vocabulary(words: DataFrame, least_symbols: int = LEAST_SYMBOLS, least_n: int = LEAST_N) -> DataFrame:
    """Distinct words of enough symbols and occurrences, and their number n."""
    long = words.filter(F.col("word").isNotNull() & (F.char_length("word") >= least_symbols))
    return long.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


Lists = dict[int, dict[int, dict[str, int]]]


def common_grams(words: DataFrame, common: int = COMMON, most: int = DICTIONARY) -> Lists:
    """Sizes of the lists of more than `common` words by length, position and gram; at most the `most` longest."""
    padded = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("p"), F.char_length("word").alias("size"))
    at = padded.select("p", "size", F.explode(F.sequence(F.lit(1), F.char_length("p"))).alias("i"))
    grams = at.select("p", "size", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(QMAX), F.char_length("p") - F.col("i") + 1))).alias("q"))
    grams = grams.groupBy("size", "i", F.substring("p", F.col("i"), F.col("q")).alias("gram")).count().filter(F.col("count") > common)
    out: Lists = {}
    for r in grams.orderBy(F.desc("count"), "size", "i", "gram").limit(most).collect():
        out.setdefault(r["size"], {}).setdefault(r["i"] - 1, {})[r["gram"]] = r["count"]
    return out


def decompose(padded: str, lists: Lists, size: int, shift: int = 0) -> list[int]:
    """End of the variable gram at every place, for lists of words of `size` symbols and places moved by `shift`."""
    of, n, out = lists.get(size, {}), len(padded), []
    for i in range(n):
        grams = of.get(i + shift)
        j, last = i + 1, min(i + QMAX, n)
        if grams:
            while j < last and padded[i:j] in grams:
                j += 1
        out.append(j)
    return out


def query_pair(padded: str, lists: Lists, size: int) -> tuple[int, int, int, int]:
    """Two grams (start, end, start, end) that do not overlap, of the shortest lists together, then the longest.

    The first is looked for at its place, the second moved by the difference of the lengths.
    """
    n = len(padded)
    shift = size - (n - 2)
    of = lists.get(size, {})
    left_ends = decompose(padded, lists, size)
    right_ends = decompose(padded, lists, size, shift) if shift else left_ends
    right, behind = (1 << 60, 0, 0, 0), [(0, 0, 0, 0)] * n
    for i in range(n - 1, 0, -1):
        j = right_ends[i]
        right = behind[i] = min(right, (of.get(i + shift, {}).get(padded[i:j], 0), i - j, i, j))
    ending: list[tuple[int, int, int, int] | None] = [None] * (n + 1)
    for i, j in enumerate(left_ends):
        entry = (of.get(i, {}).get(padded[i:j], 0), i - j, i, j)
        if ending[j] is None or entry < ending[j]:
            ending[j] = entry
    best, left = (1 << 61, 0, 0, 0, 0, 0), (1 << 60, 0, 0, 0)
    starts = of.get(0, {})
    for cut in range(1, n):
        if ending[cut] is not None and ending[cut] < left:
            left = ending[cut]
        now = left
        if cut < left_ends[0]:  # a beginning that is in the dictionary
            now = min(left, (starts[padded[:cut]], -cut, 0, cut))
        best = min(best, (now[0] + behind[cut][0], now[1] + behind[cut][1], *now[2:], *behind[cut][2:]))
    return best[2:]


def index_keys(padded: str, lists: Lists) -> list[tuple[int, str]]:
    """(place, gram) under which a word can be found."""
    ends = decompose(padded, lists, len(padded) - 2)
    return [(i, padded[i:j]) for i, j in enumerate(ends)] + [(0, padded[:j]) for j in range(1, ends[0])]


def query_keys(padded: str, lists: Lists) -> list[tuple[int, str, int, bool, int, str]]:
    """(place, gram, symbols of the other word, found by the left gram, place of the left gram, left gram)."""
    n, out = len(padded) - 2, []
    for longer in (0, 1):
        a0, a1, b0, b1 = query_pair(padded, lists, n + longer)
        left = padded[a0:a1]
        out += [(a0, left, n + longer, True, a0, left), (b0 + longer, padded[b0:b1], n + longer, False, a0, left)]
    return out


def _rows(out: list[list], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, kinds)], [name for name, _ in kinds])


INDEX = [("at", pa.int32()), ("gram", pa.string()), ("size", pa.int32()), ("padded", pa.string()), ("n", pa.int64())]
QUERY = [*INDEX, ("first", pa.bool_()), ("at_left", pa.int32()), ("left", pa.string())]


def _index(lists: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in INDEX]
            for word, n in zip(*(c.to_pylist() for c in batch.columns)):
                padded = f"^{word}$"
                for at, gram in index_keys(padded, lists.value):
                    for column, value in zip(out, (at, gram, len(word), padded, n)):
                        column.append(value)
            yield _rows(out, INDEX)

    return run


def _queries(lists: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in QUERY]
            for word, n in zip(*(c.to_pylist() for c in batch.columns)):
                padded = f"^{word}$"
                for at, gram, size, first, at_left, left in query_keys(padded, lists.value):
                    for column, value in zip(out, (at, gram, size, padded, n, first, at_left, left)):
                        column.append(value)
            yield _rows(out, QUERY)

    return run


def near_pairs(words: DataFrame, common: int = COMMON, most: int = DICTIONARY) -> DataFrame:
    """Every pair (a, b) of words at Levenshtein distance 1 once, with a_n and b_n; `a` is not the longer one."""
    words = words.select("word", "n")
    lists = words.sparkSession.sparkContext.broadcast(common_grams(words, common, most))
    key = F.xxhash64("at", "gram", "size").alias("key")
    index = words.mapInArrow(_index(lists), "at int, gram string, size int, padded string, n long")
    queries = words.mapInArrow(
        _queries(lists), "at int, gram string, size int, padded string, n long, first boolean, at_left int, left string"
    )
    i = index.select(key, "padded", "n").alias("i")
    q = queries.select(key, "padded", "n", "first", "left", "at_left").alias("q")
    holds = F.substring(F.col("i.padded"), F.col("q.at_left") + 1, F.char_length("q.left")) == F.col("q.left")
    once = (F.char_length("q.padded") < F.char_length("i.padded")) | (F.col("q.padded") < F.col("i.padded"))
    near = q.hint("merge").join(
        i, (F.col("q.key") == F.col("i.key")) & once & (holds == F.col("q.first")) & (F.levenshtein("q.padded", "i.padded", 1) == 1)
    )
    bare = lambda c: F.substring(c, F.lit(2), F.char_length(c) - 2)
    return near.select(
        bare(F.col("q.padded")).alias("a"), F.col("q.n").alias("a_n"), bare(F.col("i.padded")).alias("b"), F.col("i.n").alias("b_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table word, form: the last form reached; each round doubles the steps taken."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(now.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = step.agg(F.max("moved")).first()[0]
        now = step.drop("moved")
        if not moved:
            return now


def variants(words: DataFrame, ratio: int = 2, common: int = COMMON, most: int = DICTIONARY) -> DataFrame:
    """Words (word, n) with form, root, n_near and form_n.

    A form is the most frequent near word (ties: the smallest by code points) if it is at
    least `ratio` times as frequent. Needs distinct words; an empty table gives an empty one.
    Further columns of `words` are not passed on.
    """
    words = stored(words.select("word", "n"), "words")
    pairs = stored(near_pairs(words, common, most), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    judged = words.join(best, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    judged = stored(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    ), "judged")
    last = roots(judged.filter("form is not null"))
    return judged.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants among the words of `docs` (doc_id, text), with one symbol taken out of every hashed word.

    Null texts have no words; a null doc_id leaves its words as they are; repeated rows count
    again; very long texts are words like any other; further columns are not read.
    """
    words = occurrences(docs.select("doc_id", "text"))
    return variants(vocabulary(words.select(without_hashed_symbol(F.col("doc_id"), F.col("word")).alias("word"))))
