"""Line dedup by pairwise alignment.

Texts are sequences of units: lines, cut further at sentence ends, so a passage is found
wherever its lines are broken. Every shortest run of units of at least `block_words` words
points from each later document (larger doc_id) to the earliest one that has it, however
short its units; these pairs are aligned by patience diff, and aligned blocks of at least
`block_words` words go from the later document. A repeated block consists of its runs, so
all of it is found, be it in one earlier document or in several. Short shared units alone,
like a common closing line, make no run.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from latticework.llm import textops
from latticework.llm.tables import dropped, stored

BLOCK_WORDS = 25
STOPS = textops.byte_mask(b".!?")


def units(offsets: np.ndarray, data: np.ndarray) -> tuple[textops.Spans, np.ndarray]:
    """Lines cut at sentence ends, without outer white space, and their numbers of words."""
    words = textops.words(offsets, data)
    if not len(words):
        return words, np.zeros(0, np.int64)
    newlines = np.concatenate([[0], np.cumsum(data == 10)])
    new = np.ones(len(words), bool)
    new[1:] = (
        (words.row[1:] != words.row[:-1]) | STOPS[data[words.ends[:-1] - 1]]
        | (newlines[words.starts[1:]] > newlines[words.ends[:-1]])
    )
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(words))
    up, down = textops._powers(len(words) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * up[: len(words)])])
        value = textops.mix((sums[last] - sums[first]) * down[first])
    return textops.Spans(words.starts[first], words.ends[last - 1], words.row[first], value), last - first


def runs(row: np.ndarray, hashes: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, hash) of the shortest runs of consecutive units of a row that reach `least` words.

    Runs are taken from every unit onwards and from every unit backwards, so a passage of
    `least` words or more consists of its own runs: each of its units lies in one of them.
    """
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(words)])
    begin, stop = np.searchsorted(row, row, "left"), np.searchsorted(row, row, "right")
    at = np.arange(len(row))
    onwards = np.searchsorted(total, total[at] + least, "left")
    back = np.searchsorted(total, total[at + 1] - least, "right") - 1
    ahead, behind = onwards <= stop, back >= begin
    both = np.concatenate([np.stack([at, onwards], 1)[ahead], np.stack([back, at + 1], 1)[behind]])
    first, end = np.unique(both, axis=0).T if len(both) else np.zeros((2, 0), np.int64)
    up, down = textops._powers(len(row) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textops.mix(hashes) * up[: len(row)])])
        value = textops.mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64) * np.uint64(textops.ODD))
    return first, end, value


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched index pairs of a patience diff: unique common items anchor, gaps are aligned again."""
    out: list[tuple[int, int]] = []
    jobs = [(0, len(a), 0, len(b))]
    while jobs:
        a0, a1, b0, b1 = jobs.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and in_b.get(x) == 1}
        anchors = [(place[x], j) for j, x in enumerate(b[b0:b1], b0) if x in place]
        chain = _increasing(anchors)
        if not chain:
            continue
        before_a, before_b = a0, b0
        for i, j in chain:
            out.append((i, j))
            jobs.append((before_a, i, before_b, j))
            before_a, before_b = i + 1, j + 1
        jobs.append((before_a, a1, before_b, b1))
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs increasing on both sides; the pairs come ordered by the second."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (i, _) in enumerate(pairs):
        k = bisect_left(tails, i)
        back.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(i)
            at.append(n)
        else:
            tails[k], at[k] = i, n
    chain, n = [], at[-1] if at else -1
    while n >= 0:
        chain.append(pairs[n])
        n = back[n]
    return chain[::-1]


def common_blocks(earlier: list[int], later: list[int], words: list[int], block_words: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """Unit ranges of the later text that align with the earlier one as blocks of enough words.

    What one alignment leaves is aligned again, so a passage that moved is found too. An
    alignment chains units whatever their words and only those that are unique, so runs of
    the later text that the earlier one has and no alignment took are added.
    """
    blocks: list[tuple[int, int]] = []
    alive = list(range(len(later)))
    while alive:
        matched = patience(earlier, [later[i] for i in alive])
        found, k = [], 0
        while k < len(matched):
            e = k + 1
            while (
                e < len(matched) and matched[e][0] == matched[e - 1][0] + 1
                and alive[matched[e][1]] == alive[matched[e - 1][1]] + 1
            ):
                e += 1
            first, last = alive[matched[k][1]], alive[matched[e - 1][1]] + 1
            if sum(words[first:last]) >= block_words:
                found.append((first, last))
            k = e
        if not found:
            break
        blocks += found
        gone = {i for first, last in found for i in range(first, last)}
        alive = [i for i in alive if i not in gone]
    left = set(alive)
    return blocks + [r for r in _held_runs(earlier, later, words, block_words) if not left.isdisjoint(range(*r))] if left else blocks


def _held_runs(earlier: list[int], later: list[int], words: list[int], least: int) -> list[tuple[int, int]]:
    """Runs of the later text that are units in a row of the earlier one."""
    size = dict(zip(later, words))
    of = lambda x, w: runs(np.zeros(len(x), np.int64), np.array(x, np.int64).view(np.uint64), np.array(w, np.int64), least)
    known = set(of(earlier, [size.get(x, least) for x in earlier])[2].tolist())  # with a unit that only it has, no run is equal
    return [(f, e) for f, e, v in zip(*(x.tolist() for x in of(later, words))) if v in known]


def _sequences(block_words: int, k: int | None):
    """Units and runs of every text and, with k, its number of distinct k-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, offsets, data in textops.slices(batch.column(2)):
                found, words = units(offsets, data)
                bounds = pa.array(np.searchsorted(found.row, np.arange(end - row + 1)).astype(np.int32))
                first, _, value = runs(found.row, found.hash, words, block_words)
                ranges = pa.array(np.searchsorted(found.row[first], np.arange(end - row + 1)).astype(np.int32))
                n = np.zeros(end - row, np.int64)
                if k is not None:
                    n = np.diff(textops.shingle_sets(textops.words(offsets, data, fold=True), end - row, k)[0])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row),
                    pa.ListArray.from_arrays(bounds, pa.array(found.hash.view(np.int64))),
                    pa.ListArray.from_arrays(bounds, pa.array(words.astype(np.int32))),
                    pa.ListArray.from_arrays(ranges, pa.array(value.view(np.int64))), pa.array(n.astype(np.int64)),
                ], ["doc_id", "sig", "units", "words", "runs", "n"])

    return run


PAIR = ("doc_id", "sig", "from_id", "from_sig")


def _aligned(block_words: int, copy_share: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(6)]
            for *pair, later, words, earlier, earlier_words in zip(*(c.to_pylist() for c in batch.columns)):
                blocks = common_blocks(earlier, later, words, block_words)
                if copy_share is not None:
                    common = sum(words[i] for _, i in patience(earlier, later))
                    if common >= copy_share * max(sum(words), earlier_words):
                        continue
                for first, last in blocks:
                    for column, value in zip(out, (*pair, first, last)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [*PAIR, "first", "last"])

    return run


def alike(a: str, b: str, k: int, part: int, whole: int) -> bool:
    """Jaccard similarity of the k-word shingle sets, letter case ignored, is at least part / whole."""
    sets = []
    for raw in (a.encode(), b.encode()):
        spans = textops.words(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8), fold=True)
        sets.append(textops.shingle_sets(spans, 1, k)[1])
    common = len(np.intersect1d(*sets, assume_unique=True))
    return common > 0 and whole * common >= part * (len(sets[0]) + len(sets[1]) - common)


def _alike(pairs: DataFrame, texts: DataFrame, similar: tuple[int, int, int]) -> DataFrame:
    """Those of the pairs whose two texts (doc_id, sig, text) are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [alike(a.as_py(), b.as_py(), *similar) for a, b in zip(batch.column(4), batch.column(5))]
            yield batch.select(PAIR).filter(pa.array(found, pa.bool_()))

    texts = texts.dropDuplicates(["doc_id", "sig"])
    both = pairs.join(texts.withColumnRenamed("text", "later"), ["doc_id", "sig"]).join(
        texts.select(F.col("doc_id").alias("from_id"), F.col("sig").alias("from_sig"), F.col("text").alias("earlier")), ["from_id", "from_sig"]
    )
    return both.select(*PAIR, "later", "earlier").mapInArrow(run, ", ".join(f"{n} long" for n in PAIR))


def _copies(near: DataFrame, blocks: DataFrame, keyed: DataFrame, similar: tuple[int, int, int]) -> DataFrame:
    """Pairs that are alike as whole texts and still are when the blocks of all other pairs are gone.

    A pair that other cuts pull apart is no pair of copies: its own blocks go too, which
    may pull further pairs apart, until none is.
    """
    copies = stored(_alike(near, keyed, similar), "copies")
    left = copies.count()
    while left:
        cut = stored(_listed(blocks.join(copies, [*PAIR], "left_anti")), "cut")
        changed = cut.select("doc_id", "sig")
        doubtful = copies.join(changed, ["doc_id", "sig"], "left_semi").unionByName(
            copies.join(changed.toDF("from_id", "from_sig"), ["from_id", "from_sig"], "left_semi").select(*PAIR)
        ).distinct()
        doubtful = stored(doubtful.select(*PAIR), "doubtful")
        sides = doubtful.select("doc_id", "sig").unionByName(doubtful.select(F.col("from_id").alias("doc_id"), F.col("from_sig").alias("sig")))
        texts = _without(keyed.join(sides.distinct(), ["doc_id", "sig"], "left_semi").select("doc_id", "sig", "text"), cut)
        still = _alike(doubtful, texts.select("doc_id", "sig", "text"), similar)
        now = stored(copies.join(doubtful, [*PAIR], "left_anti").select(*PAIR).unionByName(still), "copies")
        before, left = left, now.count()
        if left == before:
            break
        copies = now
    return copies


def _listed(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "sig", "first", "last").distinct().groupBy("doc_id", "sig").agg(
        F.collect_list(F.struct("first", "last")).alias("blocks")
    )


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the byte spans; a line that goes whole takes its line end along."""
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        before = kept[-1][-1:] or (kept[-2][-1:] if len(kept) > 1 else b"")
        at = end
        if before in (b"", b"\n") and text[at : at + 1] == b"\n":
            at += 1
        elif before in (b"", b" ", b"\n") and text[at : at + 1] == b" ":
            at += 1
    kept.append(text[at:])
    return b"".join(kept)


ADDED = ("removed_words", "removed_blocks", "emptied")


def _without(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """`docs` without the listed unit ranges (doc_id, sig of the whole text, blocks), and the added columns."""
    names = docs.columns
    # a merge join whatever the number of changed texts, so small and large corpora behave alike
    joined = docs.alias("d").withColumn("_key", F.col("doc_id").cast("long")).withColumn("_sig", F.xxhash64("text")).join(
        blocks.select(F.col("doc_id").alias("_key"), F.col("sig").alias("_sig"), F.col("blocks").alias("_blocks")).hint("merge"),
        ["_key", "_sig"], "left",
    ).select(*[F.col(f"d.{n}") for n in names], "_blocks")
    at = names.index("text")

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column(len(names)).to_pylist()
            texts, words, blocks = batch.column(at).to_pylist(), [0] * batch.num_rows, [0] * batch.num_rows
            for i, found in enumerate(ranges):
                if found:
                    raw = texts[i].encode()
                    spans, sizes = units(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
                    gone = np.zeros(len(spans), bool)
                    for r in found:
                        gone[r["first"] : r["last"]] = True
                    edge = np.diff(np.concatenate([[0], gone, [0]]).astype(int))
                    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    texts[i] = _cut(raw, list(zip(spans.starts[first], spans.ends[last - 1]))).decode()
                    words[i], blocks[i] = int(sizes[gone].sum()), len(first)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            emptied = [bool(w) and not t.strip() for w, t in zip(words, texts)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(words, pa.int64()), pa.array(blocks, pa.int64()), pa.array(emptied, pa.bool_())], [*names, *ADDED]
            )

    kinds = (T.LongType(), T.LongType(), T.BooleanType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(ADDED, kinds))])
    return joined.mapInArrow(take_out, schema)


def deduplicated(
    docs: DataFrame, block_words: int = BLOCK_WORDS, copy_share: float | None = None,
    similar: tuple[int, int, int] | None = None,
) -> DataFrame:
    """`docs` with blocks taken out of `text`, and removed_words, removed_blocks, emptied.

    Columns of the three added names are replaced, others stay. Null and empty texts and rows
    with a null doc_id stay as they are and are compared with nothing. Rows that share a doc_id
    are not compared with each other. `emptied` marks texts of which nothing but white space
    is left. With `copy_share`, a pair whose aligned units hold that share of the words of both
    is a pair of copies and left whole. With `similar` = (k, part, whole), a pair is left whole
    only if a step that joins k-word shingle sets of Jaccard similarity part / whole joins
    its two texts as they come out of here (exact, see `_copies`).
    """
    docs = docs.drop(*ADDED)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sig"), "text")
    keyed = keyed.filter("doc_id is not null and text is not null")
    texts = stored(keyed.mapInArrow(
        _sequences(block_words, similar[0] if similar else None),
        "doc_id long, sig long, units array<long>, words array<int>, runs array<long>, n long",
    ), "sequences")
    key = F.struct("doc_id", "sig")
    held = texts.select(key.alias("doc"), F.explode(F.array_distinct("runs")).alias("run"))
    earliest = held.groupBy("run").agg(F.min("doc").alias("from"), F.max("doc.doc_id").alias("hi")).filter("from.doc_id < hi")
    pairs = held.join(earliest.drop("hi"), "run").filter("doc.doc_id > from.doc_id").select("doc", "from").distinct()
    pairs = stored(pairs, "pairs")
    both = pairs.join(texts.select(
        key.alias("from"), F.col("units").alias("earlier"), F.aggregate("words", F.lit(0), lambda a, x: a + x).alias("earlier_words")
    ).dropDuplicates(["from"]), "from")
    both = both.join(texts.select(key.alias("doc"), "units", "words"), "doc")
    blocks = stored(both.select(
        "doc.doc_id", "doc.sig", F.col("from.doc_id").alias("from_id"), F.col("from.sig").alias("from_sig"),
        "units", "words", "earlier", "earlier_words",
    ).mapInArrow(_aligned(block_words, copy_share), ", ".join(f"{n} long" for n in (*PAIR, "first", "last"))), "aligned")
    if similar:
        sizes = texts.select("doc_id", "sig", "n").distinct()
        near = blocks.select(*PAIR).distinct().join(sizes, ["doc_id", "sig"]).join(
            sizes.toDF("from_id", "from_sig", "from_n"), ["from_id", "from_sig"]
        ).filter(similar[2] * F.least("n", "from_n") >= similar[1] * F.greatest("n", "from_n"))
        near = stored(near.select(*PAIR), "near")
        dropped(texts)
        blocks = blocks.join(_copies(near, blocks, keyed, similar), [*PAIR], "left_anti")
    else:
        dropped(texts)
    return _without(docs, stored(_listed(blocks), "blocks"))
