"""N-gram Jaccard join by a count-vector R-tree.

Every text is the set of its distinct k-word shingles, two texts link when
whole * intersection >= part * union. Equal sets become one class. Shingles hashed
into groups give each class a vector of group counts, indexed in R-trees; the sum
of coordinate minima bounds the overlap of two classes, and pairs that survive it
are verified on the shingle sets of their texts.

The trees are dealt over the cluster by shared shingles: in any fixed order of all
shingles, linked sets share one among the first n - ceil(part * n / whole) + 1, so
a tree per shingle over the classes that hold it there loses no link. The order puts
frequent shingles last, which only affects speed. Trees of a frequent shingle are
cut into chunks; a near-copy group is first contracted along its closest pairs, then
only pairs across the components so far are searched, so no group is listed in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from latticework.llm import textops
from latticework.llm.count_rtree import CountTree, needed
from latticework.llm.tables import components, dropped, stored

GROUPS = 128
CHUNK = 2048
FREQUENT = 64
MOST_FREQUENT = 2_000_000
FILTER_BITS = 26
SPREAD = int(np.array([textops.ODD], np.uint64).view(np.int64)[0])
POINT = "doc_id long, n long, sig_a long, sig_b long, counts binary, prefix array<long>"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _signatures(bounds: np.ndarray, sets: np.ndarray) -> list[np.ndarray]:
    """Two numbers per set that do not depend on the order of its members."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(textops.mix(sets ^ np.uint64(c)))]) for c in (0x51ED27, 0xB5297A4D)]
        return [s[bounds[1:]] - s[bounds[:-1]] for s in sums]


def _lengths(n: np.ndarray, part: int, whole: int) -> np.ndarray:
    return np.where(n > 0, n + (-part * n) // whole + 1, 0)


def _ordered_prefix(sets: np.ndarray, bounds: np.ndarray, frequent: np.ndarray, part: int, whole: int):
    """First shingles of every set, rare ones first: flat values and list offsets."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    if len(frequent):
        at = np.searchsorted(frequent, sets)
        at[at == len(frequent)] = 0
        common = frequent[at] == sets
        # stable: within a row hashes are ascending already
        order = np.argsort(row * 2 + common, kind="stable")
        sets = sets[order]
    rank = np.arange(len(sets)) - bounds[row]
    take = rank < _lengths(n, part, whole)[row]
    return sets[take], np.concatenate([[0], np.cumsum(_lengths(n, part, whole))])


def _frequent(docs: DataFrame, k: int, part: int, whole: int, at_least: int) -> np.ndarray:
    """Shingles that lead the hash-ordered prefixes of many texts, at most MOST_FREQUENT of them.

    Tasks count what they see at least twice, so little is shuffled; the numbers order
    the shingles and need not be complete.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(_signed(value[n > 1])), pa.array(n[n > 1].astype(np.int64))], ["token", "n"]
            )

        for batch in batches:
            for row, end, offsets, data in textops.slices(batch.column(0)):
                spans = textops.words(offsets, data, fold=True)
                bounds, sets = textops.shingle_sets(spans, end - row, k)
                held.append(_ordered_prefix(sets, bounds, np.zeros(0, np.uint64), part, whole)[0])
                if sum(map(len, held)) > 4_000_000:
                    yield flush()
        yield flush()

    rows = (
        docs.select("text").mapInArrow(count, "token long, n long")
        .groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= at_least)
        .orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    )
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def shingle_points(docs: DataFrame, frequent: np.ndarray, k: int, part: int, whole: int) -> DataFrame:
    """Per text: set size, set signature, group counts, leading shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [p.split()[0] for p in POINT.split(", ")]
        for batch in batches:
            for row, end, offsets, data in textops.slices(batch.column(1)):
                rows = end - row
                spans = textops.words(offsets, data, fold=True)
                bounds, sets = textops.shingle_sets(spans, rows, k)
                of = np.repeat(np.arange(rows), np.diff(bounds))
                counts = np.bincount(of * GROUPS + (sets >> np.uint64(64 - GROUPS.bit_length() + 1)).astype(np.int64), minlength=rows * GROUPS)
                counts = counts.reshape(rows, GROUPS).astype("<i4")
                sig = _signatures(bounds, sets)
                lead, ends = _ordered_prefix(sets, bounds, shared.value, part, whole)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, rows), pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array(_signed(sig[0])), pa.array(_signed(sig[1])),
                    pa.array([c.tobytes() for c in counts], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(_signed(lead))),
                ], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(points, POINT)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Groups of rows with equal first `keys` columns out of sorted batches."""
    rest: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        change = np.zeros(len(table) - 1, bool)
        for k in range(keys):
            value = table.column(k).to_numpy()
            change |= value[1:] != value[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(table)]])
        if rest and any(rest[-1].column(k)[-1] != table.column(k)[0] for k in range(keys)):
            yield pa.concat_tables(rest)
            rest = []
        for start, end in zip(cuts[:-1], cuts[1:]):
            part = table.slice(start, end - start)
            if end < len(table):
                yield pa.concat_tables([*rest, part])
                rest = []
            else:
                rest.append(part)
    if rest:
        yield pa.concat_tables(rest)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, GROUPS)


def _nearest(part: int, whole: int):
    """For each class of a tree its closest earlier class by bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 2):
            ids, sizes, points = group.column(2).to_numpy(), group.column(3).to_numpy(), _vectors(group.column(4))
            if len(ids) < 2:
                continue
            a, b = [], []
            for i, found, bound in CountTree(points, sizes).searches(np.arange(len(ids)), points, sizes, part, whole):
                earlier = found < i
                if earlier.any():
                    found = found[earlier]
                    a.append(ids[i])
                    b.append(ids[found[(bound[earlier] / (sizes[i] + sizes[found])).argmax()]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _across(part: int, whole: int):
    """All pairs of a query and an indexed class of different components that the bound allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 2):
            ids, sizes, points = group.column(2).to_numpy(), group.column(3).to_numpy(), _vectors(group.column(4))
            component, indexed, asks = (group.column(c).to_numpy() for c in (5, 6, 7))
            own, query = np.flatnonzero(indexed), np.flatnonzero(asks)
            if not len(own) or not len(query):
                continue
            tree = CountTree(points[own], sizes[own])
            for i, found, _ in tree.searches(query, points[query], sizes[query], part, whole):
                found = own[found]
                found = ids[found[component[found] != component[i]]]
                if len(found):
                    at = np.full(len(found), ids[i])
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(at, found)), pa.array(np.minimum(at, found))], ["a", "b"])

    return run


def _bits(ids: DataFrame) -> np.ndarray:
    """A bit table of fixed size that has a bit set for every id."""
    words = (
        ids.select(F.expr(f"shiftrightunsigned(doc_id * {SPREAD}L, {64 - FILTER_BITS})").alias("at"))
        .select(F.expr("shiftrightunsigned(at, 6)").alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table


def _packed(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Compressed texts of the classes `ids` (doc_id, sig_a).

    The bit table lets most other texts go before the shuffle; the join afterwards is
    exact, so a crowded table only costs speed.
    """
    table = docs.sparkSession.sparkContext.broadcast(_bits(ids))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            with np.errstate(over="ignore"):
                at = batch.column(0).to_numpy().view(np.uint64) * np.uint64(textops.ODD) >> np.uint64(64 - FILTER_BITS)
            hit = (table.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            batch = batch.filter(pa.array(hit.astype(bool)))
            for row, end, offsets, data in textops.slices(batch.column(1)):
                bounds, sets = textops.shingle_sets(textops.words(offsets, data, fold=True), end - row, k)
                packed = [codec.compress(data[offsets[i] : offsets[i + 1]].tobytes(), asbytes=True) for i in range(end - row)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, end - row), pa.array(_signed(_signatures(bounds, sets)[0])),
                    pa.array(np.diff(offsets)), pa.array(packed, pa.binary()),
                ], ["doc_id", "sig_a", "size", "packed"])

    packed = docs.filter("doc_id is not null").mapInArrow(pack, "doc_id long, sig_a long, size long, packed binary")
    return packed.join(ids, ["doc_id", "sig_a"], "left_semi").dropDuplicates(["doc_id"])


def _verified(pairs: DataFrame, packed: DataFrame, k: int, part: int, whole: int) -> DataFrame:
    """Pairs of classes whose texts link."""
    text = F.struct("size", "packed")
    both = pairs.join(packed.select(F.col("doc_id").alias("a"), text.alias("text_a")), "a")
    both = both.join(packed.select(F.col("doc_id").alias("b"), text.alias("text_b")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")

        def sets(column: pa.StructArray) -> list[np.ndarray]:
            texts = [codec.decompress(p, n, asbytes=True) for n, p in zip(column.field(0).to_pylist(), column.field(1).to_pylist())]
            out = []
            for row, end, offsets, data in textops.slices(pa.array(texts, pa.binary()).cast(pa.string())):
                bounds, hashes = textops.shingle_sets(textops.words(offsets, data, fold=True), end - row, k)
                out += [hashes[bounds[i] : bounds[i + 1]] for i in range(end - row)]
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                good = [
                    len(x) + len(y) - len(np.union1d(x, y)) >= needed(len(x), len(y), part, whole)
                    for x, y in zip(sets(some.column(2)), sets(some.column(3)))
                ]
                yield some.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def _chunk(of: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(of), F.ceil(n / CHUNK)).cast("long")


def jaccard_classes(
    docs: DataFrame, k: int = 4, part: int = 85, whole: int = 100, frequent: int = FREQUENT
) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id.

    `component_id` is the smallest doc_id reachable by links. Texts without words (or
    null) have no shingles and link with nothing. Of several texts under one doc_id the
    one with the least signature stands for the document; n_shingles is each row's own.
    Rows with a null doc_id get a null component and link with nothing. Columns other
    than doc_id and text are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    points = stored(shingle_points(docs, _frequent(docs, k, part, whole, frequent), k, part, whole), "points")
    sizes = stored(points.select("doc_id", "n"), "sizes")
    member = (
        points.filter("n > 0 and doc_id is not null").groupBy("doc_id")
        .agg(F.min(F.struct("sig_a", "sig_b", "n")).alias("s")).select("doc_id", "s.*")
    )
    classes = member.groupBy("n", "sig_a", "sig_b").agg(F.min("doc_id").alias("rep"))
    member = stored(member.join(classes, ["n", "sig_a", "sig_b"]).select("doc_id", "sig_a", "rep"), "members")
    reps = member.filter("doc_id = rep").select("doc_id", "sig_a")
    heads = stored(points.join(reps, ["doc_id", "sig_a"], "left_semi").dropDuplicates(["doc_id"]), "heads")
    dropped(points)
    postings = heads.select(F.explode("prefix").alias("token"), F.col("doc_id").alias("id"))
    mask = F.xxhash64("id")
    blocks = stored(
        postings.groupBy("token").agg(
            F.count("*").alias("held"), F.min("id").alias("lo"), F.max("id").alias("hi"),
            F.sum(mask.bitwiseAND(F.lit(0x7FFFFFFF))).alias("s"), F.sum(F.shiftrightunsigned(mask, 33)).alias("t"),
        ).filter("lo < hi")
        # shingles with the same classes need one tree
        .groupBy("held", "lo", "hi", "s", "t").agg(F.min("token").alias("token")).select("token", "held", "lo"), "blocks",
    )
    trees = stored(
        postings.join(blocks.select("token", "held"), "token")
        .join(heads.select(F.col("doc_id").alias("id"), F.col("n").alias("size"), "counts"), "id"), "trees",
    )
    dropped(heads)
    ids = trees.select(F.col("id").alias("doc_id")).distinct().join(reps, "doc_id")
    packed = stored(_packed(docs, stored(ids, "ids"), k), "packed")
    near = _dealt(trees.withColumn("chunk", _chunk(F.col("id"), F.col("held"))), "token", "chunk")
    near = near.select("token", "chunk", "id", "size", "counts").mapInArrow(_nearest(part, whole), "a long, b long")
    across_chunks = (
        trees.filter(F.col("held") > CHUNK)
        .groupBy("token", _chunk(F.col("id"), F.col("held")).alias("chunk")).agg(F.min("id").alias("a"))
        .join(blocks.select("token", F.col("lo").alias("b")), "token").select("a", "b")
    )
    near = near.unionByName(across_chunks).filter("a <> b")
    near = stored(near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near")
    links = stored(_verified(near, packed, k, part, whole), "links")
    first = components(links)
    placed = trees.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    parts = placed.groupBy("token", "component").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("token").agg(F.max_by("component", "m").alias("main"), F.count("*").alias("parts"))
    placed = placed.join(mixed.filter("parts > 1").select("token", "main"), "token")
    pieces = F.ceil(F.col("held") / CHUNK)
    placed = placed.withColumn("own", _chunk(F.col("id"), F.col("held"))).withColumn("asks", F.col("component") != F.col("main"))
    placed = placed.withColumn(
        "chunk", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0).cast("long"), pieces - 1)).otherwise(F.array("own")))
    ).withColumn("indexed", F.col("chunk") == F.col("own"))
    rest = _dealt(placed, "token", "chunk").select("token", "chunk", "id", "size", "counts", "component", "indexed", "asks")
    rest = stored(rest.mapInArrow(_across(part, whole), "a long, b long").distinct().join(near, ["a", "b"], "left_anti"), "across")
    dropped(trees)
    links = stored(links.unionByName(_verified(rest, packed, k, part, whole)), "links")
    dropped(packed)
    found = member.join(components(links).select(F.col("node").alias("rep"), "component"), "rep", "left")
    found = found.select("doc_id", F.coalesce("component", "rep").alias("component"))
    return sizes.join(found, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_per_component(docs: DataFrame, k: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """`docs` with only the smallest doc_id of every component; rows with a null doc_id stay."""
    kept = jaccard_classes(docs, k, part, whole).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
