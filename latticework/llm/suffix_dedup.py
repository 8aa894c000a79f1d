"""Removal of repeated byte strings by suffix arrays, built by two-stage sorting.

A byte goes if a string of `length` bytes that covers it starts anywhere else as well. One
suffix array of a corpus can't be built on one machine, so strings that may be equal are
brought together first: every string of `length` bytes (a window) belongs to the leftmost
of its `gram`-byte grams with the smallest hash, and neighbouring windows of one gram form
a piece. Equal windows choose equal grams, so only pieces of the same gram are compared.
Grams that a single piece chose are dropped; pieces of equal bytes count as one with a
number. Pieces of one gram lie in one batch of about `BATCH` bytes, for which a suffix array
is built; neighbours that share `length` symbols are the repeats.

A gram may be chosen by very many different pieces (a common passage in ever other
surroundings). Beyond `group` of them, the windows of each piece are split into those that
reach further left and those that reach further right than half of what is open around the
gram, and either part is grouped by the longer string that its windows have in common, until
groups are small; after at most ten rounds that string is the window itself. Every window is
in exactly one part, so nothing is lost or counted twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from latticework.llm import textops, two_stage
from latticework.llm.tables import dropped, stored

LENGTH = 400
GRAM = 64
GROUP = 2048
BATCH = 1 << 19
SEGMENT = 1 << 20
PLACE_BITS = np.uint64(24)
KEPT, REMOVED = "kept", "removed"


def pieces(offsets: np.ndarray, data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, place of the gram after the first window, hashes of gram and bytes."""
    found = [_segment(offsets, data, base, length, gram) for base in range(0, max(1, len(data) - length + 1), SEGMENT)]
    return tuple(np.concatenate(columns) for columns in zip(*found))


def _segment(offsets: np.ndarray, data: np.ndarray, base: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Pieces of the windows that start in one segment of the data."""
    part = data[base : base + SEGMENT + length - 1]
    n, width = len(part) - length + 1, length - gram + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    at = np.arange(len(part) - gram + 1)
    hashes = textops.hash_spans(part, at, at + gram)
    key = (hashes >> PLACE_BITS << PLACE_BITS) | at.astype(np.uint64)
    # minima of all runs of `width` grams from running minima of blocks, forwards and backwards
    blocks = np.append(key, np.full(-len(key) % width, np.iinfo(np.uint64).max)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    owner = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    start = np.arange(n)
    end = offsets[np.searchsorted(offsets, start + base, "right")] - base
    inside = start + length <= end
    start, owner = start[inside], owner[inside]
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(start)))
    start, owner = start[first], owner[first]
    return start + base, size, owner - start, hashes[owner], textops.hash_spans(part, start, start + size + length - 1)


def _listed(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, offsets, data in textops.slices(batch.column(3)):
                start, windows, at, key, value = pieces(offsets, data, length, gram)
                of = np.searchsorted(offsets, start, "right") - 1
                owners = [batch.column(i).slice(row, end - row).take(pa.array(of)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([
                    *owners, pa.array(start - offsets[of]), pa.array(windows.astype(np.int32)), pa.array(at.astype(np.int32)),
                    pa.array(key.view(np.int64)), pa.array(value.view(np.int64)),
                ], ["doc", "sig", "sig2", "start", "windows", "at", "key", "value"])

    return run


def _cut_out(length: int, gram: int):
    """Bytes of the listed pieces of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode()
                rows = wanted.as_py()
                column = lambda name, kind: pa.array([r[name] for r in rows], kind)
                yield pa.RecordBatch.from_arrays([
                    column("key", pa.int64()), column("value", pa.int64()), column("n", pa.int64()), column("at", pa.int32()),
                    pa.array([gram] * len(rows), pa.int32()),
                    pa.array([raw[r["start"] : r["start"] + r["windows"] + length - 1] for r in rows], pa.binary()),
                ], ["key", "value", "n", "at", "core", "bytes"])

    return run


def repeated(parts: list[bytes], n: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each part, the first and last windows of its stretches of windows that occur twice or more.

    A part stands for n equal ones. One suffix array of all parts, put one after another.
    """
    sizes = np.array([len(p) for p in parts])
    data = np.frombuffer(b"\0".join(parts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = data.astype(np.int16) + np.int16(1)
    text[begin[1:] - 1] = 0
    windows = sizes - length + 1
    of = np.repeat(np.arange(len(parts)), windows)
    at = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[of]
    part_of = np.full(len(text), -1)
    part_of[at] = of
    window_hash = np.zeros(len(text), np.uint64)
    window_hash[at] = textops.hash_spans(data, at, at + length)
    order = two_stage.suffix_order(text, length)
    order = order[part_of[order] >= 0]
    first = np.flatnonzero(~two_stage.share_prefix(window_hash, order))
    total = np.add.reduceat(np.array(n)[part_of[order]], first)
    twice = np.zeros(len(text) + 1, bool)
    twice[order] = np.repeat(total, np.diff(np.append(first, len(order)))) > 1
    edge = np.diff(np.concatenate([[False], twice]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    for p, s, e in zip(part_of[starts].tolist(), (starts - begin[part_of[starts]]).tolist(), (stops - begin[part_of[starts]]).tolist()):
        out[p].append((s, e))
    return out


RANGES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
RANGES_SQL = "key long, value long, ranges array<struct<first:long,last:long>>"


def _decide(length: int):
    """Suffix arrays over batches of whole groups; rows come sorted by key and value."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated([r[3] for r in rows], [r[2] for r in rows], length)
        hits = [(r[0], r[1], [{"first": s, "last": e} for s, e in f]) for r, f in zip(rows, found) if f]
        return pa.RecordBatch.from_arrays(
            [pa.array([h[i] for h in hits], t) for i, t in enumerate((pa.int64(), pa.int64(), RANGES))], ["key", "value", "ranges"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for key, value, n, raw in zip(*(batch.column(name).to_pylist() for name in ("key", "value", "n", "bytes"))):
                if rows and rows[-1][:2] == (key, value):
                    continue  # listed again by a repeated row
                if size >= BATCH and rows[-1][0] != key:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append((key, value, n, raw))
                size += len(raw)
        if rows:
            yield flush(rows)

    return run


def _halve(length: int):
    """Each part split by its windows' reach to the left, under the hash of what these have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for key, value, n, at, core, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "value", "n", "at", "core", "bytes"))):
                open_ = length - core
                half, last = (open_ + 1) // 2, len(raw) - length
                # windows that start at most at `at - half` hold the half before, the others the half behind
                for first, stop, c0, c1 in ((0, min(last, at - half), at - half, at + core), (max(0, at - half + 1), last, at, at - half + 1 + length)):
                    if first > stop:
                        continue
                    part = np.frombuffer(raw, np.uint8)[first : stop + length]
                    spans = np.array([c0 - first, 0]), np.array([c1 - first, len(part)])
                    hashes = textops.hash_spans(part, *spans).view(np.int64).tolist()
                    for column, x in zip(out, (key, value, first, *hashes, n, c0 - first, c1 - c0, part.tobytes())):
                        column.append(x)
            kinds = (*(pa.int64(),) * 6, pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["of_key", "of_value", "shift", "key", "value", "n", "at", "core", "bytes"])

    return run


def _decided(parts: DataFrame, length: int, group: int) -> DataFrame:
    """key, value, ranges of the stored parts (key, value, n, at, core, bytes) that hold repeated windows."""
    hot = stored(parts.groupBy("key").count().filter(F.col("count") > group).select("key"), "hot")
    if hot.isEmpty():
        return parts.select("key", "value", "n", "bytes").repartition("key").sortWithinPartitions("key", "value").mapInArrow(_decide(length), RANGES_SQL)
    small = parts.join(hot, "key", "left_anti").select("key", "value", "n", "bytes")
    decided = small.repartition("key").sortWithinPartitions("key", "value").mapInArrow(_decide(length), RANGES_SQL)
    halves = stored(parts.join(hot, "key", "left_semi").mapInArrow(
        _halve(length), "of_key long, of_value long, shift long, key long, value long, n long, at int, core int, bytes binary"
    ), "halves")
    twice = halves.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")
    below = halves.join(twice, "key", "left_semi").groupBy("key", "value").agg(
        F.sum("n").alias("n"), F.first("at").alias("at"), F.first("core").alias("core"), F.first("bytes").alias("bytes")
    )
    found = _decided(stored(below, "parts"), length, group)
    moved = lambda r: F.struct((r["first"] + F.col("shift")).alias("first"), (r["last"] + F.col("shift")).alias("last"))
    up = halves.select("key", "value", "of_key", "of_value", "shift").join(found, ["key", "value"])
    up = up.groupBy(F.col("of_key").alias("key"), F.col("of_value").alias("value")).agg(F.flatten(F.collect_list(F.transform("ranges", moved))).alias("ranges"))
    return decided.unionByName(up)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(sig, sig2, spans): per text with repeats its byte ranges `from` to before `to` that windows cover, unmerged."""
    doc = F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("doc")
    texts = docs.filter(F.octet_length("text") >= length).select(doc, *signature(F.col("text")), "text")
    listed = stored(texts.mapInArrow(
        _listed(length, gram), "doc long, sig long, sig2 int, start long, windows int, at int, key long, value long"
    ), "pieces")
    # stored, so that both sides of the join are plain exchanges that Spark can split at hot grams
    twice = stored(listed.groupBy("key").count().filter("count > 1").select("key"), "twice")
    held = stored(listed.join(twice, "key", "left_semi"), "held")
    dropped(listed)
    classes = held.groupBy("key", "value").agg(F.count("*").alias("n"), F.min(F.struct("doc", "sig", "sig2", "start", "windows", "at")).alias("of"))
    wanted = classes.groupBy("of.doc", "of.sig", "of.sig2").agg(
        F.collect_list(F.struct("key", "value", "n", "of.start", "of.windows", "of.at")).alias("wanted")
    )
    parts = stored(texts.hint("merge").join(wanted, ["doc", "sig", "sig2"]).select("text", "wanted").mapInArrow(
        _cut_out(length, gram), "key long, value long, n long, at int, core int, bytes binary"
    ), "parts")
    ranges = stored(_decided(parts, length, group), "ranges")
    dropped(parts)
    spans = held.join(ranges, ["key", "value"]).select("sig", "sig2", "start", F.explode("ranges").alias("r"))
    span = F.struct((F.col("start") + F.col("r.first")).alias("from"), (F.col("start") + F.col("r.last") + length).alias("to"))
    return stored(spans.groupBy("sig", "sig2").agg(F.collect_set(span).alias("spans")), "spans")


def signature(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("sig"), F.hash(text).alias("sig2")


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["from"], s["to"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """`docs` with kept (the bytes that stay, in order) and removed (array of start, length of maximal runs).

    Texts count as their UTF-8 bytes, null ones as empty; texts shorter than `length` have no
    window and stay whole. Repeated rows are different documents, so both lose what they share,
    whatever their doc_id, null included. Columns called kept or removed are replaced, others
    stay. `length` bounds what is compared, `gram`, `group` and the batch size only the work.
    """
    docs = docs.drop(KEPT, REMOVED)
    names = docs.columns
    found = repeated_spans(docs.select("doc_id", "text"), length, gram, group)
    own = lambda name: name if name not in names else own(f"{name}_")
    spans, sig, sig2 = own("spans"), own("sig"), own("sig2")
    keyed = docs.withColumns({sig: F.xxhash64("text"), sig2: F.hash("text")})
    joined = keyed.join(found.toDF(sig, sig2, spans).hint("merge"), [sig, sig2], "left").select(*names, spans)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text, found in zip(batch.column(at), batch.column(len(names))):
                raw = (text.as_py() or "").encode()
                gone = _merged(found.as_py() or [])
                edges = [0, *(x for span in gone for x in span), len(raw)]
                kept.append(b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2])]))
                removed.append([{"start": a, "length": b - a} for a, b in gone])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kept, pa.binary()), pa.array(removed, kind)], [*names, KEPT, REMOVED])

    added = T._parse_datatype_string(f"{KEPT} binary, {REMOVED} array<struct<start:long,length:long>>")
    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))
