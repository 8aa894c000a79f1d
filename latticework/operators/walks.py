"""How far a peak reaches: nearest higher sample, nearest sample under a level.

Samples are packed per chunk (a bounded array). A search that leaves its chunk
consults one summary row per chunk and then only the chunk that ends it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.operators.scans import CHUNK, chunk_of
from latticework.session import settle


def packed(signal: DataFrame, keys: list[str], pos: str, y: str, x: str | None, size: int) -> DataFrame:
    sample = F.struct(
        F.col(pos).cast("bigint").alias("p"),
        F.col(y).cast("double").alias("v"),
        F.col(x or y).cast("double").alias("x"),
    )
    return signal.groupBy(*keys, chunk_of(pos, size).alias("_c")).agg(
        F.array_sort(F.collect_list(sample)).alias("_arr")
    )


def _summaries(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """All chunk summaries of a key as one array (one entry per chunk)."""
    low = lambda sign: F.array_min(
        F.transform("_arr", lambda s: F.struct(s["v"].alias("v"), (s["p"] * sign).alias("p")))
    )
    entry = F.struct(
        F.col("_c").alias("c"),
        F.array_max(F.transform("_arr", lambda s: s["v"])).alias("mx"),
        low(-1).alias("low_l"),
        low(1).alias("low_r"),
    )
    return chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_sums"))


def _sweep(values: list[float]) -> tuple[list[int], list[float], list[int]]:
    """Per sample: nearest strictly higher one before it, lowest in between and where."""
    stack: list[tuple[float, int, float, int]] = []
    higher, low, where = [], [], []
    for i, v in enumerate(values):
        m, a = v, i
        while stack and stack[-1][0] <= v:
            top = stack.pop()
            if top[2] < m:
                m, a = top[2], top[3]
        higher.append(stack[-1][1] if stack else -1)
        low.append(m)
        where.append(a)
        stack.append((v, i, m, a))
    return higher, low, where


def prominences(
    signal: DataFrame, peaks: DataFrame, keys: list[str], pos: str, y: str, size: int = CHUNK
) -> DataFrame:
    """Add ``prominence``, ``left_base`` and ``right_base`` to each peak row.

    ``pos`` numbers the samples of a key consecutively.
    """
    chunks = packed(signal, keys, pos, y, None, size)
    wanted = peaks.groupBy(*keys, chunk_of(pos, size).alias("_c")).agg(
        F.collect_set(F.col(pos).cast("bigint")).alias("_at")
    )
    todo = chunks.join(wanted, [*keys, "_c"])
    todo = todo.select(
        *keys, "_c", F.element_at("_arr", 1)["p"].alias("_p0"),
        F.transform("_arr", lambda s: s["v"]).alias("_v"), "_at",
    )
    key_fields = [todo.schema[k] for k in keys]
    schema = T.StructType(
        key_fields
        + [T.StructField("_c", T.LongType()), T.StructField("_p", T.LongType()),
           T.StructField("_v", T.DoubleType())]
        + [
            T.StructField(n, t)
            for side in "lr"
            for n, t in (
                (f"_{side}hit", T.BooleanType()),
                (f"_{side}low", T.DoubleType()),
                (f"_{side}at", T.LongType()),
            )
        ]
    )
    names = schema.fieldNames()

    def solve(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False, name=None):
                head, (c, p0, values, at) = row[: len(keys)], row[len(keys):]
                values = np.asarray(values).tolist()  # plain floats compare much faster
                n = len(values)
                lh, ll, la = _sweep(values)
                rh, rl, ra = _sweep(values[::-1])
                for p in at:
                    i = int(p) - p0
                    j = n - 1 - i
                    rows.append(
                        (*head, c, p, values[i], lh[i] >= 0, ll[i], p0 + la[i],
                         rh[j] >= 0, rl[j], p0 + n - 1 - ra[j])
                    )
            yield pd.DataFrame(rows, columns=names)

    near = todo.mapInPandas(solve, schema)
    ends = signal.groupBy(*keys).agg(*[f(chunk_of(pos, size)).alias(n) for f, n in ((F.min, "_c0"), (F.max, "_c1"))])
    near = _finish_prominences(near, ends, chunks, keys)
    found = near.select(
        *keys,
        F.col("_p").alias(pos),
        (F.col("_v") - F.greatest("_llow", "_rlow")).alias("prominence"),
        F.col("_lat").alias("left_base"),
        F.col("_rat").alias("right_base"),
    )
    return peaks.join(found, [*keys, pos])


def _finish_prominences(near: DataFrame, ends: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    v, c = F.col("_v"), F.col("_c")
    # stored, or both halves would sweep the chunks again
    marked = settle(near.join(ends, keys).withColumns(
        {"_ol": ~F.col("_lhit") & (F.col("_c0") < c), "_or": ~F.col("_rhit") & (F.col("_c1") > c)}
    ).drop("_c0", "_c1"))
    done = marked.where("not _ol and not _or").select(*near.columns)
    todo = marked.where("_ol or _or")
    if todo.isEmpty():
        return done
    sums = _summaries(chunks.join(todo.select(*keys).distinct(), keys, "left_semi"), keys)
    todo = todo.join(sums, keys).withColumns(
        {
            "_lc": F.array_max(F.transform(
                F.filter("_sums", lambda s: (s["c"] < c) & (s["mx"] > v)), lambda s: s["c"])),
            "_rc": F.array_min(F.transform(
                F.filter("_sums", lambda s: (s["c"] > c) & (s["mx"] > v)), lambda s: s["c"])),
        }
    )
    todo = todo.withColumns(
        {
            "_lmid": F.array_min(F.transform(
                F.filter("_sums", lambda s: (s["c"] < c)
                         & (s["c"] > F.coalesce(F.col("_lc"), F.lit(-1)))), lambda s: s["low_l"])),
            "_rmid": F.array_min(F.transform(
                F.filter("_sums", lambda s: (s["c"] > c)
                         & (F.col("_rc").isNull() | (s["c"] < F.col("_rc")))), lambda s: s["low_r"])),
        }
    ).drop("_sums")
    left = chunks.select(*keys, F.col("_c").alias("_lc"), F.col("_arr").alias("_larr"))
    right = chunks.select(*keys, F.col("_c").alias("_rc"), F.col("_arr").alias("_rarr"))
    todo = todo.join(left, [*keys, "_lc"], "left").join(right, [*keys, "_rc"], "left")
    lhit = F.array_max(F.transform(F.filter("_larr", lambda s: s["v"] > v), lambda s: s["p"]))
    rhit = F.array_min(F.transform(F.filter("_rarr", lambda s: s["v"] > v), lambda s: s["p"]))
    ledge = F.array_min(F.transform(
        F.filter("_larr", lambda s: s["p"] > lhit),
        lambda s: F.struct(s["v"].alias("v"), (-s["p"]).alias("p"))))
    redge = F.array_min(F.transform(
        F.filter("_rarr", lambda s: s["p"] < rhit),
        lambda s: F.struct(s["v"].alias("v"), s["p"].alias("p"))))
    pair = lambda low, at: F.struct(F.col(low).alias("v"), at.alias("p"))
    lbest = F.when(F.col("_ol"), F.least(pair("_llow", -F.col("_lat")), F.col("_lmid"), ledge))
    rbest = F.when(F.col("_or"), F.least(pair("_rlow", F.col("_rat")), F.col("_rmid"), redge))
    todo = todo.withColumns({"_lb": lbest, "_rb": rbest})
    todo = todo.withColumns(
        {
            "_llow": F.coalesce(F.col("_lb.v"), F.col("_llow")),
            "_lat": F.coalesce(-F.col("_lb.p"), F.col("_lat")),
            "_rlow": F.coalesce(F.col("_rb.v"), F.col("_rlow")),
            "_rat": F.coalesce(F.col("_rb.p"), F.col("_rat")),
        }
    )
    return done.unionByName(todo.select(*near.columns))


def walk_down(
    signal: DataFrame, peaks: DataFrame, keys: list[str], pos: str, y: str, x: str,
    level: Column, size: int = CHUNK,
) -> DataFrame:
    """Nearest samples at or under ``level`` on both sides of each peak.

    Adds structs ``left`` / ``right`` (p, v, x) - the series end when the curve never
    falls that low - and ``left_in`` / ``right_in``, their inner neighbours.
    """
    chunks = packed(signal, keys, pos, y, x, size)
    probes = peaks.withColumns({"_c": chunk_of(pos, size), "_t": level})
    near = probes.join(chunks, [*keys, "_c"])
    t, here = F.col("_t"), F.col(pos)

    def last_under(arr: str, upto: Column | None) -> Column:
        low = F.filter(arr, lambda s: (s["v"] <= t) if upto is None else (s["v"] <= t) & (s["p"] <= upto))
        return F.when(F.size(low) > 0, F.element_at(low, -1))

    def first_under(arr: str, since: Column | None) -> Column:
        low = F.filter(arr, lambda s: (s["v"] <= t) if since is None else (s["v"] <= t) & (s["p"] >= since))
        return F.get(low, F.lit(0))

    near = near.withColumns({"_l": last_under("_arr", here), "_r": first_under("_arr", here)}).drop("_arr")
    ends = signal.groupBy(*keys).agg(
        F.min(pos).cast("bigint").alias("_p_first"), F.max(pos).cast("bigint").alias("_p_last")
    )
    near = near.join(ends, keys)
    c = F.col("_c")
    near = near.withColumns(
        {
            "_ol": F.col("_l").isNull() & (chunk_of("_p_first", size) < c),
            "_or": F.col("_r").isNull() & (chunk_of("_p_last", size) > c),
        }
    )
    lows = chunks.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("_c").alias("c"),
            F.array_min(F.transform("_arr", lambda s: s["v"])).alias("mn"),
        ))).alias("_lows")
    )
    done = near.where("not _ol and not _or")
    todo = near.where("_ol or _or").join(lows, keys)
    todo = todo.withColumns(
        {
            "_lc": F.array_max(F.transform(
                F.filter("_lows", lambda s: (s["c"] < c) & (s["mn"] <= t)), lambda s: s["c"])),
            "_rc": F.array_min(F.transform(
                F.filter("_lows", lambda s: (s["c"] > c) & (s["mn"] <= t)), lambda s: s["c"])),
        }
    ).drop("_lows")
    todo = todo.join(
        chunks.select(*keys, F.col("_c").alias("_lc"), F.col("_arr").alias("_la")), [*keys, "_lc"], "left"
    ).join(
        chunks.select(*keys, F.col("_c").alias("_rc"), F.col("_arr").alias("_ra")), [*keys, "_rc"], "left"
    )
    todo = todo.withColumns(
        {
            "_l": F.when(F.col("_ol"), last_under("_la", None)).otherwise(F.col("_l")),
            "_r": F.when(F.col("_or"), first_under("_ra", None)).otherwise(F.col("_r")),
        }
    )
    both = done.unionByName(todo.select(*done.columns))
    both = both.withColumns(
        {
            "_lp": F.coalesce(F.col("_l.p"), F.col("_p_first")),
            "_rp": F.coalesce(F.col("_r.p"), F.col("_p_last")),
        }
    )
    # values at the four border samples, by position
    rows = signal.select(
        *keys, F.col(pos).cast("bigint").alias("_q"),
        F.struct(F.col(pos).cast("bigint").alias("p"), F.col(y).cast("double").alias("v"),
                 F.col(x).cast("double").alias("x")).alias("_s"),
    )
    marks = F.array(
        *[
            F.struct(F.lit(n).alias("n"), p.alias("q"))
            for n, p in (
                ("left", F.col("_lp")),
                ("left_in", F.col("_lp") + 1),
                ("right", F.col("_rp")),
                ("right_in", F.col("_rp") - 1),
            )
        ]
    )
    read = both.select(*keys, pos, F.explode(marks).alias("_m")).select(
        *keys, pos, F.col("_m.n").alias("_n"), F.col("_m.q").alias("_q")
    ).join(rows, [*keys, "_q"]).groupBy(*keys, pos).agg(
        *[F.max(F.when(F.col("_n") == n, F.col("_s"))).alias(n)
          for n in ("left", "left_in", "right", "right_in")]
    )
    return peaks.join(read, [*keys, pos])
