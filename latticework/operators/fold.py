"""Order-dependent selections, folded over short chains instead of whole patterns.

Greedy spacing only links candidates that are closer than the spacing, so a
pattern falls apart into independent chains; each chain is one small group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators.scans import carry


def _chains(df: DataFrame, keys: list[str], pos: str, opens: Column) -> DataFrame:
    df = carry(df, keys, pos, F.when(opens, F.col(pos)), before="_chain")
    item = F.struct(
        F.col(pos).alias("_at"), *[F.col(c) for c in df.columns if c not in (*keys, "_chain")]
    )
    return df.groupBy(*keys, "_chain").agg(F.array_sort(F.collect_list(item)).alias("_items"))


def _unpack(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.select(*keys, F.explode(column).alias("_row")).select(*keys, "_row.*").drop("_at")


def space_left_to_right(
    df: DataFrame, keys: list[str], order: str, pos: str, height: str, distance: Column, opens: Column
) -> DataFrame:
    """Walk in ``order``; a candidate too close to the last kept one replaces it if higher.

    ``opens`` marks candidates that are surely far enough from everything before them.
    """
    df = df.withColumn("_gap", distance)
    chains = _chains(df, keys, order, opens)
    first = F.slice("_items", 1, 1)
    rest = F.slice("_items", 2, F.size("_items"))

    def step(kept: Column, item: Column) -> Column:
        last = F.element_at(kept, -1)
        return (
            F.when(item[pos] - last[pos] >= item["_gap"], F.concat(kept, F.array(item)))
            .when(
                item[height] > last[height],
                F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(item)),
            )
            .otherwise(kept)
        )

    chains = chains.withColumn("_kept", F.aggregate(rest, first, step))
    return _unpack(chains, keys, "_kept").drop("_gap")


def _taken(ranked: str, gap: Column) -> Column:
    def take(acc: Column, x: Column) -> Column:
        crowded = F.exists(acc, lambda k: F.abs(k - x["p"]) < gap)
        return F.when(crowded, acc).otherwise(F.concat(acc, F.array(x["p"].cast("bigint"))))

    return F.aggregate(ranked, F.array().cast("array<bigint>"), take)


def thin_by_height(
    df: DataFrame,
    keys: list[str],
    pos: str,
    height: str,
    distances: dict[str, Column],
    *,
    high_index_first: bool,
) -> DataFrame:
    """Keep the highest of all candidates closer than a distance; one flag per distance.

    Candidates are taken from the highest down; one is kept when every kept one is at
    least the distance away. ``distances`` maps flag names to per-row distances.
    """
    gaps = {f"_gap_{n}": c for n, c in distances.items()}
    df = df.withColumns(gaps).withColumn("_far", F.greatest(*gaps, F.lit(0)))
    df = carry(df, keys, pos, F.col(pos), before="_prev", inclusive=False)
    opens = F.col("_prev").isNull() | (F.col(pos) - F.col("_prev") >= F.col("_far"))
    chains = _chains(df, keys, pos, opens)
    tie = (lambda x: -x[pos]) if high_index_first else (lambda x: x[pos])
    ranked = F.array_sort(
        F.transform("_items", lambda x: F.struct(-x[height], tie(x).alias("t"), x[pos].alias("p")))
    )
    chains = chains.withColumn("_ranked", ranked)
    for name in distances:
        gap = F.element_at("_items", 1)[f"_gap_{name}"]
        chains = chains.withColumn(f"_kept_{name}", _taken("_ranked", gap))
    rows = chains.select(
        *keys, *[f"_kept_{n}" for n in distances], F.explode("_items").alias("_row")
    )
    rows = rows.select(
        *keys, *[f"_kept_{n}" for n in distances], "_row.*"
    )
    flags = {
        n: F.array_contains(f"_kept_{n}", F.col(pos).cast("bigint")) for n in distances
    }
    return rows.withColumns(flags).drop(
        "_at", "_far", "_prev", *gaps, *[f"_kept_{n}" for n in distances]
    )
