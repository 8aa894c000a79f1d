"""Exact order statistics and summary blocks for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# resolution of the logarithmic value bands: parts per power of two
BAND_PARTS = 1024
_BAND_SHIFT = 1100 * BAND_PARTS


def value_band(v: Column) -> Column:
    """A monotone integer band of a double; equal values share a band."""
    size = F.floor(F.log2(F.abs(v)) * BAND_PARTS) + _BAND_SHIFT
    return (
        F.when(v > 1e-300, size).when(v < -1e-300, -size).otherwise(F.lit(0)).cast("bigint")
    )


def percentiles(
    df: DataFrame, keys: list[str], value: str | Column, probs: dict[str, float],
    upper: tuple[str, ...] = (),
) -> DataFrame:
    """Exact linear-interpolation percentiles per key, one row per key.

    Names listed in ``upper`` give the higher of the two neighbouring values instead.

    No group is gathered in one place: values are counted per narrow band, the
    cumulative counts say which bands hold the wanted ranks, and only the
    distinct values of those bands are ordered.
    """
    value = F.col(value) if isinstance(value, str) else value
    one = not keys
    keys = keys or ["_all"]
    vals = (df.withColumn("_all", F.lit(1)) if one else df).select(
        *keys, value.cast("double").alias("_v")
    )
    vals = vals.where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn(
        "_band", value_band(F.col("_v"))
    )
    distinct = vals.groupBy(*keys, "_band", "_v").agg(F.count(F.lit(1)).alias("_n"))
    bands = distinct.groupBy(*keys, "_band").agg(F.sum("_n").alias("_bn"))
    by_key = Window.partitionBy(*keys)
    running = by_key.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(
        *keys,
        "_band",
        "_bn",
        F.coalesce(F.sum("_bn").over(running), F.lit(0)).alias("_before"),
        F.sum("_bn").over(by_key).alias("_total"),
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                edge((F.col("_total") - 1) * F.lit(p)).cast("bigint").alias("rank"),
                F.lit(side).alias("side"),
                ((F.col("_total") - 1) * F.lit(p) - F.floor((F.col("_total") - 1) * F.lit(p)))
                .cast("double")
                .alias("frac"),
            )
            for name, p in probs.items()
            for side, edge in (("lo", F.floor), ("hi", F.ceil))
        ]
    )
    inside = F.filter(
        wanted,
        lambda t: (t["rank"] >= F.col("_before")) & (t["rank"] < F.col("_before") + F.col("_bn")),
    )
    picked = bands.withColumn("_want", inside).where(F.size("_want") > 0)
    in_band = (
        Window.partitionBy(*keys, "_band")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = (
        distinct.join(picked.select(*keys, "_band", "_before", "_want"), [*keys, "_band"])
        .withColumn("_lo", F.col("_before") + F.coalesce(F.sum("_n").over(in_band), F.lit(0)))
        .withColumn(
            "_want",
            F.filter(
                "_want",
                lambda t: (t["rank"] >= F.col("_lo")) & (t["rank"] < F.col("_lo") + F.col("_n")),
            ),
        )
    )
    hits = ranked.select(*keys, "_v", F.explode("_want").alias("_t"))
    out = hits.groupBy(*keys).agg(
        *[
            (_side(name, "hi") if name in upper else _interpolated(name)).alias(name)
            for name in probs
        ]
    )
    return out.drop("_all") if one else out


def _side(name: str, side: str) -> Column:
    return F.max(F.when((F.col("_t.name") == name) & (F.col("_t.side") == side), F.col("_v")))


def _interpolated(name: str) -> Column:
    frac = F.max(F.when(F.col("_t.name") == name, F.col("_t.frac")))
    lo, hi = _side(name, "lo"), _side(name, "hi")
    return lo + (hi - lo) * frac


def attach(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Bring one-row-per-key values back to the rows (AQE splits hot keys)."""
    return df.join(stats, keys, how)


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, population std, median, p10, p90, min, max and n per key."""
    marker = keys or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(1))
    basic = src.where(F.col(value).isNotNull()).groupBy(*marker).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(value).alias("n"),
    )
    order = percentiles(src, marker, value, {"median": 0.5, "p10": 0.1, "p90": 0.9})
    out = basic.join(order, marker)
    return out if keys else out.drop("_all")
