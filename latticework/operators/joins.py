"""Range, as-of and nearest joins built from equi joins and ordered scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators.scans import carry


def band_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_x: str,
    right_x: str,
    tolerance: float,
    *,
    strict: bool = False,
    how: str = "inner",
) -> DataFrame:
    """Pairs with ``abs(left_x - right_x)`` within ``tolerance``.

    The left side sits in one bucket of that width, the right side in its own
    and both neighbouring buckets, so the join is a hash join on the bucket.
    """
    width = F.lit(float(tolerance))
    near = F.abs(F.col(left_x) - F.col(right_x))
    ok = near < width if strict else near <= width
    lhs = left.withColumn("_bucket", F.floor(F.col(left_x) / width).cast("bigint"))
    home = F.floor(F.col(right_x) / width).cast("bigint")
    rhs = right.withColumn("_bucket", F.explode(F.array(home - 1, home, home + 1)))
    names = [*keys, "_bucket"]
    if how == "inner":
        return lhs.join(rhs, names).where(ok).drop("_bucket")
    cond = ok
    rhs = rhs.select(*[F.col(n).alias(f"_r_{n}") for n in names],
                     *[c for c in rhs.columns if c not in names])
    for n in names:
        cond = cond & (F.col(n) == F.col(f"_r_{n}"))
    out = lhs.join(rhs, cond, how)
    return out.drop(*[f"_r_{n}" for n in names], "_bucket")


def window_join(
    points: DataFrame,
    centres: DataFrame,
    keys: list[str],
    x: str,
    lo: Column,
    hi: Column,
    width: float,
) -> DataFrame:
    """Points inside ``[lo, hi]`` of each centre; the interval is cut into buckets."""
    b = F.lit(float(width))
    spans = centres.withColumn("_lo", lo).withColumn("_hi", hi).withColumn(
        "_bucket",
        F.explode(
            F.sequence(F.floor(F.col("_lo") / b), F.floor(F.col("_hi") / b))
        ),
    )
    pts = points.withColumn("_bucket", F.floor(F.col(x) / b))
    return (
        pts.join(spans, [*keys, "_bucket"])
        .where((F.col(x) >= F.col("_lo")) & (F.col(x) <= F.col("_hi")))
        .drop("_bucket", "_lo", "_hi")
    )


def _merged(query: DataFrame, ref: DataFrame, keys, qx, rx, payload) -> DataFrame:
    q = query.withColumn("_x", F.col(qx).cast("double")).withColumn("_kind", F.lit(1))
    r = ref.select(
        *keys,
        F.col(rx).cast("double").alias("_x"),
        F.lit(0).alias("_kind"),
        payload.alias("_payload"),
    )
    return q.unionByName(r, allowMissingColumns=True)


def nearest(
    query: DataFrame,
    ref: DataFrame,
    keys: list[str],
    qx: str,
    rx: str,
    name: str = "nearest_dist",
    size: float = 64.0,
) -> DataFrame:
    """Distance from each query row to the closest reference value of its key.

    One ordered pass over both sides; no pairs are formed.
    """
    both = _merged(query, ref, keys, qx, rx, F.col(rx).cast("double"))
    both = carry(
        both, keys, "_x", F.col("_payload"), before="_b", after="_a", tie=["_kind"], size=size
    )
    gap = F.least(F.col("_x") - F.col("_b"), F.col("_a") - F.col("_x"))
    return (
        both.where("_kind = 1")
        .withColumn(name, gap)
        .drop("_x", "_kind", "_payload", "_a", "_b")
    )


def interpolate(
    query: DataFrame,
    ref: DataFrame,
    keys: list[str],
    qx: str,
    rx: str,
    ry: str,
    name: str = "y_interp",
    size: float = 64.0,
) -> DataFrame:
    """Piecewise-linear value of the reference curve at each query x, ends held."""
    payload = F.struct(F.col(rx).cast("double").alias("x"), F.col(ry).cast("double").alias("y"))
    both = _merged(query, ref, keys, qx, rx, payload)
    both = carry(
        both, keys, "_x", F.col("_payload"), before="_b", after="_a", tie=["_kind"], size=size
    )
    b, a = F.col("_b"), F.col("_a")
    slope = (a["y"] - b["y"]) / (a["x"] - b["x"])
    value = (
        F.when(b.isNull(), a["y"])
        .when(a.isNull() | (a["x"] == b["x"]), b["y"])
        .otherwise(b["y"] + slope * (F.col("_x") - b["x"]))
    )
    return (
        both.where("_kind = 1")
        .withColumn(name, value)
        .drop("_x", "_kind", "_payload", "_a", "_b")
    )
