"""Ordered work inside one pattern without putting the pattern into one task.

A pattern (or trace, or event series) is cut into chunks of positions. Three
building blocks cover everything the ordered operators need:

* ``halo``   - bounded frames (lag, lead, rolling windows): rows close to a chunk
  border are copied into the neighbouring chunk, so a window partitioned by
  ``(key, chunk)`` sees exactly what a window over the whole key would see;
* ``carry``  - unbounded look-back / look-ahead (gap edges, run borders, session
  starts): solved inside the chunk, plus one summary row per chunk;
* ``dense_index`` - consecutive numbering: per-chunk counts give the offsets.

A key that holds a large part of the table is therefore spread over as many
tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.session import settle

CHUNK = 4096


def chunk_of(pos: str | Column, size: float) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(size)).cast("bigint")


def halo(df: DataFrame, pos: str, reach: int, size: int | None = None) -> DataFrame:
    """Add ``_chunk`` and copy rows within ``reach`` positions of a border."""
    size = max(size or CHUNK, reach, 1)
    home = chunk_of(pos, size)
    offset = F.pmod(F.col(pos), F.lit(size))
    return df.withColumn("_home", home).withColumn(
        "_chunk",
        F.explode(
            F.array_compact(
                F.array(
                    F.col("_home"),
                    F.when(offset < reach, F.col("_home") - 1),
                    F.when(offset >= size - reach, F.col("_home") + 1),
                )
            )
        ),
    )


def core(df: DataFrame) -> DataFrame:
    """Drop the copies made by :func:`halo`."""
    return df.where("_chunk = _home").drop("_chunk", "_home")


def ordered(keys: list[str], pos: str = "idx"):
    """The window to use between :func:`halo` and :func:`core`."""
    return Window.partitionBy(*keys, "_chunk").orderBy(pos)


def carry(
    df: DataFrame,
    keys: list[str],
    pos: str,
    value: Column,
    *,
    before: str | None = None,
    after: str | None = None,
    inclusive: bool = True,
    tie: list[str] | None = None,
    size: float | None = None,
) -> DataFrame:
    """Nearest non-null ``value`` at or before (``before``) and at or after (``after``)."""
    size = size or CHUNK
    tie = tie or []
    end = 0 if inclusive else -1
    work = df.withColumn("_c", chunk_of(pos, size)).withColumn("_v", value)
    has = F.when(F.col("_v").isNotNull(), F.col(pos))
    edges = work.groupBy(*keys, "_c").agg(
        F.max_by("_v", has).alias("_last"), F.min_by("_v", has).alias("_first")
    )
    over_chunks = Window.partitionBy(*keys)
    edges = edges.select(
        *keys,
        "_c",
        F.last("_last", ignorenulls=True)
        .over(over_chunks.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
        .alias("_from_left"),
        F.last("_first", ignorenulls=True)
        .over(over_chunks.orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1))
        .alias("_from_right"),
    )
    out = work.join(edges, [*keys, "_c"])
    inside = Window.partitionBy(*keys, "_c")
    if before:
        w = inside.orderBy(F.col(pos), *tie).rowsBetween(Window.unboundedPreceding, end)
        out = out.withColumn(
            before, F.coalesce(F.last("_v", ignorenulls=True).over(w), F.col("_from_left"))
        )
    if after:
        w = inside.orderBy(F.col(pos).desc(), *tie).rowsBetween(Window.unboundedPreceding, end)
        out = out.withColumn(
            after, F.coalesce(F.last("_v", ignorenulls=True).over(w), F.col("_from_right"))
        )
    return out.drop("_c", "_v", "_from_left", "_from_right")


def dense_index(
    df: DataFrame, keys: list[str], order: list, chunk: Column, name: str = "pos"
) -> DataFrame:
    """Number rows 0, 1, 2 ... per key; ``chunk`` must be monotone in ``order``."""
    work = df.withColumn("_c", chunk)
    counts = work.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *keys, "_c", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off")
    )
    here = Window.partitionBy(*keys, "_c").orderBy(*order)
    return (
        work.join(offsets, [*keys, "_c"])
        .withColumn(name, (F.col("_off") + F.row_number().over(here) - 1).cast("bigint"))
        .drop("_c", "_off")
    )


def sessions(
    df: DataFrame, keys: list[str], pos: str, gap: Column, name: str = "session"
) -> DataFrame:
    """Chain rows whose distance to the previous row is at most ``gap``.

    ``name`` is the position of the first row of the chain. The rows are stored first: every
    `carry` reads its input twice, with other columns each time, so nothing of it would be reused.
    """
    linked = carry(settle(df), keys, pos, F.col(pos), before="_prev", inclusive=False)
    opens = F.when(
        F.col("_prev").isNull() | (F.col(pos) - F.col("_prev") > gap), F.col(pos)
    )
    return carry(linked, keys, pos, opens, before=name).drop("_prev")


def runs(
    df: DataFrame, keys: list[str], pos: str, member: Column
) -> DataFrame:
    """Border positions around each row's run of equal membership.

    Adds ``_left`` / ``_right``: nearest non-member positions (NULL at the ends of the
    series). Only meaningful on member rows.
    """
    outside = F.when(~F.coalesce(member, F.lit(False)), F.col(pos))
    return carry(df, keys, pos, outside, before="_left", after="_right")


def running_total(
    df: DataFrame, keys: list[str], pos: str, value: Column, name: str, size: float | None = None
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the key (the row itself excluded)."""
    work = df.withColumn("_c", chunk_of(pos, size or CHUNK)).withColumn("_v", value)
    per_chunk = work.groupBy(*keys, "_c").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        *keys, "_c", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_off")
    )
    here = Window.partitionBy(*keys, "_c").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return (
        work.join(offsets, [*keys, "_c"])
        .withColumn(name, F.col("_off") + F.coalesce(F.sum("_v").over(here), F.lit(0.0)))
        .drop("_c", "_v", "_off")
    )
