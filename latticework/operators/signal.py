"""Trace cleaning, smoothing, derivatives and noise estimates.

A trace is a table (keys, pos, y); NULL y marks a column without a value. Window
frames run over chunks with halos, so long traces spread over many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.scans import (
    CHUNK,
    carry,
    chunk_of,
    core,
    dense_index,
    halo,
    ordered,
    runs,
)
from latticework.operators.stats import attach, percentiles
from latticework.session import settle

# fixed values of the trace clean-up
MAX_GAP = 10
EDGE_TRIM = 12
MAD_TO_SIGMA = 1.4826


def _bounds(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(pos).alias("_first"), F.max(pos).alias("_final"))


def gap_fill(df: DataFrame, keys: list[str], pos: str = "col", max_gap: int = MAX_GAP) -> DataFrame:
    """Bridge NULL runs of at most ``max_gap`` columns; longer runs stay NULL.

    Adds ``gap_start`` / ``gap_end`` (end exclusive) on the columns that were filled.
    """
    here = F.when(F.col("y").isNotNull(), F.struct(F.col(pos).alias("p"), F.col("y").alias("v")))
    df = carry(df, keys, pos, here, before="_b", after="_a").join(_bounds(df, keys, pos), keys)
    b, a = F.col("_b"), F.col("_a")
    start = F.coalesce(b["p"] + 1, F.col("_first"))
    end = F.coalesce(a["p"], F.col("_final") + 1)
    length = end - start
    t = (F.col(pos) - start + 1) / (length + 1)
    fill = (
        F.when(b.isNotNull() & a.isNotNull(), b["v"] + t * (a["v"] - b["v"]))
        .when(b.isNotNull(), b["v"])
        .otherwise(a["v"])
    )
    hole = F.col("y").isNull() & (length <= max_gap) & (b.isNotNull() | a.isNotNull())
    return df.withColumns(
        {
            "y_filled": F.when(F.col("y").isNotNull(), F.col("y")).when(hole, fill),
            "gap_start": F.when(hole, start),
            "gap_end": F.when(hole, end),
        }
    ).drop("_b", "_a", "_first", "_final")


def plateau_removal(
    df: DataFrame, keys: list[str], height: int, width: int, pos: str = "col"
) -> DataFrame:
    """Blank wide runs near the top edge, runs touching an end, and both borders."""
    top = max(5, int(height * 0.05))
    widest = max(10, int(width * 0.012))
    df = runs(df, keys, pos, F.col("y") < top).join(_bounds(df, keys, pos), keys)
    run_width = F.col("_right") - F.col("_left") - 1
    fake = (F.col("y") < top) & (
        F.col("_left").isNull() | F.col("_right").isNull() | (run_width > widest)
    )
    edge = (F.col(pos) < F.col("_first") + EDGE_TRIM) | (F.col(pos) > F.col("_final") - EDGE_TRIM)
    return df.withColumn("y_clean", F.when(~(fake | edge), F.col("y"))).drop(
        "_left", "_right", "_first", "_final"
    )


def fidelity_thresholds(df: DataFrame, keys: list[str], pos: str = "col") -> DataFrame:
    """Scales drawn from each trace: step noise, span, search radius, minimum lift."""
    w = ordered(keys, pos)
    steps = core(
        halo(df, pos, 1).withColumn("_step", F.abs(F.col("y") - F.lag("y").over(w)))
    )
    noise = percentiles(steps, keys, "_step", {"_noise": 0.5})
    span = percentiles(df, keys, "y", {"_p04": 0.04, "_p96": 0.96})
    count = df.groupBy(*keys).agg(F.count("y").alias("n_valid"))
    out = count.join(noise, keys, "left").join(span, keys, "left")
    step = F.coalesce(F.greatest(F.col("_noise"), F.lit(1e-6)), F.lit(1.0))
    out = out.withColumns(
        {
            "step_median_abs": step,
            "span_robust_px": F.when(
                F.col("n_valid") >= 4, F.greatest(F.col("_p96") - F.col("_p04"), F.lit(1e-6))
            ).otherwise(F.lit(1.0)),
        }
    )
    span_px = F.col("span_robust_px")
    out = out.withColumn(
        "continuity_scale_px",
        F.greatest(F.col("step_median_abs"), 0.0035 * span_px, F.lit(0.20)),
    )
    scale = F.col("continuity_scale_px")
    radius = F.bround(0.012 * F.greatest(F.col("n_valid"), F.lit(12)))
    return out.withColumns(
        {
            "radius": F.least(F.greatest(radius, F.lit(4)), F.lit(10)).cast("int"),
            "min_prominence_px": F.greatest(1.28 * scale, 0.0016 * span_px, F.lit(0.38)),
            "min_lift_px": F.greatest(0.28 * scale, F.lit(0.08)),
            "spike_delta_px": F.least(F.greatest(F.lit(6.5), 5.0 * scale), F.lit(20.0)),
        }
    ).drop("_noise", "_p04", "_p96").transform(settle)


def spike_repair(
    df: DataFrame, keys: list[str], thresholds: DataFrame, pos: str = "col"
) -> DataFrame:
    """Replace a column that drops below both neighbours by more than the delta.

    A repaired column is the left neighbour of the next one. Such chains need a
    fall of more than delta per column, so they are as short as height / delta;
    only they are folded, everything else is decided from plain neighbours.
    """
    df = attach(df, thresholds.select(*keys, F.col("spike_delta_px").alias("_d")), keys)
    w = ordered(keys, pos)
    seen = core(
        halo(df, pos, 1).withColumns(
            {"_prev": F.lag("y").over(w), "_next": F.lead("y").over(w)}
        )
    )
    linked = F.coalesce(F.col("_prev") > F.col("y") + F.col("_d"), F.lit(False))
    seen = carry(seen, keys, pos, F.when(~linked, F.col(pos)), before="_chain")
    item = F.struct(
        F.col(pos).alias("p"),
        *[F.col(c).alias(c) for c in seen.columns if c not in (*keys, pos, "_chain")],
    )
    chains = seen.groupBy(*keys, "_chain").agg(F.array_sort(F.collect_list(item)).alias("_rows"))

    def repaired(left: Column, row: Column) -> Column:
        y, nxt, d = row["y"], row["_next"], row["_d"]
        hit = (y > left + d) & (y > nxt + d)
        return F.when(F.coalesce(hit, F.lit(False)), 0.5 * (left + nxt)).otherwise(y)

    first = F.element_at("_rows", 1)
    start = F.struct(
        first["_prev"].alias("left"),
        F.array().cast("array<double>").alias("out"),
    )
    folded = F.aggregate(
        "_rows",
        start,
        lambda acc, row: F.struct(
            repaired(acc["left"], row).alias("left"),
            F.concat(acc["out"], F.array(repaired(acc["left"], row))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    rows = chains.select(*keys, F.posexplode(F.arrays_zip("_rows", folded.alias("y_new"))).alias("_i", "_z"))
    zipped = rows.select(*keys, "_z._rows.*", F.col("_z.y_new").alias("y_repaired"))
    return zipped.withColumnRenamed("p", pos).drop("_prev", "_next", "_d")


def sg_weights(window: int, order: int, at: int) -> list[float]:
    """Least-squares weights of a polynomial fitted to ``window`` samples, read at ``at``."""
    x = np.arange(window) - at
    design = np.vander(x, order + 1, increasing=True)
    return np.linalg.pinv(design)[0].tolist()


def savitzky_golay(
    df: DataFrame, keys: list[str], pos: str, y: str, window: int, name: str, order: int = 2
) -> DataFrame:
    """Polynomial smoothing over consecutively numbered samples.

    Ends are read from the polynomial fitted to the first / last full window. A
    series shorter than the window uses the widest odd window that fits.
    """
    size = window if window % 2 else window - 1
    ends = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    df = halo(df.join(ends, keys), pos, size - 1)
    w = ordered(keys, pos)
    near = {k: f"_y{k + size}" for k in range(-(size - 1), size)}
    df = df.withColumns({c: F.lead(y, k).over(w) for k, c in near.items()})
    p, n = F.col(pos), F.col("_n")

    def fitted(width: int) -> Column:
        half = width // 2

        def read(at: int) -> Column:
            terms = [F.lit(c) * F.col(near[j - at]) for j, c in enumerate(sg_weights(width, order, at))]
            total = terms[0]
            for t in terms[1:]:
                total = total + t
            return total

        value = read(half)
        for k in range(half):
            value = F.when(p == k, read(k)).when(p == n - 1 - k, read(width - 1 - k)).otherwise(value)
        return value

    out = F.when(n >= size, fitted(size))
    for width in range(size - 2, order + 1, -2):
        out = out.when(n >= width, fitted(width))
    df = df.withColumn(name, out.otherwise(F.col(y)))
    return core(df).drop("_n", *near.values())


def sg_on_valid(
    df: DataFrame, keys: list[str], window: int, pos: str = "col", y: str = "y", name: str = "y_smooth"
) -> DataFrame:
    """Smooth the valid samples as one gap-free sequence."""
    valid = dense_index(
        df.where(F.col(y).isNotNull()), keys, [pos], chunk_of(pos, CHUNK), "_seq"
    )
    return savitzky_golay(valid, keys, "_seq", y, window, name)


def default_smooth(df: DataFrame, keys: list[str], pos: str = "col", y: str = "y") -> DataFrame:
    """Five-sample smoothing that never lowers a peak (smaller y is higher)."""
    out = sg_on_valid(df, keys, 5, pos, y, "_sg")
    n = df.where(F.col(y).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_nv"))
    out = out.join(n, keys)
    return out.withColumn(
        "y_smooth", F.when(F.col("_nv") < 5, F.col(y)).otherwise(F.least("_sg", y))
    ).drop("_sg", "_nv", "_seq")


def restore_peaks(
    df: DataFrame, keys: list[str], thresholds: DataFrame, pos: str = "col",
    filled: str = "y_filled", smooth: str = "y_smooth", radii: tuple[int, ...] = tuple(range(4, 11)),
) -> DataFrame:
    """Give flattened local tops their unsmoothed height back."""
    df = attach(
        df, thresholds.select(*keys, "radius", "min_prominence_px", "min_lift_px"), keys
    )
    wide = max(radii)
    w = ordered(keys, pos)
    df = halo(df, pos, wide)
    frames = {}
    for k in radii:
        frames[f"_m{k}"] = F.min(filled).over(w.rangeBetween(-k, k))
        frames[f"_l{k}"] = F.max(filled).over(w.rangeBetween(-k, -1))
        frames[f"_r{k}"] = F.max(filled).over(w.rangeBetween(1, k))
    df = df.withColumns(frames)
    radius = F.greatest(F.col("radius"), F.lit(2))

    def chosen(part: str) -> Column:
        return F.coalesce(*[F.when(radius == k, F.col(f"_{part}{k}")) for k in radii])

    lo, left, right = chosen("m"), chosen("l"), chosen("r")
    apex = (
        (F.col(filled) <= lo + 1e-9)
        & left.isNotNull()
        & right.isNotNull()
        & (F.greatest(left, right) - F.col(filled) >= F.col("min_prominence_px"))
        & (F.col(smooth) > F.col(filled) + F.col("min_lift_px"))
    )
    df = df.withColumn(
        "y_restored", F.when(F.coalesce(apex, F.lit(False)), F.col(filled)).otherwise(F.col(smooth))
    )
    return core(df).drop(*frames, "radius", "min_prominence_px", "min_lift_px")


def curvature_blend(
    df: DataFrame, keys: list[str], pos: str = "col", filled: str = "y_filled",
    smooth: str = "y_smooth", strength: float = 0.32,
) -> DataFrame:
    """Pull strongly curved samples back toward the unsmoothed trace."""
    w = ordered(keys, pos)
    bend = F.abs(F.lag(filled).over(w) - 2 * F.col(filled) + F.lead(filled).over(w))
    df = core(halo(df, pos, 1).withColumn("_d2", bend))
    q = percentiles(df.where("_d2 > 0"), keys, "_d2", {"_q95": 0.95})
    df = attach(df, q, keys)
    share = F.least(F.lit(1.0), F.coalesce(F.col("_d2"), F.lit(0.0)) / F.col("_q95"))
    blend = F.lit(min(max(strength, 0.0), 1.0)) * F.pow(share, F.lit(1.15))
    mixed = (1 - blend) * F.col(smooth) + blend * F.col(filled)
    return df.withColumn(
        "y_blend", F.when(F.col("_q95") >= 1e-9, mixed).otherwise(F.col(smooth))
    ).drop("_d2", "_q95")


def gated_smooth(
    df: DataFrame, keys: list[str], plot_width: int, scale_h: float = 1.0, pos: str = "col",
    max_curvature: float = 1.5, max_prominence: float = 0.40, window: int = 5,
) -> DataFrame:
    """Smooth only calm stretches; each stretch is smoothed on its own."""
    reach = max(5, int(round(0.006 * plot_width)))
    valid = dense_index(df.where("y IS NOT NULL"), keys, [pos], chunk_of(pos, CHUNK), "_seq")
    size = valid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), (F.max("y") - F.min("y") + 1e-6).alias("_range")
    )
    w = ordered(keys, "_seq")
    seen = halo(valid, "_seq", reach).withColumns(
        {
            "_bend": F.abs(F.lead("y").over(w) - 2 * F.col("y") + F.lag("y").over(w))
            / max(1.0, scale_h),
            "_lmin": F.min("y").over(w.rowsBetween(-reach, -1)),
            "_rmin": F.min("y").over(w.rowsBetween(1, reach)),
        }
    )
    seen = attach(core(seen), size, keys)
    prominence = F.greatest(F.lit(0.0), F.col("y") - 0.5 * (F.col("_lmin") + F.col("_rmin")))
    calm = (
        (F.col("_bend") < max_curvature)
        & (prominence / F.col("_range") < max_prominence)
        & (F.col("_n") >= window)
    )
    seen = seen.withColumn("gate", F.coalesce(calm, F.lit(False)).cast("int"))
    whole = df.join(seen.select(*keys, pos, "gate"), [*keys, pos], "left").fillna(0, ["gate"])
    whole = runs(whole, keys, pos, F.col("gate") == 1)
    first = F.coalesce(F.col("_left"), F.lit(-1)) + 1
    stretch = whole.where("gate = 1").withColumns(
        {"_run": first.cast("bigint"), "_k": (F.col(pos) - first).cast("bigint")}
    )
    lengths = stretch.groupBy(*keys, "_run").agg(
        F.count(F.lit(1)).alias("_len"), F.min(pos).alias("_start")
    )
    stretch = stretch.join(lengths, [*keys, "_run"]).where(F.col("_len") >= window)
    stretch = stretch.withColumn("_k", (F.col(pos) - F.col("_start")).cast("bigint"))
    smooth = savitzky_golay(stretch, [*keys, "_run"], "_k", "y", window, "_sg")
    k, length = F.col("_k"), F.col("_len")
    share = (
        F.when(k < 2, (k + 1) / 3.0).when(k >= length - 2, (length - k) / 3.0).otherwise(F.lit(1.0))
    )
    smooth = smooth.select(
        *keys, pos, ((1 - share) * F.col("y") + share * F.col("_sg")).alias("_new")
    )
    return (
        whole.drop("_left", "_right")
        .join(smooth, [*keys, pos], "left")
        .withColumn("y_gated", F.coalesce("_new", "y"))
        .drop("_new")
    )


def kernel_weights(window: int = 5, order: int = 2, deriv: int = 0) -> list[float]:
    """Normalised power sums per offset; one-sided on purpose, not a true polynomial fit."""
    half = window // 2
    raw = []
    for i in range(-half, half + 1):
        total = 0.0
        for j in range(order + 1):
            if deriv == 0:
                total += float(i) ** j
            elif deriv == 1 and j >= 1:
                total += j * float(i) ** (j - 1)
            elif deriv == 2 and j >= 2:
                total += j * (j - 1) * float(i) ** (j - 2)
        raw.append(total)
    return [v / sum(raw) for v in raw]


def kernel_smooth(
    df: DataFrame, keys: list[str], pos: str = "idx", y: str = "intensity",
    window: int = 5, order: int = 2, name: str = "smoothed",
) -> DataFrame:
    """Analyzer smoothing: fixed weights, ends repeat the outermost sample."""
    half = window // 2
    w = ordered(keys, pos)
    df = halo(df, pos, window - 1)

    def sample(k: int) -> Column:
        step = F.lag if k < 0 else F.lead
        return F.coalesce(*[step(y, n).over(w) for n in range(abs(k), 0, -1)], F.col(y))

    total = None
    for k, weight in zip(range(-half, half + 1), kernel_weights(window, order), strict=True):
        term = sample(k) * F.lit(weight)
        total = term if total is None else total + term
    # the frame holds a full window somewhere exactly when the series is long enough
    enough = F.count(F.lit(1)).over(w.rowsBetween(-(window - 1), window - 1)) >= window
    return core(df.withColumn(name, F.when(enough, total).otherwise(F.col(y))))


def derivatives(df: DataFrame, keys: list[str], pos: str = "idx", y: str = "intensity") -> DataFrame:
    """First and second differences: central inside, one-sided at both ends."""
    w = ordered(keys, pos)
    at = lambda k: (F.lead(y, k) if k > 0 else F.lag(y, -k)).over(w)
    here = F.col(y)
    first = (
        F.when(at(-1).isNull(), at(1) - here)
        .when(at(1).isNull(), here - at(-1))
        .otherwise((at(1) - at(-1)) / 2)
    )
    second = (
        F.when(at(-1).isNull(), at(2) - 2 * at(1) + here)
        .when(at(1).isNull(), here - 2 * at(-1) + at(-2))
        .otherwise(at(1) - 2 * here + at(-1))
    )
    return core(halo(df, pos, 2).withColumns({"d1": first, "d2": second}))


def gradient(
    df: DataFrame, keys: list[str], pos: str, y: str, name: str
) -> DataFrame:
    """Central slope, one-sided at both ends."""
    w = ordered(keys, pos)
    prev, nxt = F.lag(y).over(w), F.lead(y).over(w)
    slope = (
        F.when(prev.isNull(), nxt - F.col(y))
        .when(nxt.isNull(), F.col(y) - prev)
        .otherwise((nxt - prev) / 2)
    )
    return core(halo(df, pos, 1).withColumn(name, slope))


def odd_window(window: int) -> int:
    window = max(3, int(window))
    return window if window % 2 else window + 1


def rolling_median_iqr(
    df: DataFrame, keys: list[str], window: int, pos: str = "col", y: str = "y"
) -> DataFrame:
    """Centred rolling median and interquartile range; NULLs are skipped.

    Fewer than four values give their standard deviation instead of the range.
    """
    half = odd_window(window) // 2
    frame = ordered(keys, pos).rangeBetween(-half, half)
    q = lambda p: F.percentile(y, F.lit(p)).over(frame)
    iqr = (
        F.when(F.count(y).over(frame) >= 4, q(0.75) - q(0.25))
        .otherwise(F.stddev_pop(y).over(frame))
    )
    return core(halo(df, pos, half).withColumns({"roll_median": q(0.5), "roll_iqr": iqr}))


def robust_sigma(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1.4826 x median absolute deviation; standard deviation, then 1, when degenerate."""
    med = percentiles(df, keys, value, {"median": 0.5})
    dev = attach(df.where(F.col(value).isNotNull()), med, keys).withColumn(
        "_dev", F.abs(F.col(value) - F.col("median"))
    )
    mad = percentiles(dev, keys, "_dev", {"mad": 0.5})
    std = df.groupBy(*keys).agg(F.stddev_pop(value).alias("_std"))
    sigma = F.col("mad") * MAD_TO_SIGMA
    sigma = F.when(sigma < 1e-6, F.col("_std")).otherwise(sigma)
    return (
        std.join(med, keys, "left").join(mad, keys, "left")
        .withColumn("sigma", F.when(sigma > 1e-9, sigma).otherwise(F.lit(1.0)))
        .withColumn("sigma", F.when(F.col("median").isNotNull(), F.col("sigma")))
        .drop("_std")
    )


def local_noise(
    df: DataFrame, keys: list[str], pos: str = "idx", y: str = "intensity", window: int = 30
) -> DataFrame:
    """Median over half-overlapping windows of the standard deviation of steps.

    ``pos`` numbers the samples 0, 1, 2 ...; series shorter than one window use all steps.
    """
    hop = window // 2
    w = ordered(keys, pos)
    steps = core(halo(df, pos, 1).withColumn("_step", F.col(y) - F.lag(y).over(w)))
    whole = settle(steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_pop("_step").alias("_all")))
    first = F.greatest(F.ceil((F.col(pos) - (window - 1)) / hop), F.lit(0))
    last = F.floor((F.col(pos) - 1) / hop)
    tagged = steps.where("_step IS NOT NULL").where(first <= last).withColumn("_win", F.explode(F.sequence(first, last)))
    # windows that end beyond the series go after they are summed up, so no step waits for the length
    spread = attach(tagged.groupBy(*keys, "_win").agg(F.stddev_pop("_step").alias("_std")), whole, keys).where(
        F.col("_win") * hop + window <= F.col("_n"))
    mid = percentiles(spread, keys, "_std", {"_mid": 0.5})
    noise = F.when(F.col("_n") >= window, F.col("_mid")).when(F.col("_n") > 2, F.col("_all"))
    return (
        whole.join(mid, keys, "left")
        .select(*keys, F.coalesce(noise, F.lit(0.0)).alias("noise"), F.col("_n").alias("n"))
    )


def smoothed_hint(
    candidates: DataFrame, spine: DataFrame, keys: list[str], radius: int = 5
) -> DataFrame:
    """Per-column median height, then a centred rolling median over the columns."""
    level = percentiles(candidates, [*keys, "col"], "y", {"level": 0.5})
    rows = spine.select(*keys, "col").join(level, [*keys, "col"], "left")
    frame = ordered(keys, "col").rangeBetween(-radius, radius)
    return core(
        halo(rows, "col", radius).withColumn("hint", F.percentile("level", F.lit(0.5)).over(frame))
    )
