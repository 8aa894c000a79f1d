"""Axis calibration, unit conversion and resampling of digitised curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators.joins import interpolate
from latticework.operators.scans import carry

# fixed values: report texts of the calibration rules, in check order
BOX_ARITY = "plot_box must have 4 elements [x0, y0, x1, y1]"
BOX_EMPTY = "plot_box has zero or negative area (ROI empty)"
BOX_OUTSIDE = "plot_box extends outside image bounds"
LENGTH_MISMATCH = "{0}_axis_points and {0}_axis_values length mismatch"
TOO_FEW_POINTS = "{0}_axis_points requires at least 2 points"
SAME_PIXEL = "{0}_axis_points have identical pixel {0} - axis mapping impossible"
SAME_VALUE = "{0}_axis_values are identical - degenerate {0} axis"
COLOUR_OUTSIDE = "color_sample_point is outside plot_box (ROI)"

# fixed value: upper bound on exported samples per curve
RESAMPLE_CAP = 20000


def rule_errors(width: Column, height: Column) -> Column:
    """Messages of every violated rule, as an array (empty means usable)."""
    box = F.col("plot_box")
    x0, y0, x1, y1 = (F.get(box, i) for i in range(4))
    full_box = F.size(box) == 4
    checks = [
        F.when(~F.coalesce(full_box, F.lit(False)), F.lit(BOX_ARITY)),
        F.when(full_box & ((x1 <= x0) | (y1 <= y0)), F.lit(BOX_EMPTY)),
        F.when(
            full_box & ((x0 < 0) | (y0 < 0) | (x1 > width) | (y1 > height)), F.lit(BOX_OUTSIDE)
        ),
    ]
    for axis, part in (("x", 0), ("y", 1)):
        pts, vals = F.col(f"{axis}_axis_points"), F.col(f"{axis}_axis_values")
        first = F.get(F.get(pts, 0), part)
        last = F.get(F.element_at(pts, -1), part)
        enough = F.size(pts) >= 2
        span = F.abs(F.get(vals, 0) - F.element_at(vals, -1))
        checks += [
            F.when(F.size(pts) != F.size(vals), F.lit(LENGTH_MISMATCH.format(axis))),
            F.when(~enough, F.lit(TOO_FEW_POINTS.format(axis))),
            F.when(enough & (F.abs(first - last) < 1), F.lit(SAME_PIXEL.format(axis))),
            F.when(enough & (F.size(vals) >= 2) & (span < 1e-12), F.lit(SAME_VALUE.format(axis))),
        ]
    point = F.col("color_sample_point")
    inside = (
        F.get(point, 0).between(x0, x1) & F.get(point, 1).between(y0, y1)
    )
    checks.append(F.when(full_box & (F.size(point) == 2) & ~inside, F.lit(COLOUR_OUTSIDE)))
    return F.array_compact(F.array(*checks))


def click_count() -> Column:
    """Six mandatory clicks plus one per optional mark, four for a perspective."""
    extra = lambda name: F.coalesce(F.size(name), F.lit(0))
    count = lambda name: F.greatest(extra(name), F.lit(0))
    corners = F.when(count("perspective_corners") > 0, 4).otherwise(0)
    return count("legend_ignore_boxes") + count("color_resample_points") + corners + 6


def click_budget(count: Column) -> Column:
    return (
        F.when(count <= 6, "normal")
        .when(count <= 7, "normal_max")
        .when(count <= 11, "hard")
        .when(count <= 12, "hard_max")
        .otherwise("ux_fail")
    )


def _scale_offset(p1: Column, p2: Column, v1: Column, v2: Column) -> tuple[Column, Column]:
    flat = F.abs(p2 - p1) < 1e-6
    scale = F.when(flat, F.lit(0.0)).otherwise((v2 - v1) / (p2 - p1))
    return scale, F.when(flat, v1).otherwise(v1 - scale * p1)


def fit_axes(df: DataFrame) -> DataFrame:
    """Linear pixel-to-value maps of both axes from their first and last marks."""
    rel = {
        "px_a": F.col("px1") - F.col("x0"),
        "px_b": F.col("px2") - F.col("x0"),
        "py_a": F.col("py1") - F.col("y0"),
        "py_b": F.col("py2") - F.col("y0"),
    }
    df = df.withColumns({k: v.cast("double") for k, v in rel.items()})
    xs, xo = _scale_offset(F.col("px_a"), F.col("px_b"), F.col("x_v1"), F.col("x_v2"))
    ys, yo = _scale_offset(F.col("py_a"), F.col("py_b"), F.col("y_v1"), F.col("y_v2"))
    return df.withColumns({"x_scale": xs, "x_offset": xo, "y_scale": ys, "y_offset": yo})


def to_value(px: Column, axis: str) -> Column:
    return F.col(f"{axis}_scale") * px + F.col(f"{axis}_offset")


def to_pixel(value: Column, axis: str) -> Column:
    scale = F.col(f"{axis}_scale")
    ref = F.col("px_a" if axis == "x" else "py_a")
    return F.when(F.abs(scale) < 1e-12, ref).otherwise((value - F.col(f"{axis}_offset")) / scale)


def roundtrip(df: DataFrame) -> DataFrame:
    """Pixel -> value -> pixel error at the marks, and the confidence drawn from it."""

    def err(ref: str, axis: str) -> Column:
        return F.abs(to_pixel(to_value(F.col(ref), axis), axis) - F.col(ref))

    df = df.withColumns(
        {
            "x_mean_error_px": (err("px_a", "x") + err("px_b", "x")) / 2,
            "y_mean_error_px": (err("py_a", "y") + err("py_b", "y")) / 2,
        }
    )
    total = (F.col("x_mean_error_px") + F.col("y_mean_error_px")) / 2
    return df.withColumn("total_mean_error_px", total).withColumn(
        "calibration_confidence",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("total_mean_error_px") / 3)),
    )


def trace_to_numeric(trace: DataFrame, maps: DataFrame, factor: int = 1) -> DataFrame:
    """Valid trace columns in axis units; an up-scaled trace is divided back first."""
    pts = trace.where(F.col("y").isNotNull()).join(maps, "sample_id")
    k = float(max(factor, 1))
    return pts.withColumns(
        {
            "two_theta": F.round(to_value(F.col("col") / k, "x"), 6),
            "intensity": F.round(to_value(F.col("y") / k, "y"), 6),
        }
    )


def minmax_normalise(points: DataFrame, keys: list[str]) -> DataFrame:
    """Intensities stretched to 0..100 per curve; NULL for a flat curve."""
    span = points.groupBy(*keys).agg(
        F.min("intensity").alias("_lo"), F.max("intensity").alias("_hi")
    )
    rng = F.col("_hi") - F.col("_lo")
    return (
        points.join(span, keys)
        .withColumn(
            "intensity_norm",
            F.when(rng > 1e-12, (F.col("intensity") - F.col("_lo")) / rng * 100),
        )
        .drop("_lo", "_hi")
    )


def plot_scale(df: DataFrame) -> DataFrame:
    """Plot size relative to the 950 x 690 reference frame."""
    df = df.withColumns(
        {"plot_w": F.col("x1") - F.col("x0") + 1, "plot_h": F.col("y1") - F.col("y0") + 1}
    )
    return df.withColumns(
        {
            "s_w": F.col("plot_w") / 950.0,
            "s_h": F.col("plot_h") / 690.0,
            "s": F.sqrt(F.col("plot_w") / 950.0 * (F.col("plot_h") / 690.0)),
        }
    )


def resample_envelope(points: DataFrame, lo: float, hi: float, n_target: int) -> DataFrame:
    """Uniform grid per curve that never cuts a peak top.

    Linear interpolation, raised to the highest sample within half a step. Curves
    that already have enough samples, or whose angles repeat, are passed through.
    """
    n = min(int(n_target), RESAMPLE_CAP)
    step = (hi - lo) / (n - 1)
    keys = ["pattern_id"]
    shape = (
        points.groupBy("pattern_id", "two_theta")
        .agg(F.count(F.lit(1)).alias("_c"))
        .groupBy("pattern_id")
        .agg(F.sum("_c").alias("_n"), F.max("_c").alias("_dup"))
    )
    usable = (F.col("_n") >= 2) & (F.col("_n") < n) & (F.col("_dup") == 1)
    marked = points.join(shape.select("pattern_id", usable.alias("_use")), keys)
    source = marked.where("_use").select("pattern_id", "two_theta", "intensity")
    grid = (
        shape.where(usable)
        .select("pattern_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx"))
        .withColumn("two_theta", F.lit(lo) + F.col("idx") * F.lit(step))
    )
    line = interpolate(grid, source, keys, "two_theta", "two_theta", "intensity", "_line")
    near = F.floor((F.col("two_theta") - lo) / step).cast("int")
    half = 0.5 * step
    tops = (
        source.withColumn("idx", F.explode(F.array(near, near + 1)))
        .withColumn("_g", F.lit(lo) + F.col("idx") * F.lit(step))
        .where(
            F.col("idx").between(0, n - 1)
            & (F.col("two_theta") >= F.greatest(F.lit(lo), F.col("_g") - half))
            & (F.col("two_theta") <= F.least(F.lit(hi), F.col("_g") + half))
        )
        .groupBy("pattern_id", "idx")
        .agg(F.max("intensity").alias("_top"))
    )
    if n < 3:
        tops = tops.limit(0)
    fine = line.join(tops, ["pattern_id", "idx"], "left").select(
        "pattern_id", "idx", "two_theta", F.greatest("_line", "_top").alias("intensity")
    )
    kept = marked.where("not _use").select("pattern_id", "idx", "two_theta", "intensity")
    return fine.unionByName(kept)


def clip(value: Column, a: Column, b: Column) -> Column:
    return F.least(F.greatest(value, F.least(a, b)), F.greatest(a, b))


def export_peaks(peaks: DataFrame, major: DataFrame, maps: DataFrame) -> DataFrame:
    """Detected peaks in axis units; the best available height is used and clipped."""
    flag = major.select("sample_id", "index", F.lit(True).alias("_m"))
    best = F.coalesce("y_pixel_roi_refined", "y_pixel_refined", "y_pixel", F.lit(0.0))
    return (
        peaks.join(flag, ["sample_id", "index"], "left")
        .join(maps, "sample_id")
        .withColumns(
            {
                "two_theta": to_value(F.col("index").cast("double"), "x"),
                "intensity": clip(to_value(best, "y"), F.col("y_v1"), F.col("y_v2")),
                "is_major": F.coalesce("_m", F.lit(False)),
            }
        )
    )


def downscale(trace: DataFrame, factor: int, width: int) -> DataFrame:
    """Trace of an enlarged plot read at every ``factor``-th column."""
    k = int(factor)
    if k <= 1:
        return trace
    # the enlarged trace covers consecutive columns, so grid positions fall on rows;
    # positions past its end repeat the last row
    last = trace.groupBy("sample_id").agg(F.max_by(F.struct("y"), "col").alias("_end"),
                                          F.max("col").alias("_max"))
    target = last.select(
        "sample_id", "_end", "_max", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("out_col")
    ).withColumn("col", (F.col("out_col") * k).cast("int"))
    joined = target.join(trace, ["sample_id", "col"], "left")
    y = F.when(F.col("col") > F.col("_max"), F.col("_end.y")).otherwise(F.col("y"))
    return joined.select("sample_id", F.col("out_col").alias("col"), (y / k).alias("y"))


def scale_about_origin(x: Column, y: Column, x0: Column, y0: Column, factor: int):
    """A pixel position after enlarging the plot box by an integer factor."""
    return x0 + F.bround((x - x0) * factor).cast("int"), y0 + F.bround((y - y0) * factor).cast("int")


def fill_linear(df: DataFrame, keys: list[str], pos: str, y: str, name: str = "y_filled") -> DataFrame:
    """Missing samples on straight lines, ends held; an all-missing series becomes 0."""
    here = F.when(F.col(y).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(y).alias("v")))
    out = carry(df, keys, pos, here, before="_b", after="_a")
    b, a = F.col("_b"), F.col("_a")
    slope = (a["v"] - b["v"]) / (a["p"] - b["p"])
    value = (
        F.when(F.col(y).isNotNull(), F.col(y))
        .when(a.isNull() & b.isNull(), F.lit(0.0))
        .when(b.isNull(), a["v"])
        .when(a.isNull(), b["v"])
        .otherwise(b["v"] + slope * (F.col(pos) - b["p"]))
    )
    return out.withColumn(name, value).drop("_a", "_b")


def export_summary(trace: DataFrame) -> DataFrame:
    """Range and counts of an exported curve: points, valid columns, gaps."""
    return trace.groupBy("sample_id").agg(
        F.min("two_theta").alias("x_min"),
        F.max("two_theta").alias("x_max"),
        F.min("intensity").alias("y_min"),
        F.max("intensity").alias("y_max"),
        F.count("intensity").alias("valid_points"),
        (F.count(F.lit(1)) - F.count("intensity")).alias("gap_count"),
    )
