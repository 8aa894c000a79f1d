"""Calibration, conversion and resampling queries."""

from pyspark.sql import functions as F

from latticework.operators import calibrate as C
from latticework.plans import inputs as I
from latticework.plans.inputs import R, oracle
from latticework.plans.registry import r, register

MARKS = """marks AS (SELECT sample_id,
    CASE WHEN sample_id % 13 = 0 THEN [x0, y0, x1] WHEN sample_id % 11 = 0 THEN [x0, y0, x0, y1]
         WHEN sample_id % 7 = 0 THEN [x0, y0, x1, 2000] ELSE [x0, y0, x1, y1] END AS plot_box,
    CASE WHEN sample_id % 5 = 0 THEN 1 ELSE 2 END AS nx,
    CASE WHEN sample_id % 9 = 0 THEN px1 ELSE px2 END AS px2b, px1,
    py1, CASE WHEN sample_id % 10 = 0 THEN py1 ELSE py2 END AS py2b,
    x_v1, CASE WHEN sample_id % 8 = 0 THEN x_v1 ELSE x_v2 END AS x_v2b, y_v1, y_v2,
    CAST(100 + sample_id % 60 * 20 AS INT) AS cx, 400 AS cy,
    sample_id % 4 AS n_legend, sample_id % 3 = 0 AS warped, sample_id % 5 AS n_colour
    FROM calibration)"""


def _marks(spark, folder):
    c = I.calibration(spark, folder)
    s = F.col("sample_id")
    pair = lambda a, b: F.array(F.col(a).cast("double"), F.col(b).cast("double"))
    full = [F.col(n).cast("double") for n in ("x0", "y0", "x1", "y1")]
    box = (
        F.when(s % 13 == 0, F.array(*full[:3]))
        .when(s % 11 == 0, F.array(full[0], full[1], full[0], full[3]))
        .when(s % 7 == 0, F.array(full[0], full[1], full[2], F.lit(2000.0)))
        .otherwise(F.array(*full))
    )
    x_first = F.array(F.col("px1").cast("double"), F.col("py1").cast("double"))
    x_last = F.array(F.when(s % 9 == 0, F.col("px1")).otherwise(F.col("px2")).cast("double"),
                     F.col("py1").cast("double"))
    y_last = F.array(F.col("px1").cast("double"),
                     F.when(s % 10 == 0, F.col("py1")).otherwise(F.col("py2")).cast("double"))
    dots = lambda n: F.when(n > 0, F.array_repeat(F.lit(1), n.cast("int")))
    return c.select(
        "sample_id",
        box.alias("plot_box"),
        F.when(s % 5 == 0, F.array(x_first)).otherwise(F.array(x_first, x_last)).alias("x_axis_points"),
        F.array(F.col("x_v1"), F.when(s % 8 == 0, F.col("x_v1")).otherwise(F.col("x_v2"))).alias("x_axis_values"),
        F.array(pair("px1", "py1"), y_last).alias("y_axis_points"),
        F.array("y_v1", "y_v2").alias("y_axis_values"),
        F.array((100 + s % 60 * 20).cast("double"), F.lit(400.0)).alias("color_sample_point"),
        dots(s % 4).alias("legend_ignore_boxes"),
        F.when(s % 3 == 0, F.array_repeat(F.lit(1), 4)).alias("perspective_corners"),
        dots(s % 5).alias("color_resample_points"),
    )


@register("calibration_rules", "C1", oracle("calibration", MARKS + f"""
    SELECT sample_id, concat_ws('|',
      CASE WHEN len(plot_box) <> 4 THEN '{C.BOX_ARITY}' END,
      CASE WHEN len(plot_box) = 4 AND (plot_box[3] <= plot_box[1] OR plot_box[4] <= plot_box[2])
        THEN '{C.BOX_EMPTY}' END,
      CASE WHEN len(plot_box) = 4 AND (plot_box[1] < 0 OR plot_box[2] < 0 OR plot_box[3] > 1200
        OR plot_box[4] > 900) THEN '{C.BOX_OUTSIDE}' END,
      CASE WHEN nx <> 2 THEN '{C.LENGTH_MISMATCH.format("x")}' END,
      CASE WHEN nx < 2 THEN '{C.TOO_FEW_POINTS.format("x")}' END,
      CASE WHEN nx >= 2 AND abs(px1 - px2b) < 1 THEN '{C.SAME_PIXEL.format("x")}' END,
      CASE WHEN nx >= 2 AND abs(x_v1 - x_v2b) < 1e-12 THEN '{C.SAME_VALUE.format("x")}' END,
      CASE WHEN abs(py1 - py2b) < 1 THEN '{C.SAME_PIXEL.format("y")}' END,
      CASE WHEN abs(y_v1 - y_v2) < 1e-12 THEN '{C.SAME_VALUE.format("y")}' END,
      CASE WHEN len(plot_box) = 4 AND NOT (cx BETWEEN plot_box[1] AND plot_box[3]
        AND cy BETWEEN plot_box[2] AND plot_box[4]) THEN '{C.COLOUR_OUTSIDE}' END) AS errors
    FROM marks"""))
def calibration_rules(spark, folder):
    errors = C.rule_errors(F.lit(1200), F.lit(900))
    return _marks(spark, folder).select("sample_id", F.concat_ws("|", errors).alias("errors"))


@register("click_budget", "C2", oracle("calibration", MARKS + """,
    n AS (SELECT sample_id, 6 + n_legend + CASE WHEN warped THEN 4 ELSE 0 END + n_colour AS clicks
          FROM marks)
    SELECT sample_id, CAST(clicks AS INT) AS clicks, CASE WHEN clicks <= 6 THEN 'normal'
      WHEN clicks <= 7 THEN 'normal_max' WHEN clicks <= 11 THEN 'hard'
      WHEN clicks <= 12 THEN 'hard_max' ELSE 'ux_fail' END AS status FROM n"""))
def click_budget(spark, folder):
    df = _marks(spark, folder).withColumn("clicks", C.click_count())
    return df.select("sample_id", "clicks", C.click_budget(F.col("clicks")).alias("status"))


FITTED = """axes AS (SELECT *, CAST(px1 - x0 AS DOUBLE) AS pa, CAST(px2 - x0 AS DOUBLE) AS pb,
      CAST(py1 - y0 AS DOUBLE) AS qa, CAST(py2 - y0 AS DOUBLE) AS qb FROM calibration),
    slopes AS (SELECT *, (x_v2 - x_v1) / (pb - pa) AS x_scale, (y_v2 - y_v1) / (qb - qa) AS y_scale
      FROM axes),
    maps AS (SELECT *, x_v1 - x_scale * pa AS x_offset, y_v1 - y_scale * qa AS y_offset FROM slopes)"""


@register("axis_fit", "C3 C4 C5", oracle("calibration", FITTED + f""",
    back AS (SELECT *, abs((x_scale * pa + x_offset - x_offset) / x_scale - pa) AS e1,
        abs((x_scale * pb + x_offset - x_offset) / x_scale - pb) AS e2,
        abs((y_scale * qa + y_offset - y_offset) / y_scale - qa) AS e3,
        abs((y_scale * qb + y_offset - y_offset) / y_scale - qb) AS e4 FROM maps)
    SELECT sample_id, {R('x_scale', 8)} AS x_scale, {R('x_offset')} AS x_offset,
      {R('y_scale', 8)} AS y_scale, {R('y_offset', 4)} AS y_offset,
      {R('x_scale * 400 + x_offset')} AS value_at_400,
      {R('(30.0 - x_offset) / x_scale')} AS pixel_at_30,
      {R('(e1 + e2 + e3 + e4) / 4')} AS total_mean_error_px,
      {R('greatest(0, least(1, 1 - (e1 + e2 + e3 + e4) / 12))', 4)} AS calibration_confidence
    FROM back"""))
def axis_fit(spark, folder):
    df = C.roundtrip(C.fit_axes(I.calibration(spark, folder)))
    return df.select(
        "sample_id",
        r("x_scale", 8).alias("x_scale"), r("x_offset").alias("x_offset"),
        r("y_scale", 8).alias("y_scale"), r("y_offset", 4).alias("y_offset"),
        r(C.to_value(F.lit(400.0), "x")).alias("value_at_400"),
        r(C.to_pixel(F.lit(30.0), "x")).alias("pixel_at_30"),
        r("total_mean_error_px").alias("total_mean_error_px"),
        r("calibration_confidence", 4).alias("calibration_confidence"),
    )


NUMERIC = FITTED + f""",
    numeric_trace AS (SELECT t.sample_id, t.col, x_scale * (t.col / 2.0) + x_offset AS two_theta,
      y_scale * (t.y / 2.0) + y_offset AS intensity, t.y FROM trace t JOIN maps USING (sample_id))"""


@register("trace_to_numeric", "C6", oracle("calibration trace", NUMERIC + f"""
    SELECT sample_id, col, {R('two_theta')} AS two_theta, {R('intensity', 4)} AS intensity
    FROM numeric_trace WHERE y IS NOT NULL"""))
def trace_to_numeric(spark, folder):
    maps = C.fit_axes(I.calibration(spark, folder))
    out = C.trace_to_numeric(I.trace(spark, folder), maps, factor=2)
    return out.select("sample_id", "col", r("two_theta").alias("two_theta"),
                      r("intensity", 4).alias("intensity"))


@register("minmax_normalise", "C7", oracle("pattern_points", f"""
    SELECT pattern_id, idx, {R('''CASE WHEN max(intensity) OVER w - min(intensity) OVER w > 1e-12
      THEN (intensity - min(intensity) OVER w) / (max(intensity) OVER w - min(intensity) OVER w) * 100
      END''', 4)} AS intensity_norm
    FROM pattern_points WINDOW w AS (PARTITION BY pattern_id)"""))
def minmax_normalise(spark, folder):
    out = C.minmax_normalise(I.pattern_points(spark, folder), ["pattern_id"])
    return out.select("pattern_id", "idx", r("intensity_norm", 4).alias("intensity_norm"))


@register("plot_scale", "C8", oracle("calibration", f"""
    SELECT sample_id, x1 - x0 + 1 + sample_id % 50 AS plot_w, y1 - y0 + 1 AS plot_h,
      {R('(x1 - x0 + 1 + sample_id % 50) / 950.0')} AS s_w, {R('(y1 - y0 + 1) / 690.0')} AS s_h,
      {R('sqrt((x1 - x0 + 1 + sample_id % 50) / 950.0 * ((y1 - y0 + 1) / 690.0))')} AS s
    FROM calibration"""))
def plot_scale(spark, folder):
    boxes = I.calibration(spark, folder).withColumn("x1", F.col("x1") + F.col("sample_id") % 50)
    return C.plot_scale(boxes).select(
        "sample_id", "plot_w", "plot_h", r("s_w").alias("s_w"), r("s_h").alias("s_h"), r("s").alias("s")
    )


GRID = """grid AS (SELECT pattern_id, k AS idx, 10.0 + k * (31.5 / 149) AS x
      FROM (SELECT DISTINCT pattern_id FROM pattern_points), range(0, 150) g(k)),
    brackets AS (SELECT g.pattern_id, g.idx, g.x, a.two_theta AS x0, a.intensity AS y0,
        b.two_theta AS x1, b.intensity AS y1
      FROM grid g LEFT JOIN pattern_points a ON a.pattern_id = g.pattern_id
          AND a.idx = least(63, CAST(floor((g.x - 10) / 0.5) AS INT))
        LEFT JOIN pattern_points b ON b.pattern_id = g.pattern_id
          AND b.idx = least(63, CAST(floor((g.x - 10) / 0.5) AS INT) + 1)),
    close AS (SELECT *, unnest([CAST(floor((x - 10) / 0.5) AS INT), CAST(floor((x - 10) / 0.5) AS INT) + 1]) AS at FROM grid),
    tops AS (SELECT g.pattern_id, g.idx, max(p.intensity) AS top
      FROM close g JOIN pattern_points p ON p.pattern_id = g.pattern_id AND p.idx = g.at
      WHERE p.two_theta >= greatest(10.0, g.x - 0.5 * 31.5 / 149) AND p.two_theta <= least(41.5, g.x + 0.5 * 31.5 / 149)
      GROUP BY ALL),
    fine AS (SELECT b.pattern_id, b.idx, b.x AS two_theta, greatest(
        CASE WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) / (x1 - x0) * (x - x0) END, top) AS intensity
      FROM brackets b LEFT JOIN tops USING (pattern_id, idx))"""


@register("resample_envelope", "C9 C10", oracle("pattern_points", GRID + f"""
    SELECT pattern_id, CAST(idx AS INT) AS idx, {R('two_theta')} AS two_theta,
      {R('least(greatest(intensity, 1000.0), 200000.0)', 3)} AS intensity FROM fine"""))
def resample_envelope(spark, folder):
    fine = C.resample_envelope(I.pattern_points(spark, folder), 10.0, 41.5, 150)
    clipped = C.clip(F.col("intensity"), F.lit(200000.0), F.lit(1000.0))
    return fine.select("pattern_id", "idx", r("two_theta").alias("two_theta"),
                       r(clipped, 3).alias("intensity"))


@register("export_peaks", "C11", oracle("calibration trace", FITTED + f""",
    peaks AS (SELECT sample_id, col, y, CASE WHEN col % 5 = 0 THEN y + 0.25 END AS refined,
        CASE WHEN col % 10 = 0 THEN y - 1 END AS roi FROM trace WHERE y IS NOT NULL)
    SELECT sample_id, col AS peak_index, {R('x_scale * col + x_offset', 4)} AS two_theta,
      {R('least(greatest(y_scale * coalesce(roi, refined, y) + y_offset, least(y_v1, y_v2)), greatest(y_v1, y_v2))')}
        AS intensity, CAST(y < 10 AS INT) AS is_major
    FROM peaks JOIN maps USING (sample_id)"""))
def export_peaks(spark, folder):
    t = I.trace(spark, folder).where("y IS NOT NULL")
    peaks = t.select(
        "sample_id", F.col("col").alias("index"), F.col("y").alias("y_pixel"),
        F.expr("CASE WHEN col % 5 = 0 THEN y + 0.25D END").alias("y_pixel_refined"),
        F.expr("CASE WHEN col % 10 = 0 THEN y - 1 END").alias("y_pixel_roi_refined"),
    )
    out = C.export_peaks(peaks, peaks.where("y_pixel < 10"), C.fit_axes(I.calibration(spark, folder)))
    return out.select("sample_id", F.col("index").alias("peak_index"), r("two_theta", 4).alias("two_theta"),
                      r("intensity").alias("intensity"), F.col("is_major").cast("int").alias("is_major"))


@register("downscale_trace", "C12", oracle("trace", f"""
    small AS (SELECT DISTINCT sample_id, k AS col, least(k * 3, 63) AS src
      FROM trace, range(0, 25) g(k))
    SELECT s.sample_id, CAST(s.col AS INT) AS col, {R('t.y / 3.0')} AS y
    FROM small s LEFT JOIN trace t ON t.sample_id = s.sample_id AND t.col = s.src"""))
def downscale_trace(spark, folder):
    out = C.downscale(I.trace(spark, folder), 3, 25)
    return out.select("sample_id", "col", r("y").alias("y"))


@register("scale_marks", "C13", oracle("calibration", """
    SELECT sample_id, x0 + 3 * (px2 - x0) AS x_scaled, y0 + 3 * (py1 - y0) AS y_scaled
    FROM calibration"""))
def scale_marks(spark, folder):
    c = I.calibration(spark, folder)
    x, y = C.scale_about_origin(F.col("px2"), F.col("py1"), F.col("x0"), F.col("y0"), 3)
    return c.select("sample_id", x.alias("x_scaled"), y.alias("y_scaled"))


@register("fill_linear", "C14", oracle("trace", f"""
    marks AS (SELECT sample_id, col, y,
        max(CASE WHEN y IS NOT NULL THEN col END) OVER (PARTITION BY sample_id ORDER BY col) AS p,
        min(CASE WHEN y IS NOT NULL THEN col END) OVER (PARTITION BY sample_id ORDER BY col
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM trace)
    SELECT m.sample_id, m.col, {R('''CASE WHEN m.y IS NOT NULL THEN m.y WHEN p IS NULL AND n IS NULL THEN 0
        WHEN p IS NULL THEN b.y WHEN n IS NULL THEN a.y
        ELSE a.y + (b.y - a.y) / (n - p) * (m.col - p) END''')} AS y_filled
    FROM marks m LEFT JOIN trace a ON a.sample_id = m.sample_id AND a.col = m.p
      LEFT JOIN trace b ON b.sample_id = m.sample_id AND b.col = m.n"""))
def fill_linear(spark, folder):
    out = C.fill_linear(I.trace(spark, folder), ["sample_id"], "col", "y")
    return out.select("sample_id", "col", r("y_filled").alias("y_filled"))


@register("export_summary", "C15", oracle("calibration trace", NUMERIC + f"""
    SELECT sample_id, {R('min(CASE WHEN y IS NOT NULL THEN two_theta END)')} AS x_min,
      {R('max(CASE WHEN y IS NOT NULL THEN two_theta END)')} AS x_max,
      {R('min(intensity)', 4)} AS y_min, {R('max(intensity)', 4)} AS y_max,
      count(y) AS valid_points, count(*) - count(y) AS gap_count
    FROM numeric_trace GROUP BY sample_id"""))
def export_summary(spark, folder):
    t = I.trace(spark, folder)
    maps = C.fit_axes(I.calibration(spark, folder))
    numeric = C.trace_to_numeric(t, maps, factor=2).select("sample_id", "col", "two_theta", "intensity")
    full = t.select("sample_id", "col").join(numeric, ["sample_id", "col"], "left").join(
        maps.select("sample_id"), "sample_id", "left_semi"
    )
    s = C.export_summary(full)
    return s.select("sample_id", r("x_min").alias("x_min"), r("x_max").alias("x_max"),
                    r("y_min", 4).alias("y_min"), r("y_max", 4).alias("y_max"),
                    "valid_points", "gap_count")
