"""Trace cleaning and smoothing queries."""

from pyspark.sql import functions as F

from latticework.operators import signal as T
from latticework.operators.scans import CHUNK, chunk_of, dense_index
from latticework.plans import inputs as I
from latticework.plans.inputs import R, oracle
from latticework.plans.registry import r, register

S = ["sample_id"]
P = ["pattern_id"]

FILLED = """edges AS (SELECT sample_id, col, y,
      max(CASE WHEN y IS NOT NULL THEN col END) OVER (PARTITION BY sample_id ORDER BY col) AS p,
      min(CASE WHEN y IS NOT NULL THEN col END) OVER (PARTITION BY sample_id ORDER BY col
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM trace),
    gaps AS (SELECT e.sample_id, e.col, e.y, a.y AS ya, b.y AS yb,
      coalesce(p + 1, 0) AS gs, coalesce(n, 64) AS ge
      FROM edges e LEFT JOIN trace a ON a.sample_id = e.sample_id AND a.col = e.p
        LEFT JOIN trace b ON b.sample_id = e.sample_id AND b.col = e.n),
    filled AS (SELECT sample_id, col, y, CASE WHEN y IS NOT NULL THEN y WHEN ge - gs > 10 THEN NULL
      WHEN ya IS NOT NULL AND yb IS NOT NULL
        THEN ya + (col - gs + 1) / CAST(ge - gs + 1 AS DOUBLE) * (yb - ya)
      ELSE coalesce(ya, yb) END AS y_filled,
      CASE WHEN y IS NULL AND ge - gs <= 10 AND coalesce(ya, yb) IS NOT NULL THEN gs END AS gap_start,
      CASE WHEN y IS NULL AND ge - gs <= 10 AND coalesce(ya, yb) IS NOT NULL THEN ge END AS gap_end
      FROM gaps)"""


@register("gap_fill", "T1", oracle("trace", FILLED + f"""
    SELECT sample_id, col, {R('y_filled')} AS y_filled, gap_start, gap_end FROM filled"""))
def gap_fill(spark, folder):
    out = T.gap_fill(I.trace(spark, folder), S)
    return out.select("sample_id", "col", r("y_filled").alias("y_filled"), "gap_start", "gap_end")


@register("plateau_removal", "T2 K25", oracle("trace", """
    flagged AS (SELECT sample_id, col, y, coalesce(y < 40, false) AS low FROM trace),
    grouped AS (SELECT *, col - row_number() OVER (PARTITION BY sample_id, low ORDER BY col) AS grp
      FROM flagged),
    sized AS (SELECT *, count(*) OVER (PARTITION BY sample_id, low, grp) AS width,
      min(col) OVER (PARTITION BY sample_id, low, grp) AS c0,
      max(col) OVER (PARTITION BY sample_id, low, grp) AS c1 FROM grouped)
    SELECT sample_id, col, CASE WHEN (low AND (c0 = 0 OR c1 = 63 OR width > 10)) OR col < 12 OR col > 51
      THEN NULL ELSE y END AS y_clean FROM sized"""))
def plateau_removal(spark, folder):
    out = T.plateau_removal(I.trace(spark, folder), S, height=800, width=64)
    return out.select("sample_id", "col", "y_clean")


THRESHOLDS = """steps AS (SELECT sample_id, abs(y - lag(y) OVER (PARTITION BY sample_id ORDER BY col)) AS step
      FROM trace),
    noise AS (SELECT sample_id, median(step) AS m FROM steps GROUP BY 1),
    spans AS (SELECT sample_id, count(y) AS n_valid, quantile_cont(y, 0.96) - quantile_cont(y, 0.04) AS sp
      FROM trace GROUP BY 1),
    base AS (SELECT sample_id, n_valid, coalesce(greatest(m, 1e-6), 1.0) AS step,
      CASE WHEN n_valid >= 4 THEN greatest(sp, 1e-6) ELSE 1.0 END AS span FROM spans JOIN noise USING (sample_id)),
    scaled AS (SELECT *, greatest(step, 0.0035 * span, 0.20) AS scale FROM base),
    thr AS (SELECT *, CAST(least(greatest(round_even(0.012 * greatest(n_valid, 12), 0), 4), 10) AS INT) AS radius,
      greatest(1.28 * scale, 0.0016 * span, 0.38) AS mp, greatest(0.28 * scale, 0.08) AS ml,
      least(greatest(6.5, 5.0 * scale), 20.0) AS spike FROM scaled)"""


@register("fidelity_thresholds", "T4", oracle("trace", THRESHOLDS + f"""
    SELECT sample_id, n_valid, radius, {R('step')} AS step_median_abs, {R('span')} AS span_robust_px,
      {R('scale')} AS continuity_scale_px, {R('mp')} AS min_prominence_px, {R('ml')} AS min_lift_px,
      {R('spike')} AS spike_delta_px FROM thr"""))
def fidelity_thresholds(spark, folder):
    t = T.fidelity_thresholds(I.trace(spark, folder), S)
    names = ["step_median_abs", "span_robust_px", "continuity_scale_px", "min_prominence_px",
             "min_lift_px", "spike_delta_px"]
    return t.select("sample_id", "n_valid", "radius", *[r(c).alias(c) for c in names])


@register("spike_repair", "T3", oracle("trace", THRESHOLDS + f""",
    near AS (SELECT t.sample_id, t.col, y, lead(y) OVER (PARTITION BY t.sample_id ORDER BY t.col) AS nxt,
      least(spike, 6.5) AS d FROM trace t JOIN thr USING (sample_id)),
    walk AS (SELECT sample_id, col, y AS y_repaired FROM near WHERE col = 0
      UNION ALL
      SELECT n.sample_id, n.col, CASE WHEN n.y > w.y_repaired + n.d AND n.y > n.nxt + n.d
        THEN 0.5 * (w.y_repaired + n.nxt) ELSE n.y END
      FROM walk w JOIN near n ON n.sample_id = w.sample_id AND n.col = w.col + 1)
    SELECT sample_id, col, {R('y_repaired')} AS y_repaired FROM walk"""))
def spike_repair(spark, folder):
    t = I.trace(spark, folder)
    delta = T.fidelity_thresholds(t, S).withColumn(
        "spike_delta_px", F.least(F.col("spike_delta_px"), F.lit(6.5)))
    out = T.spike_repair(t, S, delta)
    return out.select("sample_id", "col", r("y_repaired").alias("y_repaired"))


def _sg_sql(width: int, y: str, n: str, p: str, part: str, order: str) -> str:
    """Weighted sums of the neighbouring rows, ends from the outermost full window."""
    def read(at):
        terms = [
            f"({c!r}) * coalesce(lead({y}, {j - at}) OVER (PARTITION BY {part} ORDER BY {order}), 0)"
            for j, c in enumerate(T.sg_weights(width, 2, at))
        ]
        return "(" + " + ".join(terms) + ")"

    half = width // 2
    cases = "".join(
        f" WHEN {p} = {k} THEN {read(k)} WHEN {p} = {n} - 1 - {k} THEN {read(width - 1 - k)}"
        for k in range(half)
    )
    return f"CASE{cases} ELSE {read(half)} END"


VALID = """valid AS (SELECT sample_id, col, y, row_number() OVER (PARTITION BY sample_id ORDER BY col) - 1 AS p,
      count(*) OVER (PARTITION BY sample_id) AS n FROM trace WHERE y IS NOT NULL)"""
SG9 = _sg_sql(9, "y", "n", "p", "sample_id", "col")
SG5 = _sg_sql(5, "y", "n", "p", "sample_id", "col")


@register("sg_smooth", "T5", oracle("trace", VALID + f"""
    SELECT sample_id, col, {R(SG9)} AS y_curve, {R(SG5)} AS y_peak FROM valid"""))
def sg_smooth(spark, folder):
    t = I.trace(spark, folder)
    out = T.sg_on_valid(t, S, 9, name="y_curve")
    out = T.savitzky_golay(out, S, "_seq", "y", 5, "y_peak")
    return out.select("sample_id", "col", r("y_curve").alias("y_curve"), r("y_peak").alias("y_peak"))


SMOOTH = VALID + f""", smooth AS (SELECT sample_id, col, y, CASE WHEN n < 5 THEN y ELSE least(y, {SG5}) END AS y_smooth
      FROM valid)"""


@register("default_smooth", "T6 T7", oracle("trace", SMOOTH + f"""
    SELECT sample_id, col, {R('y_smooth')} AS y_smooth FROM smooth"""))
def default_smooth(spark, folder):
    out = T.default_smooth(I.trace(spark, folder), S)
    return out.select("sample_id", "col", r("y_smooth").alias("y_smooth"))


@register("restore_peaks", "T8", oracle("trace", THRESHOLDS + "," + VALID + f""",
    curve AS (SELECT sample_id, col, y AS f, {SG5} AS s FROM valid),
    local AS (SELECT c.sample_id, c.col, c.f, c.s, t.mp, t.ml,
        min(o.f) AS lo, max(CASE WHEN o.col < c.col THEN o.f END) AS lmax,
        max(CASE WHEN o.col > c.col THEN o.f END) AS rmax
      FROM curve c JOIN thr t USING (sample_id)
        JOIN curve o ON o.sample_id = c.sample_id AND o.col BETWEEN c.col - t.radius AND c.col + t.radius
      GROUP BY ALL)
    SELECT sample_id, col, {R('''CASE WHEN f <= lo + 1e-9 AND lmax IS NOT NULL AND rmax IS NOT NULL
      AND greatest(lmax, rmax) - f >= mp AND s > f + ml THEN f ELSE s END''')} AS y_restored FROM local"""))
def restore_peaks(spark, folder):
    t = I.trace(spark, folder)
    curve = T.sg_on_valid(t, S, 5).withColumnRenamed("y", "y_filled")
    out = T.restore_peaks(curve, S, T.fidelity_thresholds(t, S))
    return out.select("sample_id", "col", r("y_restored").alias("y_restored"))


@register("curvature_blend", "T9", oracle("trace", SMOOTH + f""",
    whole AS (SELECT t.sample_id, t.col, t.y, s.y_smooth FROM trace t LEFT JOIN smooth s USING (sample_id, col)),
    bends AS (SELECT *, abs(lag(y) OVER w - 2 * y + lead(y) OVER w) AS d2 FROM whole
      WINDOW w AS (PARTITION BY sample_id ORDER BY col)),
    q AS (SELECT sample_id, quantile_cont(d2, 0.95) AS q95 FROM bends WHERE d2 > 0 GROUP BY 1),
    shares AS (SELECT *, 0.32 * pow(least(1.0, coalesce(d2, 0) / q95), 1.15) AS b FROM bends LEFT JOIN q USING (sample_id))
    SELECT sample_id, col, {R('CASE WHEN q95 >= 1e-9 THEN (1 - b) * y_smooth + b * y ELSE y_smooth END')} AS y_blend
    FROM shares"""))
def curvature_blend(spark, folder):
    t = I.trace(spark, folder)
    s = T.default_smooth(t, S).select("sample_id", "col", "y_smooth")
    whole = t.join(s, ["sample_id", "col"], "left").withColumnRenamed("y", "y_filled")
    out = T.curvature_blend(whole, S)
    return out.select("sample_id", "col", r("y_blend").alias("y_blend"))


SG_RUN = _sg_sql(5, "y", "len", "k", "sample_id, grp", "col")


@register("gated_smooth", "T10", oracle("trace", VALID + f""",
    calm AS (SELECT sample_id, col, y, n, abs(lead(y) OVER w - 2 * y + lag(y) OVER w) AS bend,
        min(y) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS lmin,
        min(y) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS rmin,
        max(y) OVER (PARTITION BY sample_id) - min(y) OVER (PARTITION BY sample_id) + 1e-6 AS rng
      FROM valid WINDOW w AS (PARTITION BY sample_id ORDER BY col)),
    gates AS (SELECT t.sample_id, t.col, t.y, CAST(coalesce(bend < 30 AND n >= 5
        AND greatest(0, c.y - 0.5 * (lmin + rmin)) / rng < 0.9, false) AS INT) AS gate
      FROM trace t LEFT JOIN calm c USING (sample_id, col)),
    grouped AS (SELECT *, col - row_number() OVER (PARTITION BY sample_id, gate ORDER BY col) AS grp0 FROM gates),
    stretch AS (SELECT *, grp0 AS grp, row_number() OVER (PARTITION BY sample_id, grp0 ORDER BY col) - 1 AS k,
        count(*) OVER (PARTITION BY sample_id, grp0) AS len FROM grouped WHERE gate = 1),
    sm AS (SELECT sample_id, col, y, k, len, {SG_RUN} AS sg FROM stretch),
    mixed AS (SELECT sample_id, col, (1 - a) * y + a * sg AS y_new FROM (SELECT *, CASE WHEN k < 2 THEN (k + 1) / 3.0
        WHEN k >= len - 2 THEN (len - k) / 3.0 ELSE 1.0 END AS a FROM sm WHERE len >= 5))
    SELECT g.sample_id, g.col, gate, {R('coalesce(y_new, y)')} AS y_gated
    FROM gates g LEFT JOIN mixed m USING (sample_id, col)"""))
def gated_smooth(spark, folder):
    out = T.gated_smooth(I.trace(spark, folder), S, 64, max_curvature=30.0, max_prominence=0.9)
    return out.select("sample_id", "col", "gate", r("y_gated").alias("y_gated"))


KERNEL = """smoothed AS (SELECT pattern_id, idx, two_theta, intensity,
      CASE WHEN count(*) OVER (PARTITION BY pattern_id) < 5 THEN intensity ELSE
      coalesce(lag(intensity, 2) OVER w, lag(intensity) OVER w, intensity) * (3.0 / 15)
      + coalesce(lag(intensity) OVER w, intensity) * (1.0 / 15) + intensity * (1.0 / 15)
      + coalesce(lead(intensity) OVER w, intensity) * (3.0 / 15)
      + coalesce(lead(intensity, 2) OVER w, lead(intensity) OVER w, intensity) * (7.0 / 15) END AS smoothed
      FROM pattern_points WINDOW w AS (PARTITION BY pattern_id ORDER BY idx))"""


@register("analyzer_smooth", "T11", oracle("pattern_points", KERNEL + f"""
    SELECT pattern_id, idx, {R('smoothed', 3)} AS smoothed FROM smoothed"""))
def analyzer_smooth(spark, folder):
    out = T.kernel_smooth(I.pattern_points(spark, folder), P)
    return out.select("pattern_id", "idx", r("smoothed", 3).alias("smoothed"))


@register("derivatives", "T12", oracle("pattern_points", f"""
    SELECT pattern_id, idx, CASE idx WHEN 0 THEN lead(i) OVER w - i WHEN 63 THEN i - lag(i) OVER w
        ELSE (lead(i) OVER w - lag(i) OVER w) / 2 END AS d1,
      CASE idx WHEN 0 THEN lead(i, 2) OVER w - 2 * lead(i) OVER w + i
        WHEN 63 THEN i - 2 * lag(i) OVER w + lag(i, 2) OVER w
        ELSE lead(i) OVER w - 2 * i + lag(i) OVER w END AS d2
    FROM (SELECT pattern_id, idx, intensity AS i FROM pattern_points)
    WINDOW w AS (PARTITION BY pattern_id ORDER BY idx)"""))
def derivatives(spark, folder):
    return T.derivatives(I.pattern_points(spark, folder), P).select("pattern_id", "idx", "d1", "d2")


@register("rolling_median_iqr", "T13", oracle("trace", f"""
    SELECT sample_id, col, {R('median(y) OVER w')} AS roll_median, {R('''CASE WHEN count(y) OVER w >= 4
      THEN quantile_cont(y, 0.75) OVER w - quantile_cont(y, 0.25) OVER w ELSE stddev_pop(y) OVER w END''')} AS roll_iqr
    FROM trace WINDOW w AS (PARTITION BY sample_id ORDER BY col ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"""))
def rolling_median_iqr(spark, folder):
    out = T.rolling_median_iqr(I.trace(spark, folder), S, 11)
    return out.select("sample_id", "col", r("roll_median").alias("roll_median"), r("roll_iqr").alias("roll_iqr"))


@register("robust_sigma", "T14", oracle("event_series", f"""
    med AS (SELECT pattern_id, median(intensity) AS m, stddev_pop(intensity) AS sd FROM event_series GROUP BY 1),
    dev AS (SELECT pattern_id, m, sd, median(abs(intensity - m)) AS mad FROM event_series JOIN med USING (pattern_id)
      GROUP BY ALL),
    sig AS (SELECT pattern_id, m, mad, CASE WHEN 1.4826 * mad < 1e-6 THEN sd ELSE 1.4826 * mad END AS s FROM dev)
    SELECT pattern_id, {R('m')} AS median, {R('mad')} AS mad, {R('CASE WHEN s > 1e-9 THEN s ELSE 1.0 END')} AS sigma
    FROM sig"""))
def robust_sigma(spark, folder):
    out = T.robust_sigma(I.event_series(spark, folder), P, "intensity")
    return out.select("pattern_id", r("median").alias("median"), r("mad").alias("mad"), r("sigma").alias("sigma"))


@register("slope_curvature", "T15", oracle("event_series", f"""
    one AS (SELECT pattern_id, idx, CASE WHEN lag(intensity) OVER w IS NULL THEN lead(intensity) OVER w - intensity
        WHEN lead(intensity) OVER w IS NULL THEN intensity - lag(intensity) OVER w
        ELSE (lead(intensity) OVER w - lag(intensity) OVER w) / 2 END AS slope
      FROM event_series WINDOW w AS (PARTITION BY pattern_id ORDER BY idx)),
    two AS (SELECT pattern_id, idx, slope, CASE WHEN lag(slope) OVER w IS NULL THEN lead(slope) OVER w - slope
        WHEN lead(slope) OVER w IS NULL THEN slope - lag(slope) OVER w
        ELSE (lead(slope) OVER w - lag(slope) OVER w) / 2 END AS curvature
      FROM one WINDOW w AS (PARTITION BY pattern_id ORDER BY idx))
    SELECT pattern_id, idx, {R('slope', 5)} AS slope, {R('curvature', 5)} AS curvature FROM two"""))
def slope_curvature(spark, folder):
    one = T.gradient(I.event_series(spark, folder), P, "idx", "intensity", "slope")
    two = T.gradient(one, P, "idx", "slope", "curvature")
    return two.select("pattern_id", "idx", r("slope", 5).alias("slope"), r("curvature", 5).alias("curvature"))


NOISE = """diffs AS (SELECT pattern_id, idx, intensity - lag(intensity) OVER (PARTITION BY pattern_id ORDER BY idx) AS d,
      count(*) OVER (PARTITION BY pattern_id) AS n FROM event_series),
    wins AS (SELECT pattern_id, k, stddev_pop(d) AS sd FROM diffs, range(0, 100000) g(k)
      WHERE d IS NOT NULL AND k * 15 + 30 <= n AND idx BETWEEN k * 15 + 1 AND k * 15 + 29
        AND k <= idx / 15 GROUP BY ALL),
    whole AS (SELECT pattern_id, n, stddev_pop(d) AS sd FROM diffs GROUP BY ALL),
    noise AS (SELECT w.pattern_id, w.n, coalesce(CASE WHEN w.n >= 30 THEN median(x.sd) WHEN w.n > 2 THEN w.sd END, 0) AS noise
      FROM whole w LEFT JOIN wins x USING (pattern_id) GROUP BY w.pattern_id, w.n, w.sd)"""


@register("local_noise", "T16", oracle("event_series", NOISE.replace(
    "FROM diffs, range(0, 100000) g(k)",
    "FROM (SELECT *, unnest(range(greatest(0, idx // 15 - 2), idx // 15 + 1)) AS k FROM diffs)") + f"""
    SELECT pattern_id, n, {R('noise')} AS noise FROM noise"""))
def local_noise(spark, folder):
    out = T.local_noise(I.event_series(spark, folder), P)
    return out.select("pattern_id", "n", r("noise").alias("noise"))


@register("smoothed_hint", "T17", oracle("candidates trace", f"""
    level AS (SELECT sample_id, col, median(y) AS level FROM candidates WHERE source = 'skeleton' GROUP BY 1, 2)
    SELECT sample_id, col, {R('level')} AS level, {R('''median(level) OVER (PARTITION BY sample_id ORDER BY col
      ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)''')} AS hint
    FROM trace LEFT JOIN level USING (sample_id, col)"""))
def smoothed_hint(spark, folder):
    skeleton = I.candidates(spark, folder).where("source = 'skeleton'")
    out = T.smoothed_hint(skeleton, I.trace(spark, folder), S)
    return out.select("sample_id", "col", r("level").alias("level"), r("hint").alias("hint"))
