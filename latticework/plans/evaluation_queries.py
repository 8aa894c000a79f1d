"""Evaluation queries."""

from pyspark.sql import functions as F

from latticework.operators import calibrate as C
from latticework.operators import evaluate as E
from latticework.operators import signal as T
from latticework.plans import inputs as I
from latticework.plans.calibration_queries import FITTED
from latticework.plans.inputs import R, oracle
from latticework.plans.peak_queries import MAXIMA, maxima
from latticework.plans.registry import r, register
from latticework.plans.signal_queries import FILLED

K = ["pattern_id"]
S = ["sample_id"]

PIXEL_GT = FITTED + """, result AS (SELECT t.sample_id, t.col AS idx, x_scale * t.col + x_offset AS two_theta, y_scale * t.y + y_offset AS intensity
      FROM trace t JOIN maps USING (sample_id) WHERE t.y IS NOT NULL),
    gt_path AS (SELECT sample_id, col * 2 + 170 AS x, y + 90 AS y, col AS order_no FROM trace WHERE y IS NOT NULL)"""


@register("curve_mae", "E1", oracle("calibration trace", PIXEL_GT + f""",
    truth AS (SELECT g.sample_id, x - 170 AS col, arg_max(g.y, order_no) AS gt_y FROM gt_path g GROUP BY 1, 2),
    got AS (SELECT sample_id, CAST(round_even((two_theta - x_offset) / x_scale, 0) AS INT) AS col, (intensity - y_offset) / y_scale AS py FROM result JOIN maps USING (sample_id)),
    e AS (SELECT g.sample_id, avg(abs(py - (gt_y - 90))) AS mae FROM got g JOIN truth USING (sample_id, col) GROUP BY 1)
    SELECT m.sample_id, {R('CASE WHEN t.sample_id IS NULL THEN 0 ELSE coalesce(mae, 999.0) END', 4)} AS curve_y_mae_px
    FROM maps m LEFT JOIN (SELECT DISTINCT sample_id FROM truth) t USING (sample_id) LEFT JOIN e USING (sample_id)"""))
def curve_mae(spark, folder):
    maps = C.fit_axes(I.calibration(spark, folder))
    t = I.trace(spark, folder).where("y IS NOT NULL")
    result = t.join(maps, "sample_id").select("sample_id", F.col("col").alias("idx"), C.to_value(F.col("col").cast("double"), "x").alias("two_theta"),
                                              C.to_value(F.col("y"), "y").alias("intensity"))
    gt = t.select("sample_id", F.col("col").alias("order_no"), (F.col("col") * 2 + 170).alias("x"), (F.col("y") + 90).alias("y"))
    out = E.pixel_mae(result, gt, maps.select("sample_id", "x0", "y0", "x_scale", "x_offset", "y_scale", "y_offset"), F.col("x0"), F.col("y0"))
    return out.select("sample_id", r("curve_y_mae_px", 4).alias("curve_y_mae_px"))


@register("numeric_mae", "E2", oracle("pattern_points gt_points", f"""
    near AS (SELECT g.pattern_id, g.intensity AS y, a.intensity AS y0, b.intensity AS y1 FROM gt_points g
      JOIN pattern_points a ON a.pattern_id = g.pattern_id AND a.idx = g.idx LEFT JOIN pattern_points b ON b.pattern_id = g.pattern_id AND b.idx = g.idx + 1),
    s AS (SELECT pattern_id, avg(abs(CASE WHEN y1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * 0.2 END - y)) AS mae, max(y) - min(y) AS rng FROM near GROUP BY 1)
    SELECT pattern_id, {R('coalesce(mae / rng, 999.0)', 5)} AS numeric_y_mae_norm FROM (SELECT DISTINCT pattern_id FROM pattern_points) LEFT JOIN s USING (pattern_id)"""))
def numeric_mae(spark, folder):
    out = E.numeric_mae(I.pattern_points(spark, folder), I.gt_points(spark, folder), K)
    return out.select("pattern_id", r("numeric_y_mae_norm", 5).alias("numeric_y_mae_norm"))


PEAKS = MAXIMA + """, pk AS (SELECT pattern_id, idx, two_theta, intensity, intensity > 250000 AS is_major FROM spaced JOIN pattern_points USING (pattern_id, idx)),
    gt AS (SELECT pattern_id - 1 AS pattern_id, two_theta + 0.1 AS two_theta FROM pk WHERE pattern_id > 0 AND is_major),
    smp AS (SELECT DISTINCT pattern_id FROM pattern_points)"""


def _peaks(spark, folder):
    pk = maxima(spark, folder).select("pattern_id", "idx", "two_theta", "intensity", (F.col("intensity") > 250000).alias("is_major"))
    pk = T.settle(pk)
    gt = pk.where("pattern_id > 0 AND is_major").select((F.col("pattern_id") - 1).alias("pattern_id"), (F.col("two_theta") + 0.1).alias("two_theta"))
    smp = I.table(spark, folder, "embeddings").select(F.col("vec_id").alias("pattern_id"), F.lit(30.0).alias("px_per_deg"), F.lit(31.5).alias("x_range"))
    return pk, gt, smp


@register("major_peak_error", "E3 E4", oracle("pattern_points", PEAKS + f""",
    d AS (SELECT p.pattern_id, p.idx, min(abs(p.two_theta - g.two_theta)) AS d FROM pk p JOIN gt g USING (pattern_id) WHERE is_major GROUP BY 1, 2),
    e AS (SELECT pattern_id, avg(d) AS e FROM d GROUP BY 1)
    SELECT s.pattern_id, {R('coalesce(e, 999.0)')} AS major_peak_x_error_2theta,
      {R('CASE WHEN g.pattern_id IS NULL THEN 0 ELSE coalesce(e * 30, 999.0) END')} AS major_peak_x_error
    FROM smp s LEFT JOIN e USING (pattern_id) LEFT JOIN (SELECT DISTINCT pattern_id FROM gt) g USING (pattern_id)"""))
def major_peak_error(spark, folder):
    pk, gt, smp = _peaks(spark, folder)
    out = E.major_peak_error(pk, gt, K, smp)
    return out.select("pattern_id", r("major_peak_x_error_2theta").alias("major_peak_x_error_2theta"), r("major_peak_x_error").alias("major_peak_x_error"))


@register("peak_prf", "E5 E6", oracle("pattern_points", PEAKS + f""",
    tp AS (SELECT pattern_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM gt g WHERE g.pattern_id = p.pattern_id AND abs(g.two_theta - p.two_theta) <= 0.63)) AS tp FROM pk p GROUP BY 1),
    fn AS (SELECT pattern_id, count(*) AS m, count(*) FILTER (EXISTS (SELECT 1 FROM pk p WHERE p.pattern_id = g.pattern_id AND abs(g.two_theta - p.two_theta) <= 0.63)) AS f FROM gt g GROUP BY 1),
    s AS (SELECT smp.pattern_id, CASE WHEN m IS NULL THEN 1.0 WHEN n IS NULL THEN 0.0 ELSE tp / n END AS p, CASE WHEN m IS NULL THEN 1.0 WHEN n IS NULL THEN 0.0 ELSE f / m END AS q
      FROM smp LEFT JOIN tp USING (pattern_id) LEFT JOIN fn USING (pattern_id))
    SELECT pattern_id, {R('p')} AS peak_precision, {R('q')} AS peak_recall, {R('2 * p * q / greatest(p + q, 1e-12)')} AS peak_f1 FROM s"""))
def peak_prf(spark, folder):
    pk, gt, smp = _peaks(spark, folder)
    out = E.peak_scores(pk, gt, K, smp)
    return out.select("pattern_id", *[r(c).alias(c) for c in ("peak_precision", "peak_recall", "peak_f1")])


@register("max_gap", "E7", oracle("trace", FILLED + """
    SELECT sample_id, coalesce(max(gap_end - gap_start), 0) AS max_gap_px FROM filled GROUP BY 1"""))
def max_gap(spark, folder):
    return E.max_gap(T.gap_fill(I.trace(spark, folder), S), S)


@register("column_iou", "E8", oracle("trace", f"""
    n AS (SELECT sample_id, count(y) AS gt, count(y) FILTER (col < 50 + sample_id % 30) AS i, 50 + sample_id % 30 AS tot FROM trace GROUP BY 1)
    SELECT sample_id, {R('i / CAST(gt + tot - i AS DOUBLE)')} AS "IoU" FROM n"""))
def column_iou(spark, folder):
    t = I.trace(spark, folder)
    smp = t.select("sample_id").distinct().withColumn("total_columns", 50 + F.col("sample_id") % 30)
    return E.column_iou(t.where("y IS NOT NULL"), smp, S).select("sample_id", r("IoU").alias("IoU"))


@register("tail_collapse", "E9", oracle("trace", """
    o AS (SELECT sample_id, y, row_number() OVER (PARTITION BY sample_id ORDER BY col) - 1 AS i, count(*) OVER (PARTITION BY sample_id) AS n FROM trace
      WHERE y IS NOT NULL)
    SELECT sample_id, CASE WHEN max(y) - min(y) < 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS tail_collapse_rate, 0.0::DOUBLE AS tail_mae_px FROM o WHERE i >= floor(n * 0.8) GROUP BY 1"""))
def tail_collapse(spark, folder):
    t = I.trace(spark, folder).where("y IS NOT NULL")
    return E.tail_collapse(t, S)


@register("prominence_preservation", "E10", oracle("pattern_points", PEAKS + f""",
    o AS (SELECT pattern_id, list_sort(list(intensity / 150000), 'DESC') AS p FROM pk GROUP BY 1)
    SELECT pattern_id, {R('CASE WHEN p[1] < 1 THEN 0 WHEN len(p) < 2 THEN 1 ELSE least(1, p[1] / greatest(p[2], 1) * 0.5) END')} AS prominence_preservation FROM o"""))
def prominence_preservation(spark, folder):
    pk, _, _ = _peaks(spark, folder)
    out = E.prominence_preservation(pk.withColumn("prominence", F.col("intensity") / 150000), K)
    return out.select("pattern_id", r("prominence_preservation").alias("prominence_preservation"))


DIAG = """blocks AS (SELECT sample_id, col // 8 AS block, CASE WHEN count(y) < 8 THEN NULL ELSE max(y) - min(y) - 38 END AS margin FROM trace GROUP BY 1, 2),
    zones AS (SELECT sample_id, col % 3 = 0 AS resolved FROM trace WHERE y IS NULL),
    inst AS (SELECT sample_id, (count(*) FILTER (margin < 1) + count(*) FILTER (margin IS NULL) * 0.5) / count(*) AS i FROM blocks GROUP BY 1),
    z AS (SELECT sample_id, count(*) AS z, count(*) FILTER (resolved) AS ok FROM zones GROUP BY 1),
    st AS (SELECT sample_id, count(*) AS n, count(y) AS k FROM trace GROUP BY 1)"""


@register("diagnosis_metrics", "E11 E12", oracle("trace", DIAG + f"""
    SELECT sample_id, {R('k / n')} AS candidate_recall_per_column, {R('(n - k) / n')} AS empty_column_rate,
      {R('CASE WHEN z > 0 THEN ok / z ELSE 1 END')} AS recovery_success_rate, coalesce(z, 0) AS reentry_count, {R('coalesce(i, 0)')} AS path_margin_instability
    FROM st LEFT JOIN z USING (sample_id) LEFT JOIN inst USING (sample_id)"""))
def diagnosis_metrics(spark, folder):
    t = I.trace(spark, folder)
    stats = t.groupBy("sample_id").agg(F.count(F.lit(1)).alias("total_columns"), F.count("y").alias("nonempty_columns"),
                                       ((F.count(F.lit(1)) - F.count("y")) / F.count(F.lit(1))).alias("missing_column_ratio"))
    zones = t.where("y IS NULL").select("sample_id", (F.col("col") % 3 == 0).alias("resolved"))
    blocks = t.groupBy("sample_id", F.floor(F.col("col") / 8)).agg(F.when(F.count("y") >= 8, F.max("y") - F.min("y") - 38).alias("margin"))
    out = E.diagnosis(stats, zones, blocks, S)
    return out.select("sample_id", "reentry_count", *[r(c).alias(c) for c in out.columns if c not in ("sample_id", "reentry_count")])


@register("assemble_metrics", "E13", oracle("trace", FILLED + ", " + DIAG + f""",
    gap AS (SELECT sample_id, max(gap_end - gap_start) AS g FROM filled GROUP BY 1 HAVING max(gap_end - gap_start) IS NOT NULL)
    SELECT s.sample_id, CAST(coalesce(g, 0) AS DOUBLE) AS max_gap_px, {R('i', 4)} AS path_margin_instability FROM st s LEFT JOIN gap USING (sample_id) LEFT JOIN inst USING (sample_id)"""))
def assemble_metrics(spark, folder):
    t = I.trace(spark, folder)
    blocks = t.groupBy("sample_id", F.floor(F.col("col") / 8)).agg(F.when(F.count("y") >= 8, F.max("y") - F.min("y") - 38).alias("margin"))
    parts = [E.max_gap(T.gap_fill(t, S), S), E.margin_instability(blocks, S)]
    return E.assemble(t.select("sample_id").distinct(), parts, {"max_gap_px": 0.0}, {})


GTCOL = """truth AS (SELECT sample_id, col // 3 * 3 AS x, avg(y) AS y FROM trace WHERE y IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT t.sample_id, t.col, (SELECT max(x) FROM truth g WHERE g.sample_id = t.sample_id AND x <= t.col) AS xb,
      (SELECT min(x) FROM truth g WHERE g.sample_id = t.sample_id AND x >= t.col) AS xa FROM trace t),
    gtc AS (SELECT b.sample_id, b.col, least(greatest(CASE WHEN xb IS NULL THEN a.y WHEN xa IS NULL OR xa = xb THEN c.y
        ELSE c.y + (a.y - c.y) / (xa - xb) * (b.col - xb) END, 0), 45.0) AS gt_y
      FROM b LEFT JOIN truth a ON a.sample_id = b.sample_id AND a.x = xa LEFT JOIN truth c ON c.sample_id = b.sample_id AND c.x = xb)"""


def _gt_columns(spark, folder):
    t = I.trace(spark, folder)
    truth = t.where("y IS NOT NULL").select("sample_id", (F.floor(F.col("col") / 3) * 3).alias("x"), "y")
    return E.gt_columns(truth, t, S, 45.0)


@register("gt_columns", "E15", oracle("trace", GTCOL + f" SELECT sample_id, col, {R('gt_y')} AS gt_y FROM gtc"))
def gt_columns(spark, folder):
    return _gt_columns(spark, folder).select("sample_id", "col", r("gt_y").alias("gt_y"))


@register("gt_proximity", "E14", oracle("candidates trace", GTCOL + f""",
    d AS (SELECT c.sample_id, c.col, min(abs(c.y - gt_y)) AS d FROM candidates c JOIN gtc USING (sample_id, col) GROUP BY 1, 2)
    SELECT sample_id, {R('avg(CAST(d <= 3 AS DOUBLE))')} AS recall_px3, {R('avg(CAST(d <= 5 AS DOUBLE))')} AS recall_px5, {R('avg(CAST(d <= 10 AS DOUBLE))')} AS recall_px10,
      {R('avg(d)', 8)} AS mean_dist, {R('median(d)')} AS median_dist, {R('quantile_cont(d, 0.9)')} AS p90_dist, count(*) AS columns_evaluated FROM d GROUP BY 1"""))
def gt_proximity(spark, folder):
    out = E.candidate_proximity(I.candidates(spark, folder), _gt_columns(spark, folder), S)
    return out.select("sample_id", "columns_evaluated", *[r(c, 8 if c == "mean_dist" else 6).alias(c) for c in out.columns if c not in ("sample_id", "columns_evaluated")])


GATES = "gates(level, domain, metric, op, thr) AS (VALUES " + ", ".join(
    f"('{lv}', '{d}', '{m}', '{'>=' if m == 'peak_recall' else '<='}', {v})" for (lv, d), vs in E.THRESHOLDS.items() for m, v in zip(E.MAIN, vs, strict=True)) + ")"
CHECK = GATES + """, longm AS (UNPIVOT (SELECT * FROM metrics) ON """ + ", ".join(E.MAIN) + """ INTO NAME metric VALUE value),
    checked AS (SELECT l.sample_id, l.domain, l.metric, value, thr, CASE op WHEN '>=' THEN value >= thr ELSE value <= thr END AS ok
      FROM longm l JOIN gates g ON g.level = 'LEVEL' AND g.domain = l.domain AND g.metric = l.metric)"""


@register("gate_check", "E16", oracle("metrics", CHECK.replace("LEVEL", "development") + """
    SELECT sample_id, domain, CAST(bool_and(ok) AS INT) AS passed, count(*) FILTER (NOT ok) AS n_failed FROM checked GROUP BY 1, 2"""))
def gate_check(spark, folder):
    out = E.gate_verdict(E.check_gates(I.metrics(spark, folder), "unknown"))
    return out.select("sample_id", "domain", F.col("passed").cast("int").alias("passed"), "n_failed")


@register("gate_thresholds", "E17", oracle("metrics", GATES + """,
    w AS (SELECT sample_id, domain, CASE sample_id % 4 WHEN 0 THEN 'mvp' WHEN 1 THEN 'development' ELSE 'strict' END AS level FROM metrics)
    SELECT sample_id, w.level, w.domain, CAST(max(thr) FILTER (metric = 'peak_recall') AS DOUBLE) AS peak_recall, CAST(max(thr) FILTER (metric = 'curve_y_mae_px') AS DOUBLE) AS curve_y_mae_px
    FROM w JOIN gates g ON g.level = w.level AND g.domain = w.domain GROUP BY 1, 2, 3"""))
def gate_thresholds(spark, folder):
    m = I.metrics(spark, folder).select("sample_id", "domain", F.expr("CASE sample_id % 4 WHEN 0 THEN 'mvp' WHEN 1 THEN 'development' WHEN 2 THEN 'strict' ELSE 'other' END").alias("level"))
    out = E.flat_thresholds(spark, F.col("level"), F.col("domain"), m)
    return out.select("sample_id", "level", "domain", "peak_recall", "curve_y_mae_px")


WIDE = """wide AS (SELECT *, numeric_y_mae_norm AS empty_column_rate, peak_recall AS path_margin_instability, CAST(sample_id % 3 = 0 AS INT) AS tail_collapse_rate,
      numeric_y_mae_norm * 10 AS peak_f1, peak_recall + 0.3 AS "IoU", 0.97 + numeric_y_mae_norm / 2 AS candidate_recall_per_column, peak_recall AS recovery_success_rate,
      sample_id % 5 AS reentry_count FROM metrics),
    labelled AS (SELECT *, list_filter([CASE WHEN empty_column_rate > 0.05 THEN 'candidate_starvation' END, CASE WHEN path_margin_instability > 0.6 THEN 'wrong_branch_lock_in' END,
      CASE WHEN tail_collapse_rate > 0.3 THEN 'tail_collapse' END, CASE WHEN calibration_roundtrip_error > 1 THEN 'calibration_mismatch' END,
      CASE WHEN peak_f1 < 0.5 AND peak_recall >= 0.6 THEN 'peak_miss_after_smoothing' END, CASE WHEN "IoU" < 0.7 AND empty_column_rate < 0.03 THEN 'text_intrusion' END,
      CASE WHEN candidate_recall_per_column > 0.98 AND curve_y_mae_px > 10 THEN 'grid_confusion' END,
      CASE WHEN recovery_success_rate < 0.5 AND reentry_count > 0 THEN 'legend_capture' END], lambda x: x IS NOT NULL) AS labels FROM wide)"""


def _wide(spark, folder):
    m, s = I.metrics(spark, folder), F.col("sample_id")
    n, p = F.col("numeric_y_mae_norm"), F.col("peak_recall")
    return m.withColumns({
        "empty_column_rate": n, "path_margin_instability": p, "tail_collapse_rate": (s % 3 == 0).cast("int").cast("double"), "tail_mae_px": F.lit(0.0),
        "peak_f1": n * 10, "IoU": p + 0.3, "candidate_recall_per_column": 0.97 + n / 2, "recovery_success_rate": p, "reentry_count": s % 5})


@register("failure_labels", "E18", oracle("metrics", WIDE + " SELECT sample_id, array_to_string(labels, ',') AS labels FROM labelled"))
def failure_labels(spark, folder):
    return _wide(spark, folder).select("sample_id", F.concat_ws(",", E.failure_labels()).alias("labels"))


@register("metric_stats", "E20 E21", oracle("metrics", CHECK.replace("LEVEL", "mvp") + f"""
    SELECT metric, {R('avg(value)', 5)} AS mean, {R('stddev_pop(value)', 5)} AS std, {R('median(value)', 5)} AS median, {R('quantile_cont(value, 0.1)', 5)} AS p10,
      {R('quantile_cont(value, 0.9)', 5)} AS p90, {R('min(value)', 5)} AS min, {R('max(value)', 5)} AS max, count(*) AS n FROM longm GROUP BY 1"""))
def metric_stats(spark, folder):
    out = E.metric_stats(I.metrics(spark, folder), E.MAIN)
    return out.select("metric", "n", *[r(c, 5).alias(c) for c in ("mean", "std", "median", "p10", "p90", "min", "max")])


@register("failure_counts", "E21 E22", oracle("metrics", WIDE + """,
    c AS (SELECT label, count(*) AS count FROM (SELECT unnest(labels) AS label FROM labelled) GROUP BY 1)
    SELECT label, count, CASE label WHEN 'tail_collapse' THEN 'focus_tail_recovery' WHEN 'candidate_starvation' THEN 'focus_candidate_density' WHEN 'grid_confusion' THEN 'review_axis_mask_and_color'
      WHEN 'calibration_mismatch' THEN 'review_manual_inputs_calibration' WHEN 'wrong_branch_lock_in' THEN 'review_dp_window_and_recovery' ELSE 'review_dominant_failure_taxonomy' END AS action
    FROM c ORDER BY count DESC, label LIMIT 8"""))
def failure_counts(spark, folder):
    counts = E.failure_counts(_wide(spark, folder).withColumn("labels", E.failure_labels()))
    return E.top_failures(counts).withColumn("action", E.next_action(F.col("label")))


@register("batch_verdict", "E19 E23", oracle("metrics", CHECK.replace("LEVEL", "mvp") + f""",
    v AS (SELECT sample_id, domain, bool_and(ok) AS passed FROM checked GROUP BY 1, 2),
    st AS (SELECT domain, count(*) AS n, count(*) FILTER (passed) AS k FROM v GROUP BY 1),
    cur AS (SELECT domain, metric, avg(value) AS mean FROM longm GROUP BY 1, 2),
    better AS (SELECT domain, count(*) FILTER (CASE metric WHEN 'peak_recall' THEN mean > mean * 0.9 + 0.03 ELSE mean < mean * 1.2 * 0.85 END) >= 3 AS up FROM cur
      WHERE metric IN ('curve_y_mae_px', 'major_peak_x_error', 'peak_recall') GROUP BY 1)
    SELECT domain, n AS num_samples, k AS pass_count, {R('k / n')} AS pass_rate, CASE WHEN k / n >= 0.30 THEN 'mvp_pass' WHEN up THEN 'fail_but_improved' ELSE 'fail' END AS verdict
    FROM st JOIN better USING (domain)"""))
def batch_verdict(spark, folder):
    m = _wide(spark, folder)
    factor = F.when(F.col("metric") == "peak_recall", 0.9).otherwise(1.2)
    base = E.metric_stats(m, E.MAIN, ["domain"]).withColumn("mean", F.col("mean") * factor)
    out = E.batch_report(m, "mvp", ["domain"], base)
    return out.select("domain", "num_samples", "pass_count", r("pass_rate").alias("pass_rate"), "verdict")


@register("report_lines", "E24", oracle("metrics", WIDE + ", " + CHECK.replace("LEVEL", "mvp") + """,
    v AS (SELECT sample_id, bool_and(ok) AS passed FROM checked GROUP BY 1)
    SELECT sample_id, printf('    %-20s [%s]  y_mae=%.2f  peak_recall=%.2f  failures=%s', sample_id::VARCHAR, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END,
      curve_y_mae_px + 0.001, peak_recall + 0.0001, CASE WHEN len(labels) > 0 THEN array_to_string(labels, ', ') ELSE '-' END) AS line FROM labelled JOIN v USING (sample_id)"""))
def report_lines(spark, folder):
    m = _wide(spark, folder).withColumn("labels", E.failure_labels())
    v = E.gate_verdict(E.check_gates(m, "mvp")).select("sample_id", "passed")
    # shifted off exact half cents so that both engines print the same digits
    return E.report_lines(m.join(v, "sample_id").withColumns({"curve_y_mae_px": F.col("curve_y_mae_px") + 0.001, "peak_recall": F.col("peak_recall") + 0.0001}))


@register("report_samples", "E23", oracle("metrics", WIDE + ", " + CHECK.replace("LEVEL", "mvp") + """,
    v AS (SELECT sample_id, bool_and(ok) AS passed, string_agg(metric, ',' ORDER BY metric) FILTER (NOT ok) AS failed FROM checked GROUP BY 1)
    SELECT sample_id, domain, passed, coalesce(failed, '') AS failed_gates, array_to_string(labels, ',') AS labels FROM labelled JOIN v USING (sample_id)"""))
def report_samples(spark, folder):
    out = E.report_samples(_wide(spark, folder), "mvp")
    return out.select("sample_id", "domain", "passed", F.array_join("failed_gates", ",").alias("failed_gates"), F.array_join("labels", ",").alias("labels"))


@register("report_metadata", "E23", oracle("metrics", """
    SELECT domain, 'nightly' AS run_tag, 'mvp' AS gate_level, CAST(count(*) AS VARCHAR) AS num_samples, CAST(NULL AS VARCHAR) AS commit, 'unknown' AS relative_to_baseline FROM metrics GROUP BY 1"""))
def report_metadata(spark, folder):
    out = E.report_metadata(E.batch_report(_wide(spark, folder), "mvp", ["domain"]), run_tag="nightly", git_commit=None)
    said = lambda name: F.col("metadata").getItem(name).alias(name)
    return out.select("domain", said("run_tag"), said("gate_level"), said("num_samples"), F.col("metadata").getItem("git_commit").alias("commit"), "relative_to_baseline")
