"""Scoring recovered curves against ground truth, gates, labels and batch reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.operators.joins import interpolate, nearest
from latticework.operators.scans import CHUNK, chunk_of, dense_index
from latticework.operators.stats import attach, percentiles, summary

# fixed value: stands for a metric that could not be computed; gates read it as failing
NOT_COMPUTABLE = 999.0

MAIN = ["curve_y_mae_px", "major_peak_x_error", "peak_recall", "max_gap_px", "calibration_roundtrip_error",
        "numeric_y_mae_norm", "major_peak_x_error_2theta"]
DEBUG = ["IoU", "valid_ratio", "trace_score", "tail_mae_px", "tail_collapse_rate", "peak_precision", "peak_f1",
         "prominence_preservation", "major_peak_y_error"]
DIAGNOSIS = ["candidate_recall_per_column", "empty_column_rate", "recovery_success_rate", "reentry_count",
             "path_margin_instability"]

# fixed values: acceptance thresholds per level and domain, in the order of MAIN
# (peak_recall must reach its value, all others must stay at or under it)
THRESHOLDS = {
    ("mvp", "clean"): [18.0, 12.0, 0.50, 30.0, 2.0, 0.12, 0.8],
    ("mvp", "styled"): [22.0, 16.0, 0.45, 36.0, 2.5, 0.15, 1.0],
    ("mvp", "real_like"): [28.0, 20.0, 0.35, 44.0, 3.0, 0.20, 1.2],
    ("development", "clean"): [12.0, 8.0, 0.60, 20.0, 1.5, 0.08, 0.4],
    ("development", "styled"): [16.0, 11.0, 0.55, 26.0, 2.0, 0.10, 0.6],
    ("development", "real_like"): [22.0, 16.0, 0.45, 34.0, 2.5, 0.14, 0.8],
    ("strict", "clean"): [5.0, 4.0, 0.70, 10.0, 1.0, 0.04, 0.2],
    ("strict", "styled"): [6.0, 6.0, 0.68, 14.0, 1.8, 0.06, 0.3],
    ("strict", "real_like"): [8.0, 8.0, 0.60, 18.0, 2.5, 0.08, 0.5],
}
# fixed values: what to look at next for a dominating failure
NEXT_ACTION = {
    "tail_collapse": "focus_tail_recovery",
    "candidate_starvation": "focus_candidate_density",
    "grid_confusion": "review_axis_mask_and_color",
    "calibration_mismatch": "review_manual_inputs_calibration",
    "wrong_branch_lock_in": "review_dp_window_and_recovery",
}
PASS_LEVELS = {"strict": 0.60, "development": 0.50, "mvp": 0.30}


def gates(spark: SparkSession) -> DataFrame:
    rows = [(level, domain, metric, ">=" if metric == "peak_recall" else "<=", value)
            for (level, domain), values in THRESHOLDS.items() for metric, value in zip(MAIN, values, strict=True)]
    return spark.createDataFrame(rows, "level string, domain string, metric string, op string, threshold double")


def pixel_mae(result: DataFrame, gt_path: DataFrame, maps: DataFrame, gt_x0: Column, box_y0: Column) -> DataFrame:
    """Mean height difference of result and truth on shared pixel columns.

    ``result``: sample_id, idx, two_theta, intensity. ``gt_path``: sample_id, order_no, x, y;
    the last truth point of a column counts. 999 without a shared column, 0 without truth.
    """
    truth = gt_path.join(maps.select("sample_id", gt_x0.alias("_x0")), "sample_id").withColumn(
        "col", (F.col("x").cast("int") - F.col("_x0")).cast("int"))
    truth = truth.groupBy("sample_id", "col").agg(F.max_by("y", "order_no").alias("gt_y"))
    px = F.when(F.abs("x_scale") > 1e-12, (F.col("two_theta") - F.col("x_offset")) / F.col("x_scale")).otherwise(F.col("idx"))
    py = F.when(F.abs("y_scale") > 1e-12, (F.col("intensity") - F.col("y_offset")) / F.col("y_scale")).otherwise(0.0)
    got = result.join(maps.withColumn("_y0", box_y0), "sample_id").select(
        "sample_id", F.bround(px).cast("int").alias("col"), py.alias("py"), "_y0")
    pairs = got.join(truth, ["sample_id", "col"])
    mae = pairs.groupBy("sample_id").agg(F.avg(F.abs(F.col("py") - (F.col("gt_y") - F.col("_y0")))).alias("_mae"))
    has_truth = truth.select("sample_id").distinct().withColumn("_t", F.lit(True))
    return maps.select("sample_id").join(has_truth, "sample_id", "left").join(mae, "sample_id", "left").select(
        "sample_id", F.when(F.col("_t").isNull(), 0.0).otherwise(F.coalesce("_mae", F.lit(NOT_COMPUTABLE))).alias("curve_y_mae_px"))


def numeric_mae(result: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Interpolated intensity error relative to the truth's range; 999 when not computable."""
    shape = result.groupBy(*keys, "two_theta").agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(
        F.sum("_c").alias("_n"), F.max("_c").alias("_dup"))
    usable = shape.where("_n >= 2 AND _dup = 1").select(*keys)
    ref = result.join(usable, keys, "left_semi")
    both = interpolate(truth, ref, keys, "two_theta", "two_theta", "intensity")
    stat = both.groupBy(*keys).agg(
        F.avg(F.abs(F.col("y_interp") - F.col("intensity"))).alias("_mae"), F.count(F.lit(1)).alias("_m"),
        (F.max("intensity") - F.min("intensity")).alias("_rng"))
    ok = (F.col("_m") >= 2) & (F.col("_rng") >= 1e-8) & F.col("_mae").isNotNull()
    return result.select(*keys).distinct().join(stat, keys, "left").select(
        *keys, F.when(ok, F.col("_mae") / F.greatest("_rng", F.lit(1e-8))).otherwise(NOT_COMPUTABLE).alias("numeric_y_mae_norm"))


def major_peak_error(peaks: DataFrame, truth: DataFrame, keys: list[str], samples: DataFrame) -> DataFrame:
    """Mean distance of major peaks to the nearest true peak, in degrees and in pixels.

    ``samples``: keys and ``px_per_deg``. The height error of the pair is defined as 0.
    """
    near = nearest(peaks.where("is_major"), truth, keys, "two_theta", "two_theta")
    err = near.groupBy(*keys).agg(F.avg("nearest_dist").alias("_e"))
    has = truth.select(*keys).distinct().withColumn("_gt", F.lit(True))
    found = F.col("_e").isNotNull()
    return samples.join(err, keys, "left").join(has, keys, "left").select(
        *keys,
        F.when(F.col("_gt").isNull(), NOT_COMPUTABLE).when(found, F.col("_e")).otherwise(NOT_COMPUTABLE).alias("major_peak_x_error_2theta"),
        F.when(F.col("_gt").isNull(), 0.0).when(found, F.col("_e") * F.col("px_per_deg")).otherwise(NOT_COMPUTABLE).alias("major_peak_x_error"),
        F.when(F.col("_gt").isNotNull() & ~found, NOT_COMPUTABLE).otherwise(0.0).alias("major_peak_y_error"))


def peak_scores(peaks: DataFrame, truth: DataFrame, keys: list[str], samples: DataFrame) -> DataFrame:
    """Precision, recall and F1 with a tolerance of 2 % of the axis range (many to many).

    A band semi-join is the same as a nearest distance within the tolerance, so no
    pairs are built. ``samples``: keys and ``x_range``.
    """
    def hits(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        d = nearest(left, right, keys, "two_theta", "two_theta").join(samples.select(*keys, "x_range"), keys)
        return d.groupBy(*keys).agg(
            F.count_if(F.col("nearest_dist") <= F.col("x_range") * 0.02).alias(f"_{name}"), F.count(F.lit(1)).alias(f"_n_{name}"))

    out = samples.select(*keys).join(hits(peaks, truth, "tp"), keys, "left").join(hits(truth, peaks, "found"), keys, "left")
    no_gt, no_det = F.col("_n_found").isNull(), F.col("_n_tp").isNull()
    share = lambda a, b: F.when(no_gt, 1.0).when(no_det, 0.0).otherwise(F.col(a) / F.col(b))
    out = out.withColumns({"peak_precision": share("_tp", "_n_tp"), "peak_recall": share("_found", "_n_found")})
    p, q = F.col("peak_precision"), F.col("peak_recall")
    return out.select(*keys, "peak_precision", "peak_recall", (2 * p * q / F.greatest(p + q, F.lit(1e-12))).alias("peak_f1"))


def max_gap(gaps: DataFrame, keys: list[str]) -> DataFrame:
    return gaps.groupBy(*keys).agg(F.coalesce(F.max(F.col("gap_end") - F.col("gap_start")), F.lit(0)).alias("max_gap_px"))


def column_iou(truth_cols: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Overlap of the truth's columns with 0 .. total-1; 1 without truth.

    ``samples``: keys and ``total_columns``. Only counts are needed: the traced set is a range.
    """
    cols = truth_cols.select(*keys, "col").distinct().join(samples, keys)
    n = cols.groupBy(*keys).agg(F.count(F.lit(1)).alias("_gt"),
                                F.count_if((F.col("col") >= 0) & (F.col("col") < F.col("total_columns"))).alias("_in"))
    union = F.greatest(F.col("_gt") + F.col("total_columns") - F.col("_in"), F.lit(1))
    return samples.join(n, keys, "left").select(
        *keys, F.when(F.col("_gt").isNull(), 1.0).when(F.col("total_columns") <= 0, 0.0).otherwise(F.col("_in") / union).alias("IoU"))


def tail_collapse(truth: DataFrame, keys: list[str], pos: str = "col") -> DataFrame:
    """1 when the last fifth of the truth hardly moves (range under 3 px)."""
    ranked = dense_index(truth, keys, [pos], chunk_of(pos, CHUNK), "_i")
    n = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    tail = attach(ranked, n, keys).where(F.col("_i") >= F.floor(F.col("_n") * 0.8))
    return tail.groupBy(*keys).agg(
        F.when(F.max("y") - F.min("y") < 3.0, 1.0).otherwise(0.0).alias("tail_collapse_rate"), F.lit(0.0).alias("tail_mae_px"))


def prominence_preservation(peaks: DataFrame, keys: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("prominence")))
    top = peaks.withColumn("_r", rank).where("_r <= 2").groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.col("prominence"))).alias("_a"), F.max(F.when(F.col("_r") == 2, F.col("prominence"))).alias("_b"))
    value = F.when(F.col("_a") < 1, 0.0).when(F.col("_b").isNull(), 1.0).otherwise(
        F.least(F.lit(1.0), F.col("_a") / F.greatest(F.col("_b"), F.lit(1.0)) * 0.5))
    return top.select(*keys, value.alias("prominence_preservation"))


def margin_instability(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Share of blocks with a margin under 1; a missing margin counts half."""
    return blocks.groupBy(*keys).agg(
        ((F.count_if(F.col("margin") < 1.0) + F.count_if(F.col("margin").isNull()) * 0.5) / F.count(F.lit(1))).alias("path_margin_instability"))


def diagnosis(stats: DataFrame, zones: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate coverage, zone recovery and margin stability per sample."""
    z = zones.groupBy(*keys).agg(F.count(F.lit(1)).alias("_z"), F.count_if("resolved").alias("_ok"))
    out = stats.join(z, keys, "left").join(margin_instability(blocks, keys), keys, "left")
    return out.select(
        *keys, (F.col("nonempty_columns") / F.greatest("total_columns", F.lit(1))).alias("candidate_recall_per_column"),
        F.col("missing_column_ratio").alias("empty_column_rate"),
        F.when(F.col("_z") > 0, F.col("_ok") / F.col("_z")).otherwise(1.0).alias("recovery_success_rate"),
        F.coalesce("_z", F.lit(0)).alias("reentry_count"),
        F.coalesce("path_margin_instability", F.lit(0.0)).alias("path_margin_instability"))


def assemble(samples: DataFrame, parts: list[DataFrame], defaults: dict[str, float], digits: dict[str, int], key: str = "sample_id") -> DataFrame:
    """One wide metrics row per sample; absent metrics take their default, each is rounded."""
    out = samples.select(key)
    for part in parts:
        out = out.join(part, key, "left")
    cols = [c for c in out.columns if c != key]
    return out.select(key, *[F.round(F.coalesce(F.col(c).cast("double"), F.lit(defaults.get(c, 0.0))), digits.get(c, 4)).alias(c) for c in cols])


def gt_columns(truth: DataFrame, spine: DataFrame, keys: list[str], height: float) -> DataFrame:
    """Truth height for every column: repeated x averaged, lines in between, clipped."""
    level = truth.groupBy(*keys, "x").agg(F.avg("y").alias("y"))
    out = interpolate(spine.select(*keys, "col"), level, keys, "col", "x", "y", "gt_y")
    return out.where("gt_y IS NOT NULL").withColumn("gt_y", F.least(F.greatest(F.col("gt_y"), F.lit(0.0)), F.lit(height)))


def candidate_proximity(cands: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    """How close the nearest candidate of each column is to the truth."""
    d = cands.join(gt, [*keys, "col"]).groupBy(*keys, "col").agg(F.min(F.abs(F.col("y") - F.col("gt_y"))).alias("dist"))
    share = lambda t: F.avg((F.col("dist") <= t).cast("double"))
    basic = d.groupBy(*keys).agg(
        share(3).alias("recall_px3"), share(5).alias("recall_px5"), share(10).alias("recall_px10"),
        F.avg("dist").alias("mean_dist"), F.count(F.lit(1)).alias("columns_evaluated"))
    return basic.join(percentiles(d, keys, "dist", {"median_dist": 0.5, "p90_dist": 0.9}), keys)


def long_metrics(metrics: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    stack = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)
    return metrics.select(*keep, F.expr(f"stack({len(names)}, {stack}) AS (metric, value)"))


def check_gates(metrics: DataFrame, level: str = "development") -> DataFrame:
    """Verdict of every gate metric per sample.

    Unknown levels mean development, unknown domains clean; a missing metric counts as 0.
    """
    level = level if level in PASS_LEVELS else "development"
    table = gates(metrics.sparkSession).where(F.col("level") == level).drop("level")
    domain = F.when(F.col("domain").isin("clean", "styled", "real_like"), F.col("domain")).otherwise("clean")
    rows = long_metrics(metrics.withColumn("domain", domain), MAIN, ["sample_id", "domain"])
    rows = rows.join(F.broadcast(table), ["domain", "metric"]).withColumn("value", F.coalesce("value", F.lit(0.0)))
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return rows.withColumn("passed", ok)


def gate_verdict(checked: DataFrame) -> DataFrame:
    return checked.groupBy("sample_id", "domain").agg(F.every("passed").alias("passed"), F.count_if(~F.col("passed")).alias("n_failed"))


def flat_thresholds(spark: SparkSession, level: Column, domain: Column, rows: DataFrame) -> DataFrame:
    """Thresholds for the level and domain named in each row; unknown level is strict."""
    known = F.when(level.isin(*PASS_LEVELS), level).otherwise("strict")
    dom = F.when(domain.isin("clean", "styled", "real_like"), domain).otherwise("clean")
    wide = gates(spark).groupBy("level", "domain").pivot("metric", MAIN).agg(F.first("threshold"))
    return rows.withColumns({"level": known, "domain": dom}).join(F.broadcast(wide), ["level", "domain"])


def failure_labels() -> Column:
    """The eight failure labels, in fixed order, of a wide metrics row."""
    c = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    rules = [
        ("candidate_starvation", c("empty_column_rate", 0.0) > 0.05),
        ("wrong_branch_lock_in", c("path_margin_instability", 0.0) > 0.6),
        ("tail_collapse", (c("tail_mae_px", 0.0) > 8.0) | (c("tail_collapse_rate", 0.0) > 0.3)),
        ("calibration_mismatch", c("calibration_roundtrip_error", 0.0) > 1.0),
        ("peak_miss_after_smoothing", (c("peak_f1", 1.0) < 0.5) & (c("peak_recall", 1.0) >= 0.6)),
        ("text_intrusion", (c("IoU", 1.0) < 0.7) & (c("empty_column_rate", 0.0) < 0.03)),
        ("grid_confusion", (c("candidate_recall_per_column", 1.0) > 0.98) & (c("curve_y_mae_px", 0.0) > 10)),
        ("legend_capture", (c("recovery_success_rate", 1.0) < 0.5) & (c("reentry_count", 0) > 0)),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def metric_stats(metrics: DataFrame, names: list[str], groups: list[str] | None = None) -> DataFrame:
    """Mean, population std, median, p10, p90, min, max per metric over the whole batch."""
    groups = groups or []
    return summary(long_metrics(metrics, names, groups), [*groups, "metric"], "value")


def failure_counts(labelled: DataFrame, labels: str = "labels") -> DataFrame:
    return labelled.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def top_failures(counts: DataFrame, n: int = 8) -> DataFrame:
    return counts.orderBy(F.desc("count"), "label").limit(n)


def next_action(label: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in NEXT_ACTION.items() for v in pair])
    return F.when(label.isNull(), "review_low_pass_rate").otherwise(
        F.coalesce(F.try_element_at(table, label), F.lit("review_dominant_failure_taxonomy")))


def improved(base: DataFrame, now: DataFrame, group: list[str]) -> DataFrame:
    """How many core means improved: errors 15 % lower, recall 0.03 higher."""
    b = base.select(*group, "metric", F.col("mean").alias("_b"))
    both = now.select(*group, "metric", F.col("mean").alias("_n")).join(b, [*group, "metric"])
    both = both.where(F.col("metric").isin("curve_y_mae_px", "major_peak_x_error", "peak_recall", "tail_mae_px"))
    better = F.when(F.col("metric") == "peak_recall", F.col("_n") > F.col("_b") + 0.03).otherwise(F.col("_n") < F.col("_b") * 0.85)
    return both.groupBy(*group).agg((F.count_if(better) >= 3).alias("improved"))


def verdict(pass_rate: Column, level: str, is_better: Column) -> Column:
    level = (level or "development").lower()
    out = F.when(F.coalesce(is_better, F.lit(False)), "fail_but_improved").otherwise("fail")
    if level in PASS_LEVELS:
        return F.when(pass_rate >= PASS_LEVELS[level], f"{level}_pass").otherwise(out)
    return out


def batch_report(metrics: DataFrame, level: str, groups: list[str] | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """Summary row per group: sample count, pass rate, verdict, statistics, failures, next step.

    Only aggregates are nested, never the samples, so a row stays small at any batch size.
    """
    groups = groups or []
    all_ = [F.lit(1).alias("_all")]
    names = [c for c in [*MAIN, *DEBUG, *DIAGNOSIS] if c in metrics.columns]
    # the group columns may include the gate domain itself
    verdicts = gate_verdict(check_gates(metrics, level)).select("sample_id", "passed")
    rows = metrics.join(verdicts, "sample_id")
    head = rows.groupBy(*groups, *([] if groups else all_)).agg(F.count(F.lit(1)).alias("num_samples"), F.count_if("passed").alias("pass_count"))
    on = groups or ["_all"]
    head = head.withColumn("pass_rate", F.col("pass_count") / F.col("num_samples"))
    stats = metric_stats(metrics if groups else metrics.withColumn("_all", F.lit(1)), names, on)
    nested = stats.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("metric", "mean", "std", "median", "p10", "p90", "min", "max"))).alias("metric_stats"))
    fails = (metrics if groups else metrics.withColumn("_all", F.lit(1))).select(*on, F.explode(failure_labels()).alias("label")).groupBy(*on, "label").agg(F.count(F.lit(1)).alias("count"))
    tops = fails.groupBy(*on).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), "label", "count"))), 1, 8).alias("top_failures"))
    out = head.join(nested, on, "left").join(tops, on, "left")
    better = F.lit(False)
    if baseline is not None:
        out = out.join(improved(baseline, stats, on), on, "left")
        better = F.col("improved")
    out = out.withColumn("verdict", verdict(F.col("pass_rate"), level, better)).withColumn("gate_level", F.lit(level))
    return out.withColumn("next_action", next_action(F.get("top_failures", F.lit(0))["label"])).drop("_all", "improved")


def report_samples(metrics: DataFrame, level: str) -> DataFrame:
    """One row per sample of a report: whether it passed, the gates it failed and its failure labels."""
    checked = check_gates(metrics, level)
    failed = checked.where(~F.col("passed")).groupBy("sample_id").agg(F.array_sort(F.collect_set("metric")).alias("failed_gates"))
    none = F.array().cast("array<string>")
    out = metrics.withColumn("labels", failure_labels()).join(gate_verdict(checked).select("sample_id", "passed"), "sample_id").join(failed, "sample_id", "left")
    return out.withColumn("failed_gates", F.coalesce("failed_gates", none))


def report_metadata(report: DataFrame, **tags: str | None) -> DataFrame:
    """The report's rows with a map of what is known of the run (None stays absent) and the decision against a baseline."""
    known = [F.lit(x) for name, value in sorted(tags.items()) if value is not None for x in (name, value)]
    meta = F.create_map(*known) if known else F.create_map().cast("map<string,string>")
    better = F.when(F.col("verdict") == "fail_but_improved", "improved").otherwise("unknown")
    return report.withColumn("metadata", F.map_concat(meta, F.create_map(
        F.lit("gate_level"), F.col("gate_level"), F.lit("num_samples"), F.col("num_samples").cast("string")))).withColumn("relative_to_baseline", better)


def report_lines(samples: DataFrame) -> DataFrame:
    """One printable line per sample."""
    labels = F.when(F.size("labels") > 0, F.concat_ws(", ", "labels")).otherwise("-")
    return samples.select("sample_id", F.format_string(
        "    %-20s [%s]  y_mae=%.2f  peak_recall=%.2f  failures=%s", F.col("sample_id").cast("string"),
        F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.col("curve_y_mae_px"), F.col("peak_recall"), labels).alias("line"))
