"""Scored alternatives per column: confidence, ranking, quotas, filling and merging.

Columns of one sample can hold any number of raw alternatives, so counts and extremes
are aggregated first and joined back, and every selection is a ranked top-k (which
Spark prunes before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.scans import core, halo, ordered, sessions
from latticework.operators.stats import percentiles
from latticework.session import settle

# fixed values of candidate scoring and selection
MIN_CONFIDENCE = 0.25
KEEP_FILTERED, KEEP_FINAL = 16, 8
ENVELOPE_COUNT, ENVELOPE_SPAN, ENVELOPE_BONUS, ENVELOPE_DECAY = 8, 4, 0.35, 6.0
HINT_BONUS, HINT_DECAY = 0.16, 11.0
RIDGE_WEIGHT = 0.10

SC = ["sample_id", "col"]


def confidence_terms(prev_y: Column, ridge: Column | None = None) -> dict[str, Column]:
    """Weighted parts of the confidence of a candidate row."""
    continuity = F.when(prev_y.isNull(), 1.0).otherwise(F.exp(-F.abs(F.col("y") - prev_y) / 8.0))
    terms = {
        "w_color": 0.35 * F.exp(-F.col("color_dist") / 20.0),
        "w_continuity": 0.25 * continuity,
        "w_component": 0.20 / (1.0 + F.exp(-0.8 * (F.col("comp_score") - 2.0))),
        "w_axis": 0.20 * (1.0 - F.exp(-F.col("axis_dist") / 6.0)),
    }
    terms["w_ridge"] = F.lit(0.0) if ridge is None else RIDGE_WEIGHT * F.least(F.greatest(ridge, F.lit(0.0)), F.lit(1.0))
    return terms


def confidence(prev_y: Column, ridge: Column | None = None) -> Column:
    total = F.lit(0.0)
    for term in confidence_terms(prev_y, ridge).values():
        total = total + term
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def sequential_confidence(cands: DataFrame) -> DataFrame:
    """Score columns from left to right; each continues from the previous best height.

    Only the best row per (column, height) can win a column, so the walk runs over that
    reduced table (bounded by the picture's height and width).
    """
    fixed = confidence(F.lit(None).cast("double")) - 0.25
    best = cands.groupBy(*SC, "y").agg(F.max(fixed).alias("s"))
    columns = best.groupBy(*SC).agg(F.array_sort(F.collect_list(F.struct("y", "s"))).alias("opts"))
    walk = columns.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("col", "opts"))).alias("_cols"))

    def step(state: Column, item: Column) -> Column:
        scored = F.transform(item["opts"], lambda o: F.struct(
            (-(o["s"] + F.when(state["prev"].isNull(), 0.25).otherwise(
                0.25 * F.exp(-F.abs(o["y"] - state["prev"]) / 8.0)))).alias("c"), o["y"].alias("y")))
        top = F.array_min(scored)["y"].cast("double")
        return F.struct(top.alias("prev"), F.concat(state["out"], F.array(
            F.struct(item["col"].alias("col"), state["prev"].alias("prev_y")))).alias("out"))

    start = F.struct(F.lit(None).cast("double").alias("prev"), F.array().cast("array<struct<col:int,prev_y:double>>").alias("out"))
    prev = walk.select("sample_id", F.explode(F.aggregate("_cols", start, step, lambda s: s["out"])).alias("p")).select("sample_id", "p.*")
    return cands.join(prev, SC).withColumn("confidence", confidence(F.col("prev_y")))


def blend_auxiliary(cands: DataFrame, weight: float, minimum: float, aux: str = "aux") -> DataFrame:
    """Mix in an auxiliary score for candidates that are plausible already."""
    bonus = F.coalesce(F.col(aux), F.lit(0.0))
    mixed = F.least(F.greatest((1 - weight) * F.col("confidence") + weight * bonus, F.lit(0.0)), F.lit(1.0))
    return cands.withColumn("base_confidence", F.col("confidence")).withColumn(
        "confidence", F.when(F.col("confidence") >= minimum, mixed).otherwise(F.col("confidence")))


def auxiliary_summary(blended: DataFrame, minimum: float, aux: str = "aux") -> DataFrame:
    """Per sample means before and after the blend and of the auxiliary score, and how many candidates it reached."""
    low = F.col("base_confidence") < minimum
    return blended.groupBy("sample_id").agg(
        F.avg("base_confidence").alias("mean_base_conf"), F.avg("confidence").alias("mean_final_conf"), F.avg(F.coalesce(F.col(aux), F.lit(0.0))).alias("mean_contrast_bonus"),
        F.count(F.lit(1)).alias("num_candidates"), F.count_if(~low).alias("num_bonus_applied"), F.count_if(low).alias("num_base_conf_too_low"))


def envelope_bonus(cands: DataFrame) -> DataFrame:
    """Add ``rank_score``: confidence, lifted near the top of crowded, tall columns."""
    shape = cands.groupBy(*SC).agg(F.count(F.lit(1)).alias("_n"), F.min("y").alias("_top"), F.max("y").alias("_bottom"))
    tall = (F.col("_n") >= ENVELOPE_COUNT) & (F.col("_bottom") - F.col("_top") >= ENVELOPE_SPAN)
    bonus = F.when(tall, ENVELOPE_BONUS * F.exp(-(F.col("y") - F.col("_top")) / ENVELOPE_DECAY)).otherwise(0.0)
    return cands.join(shape, SC).withColumn("rank_score", F.col("confidence") + bonus).drop("_n", "_top", "_bottom")


def filter_top(cands: DataFrame, keep: int = KEEP_FILTERED, minimum: float = MIN_CONFIDENCE) -> DataFrame:
    scored = envelope_bonus(cands).where(F.col("confidence") >= minimum)
    order = Window.partitionBy(*SC).orderBy(F.desc("rank_score"), "cand_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def neighbour_bonus(cands: DataFrame, weight: float = 0.09, tau: float = 14.0) -> DataFrame:
    """Bonus for agreeing with the best candidates of the two adjacent columns."""
    top = cands.groupBy(*SC).agg(F.max_by("y", F.struct("confidence", -F.col("cand_id"))).alias("_y1"))
    near = top.select("sample_id", F.explode(F.array(F.col("col") - 1, F.col("col") + 1)).alias("col"), "_y1")
    ref = near.groupBy(*SC).agg(F.avg("_y1").alias("_ref"))  # the median of at most two values
    bonus = F.coalesce(weight * F.exp(-F.abs(F.col("y") - F.col("_ref")) / max(tau, 1e-6)), F.lit(0.0))
    return cands.join(ref, SC, "left").withColumn("neighbour_bonus", bonus).drop("_ref")


def column_rank_norm(cands: DataFrame) -> DataFrame:
    """Confidence replaced by its rank in the column, from 1 down to 0."""
    n = cands.groupBy(*SC).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*SC).orderBy(F.desc("confidence"), "cand_id"))
    return cands.withColumn("_r", rank).join(n, SC).withColumn(
        "confidence_rank", F.when(F.col("_n") <= 1, 1.0).otherwise((F.col("_n") - F.col("_r")) / (F.col("_n") - 1))).drop("_r", "_n")


def source_quota(cands: DataFrame, keep: int = KEEP_FILTERED, quota: int = 2) -> DataFrame:
    """Top rows by score, with at least ``quota`` rows of source raw where there are some."""
    scored = envelope_bonus(cands).where(F.col("confidence") >= MIN_CONFIDENCE)
    order = Window.partitionBy(*SC).orderBy(F.desc("rank_score"), "cand_id")
    ranked = scored.withColumn("_rank", F.row_number().over(order))
    pool = Window.partitionBy(*SC, F.col("source") == "raw").orderBy(
        F.when(F.col("_rank") <= keep, 0).otherwise(1), F.desc("confidence"), "cand_id")
    tagged = ranked.withColumn("_pool", F.row_number().over(pool))
    is_raw = F.col("source") == "raw"
    want = tagged.where((F.col("_rank") <= keep) | (is_raw & (F.col("_pool") <= quota)))
    forced = Window.partitionBy(*SC).orderBy(F.when(is_raw, 0).otherwise(1), F.desc("confidence"), "cand_id")
    return want.withColumn("rank", F.row_number().over(forced)).where(F.col("rank") <= keep).drop("_rank", "_pool")


def y_diversity(cands: DataFrame, keep: int = KEEP_FILTERED, bins: int = 8) -> DataFrame:
    """Best of every height bin first, filled by confidence, all re-sorted by score.

    As every kept row stays in the pool, the final order by score alone decides.
    """
    kept = envelope_bonus(cands).where(F.col("confidence") >= MIN_CONFIDENCE)
    shape = kept.groupBy(*SC).agg(F.min("y").alias("_lo"), F.max("y").alias("_hi"))
    b = F.floor((F.col("y") - F.col("_lo")) * bins / F.greatest(F.lit(1), F.col("_hi") - F.col("_lo") + 1))
    kept = kept.join(shape, SC).withColumn("y_bin", F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1)).cast("int"))
    order = Window.partitionBy(*SC).orderBy(F.desc("rank_score"), "cand_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).drop("_lo", "_hi")


def column_fill(cands: DataFrame, spine: DataFrame, height: int) -> DataFrame:
    """Rows for empty columns from their neighbours within three columns."""
    top = cands.groupBy(*SC).agg(F.min("y").cast("double").alias("uy"))
    rows = spine.select(*SC).join(top, SC, "left")
    w = ordered(["sample_id"], "col")
    here = F.when(F.col("uy").isNotNull(), F.struct("col", "uy"))
    seen = core(halo(rows, "col", 4).withColumns({
        "l": F.last(here, True).over(w.rangeBetween(-3, -1)), "r": F.first(here, True).over(w.rangeBetween(1, 3)),
        **{f"_m{k}": F.max("uy").over(w.rangeBetween(k, k)) for k in (-4, -3, -2, 2, 3, 4)}}))
    l, r, col = F.col("l"), F.col("r"), F.col("col")  # noqa: E741
    second_l = F.coalesce(*[F.when(col - l["col"] == k, F.col(f"_m{-k - 1}")) for k in (1, 2, 3)])
    second_r = F.coalesce(*[F.when(r["col"] - col == k, F.col(f"_m{k + 1}")) for k in (1, 2, 3)])
    clip = lambda v: F.least(F.greatest(F.bround(v), F.lit(0.0)), F.lit(float(height - 1)))
    both = l["uy"] + (col - l["col"]) / (r["col"] - l["col"]) * (r["uy"] - l["uy"])
    y = (
        F.when(l.isNotNull() & r.isNotNull(), clip(both))
        .when(l.isNotNull() & second_l.isNotNull(), clip(l["uy"] + (l["uy"] - second_l) * (col - l["col"])))
        .when(l.isNotNull(), F.bround(l["uy"]))
        .when(r.isNotNull() & second_r.isNotNull(), clip(r["uy"] - (second_r - r["uy"]) * (r["col"] - col)))
        .when(r.isNotNull(), F.bround(r["uy"]))
    )
    source = (
        F.when(l.isNotNull() & r.isNotNull(), "interpolated")
        .when(l.isNotNull() & second_l.isNotNull(), "neighbor_left_extrap").when(l.isNotNull(), "neighbor_left")
        .when(r.isNotNull() & second_r.isNotNull(), "neighbor_right_extrap").when(r.isNotNull(), "neighbor_right"))
    return seen.where("uy IS NULL").select(
        *SC, y.cast("int").alias("y"), F.when(l.isNotNull() & r.isNotNull(), 0.3).when(y.isNotNull(), 0.25).alias("confidence"), source.alias("source"))


def final_pick(cands: DataFrame, hints: DataFrame, keep: int = KEEP_FINAL) -> DataFrame:
    """Rank by confidence plus agreement with the hint, one row per component score."""
    hint = F.coalesce(HINT_BONUS * F.exp(-F.abs(F.col("y") - F.col("hint")) / HINT_DECAY), F.lit(0.0))
    scored = cands.join(hints, SC, "left").withColumn("pick_score", F.col("confidence") + hint)
    row = F.struct(*[F.col(c) for c in scored.columns if c not in SC])
    best = scored.groupBy(*SC, F.bround("comp_score", 2).alias("_k")).agg(
        F.max_by(row, F.struct("pick_score", -F.col("cand_id"))).alias("_r")).select(*SC, "_r.*")
    order = Window.partitionBy(*SC).orderBy(F.desc("pick_score"), "cand_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).drop("hint")


def dedupe_height(cands: DataFrame) -> DataFrame:
    """Best row per height."""
    row = F.struct(*[F.col(c) for c in cands.columns if c not in (*SC, "y")])
    return cands.groupBy(*SC, "y").agg(F.max_by(row, F.struct("confidence", -F.col("cand_id"))).alias("_r")).select(*SC, "y", "_r.*")


def merge_heights(cands: DataFrame, distance: int) -> DataFrame:
    """Chains of heights no further apart than ``distance``: best row, all source tags."""
    levels = cands.select(*SC, "y").distinct()
    chain = sessions(levels, SC, "y", F.lit(distance), "_chain")
    joined = cands.join(chain.select(*SC, "y", "_chain"), [*SC, "y"])
    return joined.groupBy(*SC, "_chain").agg(
        F.max_by(F.struct("y", "confidence"), F.struct(F.col("confidence"), -F.col("y"), -F.col("cand_id"))).alias("_b"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"), F.count(F.lit(1)).alias("members")).select(*SC, "_b.*", "source", "members")


def second_recipe(cands: DataFrame, min_confidence: float, min_support: float, distance: int, keep: int = 12) -> DataFrame:
    """Threshold filter, chain merge and top rows per column."""
    good = cands.where((F.col("confidence") >= min_confidence) & (F.col("comp_score") >= min_support))
    merged = merge_heights(good, distance)
    order = Window.partitionBy(*SC).orderBy(F.desc("confidence"), "y")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def stage_counts(raw: DataFrame, filtered: DataFrame, final: DataFrame, spine: DataFrame) -> DataFrame:
    """Rows and non-empty columns per stage, and the share of empty final columns."""
    def stage(df: DataFrame, name: str) -> DataFrame:
        per_col = df.groupBy(*SC).agg(F.count(F.lit(1)).alias("_n"))
        return per_col.groupBy("sample_id").agg(F.sum("_n").alias(f"{name}_rows"), F.count(F.lit(1)).alias(f"{name}_columns"))

    total = spine.groupBy("sample_id").agg(F.count(F.lit(1)).alias("total_columns"))
    out = total
    for df, name in ((raw, "raw"), (filtered, "filtered"), (final, "final")):
        out = out.join(stage(df, name), "sample_id", "left")
    out = out.fillna(0)
    return out.withColumn("missing_column_ratio", 1 - F.col("final_columns") / F.col("total_columns"))


def margins(cands: DataFrame) -> DataFrame:
    """Best minus second confidence per column (the best alone when there is no second)."""
    order = Window.partitionBy(*SC).orderBy(F.desc("confidence"), "cand_id")
    two = cands.withColumn("_r", F.row_number().over(order)).where("_r <= 2")
    top = two.groupBy(*SC).agg(F.max(F.when(F.col("_r") == 1, F.col("confidence"))).alias("_a"), F.max(F.when(F.col("_r") == 2, F.col("confidence"))).alias("_b"))
    return top.select(*SC, (F.col("_a") - F.coalesce("_b", F.lit(0.0))).alias("margin"))


def margin_distribution(cands: DataFrame) -> DataFrame:
    m = margins(cands)
    basic = m.groupBy("sample_id").agg(F.count("margin").alias("count"), F.avg("margin").alias("mean"))
    return basic.join(percentiles(m, ["sample_id"], "margin", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), "sample_id")


def mean_confidence(cands: DataFrame) -> DataFrame:
    return cands.groupBy("sample_id").agg(F.avg("confidence").alias("mean_confidence"), F.count(F.lit(1)).alias("n"))


def truth_rescore(cands: DataFrame, gt: DataFrame, sigma: float, sharpening: float = 1.0, only: DataFrame | None = None) -> DataFrame:
    """Confidence from the distance to the truth (on given columns only); the rule score is kept."""
    out = cands.join(gt.select(*SC, "gt_y"), SC, "left")
    hit = F.col("gt_y").isNotNull()
    if only is not None:
        out = out.join(only.select(*SC).distinct().withColumn("_on", F.lit(True)), SC, "left")
        hit = hit & F.coalesce(F.col("_on"), F.lit(False))
    z = F.abs(F.col("y") - F.col("gt_y")) / max(sigma, 1e-6)
    score = F.pow(F.exp(-(z * z)), F.lit(max(sharpening, 1e-6)))
    return out.withColumn("rule_confidence", F.col("confidence")).withColumn(
        "confidence", F.when(hit, score).otherwise(F.col("confidence"))).drop("gt_y", "_on")


def compare_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """How the confidences of two candidate sets differ, and a fingerprint of the second."""
    key = [*SC, "cand_id"]
    both = a.select(*key, F.col("confidence").alias("_a")).join(b.select(*key, F.col("confidence").alias("_b")), key, "full_outer")
    d = F.abs(F.col("_a") - F.col("_b"))
    changed = F.coalesce(d > 1e-12, F.lit(True))
    return both.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(changed).alias("changed_cells"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"),
        F.avg(d * d).alias("mean_square"), F.min(F.when(changed, F.col("col"))).alias("first_changed_col"))


def field_summary(cands: DataFrame) -> DataFrame:
    """Per sample: size and ranges of a candidate set, and a fingerprint of its cells.

    The fingerprint adds numbers made from (column, height, confidence to six decimals), so it
    needs neither an order nor the cells of a sample together.
    """
    cell = F.concat_ws(":", F.col("col").cast("string"), F.col("y").cast("bigint").cast("string"), F.bround(F.col("confidence") * 1e6).cast("bigint").cast("string"))
    number = F.conv(F.substring(F.md5(cell), 1, 10), 16, 10).cast("bigint")
    return cands.groupBy("sample_id").agg(
        F.countDistinct("col").alias("columns"), F.count(F.lit(1)).alias("total"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        F.min("confidence").alias("confidence_min"), F.max("confidence").alias("confidence_max"), F.avg("confidence").alias("confidence_mean"),
        F.sum(number).alias("fingerprint"))


def removal_counts(cands: DataFrame, keep: int = KEEP_FILTERED, minimum: float = MIN_CONFIDENCE) -> DataFrame:
    """Per sample: candidates seen, dropped for low confidence, dropped beyond the column's quota, kept."""
    weak = ~F.coalesce(F.col("confidence") >= minimum, F.lit(False))
    seen = cands.groupBy("sample_id").agg(F.count(F.lit(1)).alias("seen"), F.count_if(weak).alias("low_confidence"))
    kept = filter_top(cands, keep, minimum).groupBy("sample_id").agg(F.count(F.lit(1)).alias("kept"))
    out = seen.join(kept, "sample_id", "left").fillna(0, ["kept"])
    return out.withColumn("over_quota", F.col("seen") - F.col("low_confidence") - F.col("kept"))


def keep_near_truth(raw: DataFrame, final: DataFrame, gt: DataFrame, near: float = 5.0, wider: float = 10.0, keep: int = KEEP_FINAL) -> DataFrame:
    """Force the best raw candidate near the truth into each column's final rows."""
    final, gt = settle(final.select(*SC, "y", "confidence", "cand_id", "source")), settle(gt.select(*SC, "gt_y"))
    d = F.abs(F.col("y") - F.col("gt_y"))
    close = raw.join(gt.select(*SC, "gt_y"), SC).withColumn("_tier", F.when(d <= near, 0).when(d <= wider, 1)).where("_tier IS NOT NULL")
    pick = close.groupBy(*SC).agg(F.max_by(F.struct("y", "confidence", "cand_id", "source"), F.struct(-F.col("_tier"), F.col("confidence"), -F.col("cand_id"))).alias("_p"))
    pick = settle(pick)
    present = final.join(pick.select(*SC, "_p"), SC).where(F.col("y") == F.col("_p.y")).select(*SC).distinct()
    added = pick.join(present, SC, "left_anti").select(*SC, "_p.*").withColumn("source", F.concat("source", F.lit("+debug_gt_near")))
    added = settle(added)
    touched = added.select(*SC)
    base = final.select(*SC, "y", "confidence", "cand_id", "source")
    pool = base.join(touched, SC, "left_semi").unionByName(added).join(gt.select(*SC, "gt_y"), SC)
    n = F.count(F.lit(1)).over(Window.partitionBy(*SC))
    weak = Window.partitionBy(*SC).orderBy(F.when(d > wider, 0).otherwise(1), "confidence", F.desc("cand_id"))
    pool = pool.withColumn("_n", n).withColumn("_w", F.row_number().over(weak)).where(~((F.col("_n") > keep) & (F.col("_w") == 1) & (d > wider)))
    order = Window.partitionBy(*SC).orderBy(F.desc("confidence"), "cand_id")
    pool = pool.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).select(*base.columns)
    return base.join(touched, SC, "left_anti").unionByName(pool)
