"""Recovery of paths that settled on the wrong branch: regions, islands, added candidates, splices, guards.

Ranges of columns are rows (sample_id, start, end). Unions of ranges are sums of interval ends
along the columns, runs are chained rows, range aggregates join by column; no sample is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.paths import BEND, STEP, STEP_APEX, mask_runs
from latticework.operators.scans import carry, core, halo, ordered, running_total, sessions
from latticework.operators.signal import rolling_median_iqr
from latticework.session import settle

SAMPLE, SC = ["sample_id"], ["sample_id", "col"]
# fixed values of the recovery rules
OVERLAP, REPLACED_CONFIDENCE, STARVED = 5, 0.5, 0.5
POOL_FLOOR, POOL_SHARE, ISLAND_TOP = 0.06, 0.20, 5
BOTTOM_SHARE = 0.85
DRIFT_COLUMNS, JUMP_SCORE, DIVERGENT = 12, 0.002, 0.05
TAIL_REACH, TAIL_SPAN = 120, 220


def columns_in(ranges: DataFrame, *more: str) -> DataFrame:
    """One row for every column of every range, with its start and end."""
    return ranges.select("sample_id", "start", "end", *more, F.explode(F.sequence("start", "end")).alias("col"))


def bottom_runs(path: DataFrame, height: int, window: int = 51, least: int = 12) -> DataFrame:
    """Runs of columns below their rolling level by more than its spread, or in the bottom band."""
    seen = rolling_median_iqr(path.select(*SC, "y"), SAMPLE, window)
    low = (F.col("y") > F.col("roll_median") + F.coalesce("roll_iqr", F.lit(0.0))) | (F.col("y") >= BOTTOM_SHARE * height)
    return mask_runs(seen.withColumn("_low", F.coalesce(low, F.lit(False))), SAMPLE, "col", F.col("_low"), least)


def clipped(ranges: DataFrame, most: int) -> DataFrame:
    """Ranges cut into pieces of at most `most` columns."""
    pieces = ranges.withColumn("_s", F.explode(F.sequence(F.col("start"), F.col("end"), F.lit(most))))
    return pieces.select("sample_id", F.col("_s").alias("start"), F.least(F.col("_s") + most - 1, F.col("end")).alias("end"))


def united(ranges: DataFrame, columns: DataFrame) -> DataFrame:
    """Overlapping and touching ranges joined; `columns` has every column of the samples."""
    ends = ranges.select("sample_id", F.explode(F.array(
        F.struct(F.col("start").alias("col"), F.lit(1).alias("n")), F.struct((F.col("end") + 1).alias("col"), F.lit(-1).alias("n")))).alias("e"))
    ends = ends.groupBy("sample_id", "e.col").agg(F.sum("e.n").cast("double").alias("_n"))
    rows = columns.select(*SC).join(ends, SC, "left").fillna(0.0, ["_n"])
    rows = running_total(rows, SAMPLE, "col", F.col("_n"), "_open")
    return mask_runs(rows, SAMPLE, "col", F.col("_open") + F.col("_n") > 0.5).select("sample_id", "start", "end")


def recovery_regions(runs: DataFrame, columns: DataFrame, least: int, most: int, guard_col: int) -> DataFrame:
    """Regions to recover: long enough runs, from the guard column on, cut to `most` columns, touching pieces joined.

    As pieces of one run touch, the union takes the cut back; `clipped` gives the pieces.
    """
    kept = runs.where((F.col("end") - F.col("start") + 1 >= least) & (F.col("end") >= guard_col))
    return united(clipped(kept.withColumn("start", F.greatest("start", F.lit(guard_col))), most), columns)


def guarded_regions(regions: DataFrame, path: DataFrame, runs: DataFrame, height: int, band: float, min_score: float, min_share: float) -> DataFrame:
    """Regions with what the guard says: kept, low_bottom_score (of the sample) or not_bottom_dominated.

    The score is the longest bottom run over all columns; a region without a path is kept.
    """
    n = path.groupBy(*SAMPLE).agg(F.count(F.lit(1)).alias("_n"))
    score = n.join(runs.groupBy(*SAMPLE).agg(F.max("length").alias("_l")), SAMPLE, "left").select(
        *SAMPLE, (F.coalesce("_l", F.lit(0)) / F.greatest("_n", F.lit(1))).alias("bottom_score"))
    y = columns_in(regions).join(path.select(*SC, "y"), SC, "left")
    share = y.groupBy(*SAMPLE, "start", "end").agg(F.avg((F.col("y") >= band * height).cast("double")).alias("bottom_share"))
    verdict = F.when(F.col("bottom_score") < min_score, "low_bottom_score").when(
        F.col("bottom_share") < min_share, "not_bottom_dominated").otherwise("kept")
    return share.join(score, SAMPLE, "left").withColumn("verdict", verdict)


def pool_additions(
    current: DataFrame, pool: DataFrame, columns: DataFrame, height: int, band: float, most: int, top: int, source: str = "path_v1_filtered_non_bottom"
) -> DataFrame:
    """Up to `most` candidates of `pool` per chosen column, above the bottom band, of heights `current` lacks.

    Of the `top` most confident ones, those of at least a fifth of the best confidence count.
    """
    order = (F.desc("confidence"), F.col("cand_id"))
    place = F.row_number().over(Window.partitionBy(*SC).orderBy(*order))
    best = pool.join(columns.select(*SC).distinct(), SC, "left_semi").withColumn("_p", place).where(F.col("_p") <= top)
    best = settle(best)
    limit = best.groupBy(*SC).agg(F.greatest(F.lit(POOL_FLOOR), POOL_SHARE * F.max("confidence")).alias("_limit"))
    rows = best.join(limit, SC).where((F.col("y") < band * height) & (F.col("confidence") >= F.col("_limit")))
    rows = rows.join(current.select(*SC, "y").distinct(), [*SC, "y"], "left_anti")
    rows = rows.withColumn("_p", F.row_number().over(Window.partitionBy(*SC, "y").orderBy(*order))).where("_p = 1")
    rows = rows.withColumn("_p", F.row_number().over(Window.partitionBy(*SC).orderBy(*order))).where(F.col("_p") <= most)
    return rows.drop("_p", "_limit").withColumns({"source": F.lit(source), "reason": F.lit("monitor_risk_region_non_bottom_pool")})


def islands(
    pool: DataFrame, regions: DataFrame, path: DataFrame, height: int, band: float, least: int, jump: float = 32.0, separation: float = 48.0
) -> DataFrame:
    """Runs of columns in a region with candidates above the bottom band: their level, the path's, and the verdict.

    A column's height is the median of its five most confident such candidates. Verdicts:
    unstable_y_trajectory, low_y_separation, island. An island is at most a region long.
    """
    place = F.row_number().over(Window.partitionBy(*SC).orderBy(F.desc("confidence"), "cand_id"))
    top = pool.where(F.col("y") < band * height).withColumn("_p", place).where(F.col("_p") <= ISLAND_TOP)
    level = top.groupBy(*SC).agg(F.percentile(F.col("y").cast("double"), F.lit(0.5)).alias("level"), F.max("confidence").alias("best"))
    keys = ["sample_id", "start", "end"]
    rows = columns_in(regions).join(level, SC).join(path.select(*SC, F.col("y").alias("path_y")), SC, "left")
    rows = sessions(rows, keys, "col", F.lit(1), "island_start")
    w = ordered(keys, "col")
    moved = F.when(F.lag("island_start").over(w) == F.col("island_start"), F.abs(F.col("level") - F.lag("level").over(w)))
    rows = core(halo(rows, "col", 1).withColumn("_jump", moved))
    half = F.lit(0.5)
    out = rows.groupBy(*keys, "island_start").agg(
        F.max("col").alias("island_end"), F.count(F.lit(1)).alias("length"), F.max("_jump").alias("_jump"), F.percentile("level", half).alias("level"),
        F.percentile("path_y", half).alias("path_level"), F.max("best").alias("confidence_max"), F.percentile("best", half).alias("confidence_median"))
    out = out.where(F.col("length") >= least).withColumn("separation", F.col("path_level") - F.col("level"))
    verdict = F.when(F.col("_jump") > jump, "unstable_y_trajectory").when(F.col("separation") < separation, "low_y_separation").otherwise("island")
    return out.withColumn("verdict", verdict).drop("_jump")


def branch_comparison(original: DataFrame, replacement: DataFrame, zones: DataFrame, final: DataFrame) -> DataFrame:
    """Per zone the valid columns and mean confidences of two paths, the preferred one, and the failure class."""
    known = final.groupBy(*SC, "y").agg(F.min_by("confidence", "rank").alias("_c"))
    filled = final.select(*SC).distinct().withColumn("_filled", F.lit(1))
    rows = columns_in(zones, "trigger").join(original.select(*SC, F.col("y").cast("int").alias("y")), SC).join(known, [*SC, "y"], "left").join(
        replacement.select(*SC, F.col("y").alias("_r")), SC, "left").join(filled, SC, "left")
    out = rows.groupBy("sample_id", "start", "end", "trigger").agg(
        F.count("y").alias("original_valid"), F.count("_r").alias("recovery_valid"),
        (F.coalesce(F.sum("_c"), F.lit(0.0)) / F.count(F.lit(1))).alias("original_confidence"),
        (REPLACED_CONFIDENCE * F.count("_r") / F.count(F.lit(1))).alias("recovery_confidence"), (F.count("_filled") / F.count(F.lit(1))).alias("_share"))
    failure = (
        F.when(F.col("_share") < STARVED, "candidate_starvation").when(F.contains("trigger", F.lit("low_margin")), "wrong_branch_lock_in")
        .when(F.contains("trigger", F.lit("score_spike")), "grid_confusion").otherwise("candidate_starvation"))
    prefer = F.when(F.col("recovery_valid") > F.col("original_valid"), "recovery").otherwise("original")
    return out.withColumns({"prefer": prefer, "failure": failure}).drop("_share")


def blended(original: DataFrame, replacement: DataFrame, zones: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """The path with each zone replaced, on sliding weights over `overlap` columns at its ends; zones do not overlap."""
    rows = original.select(*SC, "y").join(columns_in(zones), SC, "left").join(replacement.select(*SC, F.col("y").alias("_r")), SC, "left")
    head, tail = F.col("col") - F.col("start"), F.col("end") - F.col("col")
    near = F.when(head < overlap, head).when(tail < overlap, tail)
    mixed = F.bround((1 - near / overlap) * F.col("y") + near / overlap * F.col("_r"))
    new = F.when(F.col("start").isNull() | F.col("_r").isNull(), F.col("y")).when(
        near.isNotNull() & F.col("y").isNotNull(), mixed).otherwise(F.col("_r"))
    return rows.select(*SC, "y", new.cast("double").alias("y_blended"))


def divergence(path: DataFrame, top1: DataFrame, near: float = 20.0, far: float = 50.0) -> DataFrame:
    """How far the path is from the best candidate of each column: mean and shares at two distances."""
    off = F.abs(F.col("y") - F.col("_t"))
    rows = path.select(*SC, "y").join(top1.select(*SC, F.col("y").alias("_t")), SC, "left").withColumn("_o", off)
    return rows.groupBy(*SAMPLE).agg(
        F.avg("_o").alias("mean_abs_diff"), F.avg((F.col("_o") >= near).cast("double")).alias("divergence_near"),
        F.avg((F.col("_o") >= far).cast("double")).alias("divergence_far"))


def source_shares(path: DataFrame, final: DataFrame) -> DataFrame:
    """Rows per source of the candidates a path chose (of one height the best ranked), and their share."""
    chosen = final.groupBy(*SC, "y").agg(F.min_by("source", "rank").alias("source"))
    rows = path.where("y IS NOT NULL").select(*SC, F.col("y").cast("int").alias("y")).join(chosen, [*SC, "y"])
    counts = rows.groupBy(*SAMPLE, "source").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*SAMPLE).agg(F.sum("n").alias("_t"))
    return counts.join(total, SAMPLE).select(*SAMPLE, "source", "n", (F.col("n") / F.col("_t")).alias("share"))


def unstable(drift_longest: Column, jump_score: Column, divergence_far: Column) -> Column:
    """Whether a monitored path shows a sign of instability; what isn't known doesn't count."""
    signs = (drift_longest >= DRIFT_COLUMNS, jump_score > JUMP_SCORE, divergence_far > DIVERGENT)
    return F.coalesce(signs[0], F.lit(False)) | F.coalesce(signs[1], F.lit(False)) | F.coalesce(signs[2], F.lit(False))


def short_tails(samples: DataFrame, runs: DataFrame, guard_col: int, reach: int = TAIL_REACH, span: int = TAIL_SPAN) -> DataFrame:
    """Whether all risk runs of a sample end before the guard column plus `reach` and are shorter than `span`; none counts."""
    shape = runs.groupBy(*SAMPLE).agg(F.max("end").alias("_e"), F.max(F.col("end") - F.col("start") + 1).alias("_s"))
    short = F.col("_e").isNull() | ((F.col("_e") < guard_col + reach) & (F.col("_s") < span))
    return samples.select(*SAMPLE).distinct().join(shape, SAMPLE, "left").select(*SAMPLE, short.alias("short_tail"))


def edge_peak_guard(path: DataFrame, sides: DataFrame, width: int, edge: int, window: int, curvature: float, prominence: float, floor: float = 3.0) -> DataFrame:
    """Per side (stable_median, sigma known) whether the rim looks like a peak: second differences and deviation from the level."""
    reach = edge + max(3, window)
    near = F.array(F.when(F.col("col") < min(reach, width), F.lit("left")), F.when(F.col("col") >= max(0, width - reach), F.lit("right")))
    w = ordered(SAMPLE, "col")
    rows = path.where("y IS NOT NULL").select(*SC, "y")
    rows = rows.withColumn("side", F.explode(F.array_compact(near)))
    w = ordered([*SAMPLE, "side"], "col")
    steps = (F.lag("col", 1).over(w) == F.col("col") - 1) & (F.lag("col", 2).over(w) == F.col("col") - 2)
    second = F.when(steps, F.abs(F.lag("y", 2).over(w) - 2 * F.lag("y", 1).over(w) + F.col("y")))
    rows = core(halo(rows, "col", 2).withColumn("_d2", second)).join(sides.select(*SAMPLE, "side", "stable_median", "sigma"), [*SAMPLE, "side"])
    out = rows.groupBy(*SAMPLE, "side").agg(
        F.coalesce(F.max("_d2"), F.lit(0.0)).alias("curvature_max"),
        F.coalesce(F.max(F.abs(F.col("y") - F.col("stable_median")) / F.greatest(F.coalesce("sigma", F.lit(0.0)), F.lit(floor))), F.lit(0.0)).alias("prominence_ratio"))
    out = sides.select(*SAMPLE, "side").join(out, [*SAMPLE, "side"], "left").fillna(0.0, ["curvature_max", "prominence_ratio"])
    return out.withColumns({
        "peak_like": (F.col("curvature_max") >= curvature) | (F.col("prominence_ratio") >= prominence),
        "peak_like_score": F.greatest(F.col("curvature_max") / max(curvature, 1e-9), F.col("prominence_ratio") / max(prominence, 1e-9)),
    })


def near_truth(path: DataFrame, final: DataFrame, truth: DataFrame, near: float = 5.0) -> DataFrame:
    """Per column the most confident candidate near the truth: rank, distance, confidence gap, what a step to it would
    cost from the selected path, and its jump and bend along the run of such columns.
    """
    final = settle(final.select(*SC, "y", "rank", "confidence", "source"))
    close = final.join(truth.select(*SC, "gt_y"), SC).where(F.abs(F.col("y") - F.col("gt_y")) <= near)
    alt = close.groupBy(*SC).agg(F.max_by(F.struct("y", "rank", "confidence", "source", "gt_y"), F.struct("confidence", -F.col("rank"))).alias("alt"))
    own = final.groupBy(*SC, "y").agg(F.min_by("confidence", "rank").alias("_own"))
    chosen = path.where("y IS NOT NULL").select(*SC, F.col("y").cast("int").alias("y")).join(own, [*SC, "y"])
    chosen = carry(settle(chosen), SAMPLE, "col", F.col("y"), before="_before", inclusive=False)
    rows = path.select(*SC).join(chosen.select(*SC, F.struct("y", F.col("_before").alias("before"), "_own").alias("sel")), SC, "left").join(alt, SC, "left")
    rows = carry(settle(rows), SAMPLE, "col", F.when(F.col("sel").isNotNull(), F.struct("sel.y", "sel.before")), before="_prev", inclusive=False)
    w = ordered(SAMPLE, "col")
    one, two = F.lag("alt.y", 1).over(w), F.lag("alt.y", 2).over(w)
    rows = core(halo(rows, "col", 2).withColumns({"jump": F.abs(F.col("alt.y") - one), "bend": F.abs((F.col("alt.y") - one) - (one - two))}))
    move = F.col("alt.y") - F.col("_prev.y")
    step = F.when(F.col("alt.source") == "peak_apex", STEP_APEX).otherwise(STEP)
    return rows.select(
        *SC, F.col("sel.y").alias("selected_y"), F.col("alt.y").alias("near_y"), F.col("alt.rank").alias("near_rank"),
        F.abs(F.col("alt.y") - F.col("alt.gt_y")).alias("distance"), (F.col("alt.confidence") - F.col("sel._own")).alias("confidence_gap"),
        F.when(F.col("alt").isNotNull(), F.coalesce(step * F.abs(move), F.lit(0.0))).alias("transition_cost"),
        F.when(F.col("alt").isNotNull(), F.coalesce(BEND * F.abs(move - (F.col("_prev.y") - F.col("_prev.before"))), F.lit(0.0))).alias("curvature_cost"), "jump", "bend")


def feasibility(near: DataFrame) -> DataFrame:
    """Per sample whether a path could have stayed near the truth: columns, longest run and gap, jumps and bends."""
    near = settle(near)
    base = near.groupBy(*SAMPLE).agg(
        F.count("near_y").alias("near_columns"), F.avg("jump").alias("mean_jump"), F.max("jump").alias("max_jump"), F.avg("bend").alias("mean_bend"),
        F.avg("confidence_gap").alias("mean_confidence_gap"), F.avg("transition_cost").alias("mean_transition_cost"))
    for name, mask in (("longest_run", F.col("near_y").isNotNull()), ("longest_gap", F.col("near_y").isNull())):
        longest = mask_runs(near, SAMPLE, "col", mask).groupBy(*SAMPLE).agg(F.max("length").alias(name))
        base = base.join(longest, SAMPLE, "left").fillna(0, [name])
    return base
