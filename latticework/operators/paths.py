"""Minimum-cost paths through candidates and diagnostics over paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.scans import carry, core, halo, ordered, runs, sessions
from latticework.operators.signal import MAD_TO_SIGMA, robust_sigma, rolling_median_iqr
from latticework.operators.stats import attach, percentiles
from latticework.session import settle

SC = ["sample_id", "col"]
# fixed values of the path cost
STEP, STEP_APEX, BEND, DOUBT, SWITCH, SWITCH_AT = 1.0, 0.35, 0.20, 0.88, 1.2, 0.58
BORDER, BORDER_RADIUS = 3.0, 12
BLOCK = 50


def window_limit(width: int) -> int:
    return max(28, round(0.035 * width))


def border_cost(y: Column, height: int) -> Column:
    near = F.least(y, F.lit(height - 1) - y)
    return F.when(near >= BORDER_RADIUS, 0.0).otherwise(BORDER * (1 - near / float(BORDER_RADIUS)))


def min_cost_path(final: DataFrame, spine: DataFrame, width: int, height: int) -> DataFrame:
    """Cheapest smooth path per sample, one row per column (y NULL where there is none).

    ``final`` holds at most a few ranked rows per column; a column trend_cost, where there
    is one, adds to the cost of a row. An empty column restarts the search and only the
    stretch after the last one is reported, so only that stretch (at most one picture
    width) is folded.
    """
    if "trend_cost" not in final.columns:
        final = final.withColumn("trend_cost", F.lit(0.0))
    limit = window_limit(width)
    last_empty = spine.select(*SC).join(final.select(*SC).distinct(), SC, "left_anti").join(
        final.groupBy("sample_id").agg(F.max("col").alias("_end")), "sample_id").where(
        F.col("col") < F.col("_end")).groupBy("sample_id").agg(F.max("col").alias("_cut"))
    row = F.struct("rank", "confidence", "comp_score", "source")
    # equal heights: position of the first, attributes of the last
    levels = final.groupBy(*SC, "y").agg(F.min("rank").alias("at"), F.max(row).alias("_l"), F.max("trend_cost").alias("_pull"))
    live = levels.join(last_empty, "sample_id", "left").where(F.col("_cut").isNull() | (F.col("col") > F.col("_cut")))
    # whole hundredths, so that steps and bends add up exactly: equal costs must stay equal
    hundredths = lambda v: round(v * 100)
    apex = F.when(F.col("_l.source") == "peak_apex", hundredths(STEP_APEX)).otherwise(hundredths(STEP))
    option = F.struct("at", F.col("y").cast("int").alias("y"), (DOUBT * (1 - F.col("_l.confidence")) + F.col("_pull")).alias("doubt"),
                      F.col("_l.comp_score").alias("comp"), apex.alias("step"), border_cost(F.col("y"), height).alias("border"))
    columns = live.groupBy(*SC).agg(F.array_sort(F.collect_list(option)).alias("opts"))
    rows = columns.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("col", "opts"))).alias("_cols"))
    state = "struct<cost:double,at:int,y:int,prev:int,comp:double>"

    def first_states(item: Column) -> Column:
        return F.transform(item["opts"], lambda o: F.struct(
            (o["doubt"] + o["border"]).alias("cost"), o["at"].alias("at"), o["y"].alias("y"), F.lit(None).cast("int").alias("prev"), o["comp"].alias("comp")))

    def advance(states: Column, item: Column) -> Column:
        def enter(o: Column) -> Column:
            def via(s: Column) -> Column:
                bend = F.when(s["prev"].isNull(), 0).otherwise(hundredths(BEND) * F.abs((o["y"] - s["y"]) - (s["y"] - s["prev"])))
                switch = F.when(F.abs(o["comp"] - s["comp"]) > SWITCH_AT, SWITCH).otherwise(0.0)
                total = s["cost"] + ((o["step"] * F.abs(o["y"] - s["y"]) + bend) / 100.0 + o["doubt"] + switch + o["border"])
                return F.struct(total.alias("cost"), s["at"].alias("from"), s["y"].alias("prev"))

            near = F.filter(states, lambda s: F.abs(o["y"] - s["y"]) <= limit)
            cheapest = F.array_min(F.transform(states, lambda s: F.struct(s["cost"].alias("cost"), s["at"].alias("from"), s["y"].alias("prev"))))
            jump = F.struct((cheapest["cost"] + o["doubt"] + o["step"] * F.abs(o["y"] - cheapest["prev"]) / 100.0).alias("cost"),
                            cheapest["from"].alias("from"), cheapest["prev"].alias("prev"))
            best = F.coalesce(F.array_min(F.transform(near, via)), jump)
            return F.struct(best["cost"].alias("cost"), o["at"].alias("at"), o["y"].alias("y"), best["prev"].alias("prev"), o["comp"].alias("comp"))

        return F.transform(item["opts"], enter)

    def step(acc: Column, item: Column) -> Column:
        states = F.when(F.size(acc["states"]) == 0, first_states(item)).otherwise(advance(acc["states"], item))
        back = F.struct(item["col"].alias("col"), F.transform(states, lambda s: F.struct(s["y"].alias("y"), s["prev"].alias("prev"), s["cost"].alias("cost"))).alias("s"))
        return F.struct(states.alias("states"), F.concat(acc["back"], F.array(back)).alias("back"))

    start = F.struct(F.array().cast(f"array<{state}>").alias("states"),
                     F.array().cast("array<struct<col:int,s:array<struct<y:int,prev:int,cost:double>>>>").alias("back"))
    solved = rows.select("sample_id", F.aggregate("_cols", start, step).alias("r"))
    solved = solved.select("sample_id", F.array_min("r.states").alias("end"), F.reverse("r.back").alias("back"))

    def trace_back(acc: Column, item: Column) -> Column:
        here = F.get(F.filter(item["s"], lambda s: s["y"] == acc["y"]), 0)
        return F.struct(here["prev"].alias("y"), F.concat(acc["out"], F.array(F.struct(item["col"].alias("col"), acc["y"].alias("y"), here["cost"].alias("cost")))).alias("out"))

    init = F.struct(F.col("end.y").alias("y"), F.array().cast("array<struct<col:int,y:int,cost:double>>").alias("out"))
    path = solved.select("sample_id", F.explode(F.aggregate("back", init, trace_back, lambda a: a["out"])).alias("p")).select("sample_id", "p.*")
    return spine.select(*SC).join(path, SC, "left")


def apex_pull(path: DataFrame, cands: DataFrame, slack: float = 0.22, absolute: float = 0.30, lift: int = 6, most: int = 320) -> DataFrame:
    """Move a column to its highest sufficiently confident candidate."""
    best = cands.groupBy(*SC).agg(F.max("confidence").alias("_best"))
    seen = cands.join(best, SC).join(path.where("y IS NOT NULL").select(*SC, F.col("y").alias("_py")), SC)
    higher = F.col("y") < F.col("_py")
    a = F.min(F.when(higher & (F.col("confidence") >= F.col("_best") - slack), F.col("y")))
    b = F.min(F.when((F.col("confidence") >= absolute) & (F.col("y") < F.col("_py") - lift), F.col("y")))
    top = seen.groupBy(*SC, "_py").agg(F.coalesce(a, b).alias("_apex")).where(F.col("_py") - F.col("_apex") <= most)
    return path.join(top.select(*SC, "_apex"), SC, "left").withColumn("y_pulled", F.coalesce("_apex", "y")).drop("_apex")


def column_status(spine: DataFrame, final: DataFrame, reached: DataFrame) -> DataFrame:
    """Columns without candidates, with a state, and with candidates but no state."""
    has = final.select(*SC).distinct().withColumn("_c", F.lit(1))
    ok = reached.select(*SC).distinct().withColumn("_s", F.lit(1))
    rows = spine.select(*SC).join(has, SC, "left").join(ok, SC, "left")
    status = F.when(F.col("_c").isNull(), "starvation").when(F.col("_s").isNotNull(), "ok").otherwise("path_choice")
    return rows.groupBy("sample_id").agg(*[F.count_if(status == s).alias(f"{s}_columns") for s in ("ok", "starvation", "path_choice")])


def block_stats(states: DataFrame, size: int = BLOCK) -> DataFrame:
    """Cheapest and second cheapest state cost at the last column of each block."""
    block = F.floor(F.col("col") / size).cast("int")
    ends = states.groupBy("sample_id", block.alias("block")).agg(F.max("col").alias("block_end"), F.min("col").alias("block_start"))
    at_end = states.join(ends.select("sample_id", "block", F.col("block_end").alias("col")), SC)
    order = Window.partitionBy("sample_id", "block").orderBy("cost")
    two = at_end.withColumn("_r", F.row_number().over(order)).where("_r <= 2").groupBy("sample_id", "block").agg(
        F.max(F.when(F.col("_r") == 1, F.col("cost"))).alias("top1_cost"), F.max(F.when(F.col("_r") == 2, F.col("cost"))).alias("top2_cost"))
    return ends.join(two, ["sample_id", "block"], "left").withColumn("margin", F.col("top2_cost") - F.col("top1_cost"))


def path_costs(path: DataFrame, cands: DataFrame, height: int) -> DataFrame:
    """Cost parts of every step of a chosen path."""
    own = cands.groupBy(*SC, "y").agg(F.max("confidence").alias("conf"), F.max("comp_score").alias("comp"))
    w = ordered(["sample_id"], "col")
    rows = path.select(*SC, "y").join(own, [*SC, "y"], "left")
    rows = core(halo(rows, "col", 2).withColumns({
        "_y1": F.lag("y", 1).over(w), "_y2": F.lag("y", 2).over(w), "_c1": F.lag("comp", 1).over(w)}))
    return rows.where("y IS NOT NULL AND _y1 IS NOT NULL").select(
        *SC, "y", (STEP * F.abs(F.col("y") - F.col("_y1"))).alias("transition_cost"),
        F.coalesce(BEND * F.abs((F.col("y") - F.col("_y1")) - (F.col("_y1") - F.col("_y2"))), F.lit(0.0)).alias("curvature_cost"),
        (DOUBT * (1 - F.col("conf"))).alias("confidence_cost"),
        F.when(F.abs(F.col("comp") - F.col("_c1")) > SWITCH_AT, SWITCH).otherwise(0.0).alias("component_switch_cost"),
        border_cost(F.col("y"), height).alias("border_cost"))


def mask_runs(df: DataFrame, keys: list[str], pos: str, mask: Column, least: int = 1) -> DataFrame:
    """Runs of consecutive positions where ``mask`` holds: start, end, length."""
    hit = df.where(mask).select(*keys, pos)
    chained = sessions(hit, keys, pos, F.lit(1), "start")
    return chained.groupBy(*keys, "start").agg(F.max(pos).alias("end"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least)


def path_monitor(path: DataFrame, height: int, window: int = 51, min_run: int = 12) -> DataFrame:
    """Signs of a path that settled on the wrong branch: bottom runs, drift runs, jump clusters."""
    key = ["sample_id"]
    path = settle(path.select(*SC, "y"))
    n = path.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    seen = rolling_median_iqr(path.select(*SC, "y"), key, window)
    bottom = (F.col("y") > F.col("roll_median") + F.coalesce("roll_iqr", F.lit(0.0))) | (F.col("y") >= 0.85 * height)
    seen = settle(seen.withColumns({"bottom": F.coalesce(bottom, F.lit(False)), "resid": F.col("y") - F.col("roll_median")}))
    sigma = robust_sigma(seen, key, "resid").select(*key, F.col("sigma").alias("_global"))
    local = rolling_median_iqr(seen.select(*SC, F.col("resid").alias("y")), key, window).select(*SC, F.col("roll_iqr").alias("_iqr"))
    dev = seen.join(local, SC).join(sigma, key, "left")
    z = F.abs(F.col("resid") / F.greatest(F.coalesce(F.col("_iqr") / 1.349, F.col("_global")), F.lit(1.0)))
    dev = settle(dev.select(*SC, z.alias("_z")))
    w = ordered(key, "col")
    step = core(halo(path.select(*SC, "y"), "col", 2).withColumns({
        "_dy": F.abs(F.col("y") - F.lag("y").over(w)), "_ddy": F.abs(F.col("y") - 2 * F.lag("y").over(w) + F.lag("y", 2).over(w))}))
    step = settle(step)
    limits = None
    for name, floor in (("_dy", 8.0), ("_ddy", 12.0)):
        med = percentiles(step, key, name, {"m": 0.5})
        mad = percentiles(attach(step, med, key).withColumn("_x", F.abs(F.col(name) - F.col("m"))), key, "_x", {"d": 0.5})
        t = F.col("m") + 3.0 * (MAD_TO_SIGMA * F.col("d"))
        part = med.join(mad, key).select(*key, F.when(t < 1.0, floor).otherwise(t).alias(f"{name}_thr"))
        limits = part if limits is None else limits.join(part, key, "full")
    jumps = attach(step, limits, key)
    jump = F.coalesce(F.col("_dy") >= F.col("_dy_thr"), F.lit(False)) | F.coalesce(F.col("_ddy") >= F.col("_ddy_thr"), F.lit(False))

    def longest(df: DataFrame, mask: Column, least: int, name: str) -> DataFrame:
        r = mask_runs(df, key, "col", mask, least)
        return r.groupBy(*key).agg(F.max("length").alias(f"{name}_longest"), F.count(F.lit(1)).alias(f"{name}_runs"))

    out = n
    for part in (longest(seen, F.col("bottom"), min_run, "bottom"), longest(dev, F.col("_z") >= 3.0, min_run, "drift"), longest(jumps, jump, 1, "jump")):
        out = out.join(part, key, "left")
    out = out.fillna(0)
    return out.join(dev.groupBy(*key).agg(F.max("_z").alias("max_z")), key, "left")


def low_coverage_zones(path: DataFrame, window: int = 40, least: float = 0.85) -> DataFrame:
    """Half-overlapping windows where too few columns have a path."""
    hop = window // 2
    n = path.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"))
    first = F.greatest(F.ceil((F.col("col") - (window - 1)) / hop), F.lit(0))
    rows = path.join(n, "sample_id").withColumn("_w", F.explode(F.sequence(first, F.floor(F.col("col") / hop)))).where(
        F.col("_w") * hop + window <= F.col("_n"))
    z = rows.groupBy("sample_id", "_w").agg((F.count("y") / F.lit(window)).alias("metric")).where(F.col("metric") < least)
    return z.select("sample_id", F.lit("low_valid_ratio").alias("trigger"), (F.col("_w") * hop).cast("int").alias("col_start"),
                    (F.col("_w") * hop + window - 1).cast("int").alias("col_end"), "metric")


def missing_zones(path: DataFrame, width: int) -> DataFrame:
    """Stretches without a path; a long one is cut whenever it exceeds the limit."""
    most = max(8, round(0.015 * width))
    r = mask_runs(path, ["sample_id"], "col", F.col("y").isNull(), most + 1)
    parts = r.withColumn("_k", F.explode(F.sequence(F.lit(0), (F.floor(F.col("length") / (most + 1)) - 1).cast("int"))))
    start = F.col("start") + F.col("_k") * (most + 1)
    return parts.select("sample_id", F.lit("consecutive_missing").alias("trigger"), start.cast("int").alias("col_start"),
                        (start + most).cast("int").alias("col_end"), F.lit(float(most + 1)).alias("metric"))


def spike_zones(path: DataFrame, blocks: DataFrame, warm_up: int = 3, edge: int = 2, ratio: float = 0.30, covered: float = 0.95) -> DataFrame:
    """Blocks whose cost grows much faster than the sample's stable blocks and that lack some path columns.

    ``blocks``: sample_id, block_start, block_end, top1_cost. The first ``warm_up`` and last
    ``edge`` blocks are not looked at; samples with fewer than ``warm_up`` + 3 blocks have no zones.
    """
    w = Window.partitionBy("sample_id").orderBy("block_start")
    inc = blocks.withColumns({"_b": F.row_number().over(w) - 1, "_d": F.col("top1_cost") - F.lag("top1_cost").over(w)})
    n = blocks.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"))
    stable = inc.join(n, "sample_id").where(
        (F.col("_n") >= warm_up + 3) & (F.col("_b") >= warm_up) & (F.col("_b") <= F.col("_n") - 1 - edge) & F.col("_d").isNotNull())
    usual = stable.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_k"), F.avg("_d").alias("_m"), F.stddev_pop("_d").alias("_s")).where("_k >= 3")
    high = stable.join(usual, "sample_id").where(F.col("_d") > F.col("_m") + F.greatest(2.5 * F.col("_s"), F.col("_m") * ratio))
    cols = high.withColumn("col", F.explode(F.sequence("block_start", "block_end"))).join(path.select(*SC, "y"), SC, "left")
    share = cols.groupBy("sample_id", "block_start", "block_end").agg(
        (F.count("y") / F.count(F.lit(1))).alias("_share"), (F.first("_d") / F.greatest(F.first("_m"), F.lit(0.01))).alias("metric"))
    return share.where(F.col("_share") < covered).select(
        "sample_id", F.lit("score_spike").alias("trigger"), F.col("block_start").alias("col_start"), F.col("block_end").alias("col_end"), "metric")


def low_margin_zones(blocks: DataFrame, margin: float = 0.15, least_blocks: int = 2, least_columns: int = 12) -> DataFrame:
    """Runs of blocks with close best states; a run that lasts to the last block counts as unfinished."""
    w = Window.partitionBy("sample_id").orderBy("block_start")
    b = blocks.withColumn("_b", F.row_number().over(w) - 1)
    last = b.groupBy("sample_id").agg(F.max("_b").alias("_last"))
    runs = mask_runs(b, ["sample_id"], "_b", F.coalesce(F.col("margin") < margin, F.lit(False)), least_blocks)
    runs = runs.join(last, "sample_id").where("end < _last")
    inside = runs.withColumn("_b", F.explode(F.sequence("start", "end"))).join(b.select("sample_id", "_b", "block_start", "block_end"), ["sample_id", "_b"])
    z = inside.groupBy("sample_id", "start", "length").agg(
        F.min("block_start").alias("col_start"), F.max("block_end").alias("col_end"), F.sum(F.col("block_end") - F.col("block_start") + 1).alias("_cols"))
    return z.where(F.col("_cols") >= least_columns).select(
        "sample_id", F.lit("low_margin_streak").alias("trigger"), "col_start", "col_end", F.col("length").cast("double").alias("metric"))


def merge_zones(zones: DataFrame, gap: int = 20) -> DataFrame:
    """Join zones closer than ``gap`` columns and unite their trigger names."""
    one = zones.groupBy("sample_id", "col_start", "col_end").agg(F.min("trigger").alias("trigger"))
    # furthest end of all zones starting earlier: per start the largest end, then an ordered scan
    starts = one.groupBy("sample_id", "col_start").agg(F.max("col_end").alias("_e"))
    w = Window.partitionBy("sample_id").orderBy("col_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_reach", F.max("_e").over(w))
    opens = F.col("_reach").isNull() | (F.col("col_start") > F.col("_reach") + gap)
    starts = carry(starts, ["sample_id"], "col_start", F.when(opens, F.col("col_start")), before="_zone")
    return one.join(starts.select("sample_id", "col_start", "_zone"), ["sample_id", "col_start"]).groupBy("sample_id", "_zone").agg(
        F.max("col_end").alias("col_end"), F.array_join(F.array_sort(F.collect_set("trigger")), "+").alias("trigger")).withColumnRenamed("_zone", "col_start")


def edge_anomaly(path: DataFrame, width: int, edge: int = 5, gap: int = 5, stable: int = 32, min_dev: float = 8.0,
                 z: float = 3.0, min_points: int = 12, floor: float = 3.0) -> DataFrame:
    """Per side: does the rim leave the level of the stable columns next to it."""
    lo = width - edge - gap - stable
    sides = F.array(
        F.when(F.col("col") < edge + gap + stable, F.struct(F.lit("left").alias("side"), F.when(F.col("col") < edge, "edge").when(
            F.col("col") >= edge + gap, "stable").alias("zone"), (F.col("col") == edge - 1).alias("be"), (F.col("col") == edge + gap).alias("bs"))),
        F.when(F.col("col") >= max(0, lo), F.struct(F.lit("right").alias("side"), F.when(F.col("col") >= width - edge, "edge").when(
            F.col("col") < width - edge - gap, "stable").alias("zone"), (F.col("col") == width - edge).alias("be"), (F.col("col") == width - edge - gap - 1).alias("bs"))))
    rows = path.where("y IS NOT NULL").withColumn("_s", F.explode(F.array_compact(sides))).select("sample_id", "col", "y", "_s.*").where("zone IS NOT NULL")
    key = ["sample_id", "side"]
    base = rows.groupBy(*key).agg(
        F.count_if(F.col("zone") == "stable").alias("n_stable"), F.count_if(F.col("zone") == "edge").alias("n_edge"),
        F.abs(F.max(F.when(F.col("be"), F.col("y"))) - F.max(F.when(F.col("bs"), F.col("y")))).alias("jump"),
        F.regr_slope(F.when(F.col("zone") == "stable", F.col("y")), F.col("col")).alias("slope"),
        F.regr_intercept(F.when(F.col("zone") == "stable", F.col("y")), F.col("col")).alias("intercept"))
    med = percentiles(rows.where("zone = 'stable'"), key, "y", {"stable_median": 0.5})
    edge_med = percentiles(rows.where("zone = 'edge'"), key, "y", {"edge_median": 0.5})
    dev = attach(rows.where("zone = 'stable'"), med, key).withColumn("_d", F.abs(F.col("y") - F.col("stable_median")))
    mad = percentiles(dev, key, "_d", {"_mad": 0.5})
    out = base.join(med, key, "left").join(edge_med, key, "left").join(mad, key, "left")
    sigma = F.greatest(MAD_TO_SIGMA * F.col("_mad"), F.lit(floor))
    out = out.withColumns({"sigma": sigma, "deviation": F.col("edge_median") - F.col("stable_median")})
    limit = F.greatest(F.lit(min_dev), z * F.col("sigma"))
    off = (F.col("n_stable") >= min_points) & (F.col("n_edge") >= 2) & (F.abs("deviation") > limit)
    return out.withColumn("anomaly", F.coalesce(off, F.lit(False)) | F.coalesce(F.col("jump") > limit, F.lit(False))).drop("_mad")


def edge_repair(path: DataFrame, sides: DataFrame, width: int, height: int, edge: int = 5, most: float = 40.0) -> DataFrame:
    """Pull anomalous rim columns toward the line (or, if it is too steep, the median) of the stable zone."""
    side = F.when(F.col("col") < edge, "left").when(F.col("col") >= width - edge, "right")
    rows = path.withColumn("side", side).join(sides.where("anomaly AND stable_median IS NOT NULL").select(
        "sample_id", "side", "slope", "intercept", "stable_median", "n_stable"), ["sample_id", "side"], "left")
    steep = F.abs("slope") > 4.0
    target = F.when((F.col("n_stable") < 3) | F.col("slope").isNull() | steep, F.col("stable_median")).otherwise(F.col("slope") * F.col("col") + F.col("intercept"))
    move = F.least(F.greatest(target - F.col("y"), F.lit(-most)), F.lit(most))
    new = F.least(F.greatest(F.bround(F.col("y") + move), F.lit(0.0)), F.lit(float(height - 1)))
    return rows.withColumn("y_repaired", F.when(F.col("stable_median").isNotNull() & F.col("y").isNotNull(), new).otherwise(F.col("y"))).select(*SC, "y", "y_repaired")


@dataclass(frozen=True)
class RiskRules:
    """Thresholds of the column risk rules and of the segments made of risky columns."""

    conf_margin: float = 0.08
    entropy_high: float = 1.2
    count_high: int = 6
    y_gap: float = 8.0
    y_gap_margin: float = 0.15
    peak_margin: float = 0.18
    axis_distance: float = 2.5
    block_margin: float = 0.12
    boundary_axis: float = 1.2
    peak_radius: int = 12
    local_window: int = 2
    taxonomy_margin: float = 0.25
    taxonomy_count: int = 4
    entropy_requires_margin: bool = False
    taxonomy_requires_margin: bool = False
    dilate_radius: int = 3
    merge_gap: int = 2
    least_columns: int = 6


# fixed values: sample labels that put columns at risk
RISKY_LABELS = ("grid_confusion", "peak_miss_after_smoothing")


def risk_features(cands: DataFrame, width: int, height: int, blocks: DataFrame | None = None, peaks: DataFrame | None = None,
                  rules: RiskRules = RiskRules()) -> DataFrame:
    """Per column with candidates: best two, count, entropy (plain sum over shares), neighbourhood and block figures.

    ``blocks`` (sample_id, block_start, block_end, margin) and ``peaks`` (sample_id, col) may be left out.
    """
    clipped = F.least(F.greatest(F.col("confidence"), F.lit(1e-12)), F.lit(1.0))
    n = cands.groupBy(*SC).agg(F.count(F.lit(1)).alias("candidate_count"), F.sum(clipped).alias("_s"))
    p = clipped / F.col("_s")
    ent = cands.join(n.select(*SC, "_s"), SC).groupBy(*SC).agg(F.sum(-p * F.log(p)).alias("conf_entropy"))
    row = ("confidence", "y", "axis_dist", "comp_score")
    order = Window.partitionBy(*SC).orderBy(F.desc("confidence"), "cand_id")
    two = cands.withColumn("_r", F.row_number().over(order)).where("_r <= 2")
    pick = lambda k: F.max(F.when(F.col("_r") == k, F.struct(*row)))
    top = two.groupBy(*SC).agg(pick(1).alias("a"), pick(2).alias("b"))
    reach = F.sequence(F.col("col") - rules.local_window, F.col("col") + rules.local_window)
    near = cands.groupBy(*SC).agg(*[F.sum(v).alias(f"_{m}") for m, v in {
        "k": F.lit(1), "y": F.col("y"), "yy": F.col("y") * F.col("y"), "c": F.col("confidence"), "cc": F.col("confidence") * F.col("confidence")}.items()])
    near = near.withColumn("_j", F.explode(reach)).groupBy("sample_id", F.col("_j").alias("col")).agg(
        *[F.sum(f"_{m}").alias(f"_{m}") for m in ("k", "y", "yy", "c", "cc")],
        (F.count_if(F.col("col") == F.col("_j") - 1) + F.count_if(F.col("col") == F.col("_j") + 1)).alias("_beside"))
    spread = lambda m: F.sqrt(F.greatest(F.col(f"_{m}{m}") / F.col("_k") - F.pow(F.col(f"_{m}") / F.col("_k"), 2), F.lit(0.0)))
    inside = (F.col("col") > 0).cast("int") + (F.col("col") < width - 1).cast("int")
    out = n.join(top, SC).join(ent, SC).join(near, SC)
    if blocks is not None:
        cover = blocks.withColumn("col", F.explode(F.sequence("block_start", "block_end"))).groupBy(*SC).agg(
            F.min_by("margin", "block_start").alias("block_margin"))
        out = out.join(cover, SC, "left")
    else:
        out = out.withColumn("block_margin", F.lit(None).cast("double"))
    if peaks is not None:
        around = F.explode(F.sequence(F.col("col") - rules.peak_radius, F.col("col") + rules.peak_radius))
        out = out.join(peaks.select("sample_id", around.alias("col")).distinct().withColumn("_peak", F.lit(True)), SC, "left")
    else:
        out = out.withColumn("_peak", F.lit(False))
    y1, axis = F.col("a.y"), F.col("a.axis_dist")
    return out.select(
        *SC, "candidate_count", F.col("a.confidence").alias("top1_conf"), F.coalesce("b.confidence", "a.confidence").alias("top2_conf"),
        (F.col("a.confidence") - F.coalesce("b.confidence", "a.confidence")).alias("conf_margin"), "conf_entropy",
        axis.alias("axis_dist"), F.col("a.comp_score").alias("comp_score"), F.abs(y1 - F.coalesce("b.y", "a.y")).cast("double").alias("y_gap"),
        (inside - F.col("_beside")).cast("int").alias("empty_neighbours"), F.coalesce("_peak", F.lit(False)).alias("near_peak"),
        spread("y").alias("local_y_std"), spread("c").alias("local_conf_std"), "block_margin",
        F.coalesce(F.col("block_margin") < rules.block_margin, F.lit(False)).alias("block_margin_low"),
        ((y1 <= 2) | (y1 >= height - 3) | F.coalesce(axis < rules.boundary_axis, F.lit(False))).alias("boundary_nearby"))


def risk_reasons(rules: RiskRules = RiskRules(), labelled: Column | None = None) -> Column:
    """Names of the rules that a column breaks; ``labelled`` tells whether its sample carries a risky label."""
    margin, count = F.col("conf_margin"), F.col("candidate_count")
    low = margin < rules.conf_margin
    crowded = (count >= rules.count_high) & (F.col("conf_entropy") > rules.entropy_high)
    by_label = (low | crowded) if rules.taxonomy_requires_margin else ((margin < rules.taxonomy_margin) | (count >= rules.taxonomy_count))
    return F.array_compact(F.array(
        F.when(low, "low_conf_margin"),
        F.when(crowded & low if rules.entropy_requires_margin else crowded, "high_entropy_many_cands"),
        F.when(F.col("axis_dist") < rules.axis_distance, "axis_proximity_risk"),
        F.when((F.col("y_gap") >= rules.y_gap) & (margin < rules.y_gap_margin), "large_y_gap_low_margin"),
        F.when(F.col("near_peak") & (margin < rules.peak_margin), "peak_window_low_margin"),
        F.when(F.lit(False) if labelled is None else labelled & by_label, "taxonomy_prior"),
        F.when(F.col("block_margin_low"), "dp_margin_low")))


def risk_summary(features: DataFrame, width: int, rules: RiskRules = RiskRules()) -> DataFrame:
    """Per sample: risky columns before and after the label rule, dilation and merging, with shares of the width.

    ``features`` has ``reasons`` (all rules) and ``reasons_raw`` (without the label rule).
    """
    features = settle(features.select(*SC, "reasons", "reasons_raw"))
    raw = features.groupBy("sample_id").agg(
        F.count_if(F.size("reasons_raw") > 0).alias("risky_raw"), F.count_if(F.size("reasons") > 0).alias("risky_labelled"))
    wide = settle(dilate(features.where(F.size("reasons") > 0).select(*SC, "reasons"), width, rules.dilate_radius))
    counted = wide.groupBy("sample_id").agg(F.count(F.lit(1)).alias("risky_dilated"))
    seg = risk_segments(wide, rules.merge_gap, rules.least_columns).groupBy("sample_id").agg(
        F.sum("segment_len").alias("risky_merged"), F.count(F.lit(1)).alias("segments"))
    names = ["risky_raw", "risky_labelled", "risky_dilated", "risky_merged"]
    out = raw.join(counted, "sample_id", "left").join(seg, "sample_id", "left").fillna(0, [*names, "segments"])
    return out.select("sample_id", *names, "segments", *[(F.col(n) / max(1, width)).alias(n.replace("risky", "ratio")) for n in names])


def risk_reason_counts(features: DataFrame, width: int) -> DataFrame:
    """Per sample and rule: columns that break it, before the label rule, and their share of the width."""
    return features.select("sample_id", F.explode("reasons_raw").alias("reason")).groupBy("sample_id", "reason").agg(
        F.count(F.lit(1)).alias("columns")).withColumn("ratio", F.col("columns") / max(1, width))


def dilate(risky: DataFrame, width: int, radius: int) -> DataFrame:
    """Spread risky columns sideways; new columns inherit the reasons of the nearest left-first source."""
    spread = risky.withColumn("_j", F.explode(F.sequence(F.col("col") - radius, F.col("col") + radius))).where(F.col("_j").between(0, width - 1))
    own = F.col("_j") == F.col("col")
    reasons = F.when(own, F.col("reasons")).otherwise(F.array_distinct(F.concat("reasons", F.array(F.lit("dilated_neighbor")))))
    return spread.groupBy("sample_id", F.col("_j").alias("col")).agg(F.min_by(reasons, F.struct(F.when(own, 0).otherwise(1), F.col("col"))).alias("reasons"))


def risk_segments(risky: DataFrame, gap: int = 2, least: int = 6) -> DataFrame:
    """Chains of risky columns (small holes allowed) of a minimum length with all their reasons."""
    chained = sessions(risky, ["sample_id"], "col", F.lit(gap + 1), "segment_start")
    tags = chained.select("sample_id", "segment_start", "col", F.explode_outer("reasons").alias("reason"))
    seg = tags.groupBy("sample_id", "segment_start").agg(
        F.max("col").alias("segment_end"), F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("risk_reasons"))
    return seg.withColumn("segment_len", F.col("segment_end") - F.col("segment_start") + 1).where(F.col("segment_len") >= least)


def merge_paths(a: DataFrame, b: DataFrame, cands: DataFrame, scale: float = 1.0) -> DataFrame:
    """One path from two: weighted mean when close, else the more confident."""
    both = a.select(*SC, F.col("y").alias("_a")).join(b.select(*SC, F.col("y").alias("_b")), SC, "full_outer")
    best = cands.groupBy(*SC, "y").agg(F.max("confidence").alias("_c"))
    for side in ("_a", "_b"):
        both = both.join(best.select(*SC, F.col("y").cast("double").alias(side), F.col("_c").alias(f"{side}c")), [*SC, side], "left")
    ca, cb = F.coalesce("_ac", F.lit(0.5)), F.coalesce("_bc", F.lit(0.5))
    mean = F.bround((ca * F.col("_a") + cb * F.col("_b")) / (ca + cb + 1e-9))
    y = (F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a"))
         .when(F.abs(F.col("_a") - F.col("_b")) <= 1.5 * scale, mean).when(ca >= cb, F.col("_a")).otherwise(F.col("_b")))
    return both.select(*SC, y.alias("y"))


def path_disagreement(a: DataFrame, b: DataFrame, margins: DataFrame, scale: float = 1.0, size: int = BLOCK) -> DataFrame:
    """Per block: how far two paths differ, how much they overlap, how ambiguous the columns are."""
    both = a.select(*SC, F.col("y").alias("_a")).join(b.select(*SC, F.col("y").alias("_b")), SC, "full_outer").join(margins, SC, "left")
    block = F.floor(F.col("col") / size).cast("int")
    m = F.coalesce("margin", F.lit(0.0))
    d = F.abs(F.col("_a") - F.col("_b"))
    rows = both.select("sample_id", block.alias("block"), d.alias("d"), m.alias("m"),
                       (F.col("_a").isNotNull() | F.col("_b").isNotNull()).alias("any"))
    out = rows.groupBy("sample_id", "block").agg(
        F.coalesce(F.avg("d"), F.lit(0.0)).alias("dis_mean"), F.coalesce(F.max("d"), F.lit(0.0)).alias("dis_max"),
        (F.count("d") / F.greatest(F.count_if("any"), F.lit(1))).alias("overlap_ratio"), F.avg("m").alias("_m"), F.avg((F.col("m") < 0.10).cast("double")).alias("_low"))
    out = out.join(percentiles(rows, ["sample_id", "block"], "d", {"_p90": 0.9}), ["sample_id", "block"], "left").withColumn("dis_p90", F.coalesce("_p90", F.lit(0.0)))
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    amb = 0.55 * (1 - clip((F.col("_m") - 0.05) / 0.20)) + 0.25 * F.col("_low") + 0.20 * clip(F.col("dis_mean") / max(4.0 * scale, 1e-9))
    return out.withColumn("amb_block", amb).withColumns({
        "unstable": (F.col("dis_mean") > 2.5 * scale) | (F.col("dis_p90") > 4.0 * scale) | (F.col("overlap_ratio") < 0.75), "ambiguous": F.col("amb_block") > 0.60}).drop("_m", "_low", "_p90")
