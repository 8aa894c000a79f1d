"""Queries of path recovery: regions, islands, additions, splices, guards and what a path near the truth would take."""

from pyspark.sql import functions as F

from latticework.operators import candidates as C
from latticework.operators import paths as Q
from latticework.operators import recovery as V
from latticework.plans import inputs as I
from latticework.plans.candidate_queries import EDGE, HINTED, SCORED, _edges, _final, cands, runs_sql
from latticework.plans.inputs import R, oracle
from latticework.plans.registry import ORACLES, r, register

# heights of 1 to 50; the pictures are narrow, so runs, regions and distances are small
HEIGHT, BAND, LOW = 40, 0.7, 28
RUNS = {"window": 11, "least": 2}

BOTTOM_SQL = """m AS (SELECT sample_id, col, y, median(y) OVER w AS med, CASE WHEN count(y) OVER w >= 4 THEN quantile_cont(y, 0.75) OVER w - quantile_cont(y, 0.25) OVER w ELSE stddev_pop(y) OVER w END AS iqr
      FROM trace WINDOW w AS (PARTITION BY sample_id ORDER BY col ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)), """ + runs_sql("m", "y > med + coalesce(iqr, 0) OR y >= 0.85 * 40", "bot", 2)
REGION_SQL = BOTTOM_SQL + """,
    cov AS (SELECT DISTINCT sample_id, unnest(range(greatest(c0, 8), c1 + 1)) AS col FROM bot_r WHERE len >= 2 AND c1 >= 8),
    reg AS (SELECT sample_id, CAST(min(col) AS INT) AS a, CAST(max(col) AS INT) AS b FROM (SELECT *, col - row_number() OVER (PARTITION BY sample_id ORDER BY col) AS g FROM cov) GROUP BY sample_id, g)"""
ZONES = "w AS (" + ORACLES["trouble_zones"].split("w AS (", 1)[1].split("SELECT sample_id, CAST(min(c0)")[0].rstrip() + """,
    zn AS (SELECT sample_id, CAST(min(c0) AS INT) AS a, CAST(max(c1) AS INT) AS b FROM g GROUP BY sample_id, z),
    zc AS (SELECT sample_id, a, b, CAST(unnest(range(a, b + 1)) AS INT) AS col FROM zn)"""
SPARE_SQL = f"spare AS (SELECT sample_id, col, y FROM candidates WHERE y < {LOW} QUALIFY row_number() OVER (PARTITION BY sample_id, col ORDER BY confidence DESC, cand_id) = 1)"


def _runs(spark, folder):
    return V.bottom_runs(I.trace(spark, folder), HEIGHT, **RUNS)


def _regions(spark, folder):
    return V.recovery_regions(_runs(spark, folder), I.trace(spark, folder), 2, 16, 8)


def _zones(spark, folder):
    t = Q.settle(I.trace(spark, folder))
    zones = Q.low_coverage_zones(t, 10, 0.85).drop("metric").unionByName(Q.missing_zones(t, 64).drop("metric"))
    return Q.merge_zones(zones, 2).select("sample_id", F.col("col_start").cast("int").alias("start"), F.col("col_end").cast("int").alias("end"), "trigger")


def _spare(spark, folder):
    """The most confident candidate of each column above the bottom band."""
    return cands(spark, folder).where(F.col("y") < LOW).groupBy("sample_id", "col").agg(F.max_by("y", F.struct("confidence", -F.col("cand_id"))).alias("y"))


@register("recovery_regions", "K31", oracle("trace", REGION_SQL + ' SELECT sample_id, a AS "start", b AS "end" FROM reg'))
def recovery_regions(spark, folder):
    return _regions(spark, folder).select("sample_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@register("guarded_regions", "K32", oracle("trace", REGION_SQL + f""",
    sc AS (SELECT sample_id, coalesce(max(longest), 0) / 64.0 AS bottom_score FROM trace LEFT JOIN bot USING (sample_id) GROUP BY 1),
    sh AS (SELECT g.sample_id, a, b, avg(CASE WHEN t.y >= {LOW} THEN 1.0 WHEN t.y < {LOW} THEN 0.0 END) AS bottom_share FROM reg g JOIN trace t ON t.sample_id = g.sample_id AND t.col BETWEEN a AND b GROUP BY 1, 2, 3)
    SELECT sample_id, a AS "start", b AS "end", {R('bottom_share')} AS bottom_share, {R('bottom_score')} AS bottom_score,
      CASE WHEN bottom_score < 0.04 THEN 'low_bottom_score' WHEN bottom_share < 0.8 THEN 'not_bottom_dominated' ELSE 'kept' END AS verdict FROM sh JOIN sc USING (sample_id)"""))
def guarded_regions(spark, folder):
    out = V.guarded_regions(_regions(spark, folder), I.trace(spark, folder), _runs(spark, folder), HEIGHT, BAND, 0.04, 0.8)
    return out.select("sample_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
                      r("bottom_share").alias("bottom_share"), r("bottom_score").alias("bottom_score"), "verdict")


@register("pool_additions", "K33", oracle("candidates trace", SCORED + ", " + HINTED + ", " + REGION_SQL + f""",
    ch AS (SELECT DISTINCT g.sample_id, t.col FROM reg g JOIN trace t ON t.sample_id = g.sample_id AND t.col BETWEEN a AND b),
    po AS (SELECT *, max(confidence) OVER (PARTITION BY sample_id, col) AS top FROM (SELECT * FROM ranked WHERE rank <= 16) SEMI JOIN ch USING (sample_id, col)
      QUALIFY row_number() OVER (PARTITION BY sample_id, col ORDER BY confidence DESC, cand_id) <= 8),
    ok AS (SELECT * FROM po WHERE y < {LOW} AND confidence >= greatest(0.06, 0.2 * top) AND NOT EXISTS (SELECT 1 FROM final f WHERE f.sample_id = po.sample_id AND f.col = po.col AND f.y = po.y)
      QUALIFY row_number() OVER (PARTITION BY sample_id, col, y ORDER BY confidence DESC, cand_id) = 1)
    SELECT sample_id, col, y, cand_id FROM ok QUALIFY row_number() OVER (PARTITION BY sample_id, col ORDER BY confidence DESC, cand_id) <= 2"""))
def pool_additions(spark, folder):
    pool = C.filter_top(cands(spark, folder)).drop("rank")
    out = V.pool_additions(_final(spark, folder, 8), pool, V.columns_in(_regions(spark, folder)), HEIGHT, BAND, 2, 8)
    return out.select("sample_id", "col", "y", "cand_id")


@register("islands", "K34", oracle("candidates trace", SCORED + ", " + ZONES + f""",
    lv AS (SELECT sample_id, col, median(y) AS level, max(confidence) AS best FROM (SELECT * FROM ranked WHERE rank <= 16 AND y < {LOW}
      QUALIFY row_number() OVER (PARTITION BY sample_id, col ORDER BY confidence DESC, cand_id) <= 5) GROUP BY 1, 2),
    ic AS (SELECT z.sample_id, z.a, z.b, z.col, level, best, t.y AS py, z.col - row_number() OVER (PARTITION BY z.sample_id, z.a ORDER BY z.col) AS g FROM zc z JOIN lv USING (sample_id, col) JOIN trace t USING (sample_id, col)),
    ij AS (SELECT *, abs(level - lag(level) OVER (PARTITION BY sample_id, a, g ORDER BY col)) AS j FROM ic),
    ia AS (SELECT sample_id, a, b, min(col) AS island_start, max(col) AS island_end, count(*) AS length, max(j) AS j, median(level) AS level, median(py) AS path_level, max(best) AS confidence_max, median(best) AS confidence_median
      FROM ij GROUP BY sample_id, a, b, g HAVING count(*) >= 3)
    SELECT sample_id, a AS "start", island_start, island_end, length, {R('level')} AS level, {R('path_level')} AS path_level, {R('confidence_max')} AS confidence_max, {R('confidence_median')} AS confidence_median,
      CASE WHEN j > 16 THEN 'unstable_y_trajectory' WHEN path_level - level < 4 THEN 'low_y_separation' ELSE 'island' END AS verdict FROM ia"""))
def islands(spark, folder):
    pool = C.filter_top(cands(spark, folder)).drop("rank")
    out = V.islands(pool, _zones(spark, folder), I.trace(spark, folder), HEIGHT, BAND, 3, jump=16.0, separation=4.0)
    return out.select("sample_id", "start", F.col("island_start").cast("int").alias("island_start"), F.col("island_end").cast("int").alias("island_end"), "length",
                      *[r(c).alias(c) for c in ("level", "path_level", "confidence_max", "confidence_median")], "verdict")


@register("branch_comparison", "K29", oracle("candidates trace", HINTED + ", " + SPARE_SQL + ", " + ZONES + f""",
    k AS (SELECT sample_id, col, y, arg_min(confidence, rank) AS c FROM final GROUP BY 1, 2, 3),
    x AS (SELECT z.sample_id, z.a, z.b, count(t.y) AS ov, count(s.y) AS rv, coalesce(sum(k.c), 0) / count(*) AS oc, 0.5 * count(s.y) / count(*) AS rc, count(f.col) / count(*) AS share
      FROM zc z JOIN trace t USING (sample_id, col) LEFT JOIN k ON k.sample_id = z.sample_id AND k.col = z.col AND k.y = t.y LEFT JOIN spare s ON s.sample_id = z.sample_id AND s.col = z.col
      LEFT JOIN (SELECT DISTINCT sample_id, col FROM final) f ON f.sample_id = z.sample_id AND f.col = z.col GROUP BY 1, 2, 3)
    SELECT sample_id, a AS "start", b AS "end", ov AS original_valid, rv AS recovery_valid, {R('oc', 4)} AS original_confidence, {R('rc', 4)} AS recovery_confidence,
      CASE WHEN rv > ov THEN 'recovery' ELSE 'original' END AS prefer, 'candidate_starvation' AS failure FROM x"""))
def branch_comparison(spark, folder):
    out = V.branch_comparison(I.trace(spark, folder), _spare(spark, folder), _zones(spark, folder), _final(spark, folder))
    return out.select("sample_id", "start", "end", "original_valid", "recovery_valid", r("original_confidence", 4).alias("original_confidence"),
                      r("recovery_confidence", 4).alias("recovery_confidence"), "prefer", "failure")


@register("blended_path", "K30", oracle("candidates trace", SPARE_SQL + ", " + ZONES + """,
    x AS (SELECT t.sample_id, t.col, t.y, s.y AS ry, a, CASE WHEN t.col - a < 5 THEN t.col - a WHEN b - t.col < 5 THEN b - t.col END AS near
      FROM trace t LEFT JOIN zc USING (sample_id, col) LEFT JOIN spare s ON s.sample_id = t.sample_id AND s.col = t.col)
    SELECT sample_id, col, y, CAST(CASE WHEN a IS NULL OR ry IS NULL THEN y WHEN near IS NOT NULL AND y IS NOT NULL THEN round_even((1 - near / 5.0) * y + near / 5.0 * ry, 0) ELSE ry END AS DOUBLE) AS y_blended FROM x"""))
def blended_path(spark, folder):
    return V.blended(I.trace(spark, folder), _spare(spark, folder), _zones(spark, folder))


RATES_SQL = """dv AS (SELECT t.sample_id, avg(abs(t.y - f.y)) AS mean_abs_diff, avg(CASE WHEN abs(t.y - f.y) >= 5 THEN 1.0 WHEN abs(t.y - f.y) < 5 THEN 0.0 END) AS dn, avg(CASE WHEN abs(t.y - f.y) >= 10 THEN 1.0 WHEN abs(t.y - f.y) < 10 THEN 0.0 END) AS df
      FROM trace t LEFT JOIN final f ON f.sample_id = t.sample_id AND f.col = t.col AND f.rank = 1 GROUP BY 1)"""


def _divergence(spark, folder):
    return V.divergence(I.trace(spark, folder), _final(spark, folder).where("rank = 1"), 5.0, 10.0)


@register("path_divergence", "K26", oracle("candidates trace", HINTED + ", " + RATES_SQL + f"""
    SELECT sample_id, {R('mean_abs_diff')} AS mean_abs_diff, {R('dn')} AS divergence_near, {R('df')} AS divergence_far FROM dv"""))
def path_divergence(spark, folder):
    return _divergence(spark, folder).select("sample_id", *[r(c).alias(c) for c in ("mean_abs_diff", "divergence_near", "divergence_far")])


@register("source_shares", "K26", oracle("candidates trace", HINTED + f""",
    c AS (SELECT sample_id, col, y, arg_min(source, rank) AS source FROM final GROUP BY 1, 2, 3),
    n AS (SELECT t.sample_id, source, count(*) AS n FROM trace t JOIN c ON c.sample_id = t.sample_id AND c.col = t.col AND c.y = t.y GROUP BY 1, 2)
    SELECT sample_id, source, n, {R('n / sum(n) OVER (PARTITION BY sample_id)')} AS share FROM n"""))
def source_shares(spark, folder):
    return V.source_shares(I.trace(spark, folder), _final(spark, folder)).select("sample_id", "source", "n", r("share").alias("share"))


@register("recovery_signals", "K35", oracle("candidates trace", HINTED + ", " + RATES_SQL + ", " + BOTTOM_SQL + f""",
    pm AS ({ORACLES['path_monitor']}), tl AS (SELECT sample_id, max(c1) AS e, max(c1 - c0 + 1) AS s FROM bot_r GROUP BY 1)
    SELECT p.sample_id, coalesce(drift_longest >= 12, false) OR coalesce(jump_longest / CAST(n AS DOUBLE) > 0.002, false) OR coalesce(df > 0.05, false) AS unstable,
      e IS NULL OR (e < 8 + 50 AND s < 4) AS short_tail FROM pm p JOIN dv USING (sample_id) LEFT JOIN tl USING (sample_id)"""))
def recovery_signals(spark, folder):
    monitor = Q.path_monitor(I.trace(spark, folder), 40, 11, 2).join(_divergence(spark, folder), "sample_id")
    tails = V.short_tails(I.trace(spark, folder), _runs(spark, folder), 8, reach=50, span=4)
    signs = V.unstable(F.col("drift_longest"), F.col("jump_longest") / F.col("n"), F.col("divergence_far"))
    return monitor.select("sample_id", signs.alias("unstable")).join(tails, "sample_id")


@register("edge_peak_guard", "K37", oracle("trace", EDGE + f""",
    sc AS (SELECT sample_id, col, y, unnest(list_filter([CASE WHEN col < 14 THEN 'left' END, CASE WHEN col >= 50 THEN 'right' END], lambda s: s IS NOT NULL)) AS side FROM trace WHERE y IS NOT NULL),
    dd AS (SELECT *, CASE WHEN lag(col) OVER w = col - 1 AND lag(col, 2) OVER w = col - 2 THEN abs(lag(y, 2) OVER w - 2 * lag(y) OVER w + y) END AS d2 FROM sc WINDOW w AS (PARTITION BY sample_id, side ORDER BY col)),
    gd AS (SELECT es.sample_id, es.side, coalesce(max(d2), 0) AS cm, coalesce(max(abs(dd.y - sm) / greatest(coalesce(sigma, 0), 3)), 0) AS pr FROM es LEFT JOIN dd ON dd.sample_id = es.sample_id AND dd.side = es.side GROUP BY 1, 2)
    SELECT sample_id, side, CAST(cm AS DOUBLE) AS curvature_max, {R('pr')} AS prominence_ratio, cm >= 60 OR pr >= 2.5 AS peak_like, {R('greatest(cm / 60.0, pr / 2.5)')} AS peak_like_score FROM gd"""))
def edge_peak_guard(spark, folder):
    out = V.edge_peak_guard(I.trace(spark, folder), _edges(spark, folder), 64, 5, 9, 60.0, 2.5)
    return out.select("sample_id", "side", "curvature_max", r("prominence_ratio").alias("prominence_ratio"), "peak_like", r("peak_like_score").alias("peak_like_score"))


NEAR_SQL = HINTED + """,
    gt AS (SELECT sample_id - 1 AS sample_id, col, y AS gt_y FROM trace WHERE y IS NOT NULL),
    al AS (SELECT f.sample_id, f.col, f.y AS ny, f.rank AS nr, f.confidence AS nc, gt_y FROM final f JOIN gt USING (sample_id, col) WHERE abs(f.y - gt_y) <= 5
      QUALIFY row_number() OVER (PARTITION BY f.sample_id, f.col ORDER BY f.confidence DESC, f.rank) = 1),
    ow AS (SELECT sample_id, col, y, arg_min(confidence, rank) AS oc FROM final GROUP BY 1, 2, 3),
    se AS (SELECT t.sample_id, t.col, ow.y AS sy, oc FROM trace t LEFT JOIN ow ON ow.sample_id = t.sample_id AND ow.col = t.col AND ow.y = t.y),
    sq AS (SELECT sample_id, col, sy, lag(sy) OVER (PARTITION BY sample_id ORDER BY col) AS py FROM se WHERE sy IS NOT NULL),
    pv AS (SELECT s.*, (SELECT arg_max(q.sy, q.col) FROM sq q WHERE q.sample_id = s.sample_id AND q.col < s.col) AS p1, (SELECT arg_max({'v': q.py}, q.col).v FROM sq q WHERE q.sample_id = s.sample_id AND q.col < s.col) AS p2 FROM se s),
    nt AS (SELECT p.sample_id, p.col, sy AS selected_y, ny AS near_y, nr AS near_rank, abs(ny - gt_y) AS distance, nc - oc AS confidence_gap, CASE WHEN ny IS NOT NULL THEN CAST(coalesce(abs(ny - p1), 0) AS DOUBLE) END AS transition_cost,
      CASE WHEN ny IS NOT NULL THEN coalesce(0.2 * abs((ny - p1) - (p1 - p2)), 0) END AS curvature_cost, abs(ny - lag(ny) OVER w) AS jump, abs((ny - lag(ny) OVER w) - (lag(ny) OVER w - lag(ny, 2) OVER w)) AS bend
      FROM pv p LEFT JOIN al USING (sample_id, col) WINDOW w AS (PARTITION BY p.sample_id ORDER BY p.col))"""


def _near(spark, folder):
    t = Q.settle(I.trace(spark, folder))
    truth = t.where("y IS NOT NULL").select((F.col("sample_id") - 1).alias("sample_id"), "col", F.col("y").alias("gt_y"))
    return V.near_truth(t, _final(spark, folder), truth)


@register("near_truth", "K24", oracle("candidates trace", NEAR_SQL + f"""
    SELECT sample_id, col, selected_y, near_y, near_rank, distance, {R('confidence_gap')} AS confidence_gap, transition_cost, {R('curvature_cost')} AS curvature_cost, jump, bend FROM nt"""))
def near_truth(spark, folder):
    """The trace of the next sample plays the truth."""
    return _near(spark, folder).withColumns({c: r(c) for c in ("confidence_gap", "curvature_cost")})


@register("path_feasibility", "K24", oracle("candidates trace", NEAR_SQL + ", " + runs_sql("nt", "near_y IS NOT NULL", "hit", 1) + ", " + runs_sql("nt", "near_y IS NULL", "mis", 1) + f""",
    ag AS (SELECT sample_id, count(near_y) AS near_columns, avg(jump) AS mean_jump, max(jump) AS max_jump, avg(bend) AS mean_bend, avg(confidence_gap) AS gap, avg(transition_cost) AS tc FROM nt GROUP BY 1)
    SELECT ag.sample_id, near_columns, {R('mean_jump')} AS mean_jump, max_jump, {R('mean_bend')} AS mean_bend, {R('gap')} AS mean_confidence_gap, {R('tc')} AS mean_transition_cost,
      coalesce(hit.longest, 0) AS longest_run, coalesce(mis.longest, 0) AS longest_gap FROM ag LEFT JOIN hit USING (sample_id) LEFT JOIN mis USING (sample_id)"""))
def path_feasibility(spark, folder):
    out = V.feasibility(_near(spark, folder))
    return out.withColumns({c: r(c) for c in ("mean_jump", "mean_bend", "mean_confidence_gap", "mean_transition_cost")})
