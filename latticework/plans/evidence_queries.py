"""Envelope, apex, trend, continuity and quota queries."""

from pyspark.sql import functions as F

from latticework.operators import candidates as C
from latticework.operators import evidence as E
from latticework.operators import paths as Q
from latticework.plans import inputs as I
from latticework.plans.candidate_queries import HINTED, PATH_SQL, SCORED, _final, cands
from latticework.plans.inputs import R, oracle
from latticework.plans.registry import r, register

WIDTH, HEIGHT = 64, 60
# the pictures are narrow and their candidates scattered: a window of 3 and a prominence of 2
ENVELOPE = {"window": 3, "min_prominence": 2.0}
DISTANCE = 12

SPINE = "spine AS (SELECT DISTINCT sample_id, CAST(g.i AS INT) AS col FROM candidates, range(0, 64) g(i))"
ENVELOPE_SQL = SPINE + """,
    px AS (SELECT DISTINCT sample_id, col, CAST(y AS DOUBLE) AS y FROM candidates),
    e0 AS (SELECT s.sample_id, s.col, round(quantile_cont(p.y, 0.1), 9) AS y_top, round(quantile_cont(p.y, 0.8), 9) AS y_bottom, count(p.y) AS pixels, list(p.y) AS ys
      FROM spine s LEFT JOIN px p ON p.sample_id = s.sample_id AND p.col BETWEEN s.col - 1 AND s.col + 1 GROUP BY 1, 2),
    e1 AS (SELECT sample_id, col, y_top, y_bottom, round(y_bottom - y_top, 9) AS thickness, pixels, CASE WHEN pixels = 0 THEN 0 ELSE len(list_filter(ys, lambda y: y <= y_top + 2)) END AS top_support,
      last_value(CASE WHEN y_top IS NOT NULL THEN col END IGNORE NULLS) OVER a AS bc, last_value(y_top IGNORE NULLS) OVER a AS bv,
      last_value(CASE WHEN y_top IS NOT NULL THEN col END IGNORE NULLS) OVER d AS ac, last_value(y_top IGNORE NULLS) OVER d AS av FROM e0
      WINDOW a AS (PARTITION BY sample_id ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (PARTITION BY sample_id ORDER BY col DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    e2 AS (SELECT *, CASE WHEN y_top IS NOT NULL THEN y_top WHEN bv IS NULL AND av IS NULL THEN 0 WHEN bv IS NULL THEN av WHEN av IS NULL THEN bv ELSE bv + (av - bv) / (ac - bc) * (col - bc) END AS smooth_top FROM e1),
    e3 AS (SELECT *, round(median(smooth_top) OVER (PARTITION BY sample_id ORDER BY col RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING) - smooth_top, 9) AS prominence,
      CASE WHEN col = 0 THEN lead(smooth_top) OVER w - smooth_top WHEN col = 63 THEN smooth_top - lag(smooth_top) OVER w ELSE (lead(smooth_top) OVER w - lag(smooth_top) OVER w) / 2 END AS slope,
      FROM e2 WINDOW w AS (PARTITION BY sample_id ORDER BY col)),
    env AS (SELECT *, CASE WHEN col = 0 THEN lead(slope) OVER w - slope WHEN col = 63 THEN slope - lag(slope) OVER w ELSE (lead(slope) OVER w - lag(slope) OVER w) / 2 END AS curvature,
      coalesce(y_top IS NOT NULL AND pixels >= 5 AND top_support >= 2 AND prominence >= 2 AND thickness >= 2 AND col BETWEEN 3 AND 60, false) AS peak FROM e3 WINDOW w AS (PARTITION BY sample_id ORDER BY col))"""
PAIRS_SQL = ENVELOPE_SQL + f""",
    low AS (SELECT sample_id, col, smooth_top FROM (SELECT *, lag(smooth_top) OVER w AS b, lead(smooth_top) OVER w AS a FROM env WINDOW w AS (PARTITION BY sample_id ORDER BY col))
      WHERE y_top IS NOT NULL AND peak AND smooth_top <= b AND smooth_top <= a AND col BETWEEN 1 AND 62),
    pair AS (SELECT l.sample_id, l.col AS left_col, z.col AS right_col, z.col - l.col AS tip_distance, round(max(m.smooth_top) - least(any_value(l.smooth_top), any_value(z.smooth_top)), 9) AS valley_depth,
      coalesce(median(m.thickness), 0) AS thickness_ref FROM low l JOIN low z ON z.sample_id = l.sample_id AND z.col - l.col BETWEEN 2 AND {DISTANCE}
      JOIN env m ON m.sample_id = l.sample_id AND m.col BETWEEN l.col AND z.col GROUP BY 1, 2, 3),
    pairs AS (SELECT *, valley_depth <= greatest(4, round(0.18 * thickness_ref, 9)) AS false_split FROM pair)"""
APEX_SQL = PAIRS_SQL + """,
    apex AS (SELECT e.*, coalesce((SELECT bool_or(p.false_split) FROM pairs p WHERE p.sample_id = e.sample_id AND e.col BETWEEN p.left_col AND p.right_col), false) AS false_split,
      coalesce((SELECT bool_or(NOT p.false_split) FROM pairs p WHERE p.sample_id = e.sample_id AND e.col BETWEEN p.left_col AND p.right_col), false) AS true_doublet, CAST(round_even(y_top, 0) AS INT) AS y FROM env e),
    apexes AS (SELECT *, CASE WHEN NOT peak THEN 'skipped_not_peak_window' WHEN false_split THEN 'skipped_double_tip_guard' WHEN y IS NULL THEN 'skipped_invalid_top'
      WHEN y < 0 OR y >= 60 THEN 'skipped_out_of_bounds' WHEN EXISTS (SELECT 1 FROM candidates c WHERE c.sample_id = apex.sample_id AND c.col = apex.col AND abs(c.y - apex.y) <= 1) THEN 'skipped_duplicate_y' ELSE 'added' END AS reason FROM apex)"""


def _envelope(spark, folder):
    return E.pixel_envelope(cands(spark, folder).select("sample_id", "col", "y"), WIDTH, **ENVELOPE)


def _apexes(spark, folder):
    env = Q.settle(_envelope(spark, folder))
    marks = E.doublet_columns(E.doublets(env, WIDTH, DISTANCE), env)
    return E.apex_columns(env, marks, cands(spark, folder), HEIGHT)


@register("pixel_envelope", "K49", oracle("candidates", ENVELOPE_SQL + f"""
    SELECT sample_id, col, {R('y_top')} AS y_top, {R('y_bottom')} AS y_bottom, {R('thickness')} AS thickness, pixels, top_support, {R('smooth_top')} AS smooth_top,
      {R('prominence')} AS prominence, {R('slope')} AS slope, {R('curvature')} AS curvature, peak FROM env"""))
def pixel_envelope(spark, folder):
    rounded = ("y_top", "y_bottom", "thickness", "smooth_top", "prominence", "slope", "curvature")
    return _envelope(spark, folder).select("sample_id", "col", "pixels", "top_support", "peak", *[r(c).alias(c) for c in rounded])


@register("envelope_doublets", "K50", oracle("candidates", PAIRS_SQL + f"""
    SELECT sample_id, left_col, right_col, tip_distance, {R('valley_depth')} AS valley_depth, {R('thickness_ref')} AS thickness_ref, false_split FROM pairs"""))
def envelope_doublets(spark, folder):
    return E.doublets(_envelope(spark, folder), WIDTH, DISTANCE).select(
        "sample_id", "left_col", "right_col", "tip_distance", r("valley_depth").alias("valley_depth"), r("thickness_ref").alias("thickness_ref"), "false_split")


@register("apex_columns", "K51", oracle("candidates", APEX_SQL + " SELECT sample_id, col, y, false_split, true_doublet, reason FROM apexes"))
def apex_columns(spark, folder):
    return _apexes(spark, folder).select("sample_id", "col", "y", "false_split", "true_doublet", "reason")


@register("apex_candidates", "K51", oracle("candidates", APEX_SQL + f""",
    n AS (SELECT a.sample_id, a.col, a.y, a.prominence, a.thickness, c.confidence, c.comp_score, c.axis_dist FROM apexes a LEFT JOIN candidates c USING (sample_id, col) WHERE reason = 'added'
      QUALIFY row_number() OVER (PARTITION BY a.sample_id, a.col ORDER BY abs(c.y - a.y), c.confidence DESC, c.cand_id) = 1)
    SELECT sample_id, col, y, {R('least(0.95, greatest(coalesce(confidence, 0), 0.35))')} AS confidence, {R('comp_score')} AS comp_score, axis_dist, {R('prominence')} AS prominence, {R('thickness')} AS thickness FROM n"""))
def apex_candidates(spark, folder):
    out = E.apex_candidates(_apexes(spark, folder), cands(spark, folder))
    return out.select("sample_id", "col", "y", r("confidence").alias("confidence"), r("comp_score").alias("comp_score"), "axis_dist", r("prominence").alias("prominence"), r("thickness").alias("thickness"))


# spans of two fifths of the height and runs of three columns, as the pictures are narrow
TREND = {"sigma": 6.0, "share": 0.6, "run": 3, "most": 0.9}


def trend_sql(source: str) -> str:
    return f"""t0 AS (SELECT s.sample_id, s.col, CAST(min(f.y) AS DOUBLE) AS top_y, coalesce(max(f.y) - min(f.y), 0) > 36 AS wide FROM spine s LEFT JOIN {source} f USING (sample_id, col) GROUP BY 1, 2),
    t1 AS (SELECT *, wide AND count(*) FILTER (wide) OVER (PARTITION BY sample_id) <= 0.9 * 64 AS w, count(top_y) OVER (PARTITION BY sample_id) AS tops,
      last_value(CASE WHEN top_y IS NOT NULL THEN col END IGNORE NULLS) OVER a AS bc, last_value(top_y IGNORE NULLS) OVER a AS bv,
      last_value(CASE WHEN top_y IS NOT NULL THEN col END IGNORE NULLS) OVER d AS ac, last_value(top_y IGNORE NULLS) OVER d AS av FROM t0
      WINDOW a AS (PARTITION BY sample_id ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (PARTITION BY sample_id ORDER BY col DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    t2 AS (SELECT sample_id, col, count(*) FILTER (w) OVER (PARTITION BY sample_id ORDER BY col RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 3 AS wide,
      CASE WHEN top_y IS NOT NULL THEN top_y WHEN tops < 2 THEN 0 WHEN bv IS NULL THEN av WHEN av IS NULL THEN bv ELSE bv + (av - bv) / (ac - bc) * (col - bc) END AS v FROM t1),
    kern AS (SELECT CAST(j AS INT) AS j, exp(-0.5 * pow(j / 6.0, 2)) / sum(exp(-0.5 * pow(j / 6.0, 2))) OVER () AS g FROM range(-24, 25) k(j)),
    sm AS (SELECT a.sample_id, a.col, sum(g * b.v) AS trend_y FROM t2 a, kern JOIN t2 b ON b.sample_id = a.sample_id AND b.col = CASE WHEN a.col + j < 0 THEN -1 - a.col - j WHEN a.col + j > 63 THEN 127 - a.col - j ELSE a.col + j END GROUP BY 1, 2)"""


@register("band_trend", "K20", oracle("candidates", HINTED + ", " + SPINE + ", " + trend_sql("final") + f"""
    SELECT sample_id, col, wide, {R('trend_y')} AS trend_y FROM t2 JOIN sm USING (sample_id, col)"""))
def band_trend(spark, folder):
    return E.band_trend(_final(spark, folder), WIDTH, HEIGHT, **TREND).select("sample_id", "col", "wide", r("trend_y").alias("trend_y"))


@register("trend_path", "K19 K20", oracle("candidates trace", HINTED + ", " + APEX_SQL + """,
    an AS (SELECT a.sample_id, a.col, a.y, c.confidence, c.comp_score FROM apexes a LEFT JOIN candidates c USING (sample_id, col) WHERE reason = 'added'
      QUALIFY row_number() OVER (PARTITION BY a.sample_id, a.col ORDER BY abs(c.y - a.y), c.confidence DESC, c.cand_id) = 1),
    both_ AS (SELECT sample_id, col, y, rank, least(confidence, 1) AS confidence, comp_score, source FROM final
      UNION ALL SELECT sample_id, col, y, 9, least(0.95, greatest(coalesce(confidence, 0), 0.35)), comp_score, 'peak_apex' FROM an), """ + trend_sql("both_") + """,
    paths AS (SELECT b.*, CASE WHEN t2.wide THEN 0.08 * abs(b.y - trend_y) ELSE CAST(0 AS DOUBLE) END AS trend_cost FROM both_ b JOIN t2 USING (sample_id, col) JOIN sm USING (sample_id, col)
      QUALIFY NOT t2.wide OR row_number() OVER (PARTITION BY b.sample_id, b.col ORDER BY b.y, rank) <= greatest(3, floor(0.4 * count(*) OVER (PARTITION BY b.sample_id, b.col)))), """ + PATH_SQL + f"""
    SELECT t.sample_id, t.col, b.best.y AS y, {R('b.best.cost', 4)} AS cost FROM trace t LEFT JOIN bk b ON b.sample_id = t.sample_id AND b.col = t.col"""))
def trend_path(spark, folder):
    """Cheapest path with apex candidates among the rows and the trend of wide bands."""
    raw = cands(spark, folder)
    apexes = Q.settle(E.apex_candidates(_apexes(spark, folder), raw))
    final = _final(spark, folder).select("sample_id", "col", "y", "rank", F.least("confidence", F.lit(1.0)).alias("confidence"), "comp_score", "source")
    both = final.unionByName(apexes.select("sample_id", "col", "y", F.lit(C.KEEP_FINAL + 1).alias("rank"), "confidence", "comp_score", "source"))
    both = Q.settle(both)
    held = E.held_to_trend(both, E.band_trend(both, WIDTH, HEIGHT, **TREND))
    return Q.min_cost_path(held, I.trace(spark, folder), WIDTH, HEIGHT).select("sample_id", "col", "y", r("cost", 4).alias("cost"))


EVIDENCE_SQL = SCORED + """,
    ev AS (SELECT k.*, k.confidence + 0.25 * (SELECT count(*) FROM kept o WHERE o.sample_id = k.sample_id AND o.col = k.col AND abs(o.y - k.y) <= 2) / count(*) OVER w
      + 0.25 * (CASE WHEN EXISTS (SELECT 1 FROM candidates o WHERE o.sample_id = k.sample_id AND o.col = k.col - 1 AND abs(o.y - k.y) <= 3) THEN 0.5 ELSE 0 END
        + CASE WHEN EXISTS (SELECT 1 FROM candidates o WHERE o.sample_id = k.sample_id AND o.col = k.col + 1 AND abs(o.y - k.y) <= 3) THEN 0.5 ELSE 0 END)
      + 0.05 * least(1, greatest(0, comp_score / 10)) AS evidence,
      CAST(least(3, floor((y - min(y) OVER w) * 4 / greatest(max(y) OVER w - min(y) OVER w, 1))) AS INT) AS y_bin, y < 12 AS up FROM kept k WINDOW w AS (PARTITION BY sample_id, col)),
    p0 AS (SELECT *, row_number() OVER (PARTITION BY sample_id, col, y_bin ORDER BY round(evidence, 9) DESC, rank_score DESC, cand_id) AS b FROM ev),
    p1 AS (SELECT *, row_number() OVER (PARTITION BY sample_id, col ORDER BY CASE WHEN b <= 1 THEN 0 ELSE 1 END, CASE WHEN b <= 1 THEN y_bin END, rank_score DESC, cand_id) <= 5 AS sel FROM p0),
    p2 AS (SELECT *, greatest(0, least(count(*) FILTER (sel AND up) OVER w - floor(count(*) FILTER (sel) OVER w * (0.3 + 1e-12)), count(*) FILTER (sel AND up) OVER w - 1, count(*) FILTER (NOT sel AND NOT up) OVER w)) AS swaps,
      row_number() OVER (PARTITION BY sample_id, col, sel, up ORDER BY rank_score, cand_id DESC) AS leave, row_number() OVER (PARTITION BY sample_id, col, sel, up ORDER BY round(evidence, 9) DESC, rank_score DESC, cand_id) AS enter
      FROM p1 WINDOW w AS (PARTITION BY sample_id, col))"""


@register("evidence_pick", "K7", oracle("candidates", EVIDENCE_SQL + f"""
    SELECT sample_id, col, cand_id, {R('evidence')} AS evidence, row_number() OVER (PARTITION BY sample_id, col ORDER BY rank_score DESC, cand_id) AS rank FROM p2
    WHERE CASE WHEN sel THEN NOT up OR leave > swaps ELSE NOT up AND enter <= swaps END"""))
def evidence_pick(spark, folder):
    raw = cands(spark, folder)
    kept = C.envelope_bonus(raw).where(F.col("confidence") >= C.MIN_CONFIDENCE)
    out = E.evidence_pick(kept, raw, HEIGHT, keep=5, bins=4, upper_cap=0.3)
    return out.select("sample_id", "col", "cand_id", r("evidence").alias("evidence"), "rank")


@register("evidence_quota", "K12", oracle("candidates", HINTED + """,
    qs AS (SELECT c.*, confidence + 0.25 * (SELECT count(*) FROM candidates o WHERE o.sample_id = c.sample_id AND o.col = c.col AND abs(o.y - c.y) <= 2) / count(*) OVER (PARTITION BY sample_id, col) + 0.12 AS q FROM candidates c),
    qf AS (SELECT sample_id, col, cand_id, row_number() OVER (PARTITION BY sample_id, col ORDER BY round(q, 9) DESC, confidence DESC, cand_id) AS place FROM qs WHERE y >= 12 QUALIFY place <= 2),
    u AS (SELECT *, 0 AS turn FROM qf UNION ALL SELECT sample_id, col, cand_id, rank, 1 FROM final ANTI JOIN qf USING (sample_id, col, cand_id))
    SELECT sample_id, col, cand_id, turn = 0 AS by_quota, row_number() OVER (PARTITION BY sample_id, col ORDER BY turn, place) AS rank FROM u QUALIFY rank <= 8"""))
def evidence_quota(spark, folder):
    return E.evidence_quota(_final(spark, folder), cands(spark, folder), HEIGHT).select("sample_id", "col", "cand_id", "by_quota", "rank")


CONTINUITY_SQL = """nb AS (SELECT c.sample_id, c.col, c.cand_id, abs(o.col - c.col) AS d, sign(o.col - c.col) AS side, min(abs(o.y - c.y)) AS j FROM candidates c
      JOIN (SELECT DISTINCT sample_id, col, y FROM candidates) o ON o.sample_id = c.sample_id AND o.col <> c.col AND o.col BETWEEN c.col - 3 AND c.col + 3 AND abs(o.y - c.y) <= 8 GROUP BY 1, 2, 3, 4, 5),
    ns AS (SELECT sample_id, col, cand_id, count(*) AS hits, sum((1 - j / 8.0) / d) AS support, sum(j / CAST(d AS DOUBLE)) AS jumps FROM nb GROUP BY 1, 2, 3),
    cs AS (SELECT c.*, coalesce(hits, 0) AS support_hits, coalesce(support, 0) AS support, coalesce(jumps, 0) / greatest(coalesce(hits, 0), 1) / 8.0 AS jump_penalty,
      (SELECT count(*) FROM candidates o WHERE o.sample_id = c.sample_id AND o.col = c.col AND abs(o.y - c.y) <= 2) / count(*) OVER (PARTITION BY c.sample_id, c.col) AS density
      FROM candidates c LEFT JOIN ns USING (sample_id, col, cand_id)),
    cc AS (SELECT *, confidence + 0.34 * support + 0.12 * density - 0.18 * jump_penalty AS continuity FROM cs)"""


@register("continuity_score", "K13", oracle("candidates", CONTINUITY_SQL + f"""
    SELECT sample_id, col, cand_id, support_hits, {R('support', 8)} AS support, {R('density', 8)} AS density, {R('jump_penalty', 8)} AS jump_penalty, {R('continuity', 8)} AS continuity FROM cc"""))
def continuity_score(spark, folder):
    out = E.continuity_score(cands(spark, folder))
    return out.select("sample_id", "col", "cand_id", F.col("support_hits").cast("long").alias("support_hits"), *[r(c, 8).alias(c) for c in ("support", "density", "jump_penalty", "continuity")])


@register("continuity_quota", "K13", oracle("candidates", HINTED + ", " + CONTINUITY_SQL + """,
    c1 AS (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY sample_id, col, y ORDER BY round(continuity, 9) DESC, confidence DESC, cand_id) = 1),
    qf AS (SELECT sample_id, col, cand_id, row_number() OVER (PARTITION BY sample_id, col ORDER BY round(continuity, 9) DESC, confidence DESC, cand_id) AS place FROM c1 QUALIFY place <= 2),
    u AS (SELECT *, 0 AS turn FROM qf UNION ALL SELECT sample_id, col, cand_id, rank, 1 FROM final ANTI JOIN qf USING (sample_id, col, cand_id))
    SELECT sample_id, col, cand_id, turn = 0 AS by_continuity, row_number() OVER (PARTITION BY sample_id, col ORDER BY turn, place) AS rank FROM u QUALIFY rank <= 8"""))
def continuity_quota(spark, folder):
    return E.continuity_quota(_final(spark, folder), cands(spark, folder)).select("sample_id", "col", "cand_id", "by_continuity", "rank")
