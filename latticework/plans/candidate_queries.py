"""Candidate and path queries."""

from pyspark.sql import functions as F

from latticework.operators import candidates as C
from latticework.operators import paths as Q
from latticework.plans import inputs as I
from latticework.plans.evaluation_queries import GTCOL, _gt_columns
from latticework.plans.inputs import R, oracle
from latticework.plans.registry import r, register

S = ["sample_id"]


def cands(spark, folder):
    """Candidates with confidences in 0..1."""
    return I.candidates(spark, folder)


CONF = """0.35 * exp(-color_dist / 20.0) + 0.20 / (1.0 + exp(-0.8 * (comp_score - 2.0))) + 0.20 * (1.0 - exp(-axis_dist / 6.0))"""


@register("candidate_confidence", "K1", oracle("candidates", f"""
    SELECT sample_id, col, cand_id, {R('0.35 * exp(-color_dist / 20.0)')} AS w_color, {R('0.25 * exp(-abs(y - 25) / 8.0)')} AS w_continuity,
      {R('0.20 / (1.0 + exp(-0.8 * (comp_score - 2.0)))')} AS w_component, {R('0.20 * (1.0 - exp(-axis_dist / 6.0))')} AS w_axis,
      {R('least(1, ' + CONF + ' + 0.25 * exp(-abs(y - 25) / 8.0) + 0.1 * least(confidence, 1))')} AS confidence FROM candidates"""))
def candidate_confidence(spark, folder):
    c = cands(spark, folder)
    terms = C.confidence_terms(F.lit(25.0))
    return c.select("sample_id", "col", "cand_id", *[r(terms[n]).alias(n) for n in ("w_color", "w_continuity", "w_component", "w_axis")],
                    r(C.confidence(F.lit(25.0), F.col("confidence"))).alias("confidence"))


@register("sequential_confidence", "K2", oracle("candidates", f"""
    best AS (SELECT sample_id, col, y, max({CONF}) AS s FROM candidates GROUP BY 1, 2, 3),
    cols AS (SELECT sample_id, col, list({{'y': y, 's': s}} ORDER BY y) AS o, row_number() OVER (PARTITION BY sample_id ORDER BY col) AS k FROM best GROUP BY 1, 2),
    walk AS (SELECT DISTINCT sample_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS INT) AS col, CAST(NULL AS DOUBLE) AS prev_y, CAST(NULL AS DOUBLE) AS top FROM cols
      UNION ALL SELECT c.sample_id, c.k, c.col, w.top, list_sort(list_transform(c.o, lambda x: [-(x.s + CASE WHEN w.top IS NULL THEN 0.25 ELSE 0.25 * exp(-abs(x.y - w.top) / 8.0) END), x.y::DOUBLE]))[1][2]
      FROM walk w JOIN cols c ON c.sample_id = w.sample_id AND c.k = w.k + 1)
    SELECT c.sample_id, c.col, c.cand_id, {R('least(1, ' + CONF + ' + CASE WHEN w.prev_y IS NULL THEN 0.25 ELSE 0.25 * exp(-abs(c.y - w.prev_y) / 8.0) END)')} AS confidence
    FROM candidates c JOIN walk w USING (sample_id, col)"""))
def sequential_confidence(spark, folder):
    return C.sequential_confidence(cands(spark, folder)).select("sample_id", "col", "cand_id", r("confidence").alias("confidence"))


@register("blend_auxiliary", "K3", oracle("candidates", f"""
    SELECT sample_id, col, cand_id, {R('CASE WHEN confidence >= 0.35 THEN least(1, 0.85 * confidence + 0.15 * comp_score / 10) ELSE confidence END')} AS confidence FROM candidates"""))
def blend_auxiliary(spark, folder):
    out = C.blend_auxiliary(cands(spark, folder).withColumn("aux", F.col("comp_score") / 10), 0.15, 0.35)
    return out.select("sample_id", "col", "cand_id", r("confidence").alias("confidence"))


@register("auxiliary_summary", "K3", oracle("candidates", f"""
    SELECT sample_id, {R('avg(confidence)')} AS mean_base_conf, {R('avg(CASE WHEN confidence >= 0.35 THEN least(1, 0.85 * confidence + 0.15 * comp_score / 10) ELSE confidence END)')} AS mean_final_conf,
      {R('avg(comp_score / 10)')} AS mean_contrast_bonus, count(*) AS num_candidates, count(*) FILTER (confidence >= 0.35) AS num_bonus_applied, count(*) FILTER (confidence < 0.35) AS num_base_conf_too_low
    FROM candidates GROUP BY 1"""))
def auxiliary_summary(spark, folder):
    out = C.auxiliary_summary(C.blend_auxiliary(cands(spark, folder).withColumn("aux", F.col("comp_score") / 10), 0.15, 0.35), 0.35)
    return out.withColumns({c: r(c) for c in ("mean_base_conf", "mean_final_conf", "mean_contrast_bonus")})


SCORED = """scored AS (SELECT *, confidence + CASE WHEN count(*) OVER w >= 8 AND max(y) OVER w - min(y) OVER w >= 4
      THEN 0.35 * exp(-(y - min(y) OVER w) / 6.0) ELSE 0 END AS rank_score FROM candidates WINDOW w AS (PARTITION BY sample_id, col)),
    kept AS (SELECT * FROM scored WHERE confidence >= 0.25),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id, col ORDER BY rank_score DESC, cand_id) AS rank FROM kept)"""


@register("candidate_topk", "K4", oracle("candidates", SCORED + f"""
    SELECT sample_id, col, cand_id, y, {R('rank_score')} AS rank_score, rank FROM ranked WHERE rank <= 16"""))
def candidate_topk(spark, folder):
    return C.filter_top(cands(spark, folder)).select("sample_id", "col", "cand_id", "y", r("rank_score").alias("rank_score"), "rank")


@register("neighbour_bonus", "K5", oracle("candidates", f"""
    t AS (SELECT sample_id, col, y FROM candidates QUALIFY row_number() OVER (PARTITION BY sample_id, col ORDER BY confidence DESC, cand_id) = 1),
    ref AS (SELECT sample_id, col, median(y) AS m FROM (SELECT sample_id, col - 1 AS col, y FROM t UNION ALL SELECT sample_id, col + 1, y FROM t) GROUP BY 1, 2)
    SELECT c.sample_id, c.col, c.cand_id, {R('coalesce(0.09 * exp(-abs(c.y - m) / 14.0), 0)')} AS neighbour_bonus FROM candidates c LEFT JOIN ref USING (sample_id, col)"""))
def neighbour_bonus(spark, folder):
    return C.neighbour_bonus(cands(spark, folder)).select("sample_id", "col", "cand_id", r("neighbour_bonus").alias("neighbour_bonus"))


@register("column_rank_norm", "K6", oracle("candidates", f"""
    SELECT sample_id, col, cand_id, {R('CASE WHEN count(*) OVER c <= 1 THEN 1 ELSE (count(*) OVER c - row_number() OVER w) / (count(*) OVER c - 1) END')} AS confidence_rank
    FROM candidates WINDOW w AS (PARTITION BY sample_id, col ORDER BY confidence DESC, cand_id), c AS (PARTITION BY sample_id, col)"""))
def column_rank_norm(spark, folder):
    return C.column_rank_norm(cands(spark, folder)).select("sample_id", "col", "cand_id", r("confidence_rank").alias("confidence_rank"))


@register("source_quota", "K8", oracle("candidates", SCORED + """,
    tagged AS (SELECT *, row_number() OVER (PARTITION BY sample_id, col, source = 'raw' ORDER BY CASE WHEN rank <= 16 THEN 0 ELSE 1 END, confidence DESC, cand_id) AS pool FROM ranked),
    want AS (SELECT * FROM tagged WHERE rank <= 16 OR (source = 'raw' AND pool <= 2))
    SELECT sample_id, col, cand_id, row_number() OVER (PARTITION BY sample_id, col ORDER BY CASE WHEN source = 'raw' THEN 0 ELSE 1 END, confidence DESC, cand_id) AS rank
    FROM want QUALIFY rank <= 16""".replace("QUALIFY rank <= 16", "QUALIFY row_number() OVER (PARTITION BY sample_id, col ORDER BY CASE WHEN source = 'raw' THEN 0 ELSE 1 END, confidence DESC, cand_id) <= 16")))
def source_quota(spark, folder):
    return C.source_quota(cands(spark, folder)).select("sample_id", "col", "cand_id", "rank")


@register("y_diversity", "K9", oracle("candidates", SCORED + """,
    b AS (SELECT *, least(7, greatest(0, CAST(floor((y - min(y) OVER w) * 8.0 / greatest(1, max(y) OVER w - min(y) OVER w + 1)) AS INT))) AS y_bin FROM ranked WINDOW w AS (PARTITION BY sample_id, col))
    SELECT sample_id, col, cand_id, y_bin, rank FROM b WHERE rank <= 16"""))
def y_diversity(spark, folder):
    return C.y_diversity(cands(spark, folder)).select("sample_id", "col", "cand_id", "y_bin", "rank")


FILL = """rowsx AS (SELECT t.sample_id, t.col, u.uy FROM trace t LEFT JOIN (SELECT sample_id, col, min(c.y)::DOUBLE AS uy FROM candidates c JOIN trace h USING (sample_id, col) WHERE h.y IS NOT NULL GROUP BY 1, 2) u USING (sample_id, col)),
    mk AS (SELECT *, (SELECT max(o.col) FROM rowsx o WHERE o.sample_id = e.sample_id AND o.uy IS NOT NULL AND o.col BETWEEN e.col - 3 AND e.col - 1) AS lc,
      (SELECT min(o.col) FROM rowsx o WHERE o.sample_id = e.sample_id AND o.uy IS NOT NULL AND o.col BETWEEN e.col + 1 AND e.col + 3) AS rc FROM rowsx e WHERE uy IS NULL),
    v AS (SELECT m.sample_id, m.col, lc, rc, a.uy AS ly, b.uy AS ry, a2.uy AS ly2, b2.uy AS ry2 FROM mk m
      LEFT JOIN rowsx a ON a.sample_id = m.sample_id AND a.col = lc LEFT JOIN rowsx b ON b.sample_id = m.sample_id AND b.col = rc
      LEFT JOIN rowsx a2 ON a2.sample_id = m.sample_id AND a2.col = lc - 1 LEFT JOIN rowsx b2 ON b2.sample_id = m.sample_id AND b2.col = rc + 1),
    f AS (SELECT *, CASE WHEN ly IS NOT NULL AND ry IS NOT NULL THEN ly + (col - lc) / CAST(rc - lc AS DOUBLE) * (ry - ly) WHEN ly IS NOT NULL AND ly2 IS NOT NULL THEN ly + (ly - ly2) * (col - lc)
        WHEN ly IS NOT NULL THEN ly WHEN ry IS NOT NULL AND ry2 IS NOT NULL THEN ry - (ry2 - ry) * (rc - col) ELSE ry END AS raw,
      CASE WHEN ly IS NOT NULL AND ry IS NOT NULL THEN 'interpolated' WHEN ly IS NOT NULL AND ly2 IS NOT NULL THEN 'neighbor_left_extrap' WHEN ly IS NOT NULL THEN 'neighbor_left'
        WHEN ry IS NOT NULL AND ry2 IS NOT NULL THEN 'neighbor_right_extrap' WHEN ry IS NOT NULL THEN 'neighbor_right' END AS source FROM v)"""


@register("column_fill", "K10", oracle("candidates trace", FILL + """
    SELECT sample_id, col, CASE WHEN raw IS NOT NULL THEN CAST(least(greatest(round_even(raw, 0), 0), 59) AS INT) END AS y, CASE WHEN source = 'interpolated' THEN CAST(0.3 AS DOUBLE) WHEN source IS NOT NULL THEN CAST(0.25 AS DOUBLE) END AS confidence, source FROM f"""))
def column_fill(spark, folder):
    """Columns without a trace value count as empty."""
    t = I.trace(spark, folder)
    c = cands(spark, folder).join(t.where("y IS NOT NULL").select("sample_id", "col"), ["sample_id", "col"], "left_semi")
    return C.column_fill(c, t, 60)


HINTED = """hints AS (SELECT sample_id, col, avg(y) AS hint FROM candidates WHERE source = 'skeleton' GROUP BY 1, 2),
    ps AS (SELECT c.*, confidence + coalesce(0.16 * exp(-abs(y - hint) / 11.0), 0) AS pick_score FROM candidates c LEFT JOIN hints USING (sample_id, col)),
    ded AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY sample_id, col, round_even(comp_score, 2) ORDER BY pick_score DESC, cand_id) = 1),
    final AS (SELECT *, row_number() OVER (PARTITION BY sample_id, col ORDER BY pick_score DESC, cand_id) AS rank FROM ded QUALIFY row_number() OVER (PARTITION BY sample_id, col ORDER BY pick_score DESC, cand_id) <= 8)"""


def _final(spark, folder, keep=C.KEEP_FINAL):
    c = cands(spark, folder)
    hints = c.where("source = 'skeleton'").groupBy("sample_id", "col").agg(F.avg("y").alias("hint"))
    return C.final_pick(c, hints, keep)


@register("candidate_final", "K11", oracle("candidates", HINTED + f" SELECT sample_id, col, cand_id, {R('pick_score')} AS pick_score, rank FROM final"))
def candidate_final(spark, folder):
    return _final(spark, folder).select("sample_id", "col", "cand_id", r("pick_score").alias("pick_score"), "rank")


@register("dedupe_height", "K14", oracle("candidates", """SELECT sample_id, col, y, cand_id, confidence FROM candidates
    QUALIFY row_number() OVER (PARTITION BY sample_id, col, y ORDER BY confidence DESC, cand_id) = 1"""))
def dedupe_height(spark, folder):
    return C.dedupe_height(cands(spark, folder)).select("sample_id", "col", "y", "cand_id", "confidence")


CHAIN = """lv AS (SELECT DISTINCT sample_id, col, y FROM SRC), op AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY sample_id, col ORDER BY y) <= 3 THEN 0 ELSE 1 END AS o FROM lv),
    ch AS (SELECT *, sum(o) OVER (PARTITION BY sample_id, col ORDER BY y) AS g FROM op),
    mg AS (SELECT c.sample_id, c.col, g, arg_max(row(c.y, confidence), row(confidence, -c.y, -cand_id)) AS b, count(*) AS members,
      array_to_string(list_sort(list(DISTINCT source)), '+') AS source FROM SRC c JOIN ch USING (sample_id, col, y) GROUP BY 1, 2, 3)"""


@register("merge_heights", "K15", oracle("candidates", CHAIN.replace("SRC", "candidates") + """
    SELECT sample_id, col, b[1] AS y, b[2] AS confidence, members, source FROM mg"""))
def merge_heights(spark, folder):
    return C.merge_heights(cands(spark, folder), 3)


@register("second_recipe", "K16", oracle("candidates", "good AS (SELECT * FROM candidates WHERE confidence >= 0.3 AND comp_score >= 2), " + CHAIN.replace("SRC", "good") + """
    SELECT sample_id, col, b[1] AS y, b[2] AS confidence, row_number() OVER (PARTITION BY sample_id, col ORDER BY b[2] DESC, b[1]) AS rank FROM mg
    QUALIFY row_number() OVER (PARTITION BY sample_id, col ORDER BY b[2] DESC, b[1]) <= 12"""))
def second_recipe(spark, folder):
    return C.second_recipe(cands(spark, folder), 0.3, 2.0, 3).select("sample_id", "col", "y", "confidence", "rank")


@register("stage_counts", "K17", oracle("candidates trace", HINTED + ", " + SCORED + f""", n AS (SELECT sample_id, count(*) AS t FROM trace GROUP BY 1),
    a AS (SELECT sample_id, count(*) AS raw_rows, count(DISTINCT col) AS raw_columns FROM candidates GROUP BY 1),
    b AS (SELECT sample_id, count(*) AS filtered_rows, count(DISTINCT col) AS filtered_columns FROM ranked WHERE rank <= 16 GROUP BY 1),
    c AS (SELECT sample_id, count(*) AS final_rows, count(DISTINCT col) AS final_columns FROM final GROUP BY 1)
    SELECT sample_id, t AS total_columns, raw_rows, raw_columns, coalesce(filtered_rows, 0) AS filtered_rows, coalesce(filtered_columns, 0) AS filtered_columns, final_rows, final_columns,
      {R('1 - final_columns / CAST(t AS DOUBLE)')} AS missing_column_ratio FROM n JOIN a USING (sample_id) LEFT JOIN b USING (sample_id) JOIN c USING (sample_id)"""))
def stage_counts(spark, folder):
    c = cands(spark, folder)
    out = C.stage_counts(c, C.filter_top(c), _final(spark, folder), I.trace(spark, folder))
    return out.withColumn("missing_column_ratio", r("missing_column_ratio"))


MARGIN = """mr AS (SELECT sample_id, col, confidence AS c1, lead(confidence) OVER w AS c2, row_number() OVER w AS k FROM candidates WINDOW w AS (PARTITION BY sample_id, col ORDER BY confidence DESC, cand_id)),
    mar AS (SELECT sample_id, col, c1 - coalesce(c2, 0) AS margin FROM mr WHERE k = 1)"""


@register("candidate_margins", "K18 K52", oracle("candidates", MARGIN + f""", mc AS (SELECT sample_id, avg(confidence) AS mean_confidence, count(*) AS n FROM candidates GROUP BY 1)
    SELECT sample_id, count(margin) AS count, {R('avg(margin)', 8)} AS mean, {R('quantile_cont(margin, 0.1)')} AS p10, {R('median(margin)')} AS p50, {R('quantile_cont(margin, 0.9)')} AS p90,
      {R('any_value(mean_confidence)')} AS mean_confidence, any_value(n) AS n FROM mar JOIN mc USING (sample_id) GROUP BY 1"""))
def candidate_margins(spark, folder):
    c = cands(spark, folder)
    out = C.margin_distribution(c).join(C.mean_confidence(c), "sample_id")
    return out.select("sample_id", "count", "n", r("mean", 8).alias("mean"), *[r(x).alias(x) for x in ("p10", "p50", "p90", "mean_confidence")])


# the search column by column over lists of states, then the way back; `paths` holds the ranked rows with trend_cost
PATH_SQL = """lv AS (SELECT sample_id, col, y, min(rank) AS rk, arg_max(confidence, rank) AS conf, arg_max(comp_score, rank) AS comp, arg_max(source, rank) AS src, max(trend_cost) AS pull FROM paths GROUP BY 1, 2, 3),
    lc AS (SELECT t.sample_id, max(t.col) AS cut FROM trace t JOIN (SELECT sample_id, max(col) AS e FROM lv GROUP BY 1) m ON m.sample_id = t.sample_id AND t.col < m.e
      WHERE NOT EXISTS (SELECT 1 FROM lv WHERE lv.sample_id = t.sample_id AND lv.col = t.col) GROUP BY 1),
    co AS (SELECT sample_id, col, list({'rk': rk, 'y': CAST(y AS INT), 'doubt': 0.88 * (1 - conf) + pull, 'comp': comp, 'step': CASE WHEN src = 'peak_apex' THEN 0.35 ELSE 1.0 END,
        'border': CASE WHEN least(y, 59 - y) >= 12 THEN 0 ELSE 3.0 * (1 - least(y, 59 - y) / 12.0) END} ORDER BY rk) AS opts, row_number() OVER (PARTITION BY sample_id ORDER BY col) AS k
      FROM lv LEFT JOIN lc USING (sample_id) WHERE cut IS NULL OR col > cut GROUP BY 1, 2),
    wk AS (SELECT sample_id, k, col, list_transform(opts, lambda o: {'cost': CAST(o.doubt + o.border AS DOUBLE), 'rk': o.rk, 'y': o.y, 'prev': CAST(NULL AS INT), 'comp': o.comp}) AS st FROM co WHERE k = 1
      UNION ALL SELECT c.sample_id, c.k, c.col, list_transform(c.opts, lambda o: list_transform([coalesce(
        list_min(list_transform(list_filter(w.st, lambda s: abs(o.y - s.y) <= 28), lambda s: {'cost': s.cost + (o.step * abs(o.y - s.y) + CASE WHEN s.prev IS NULL THEN 0 ELSE 0.2 * abs((o.y - s.y) - (s.y - s.prev)) END
          + o.doubt + CASE WHEN abs(o.comp - s.comp) > 0.58 THEN 1.2 ELSE 0 END + o.border), 'f': s.rk, 'p': s.y})),
        list_transform([list_min(list_transform(w.st, lambda s: {'cost': s.cost, 'f': s.rk, 'p': s.y}))], lambda m: {'cost': m.cost + o.doubt + o.step * abs(o.y - m.p), 'f': m.f, 'p': m.p})[1])],
        lambda b: {'cost': CAST(b.cost AS DOUBLE), 'rk': o.rk, 'y': o.y, 'prev': b.p, 'comp': o.comp})[1]) FROM wk w JOIN co c ON c.sample_id = w.sample_id AND c.k = w.k + 1),
    bk AS (SELECT sample_id, k, col, list_min(st) AS best FROM wk QUALIFY k = max(k) OVER (PARTITION BY sample_id)
      UNION ALL SELECT w.sample_id, w.k, w.col, list_filter(w.st, lambda z: z.y = b.best.prev)[1] FROM bk b JOIN wk w ON w.sample_id = b.sample_id AND w.k = b.k - 1 WHERE b.best.prev IS NOT NULL)"""


@register("min_cost_path", "K19", oracle("candidates trace", HINTED + """,
    paths AS (SELECT * REPLACE (least(confidence, 1) AS confidence), CAST(0 AS DOUBLE) AS trend_cost FROM final), """ + PATH_SQL + f"""
    SELECT t.sample_id, t.col, b.best.y AS y, {R('b.best.cost', 4)} AS cost FROM trace t LEFT JOIN bk b ON b.sample_id = t.sample_id AND b.col = t.col"""))
def min_cost_path(spark, folder):
    final = _final(spark, folder).withColumn("confidence", F.least("confidence", F.lit(1.0)))
    out = Q.min_cost_path(final, I.trace(spark, folder), 64, 60)
    return out.select("sample_id", "col", "y", r("cost", 4).alias("cost"))


@register("apex_pull", "K21", oracle("candidates trace", """
    b AS (SELECT sample_id, col, max(confidence) AS best FROM candidates GROUP BY 1, 2),
    s AS (SELECT c.sample_id, c.col, t.y AS py, min(CASE WHEN c.y < t.y AND confidence >= best - 0.22 THEN c.y END) AS a, min(CASE WHEN confidence >= 0.3 AND c.y < t.y - 6 THEN c.y END) AS z
      FROM candidates c JOIN b USING (sample_id, col) JOIN trace t USING (sample_id, col) WHERE t.y IS NOT NULL GROUP BY 1, 2, 3)
    SELECT t.sample_id, t.col, CAST(CASE WHEN s.py - coalesce(a, z) <= 30 THEN coalesce(a, z) ELSE t.y END AS DOUBLE) AS y_pulled FROM trace t LEFT JOIN s USING (sample_id, col)"""))
def apex_pull(spark, folder):
    return Q.apex_pull(I.trace(spark, folder), cands(spark, folder), most=30).select("sample_id", "col", F.col("y_pulled").cast("double").alias("y_pulled"))


@register("path_blocks", "K22 K23", oracle("candidates trace", f"""
    st AS (SELECT sample_id, col, y + confidence * 10 + cand_id % 1000 / 1000.0 AS cost FROM candidates),
    e AS (SELECT sample_id, col // 16 AS block, max(col) AS ce, min(col) AS cs FROM st GROUP BY 1, 2),
    k AS (SELECT s.sample_id, e.block, cost, row_number() OVER (PARTITION BY s.sample_id, e.block ORDER BY cost) AS rk FROM st s JOIN e ON e.sample_id = s.sample_id AND s.col = e.ce),
    cs AS (SELECT t.sample_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM candidates c WHERE c.sample_id = t.sample_id AND c.col = t.col)) AS starvation_columns,
      count(*) FILTER (EXISTS (SELECT 1 FROM st c WHERE c.sample_id = t.sample_id AND c.col = t.col)) AS ok_columns FROM trace t GROUP BY 1)
    SELECT e.sample_id, CAST(e.block AS INT) AS block, cs AS block_start, ce AS block_end, {R('max(cost) FILTER (rk = 1)', 4)} AS top1_cost, {R('max(cost) FILTER (rk = 2) - max(cost) FILTER (rk = 1)', 4)} AS margin,
      any_value(starvation_columns) AS starvation_columns, any_value(ok_columns) AS ok_columns
    FROM e JOIN k USING (sample_id, block) JOIN cs USING (sample_id) GROUP BY 1, 2, 3, 4""".replace("cs AS (SELECT t.sample_id", "stt AS (SELECT t.sample_id").replace("JOIN cs USING", "JOIN stt USING")))
def path_blocks(spark, folder):
    c = cands(spark, folder)
    states = c.select("sample_id", "col", (F.col("y") + F.col("confidence") * 10 + F.col("cand_id") % 1000 / 1000.0).alias("cost"))
    status = Q.column_status(I.trace(spark, folder), c, states)
    out = Q.block_stats(states, 16).join(status, "sample_id")
    return out.select("sample_id", "block", "block_start", "block_end", r("top1_cost", 4).alias("top1_cost"), r("margin", 4).alias("margin"), "starvation_columns", "ok_columns")


@register("path_costs", "K24", oracle("candidates trace", f"""
    own AS (SELECT sample_id, col, y, max(confidence) AS conf, max(comp_score) AS comp FROM candidates GROUP BY 1, 2, 3),
    p AS (SELECT t.sample_id, t.col, t.y, conf, comp, lag(t.y) OVER w AS y1, lag(t.y, 2) OVER w AS y2, lag(comp) OVER w AS c1 FROM trace t LEFT JOIN own o ON o.sample_id = t.sample_id AND o.col = t.col AND o.y = t.y
      WINDOW w AS (PARTITION BY t.sample_id ORDER BY t.col))
    SELECT sample_id, col, y, abs(y - y1) AS transition_cost, {R('coalesce(0.2 * abs(y - 2 * y1 + y2), 0)')} AS curvature_cost, {R('0.88 * (1 - conf)')} AS confidence_cost,
      CASE WHEN abs(comp - c1) > 0.58 THEN CAST(1.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS component_switch_cost, {R('CASE WHEN least(y, 59 - y) >= 12 THEN 0 ELSE 3 * (1 - least(y, 59 - y) / 12.0) END')} AS border_cost
    FROM p WHERE y IS NOT NULL AND y1 IS NOT NULL"""))
def path_costs(spark, folder):
    out = Q.path_costs(I.trace(spark, folder), cands(spark, folder), 60)
    return out.select("sample_id", "col", "y", "transition_cost", "component_switch_cost", *[r(x).alias(x) for x in ("curvature_cost", "confidence_cost", "border_cost")])


def runs_sql(src: str, mask: str, name: str, least: int) -> str:
    return f"""{name}_h AS (SELECT sample_id, col, col - row_number() OVER (PARTITION BY sample_id ORDER BY col) AS g FROM {src} WHERE {mask}),
    {name}_r AS (SELECT sample_id, g, min(col) AS c0, max(col) AS c1, count(*) AS len FROM {name}_h GROUP BY 1, 2 HAVING count(*) >= {least}),
    {name} AS (SELECT sample_id, max(len) AS longest, count(*) AS runs FROM {name}_r GROUP BY 1)"""


@register("path_monitor", "K26 K25", oracle("trace", """
    m AS (SELECT sample_id, col, y, median(y) OVER w AS med, CASE WHEN count(y) OVER w >= 4 THEN quantile_cont(y, 0.75) OVER w - quantile_cont(y, 0.25) OVER w ELSE stddev_pop(y) OVER w END AS iqr
      FROM trace WINDOW w AS (PARTITION BY sample_id ORDER BY col ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
    rs AS (SELECT *, y - med AS rd FROM m),
    li AS (SELECT *, CASE WHEN count(rd) OVER w >= 4 THEN quantile_cont(rd, 0.75) OVER w - quantile_cont(rd, 0.25) OVER w ELSE stddev_pop(rd) OVER w END AS riqr
      FROM rs WINDOW w AS (PARTITION BY sample_id ORDER BY col ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
    gm AS (SELECT sample_id, median(rd) AS gmed, stddev_pop(rd) AS gsd FROM rs GROUP BY 1), gd AS (SELECT r.sample_id, median(abs(rd - gmed)) AS gmad, any_value(gsd) AS gsd FROM rs r JOIN gm USING (sample_id) GROUP BY 1),
    zs AS (SELECT l.*, abs(rd / greatest(coalesce(riqr / 1.349, CASE WHEN 1.4826 * gmad < 1e-6 THEN gsd ELSE 1.4826 * gmad END), 1.0)) AS z FROM li l JOIN gd USING (sample_id)),
    st AS (SELECT sample_id, col, abs(y - lag(y) OVER w) AS dy, abs(y - 2 * lag(y) OVER w + lag(y, 2) OVER w) AS ddy FROM trace WINDOW w AS (PARTITION BY sample_id ORDER BY col)),
    me AS (SELECT sample_id, median(dy) AS m1, median(ddy) AS m2 FROM st GROUP BY 1),
    md AS (SELECT s.sample_id, any_value(m1) + 3 * 1.4826 * median(abs(dy - m1)) AS t1, any_value(m2) + 3 * 1.4826 * median(abs(ddy - m2)) AS t2 FROM st s JOIN me USING (sample_id) GROUP BY 1),
    jp AS (SELECT s.sample_id, s.col, coalesce(dy >= CASE WHEN t1 < 1 THEN 8 ELSE t1 END, false) OR coalesce(ddy >= CASE WHEN t2 < 1 THEN 12 ELSE t2 END, false) AS j FROM st s JOIN md USING (sample_id)), """
    + runs_sql("m", "y > med + coalesce(iqr, 0) OR y >= 0.85 * 40", "bot", 2) + ", " + runs_sql("zs", "z >= 3", "dri", 2) + ", " + runs_sql("jp", "j", "jum", 1) + f""",
    mz AS (SELECT sample_id, max(z) AS max_z, count(*) AS n FROM zs GROUP BY 1)
    SELECT m.sample_id, n, coalesce(bot.longest, 0) AS bottom_longest, coalesce(bot.runs, 0) AS bottom_runs, coalesce(dri.longest, 0) AS drift_longest, coalesce(dri.runs, 0) AS drift_runs,
      coalesce(jum.longest, 0) AS jump_longest, coalesce(jum.runs, 0) AS jump_runs, {R('max_z')} AS max_z FROM mz m LEFT JOIN bot USING (sample_id) LEFT JOIN dri USING (sample_id) LEFT JOIN jum USING (sample_id)"""))
def path_monitor(spark, folder):
    out = Q.path_monitor(I.trace(spark, folder), 40, 11, 2)
    return out.withColumn("max_z", r("max_z"))


@register("trouble_zones", "K27 K28", oracle("trace", """
    w AS (SELECT sample_id, k * 5 AS c0, k * 5 + 9 AS c1, count(y) / 10.0 AS v FROM trace, range(0, 11) g(k) WHERE col BETWEEN k * 5 AND k * 5 + 9 AND k * 5 + 10 <= 64 GROUP BY 1, 2, 3 HAVING count(y) / 10.0 < 0.85),
    o AS (SELECT *, CASE WHEN c0 <= max(c1) OVER (PARTITION BY sample_id ORDER BY c0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 0 ELSE 1 END AS op FROM w),
    g AS (SELECT *, sum(op) OVER (PARTITION BY sample_id ORDER BY c0) AS z FROM o)
    SELECT sample_id, CAST(min(c0) AS INT) AS col_start, CAST(max(c1) AS INT) AS col_end, 'low_valid_ratio' AS trigger FROM g GROUP BY sample_id, z"""))
def trouble_zones(spark, folder):
    t = I.trace(spark, folder)
    zones = Q.low_coverage_zones(t, 10, 0.85).drop("metric").unionByName(Q.missing_zones(t, 64).drop("metric"))
    return Q.merge_zones(zones, 2).select("sample_id", "col_start", "col_end", "trigger")


@register("block_zones", "K27", oracle("candidates trace", """
    st AS (SELECT sample_id, col, y + confidence * 10 + cand_id % 1000 / 1000.0 AS cost FROM candidates),
    be AS (SELECT sample_id, col // 4 AS block, max(col) AS ce, min(col) AS cs FROM st GROUP BY 1, 2),
    k AS (SELECT s.sample_id, e.block, cost, row_number() OVER (PARTITION BY s.sample_id, e.block ORDER BY cost) AS rk FROM st s JOIN be e ON e.sample_id = s.sample_id AND s.col = e.ce),
    b AS (SELECT e.sample_id, cs, ce, max(cost) FILTER (rk = 1) AS c1, max(cost) FILTER (rk = 2) - max(cost) FILTER (rk = 1) AS margin FROM be e JOIN k USING (sample_id, block) GROUP BY 1, 2, 3),
    i AS (SELECT *, row_number() OVER w - 1 AS bi, c1 - lag(c1) OVER w AS d, count(*) OVER (PARTITION BY sample_id) AS n FROM b WINDOW w AS (PARTITION BY sample_id ORDER BY cs)),
    sb AS (SELECT * FROM i WHERE n >= 6 AND bi >= 3 AND bi <= n - 3 AND d IS NOT NULL),
    us AS (SELECT sample_id, avg(d) AS m, stddev_pop(d) AS s FROM sb GROUP BY 1 HAVING count(*) >= 3),
    hi AS (SELECT sb.*, m FROM sb JOIN us USING (sample_id) WHERE d > m + greatest(2.5 * s, m * 0.3)),
    sz AS (SELECT h.sample_id, h.cs, h.ce, any_value(h.d) / greatest(any_value(h.m), 0.01) AS metric FROM hi h LEFT JOIN trace t ON t.sample_id = h.sample_id AND t.col BETWEEN h.cs AND h.ce
      GROUP BY 1, 2, 3 HAVING count(t.y) / CAST(h.ce - h.cs + 1 AS DOUBLE) < 0.95),
    lw AS (SELECT *, bi - row_number() OVER (PARTITION BY sample_id ORDER BY bi) AS g FROM i WHERE margin < 0.15),
    lz AS (SELECT sample_id, min(cs) AS cs, max(ce) AS ce, count(*) AS metric FROM lw GROUP BY sample_id, g HAVING count(*) >= 2 AND max(bi) < max(n) - 1 AND sum(ce - cs + 1) >= 12)
    SELECT sample_id, 'score_spike' AS trigger, CAST(cs AS INT) AS col_start, CAST(ce AS INT) AS col_end, """ + R("metric", 4) + """ AS metric FROM sz
    UNION ALL SELECT sample_id, 'low_margin_streak', CAST(cs AS INT), CAST(ce AS INT), CAST(metric AS DOUBLE) FROM lz"""))
def block_zones(spark, folder):
    c, t = cands(spark, folder), I.trace(spark, folder)
    states = c.select("sample_id", "col", (F.col("y") + F.col("confidence") * 10 + F.col("cand_id") % 1000 / 1000.0).alias("cost"))
    blocks = Q.block_stats(states, 4)
    zones = Q.spike_zones(t, blocks).withColumn("metric", r("metric", 4)).unionByName(Q.low_margin_zones(blocks))
    return zones.select("sample_id", "trigger", F.col("col_start").cast("int").alias("col_start"), F.col("col_end").cast("int").alias("col_end"), "metric")


EDGE = """zn AS (SELECT sample_id, col, y, 'left' AS side, CASE WHEN col < 5 THEN 'edge' WHEN col >= 10 AND col < 42 THEN 'stable' END AS z, col = 4 AS be, col = 10 AS bs FROM trace WHERE y IS NOT NULL
      UNION ALL SELECT sample_id, col, y, 'right', CASE WHEN col >= 59 THEN 'edge' WHEN col < 54 AND col >= 22 THEN 'stable' END, col = 59, col = 53 FROM trace WHERE y IS NOT NULL),
    ed AS (SELECT sample_id, side, count(*) FILTER (z = 'stable') AS n_stable, count(*) FILTER (z = 'edge') AS n_edge, abs(max(CASE WHEN be THEN y END) - max(CASE WHEN bs THEN y END)) AS jump,
        median(CASE WHEN z = 'stable' THEN y END) AS sm, median(CASE WHEN z = 'edge' THEN y END) AS em, regr_slope(CASE WHEN z = 'stable' THEN y END, col) AS slope, regr_intercept(CASE WHEN z = 'stable' THEN y END, col) AS icpt
      FROM zn WHERE z IS NOT NULL GROUP BY 1, 2),
    mads AS (SELECT zn.sample_id, zn.side, median(abs(zn.y - ed.sm)) AS mad FROM zn JOIN ed ON ed.sample_id = zn.sample_id AND ed.side = zn.side WHERE zn.z = 'stable' GROUP BY 1, 2),
    es AS (SELECT d.*, greatest(1.4826 * mad, 2.0) AS sigma FROM ed d LEFT JOIN mads ON mads.sample_id = d.sample_id AND mads.side = d.side),
    ea AS (SELECT *, em - sm AS dev, coalesce(n_stable >= 12 AND n_edge >= 2 AND abs(em - sm) > greatest(2.0, 0.5 * sigma), false) OR coalesce(jump > greatest(2.0, 0.5 * sigma), false) AS anomaly FROM es)"""


def _edges(spark, folder):
    return Q.edge_anomaly(I.trace(spark, folder), 64, min_dev=2.0, z=0.5, floor=2.0)


@register("edge_anomaly", "K36", oracle("trace", EDGE + f"""
    SELECT sample_id, side, n_stable, n_edge, {R('sm')} AS stable_median, {R('sigma')} AS sigma, {R('dev')} AS deviation, jump, CAST(anomaly AS INT) AS anomaly FROM ea"""))
def edge_anomaly(spark, folder):
    out = _edges(spark, folder)
    return out.select("sample_id", "side", "n_stable", "n_edge", r("stable_median").alias("stable_median"), r("sigma").alias("sigma"), r("deviation").alias("deviation"), "jump", F.col("anomaly").cast("int").alias("anomaly"))


@register("edge_repair", "K38", oracle("trace", EDGE + """,
    bad AS (SELECT * FROM ea WHERE anomaly), tr AS (SELECT *, CASE WHEN col < 5 THEN 'left' WHEN col >= 59 THEN 'right' END AS side FROM trace),
    tg AS (SELECT t.sample_id, t.col, t.y, CASE WHEN n_stable < 3 OR slope IS NULL OR abs(slope) > 4 THEN sm ELSE slope * t.col + icpt END AS tgt, sm FROM tr t
      LEFT JOIN bad ON bad.sample_id = t.sample_id AND bad.side = t.side)
    SELECT sample_id, col, CASE WHEN sm IS NOT NULL AND y IS NOT NULL THEN least(greatest(round_even(y + least(greatest(tgt - y, -40), 40), 0), 0), 59) ELSE y END AS y_repaired FROM tg"""))
def edge_repair(spark, folder):
    return Q.edge_repair(I.trace(spark, folder), _edges(spark, folder), 64, 60).select("sample_id", "col", "y_repaired")


# written from the rule text: plain joins, no shared sums
RISK = """cl AS (SELECT *, least(greatest(confidence, 1e-12), 1.0) AS cf FROM candidates),
    tot AS (SELECT sample_id, col, count(*) AS n, sum(cf) AS s FROM cl GROUP BY 1, 2),
    en AS (SELECT c.sample_id, c.col, -sum(cf / s * ln(cf / s)) AS ent FROM cl c JOIN tot USING (sample_id, col) GROUP BY 1, 2),
    tp AS (SELECT sample_id, col, max(CASE WHEN k = 1 THEN confidence END) AS c1, max(CASE WHEN k = 2 THEN confidence END) AS c2, max(CASE WHEN k = 1 THEN y END) AS y1, max(CASE WHEN k = 2 THEN y END) AS y2,
        max(CASE WHEN k = 1 THEN axis_dist END) AS ax, max(CASE WHEN k = 1 THEN comp_score END) AS comp
      FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, col ORDER BY confidence DESC, cand_id) AS k FROM candidates) WHERE k <= 2 GROUP BY 1, 2),
    sp AS (SELECT sample_id, col, unnest([col - 2, col - 1, col, col + 1, col + 2]) AS j, y, confidence FROM candidates),
    lo AS (SELECT sample_id, j AS col, stddev_pop(y) AS ys, stddev_pop(confidence) AS cs, count(DISTINCT CASE WHEN abs(col - j) = 1 THEN col END) AS beside FROM sp GROUP BY 1, 2),
    sta AS (SELECT sample_id, col, y + confidence * 10 + cand_id % 1000 / 1000.0 AS cost FROM candidates),
    be AS (SELECT sample_id, col // 16 AS block, max(col) AS ce FROM sta GROUP BY 1, 2),
    bk AS (SELECT s.sample_id, e.block, cost, row_number() OVER (PARTITION BY s.sample_id, e.block ORDER BY cost) AS rk FROM sta s JOIN be e ON e.sample_id = s.sample_id AND s.col = e.ce),
    bm AS (SELECT sample_id, block, max(cost) FILTER (rk = 2) - max(cost) FILTER (rk = 1) AS bmargin FROM bk GROUP BY 1, 2),
    pkc AS (SELECT sample_id, arg_min(col, row(y, col)) AS pc FROM trace WHERE y IS NOT NULL GROUP BY 1),
    ft AS (SELECT tp.sample_id, tp.col, n, c1, coalesce(c2, c1) AS c2, c1 - coalesce(c2, c1) AS cm, ent, abs(y1 - coalesce(y2, y1))::DOUBLE AS gap, ax, comp,
        CAST((tp.col > 0)::INT + (tp.col < 63)::INT - beside AS INT) AS empties, coalesce(abs(tp.col - pc) <= 12, false) AS np, ys, lo.cs AS lcs, bmargin, coalesce(bmargin < 0.12, false) AS bl,
        (y1 <= 2 OR y1 >= 57 OR ax < 1.2) AS edge, tp.sample_id % 3 = 0 AS tax
      FROM tp JOIN tot USING (sample_id, col) JOIN en USING (sample_id, col) JOIN lo USING (sample_id, col)
      LEFT JOIN bm ON bm.sample_id = tp.sample_id AND bm.block = tp.col // 16 LEFT JOIN pkc ON pkc.sample_id = tp.sample_id),
    fr AS (SELECT *, list_filter([CASE WHEN cm < 0.08 THEN 'low_conf_margin' END, CASE WHEN n >= 6 AND ent > 1.2 THEN 'high_entropy_many_cands' END, CASE WHEN ax < 2.5 THEN 'axis_proximity_risk' END,
        CASE WHEN gap >= 8 AND cm < 0.15 THEN 'large_y_gap_low_margin' END, CASE WHEN np AND cm < 0.18 THEN 'peak_window_low_margin' END], lambda x: x IS NOT NULL) AS r0,
      list_filter([CASE WHEN bl THEN 'dp_margin_low' END], lambda x: x IS NOT NULL) AS r2 FROM ft),
    fl AS (SELECT *, list_concat(r0, r2) AS rw, list_concat(list_concat(r0, CASE WHEN tax AND (cm < 0.25 OR n >= 4) THEN ['taxonomy_prior'] ELSE [] END), r2) AS rs FROM fr)"""
SEGMENTS = RISK + """,
    dl AS (SELECT sample_id, j AS col, arg_min(CASE WHEN j = c THEN rs ELSE list_append(rs, 'dilated_neighbor') END, row(CASE WHEN j = c THEN 0 ELSE 1 END, c)) AS rs
      FROM (SELECT sample_id, col AS c, rs, unnest(range(col - 3, col + 4)) AS j FROM fl WHERE len(rs) > 0) WHERE j BETWEEN 0 AND 63 GROUP BY 1, 2),
    sg AS (SELECT *, CASE WHEN col - lag(col) OVER (PARTITION BY sample_id ORDER BY col) <= 3 THEN 0 ELSE 1 END AS o FROM dl),
    sq AS (SELECT *, sum(o) OVER (PARTITION BY sample_id ORDER BY col) AS g FROM sg),
    se AS (SELECT sample_id, CAST(min(col) AS INT) AS segment_start, CAST(max(col) AS INT) AS segment_end, CAST(max(col) - min(col) + 1 AS INT) AS segment_len,
        array_to_string(list_sort(list_distinct(flatten(list(rs)))), ';') AS risk_reasons FROM sq GROUP BY sample_id, g HAVING max(col) - min(col) + 1 >= 6)"""


def _risky(spark, folder):
    """Blocks from the candidates' own costs, the highest trace point as peak, every third sample labelled."""
    c, t = cands(spark, folder), I.trace(spark, folder)
    states = c.select("sample_id", "col", (F.col("y") + F.col("confidence") * 10 + F.col("cand_id") % 1000 / 1000.0).alias("cost"))
    peaks = t.where("y IS NOT NULL").groupBy("sample_id").agg(F.min_by("col", F.struct("y", "col")).alias("col"))
    f = Q.risk_features(c, 64, 60, Q.block_stats(states, 16), peaks)
    return f.withColumn("reasons_raw", Q.risk_reasons()).withColumn("reasons", Q.risk_reasons(labelled=F.col("sample_id") % 3 == 0))


@register("risk_features", "K39 K40", oracle("candidates trace", RISK + f"""
    SELECT sample_id, col, n AS candidate_count, {R('c1')} AS top1_conf, {R('c2')} AS top2_conf, {R('cm')} AS conf_margin, {R('ent')} AS conf_entropy, gap AS y_gap, ax AS axis_dist, {R('comp')} AS comp_score, empties AS empty_neighbours,
      CAST(np AS INT) AS near_peak, {R('ys', 4)} AS local_y_std, {R('lcs', 4)} AS local_conf_std, {R('bmargin', 4)} AS block_margin, CAST(edge AS INT) AS boundary_nearby, array_to_string(rs, ';') AS reasons FROM fl"""))
def risk_features(spark, folder):
    return _risky(spark, folder).select(
        "sample_id", "col", "candidate_count", *[r(n).alias(n) for n in ("top1_conf", "top2_conf", "conf_margin", "conf_entropy", "comp_score")], "y_gap", "axis_dist",
        "empty_neighbours", *[F.col(n).cast("int").alias(n) for n in ("near_peak", "boundary_nearby")],
        *[r(n, 4).alias(n) for n in ("local_y_std", "local_conf_std", "block_margin")], F.concat_ws(";", "reasons").alias("reasons"))


@register("risk_segments", "K41 K42", oracle("candidates trace", SEGMENTS + " SELECT * FROM se"))
def risk_segments(spark, folder):
    risky = _risky(spark, folder).where(F.size("reasons") > 0).select("sample_id", "col", "reasons")
    out = Q.risk_segments(Q.dilate(risky, 64, 3))
    return out.select("sample_id", *[F.col(n).cast("int").alias(n) for n in ("segment_start", "segment_end", "segment_len")], "risk_reasons")


@register("risk_summary", "K43", oracle("candidates trace", SEGMENTS + f""",
    a AS (SELECT sample_id, count(*) FILTER (len(rw) > 0) AS risky_raw, count(*) FILTER (len(rs) > 0) AS risky_labelled FROM fl GROUP BY 1),
    b AS (SELECT sample_id, count(*) AS risky_dilated FROM dl GROUP BY 1),
    c AS (SELECT sample_id, CAST(sum(segment_len) AS BIGINT) AS risky_merged, count(*) AS segments FROM se GROUP BY 1)
    SELECT sample_id, risky_raw, risky_labelled, coalesce(risky_dilated, 0) AS risky_dilated, coalesce(risky_merged, 0) AS risky_merged, coalesce(segments, 0) AS segments,
      {R('risky_raw / 64.0')} AS ratio_raw, {R('risky_labelled / 64.0')} AS ratio_labelled, {R('coalesce(risky_dilated, 0) / 64.0')} AS ratio_dilated, {R('coalesce(risky_merged, 0) / 64.0')} AS ratio_merged
    FROM a LEFT JOIN b USING (sample_id) LEFT JOIN c USING (sample_id)"""))
def risk_summary(spark, folder):
    out = Q.risk_summary(_risky(spark, folder), 64)
    return out.select("sample_id", "risky_raw", "risky_labelled", "risky_dilated", "risky_merged", "segments",
                      *[r(f"ratio_{n}").alias(f"ratio_{n}") for n in ("raw", "labelled", "dilated", "merged")])


@register("risk_reason_counts", "K43", oracle("candidates trace", RISK + f"""
    SELECT sample_id, reason, count(*) AS columns, {R('count(*) / 64.0')} AS ratio FROM (SELECT sample_id, unnest(rw) AS reason FROM fl) GROUP BY 1, 2"""))
def risk_reason_counts(spark, folder):
    return Q.risk_reason_counts(_risky(spark, folder), 64).withColumn("ratio", r("ratio"))


RESCORE = GTCOL + ", " + MARGIN + """, rsc AS (SELECT c.*, CASE WHEN gt_y IS NOT NULL AND margin < 0.08 THEN pow(exp(-pow((c.y - gt_y) / 6.0, 2)), 1.5) ELSE confidence END AS conf2
      FROM candidates c LEFT JOIN gtc USING (sample_id, col) LEFT JOIN mar USING (sample_id, col))"""


def _rescored(spark, folder):
    c = cands(spark, folder)
    return C.truth_rescore(c, _gt_columns(spark, folder), 6.0, 1.5, only=C.margins(c).where("margin < 0.08"))


@register("truth_rescore", "K44", oracle("candidates trace", RESCORE + f" SELECT sample_id, col, cand_id, {R('conf2')} AS confidence, {R('confidence')} AS rule_confidence FROM rsc"))
def truth_rescore(spark, folder):
    return _rescored(spark, folder).select("sample_id", "col", "cand_id", r("confidence").alias("confidence"), r("rule_confidence").alias("rule_confidence"))


@register("compare_sets", "K45", oracle("candidates trace", RESCORE + f""", d AS (SELECT sample_id, col, abs(confidence - conf2) AS d FROM rsc)
    SELECT sample_id, count(*) AS cells, count(*) FILTER (d > 1e-12) AS changed_cells, {R('max(d)')} AS max_abs, {R('avg(d)')} AS mean_abs, {R('avg(d * d)')} AS mean_square,
      min(col) FILTER (d > 1e-12) AS first_changed_col FROM d GROUP BY 1"""))
def compare_sets(spark, folder):
    out = C.compare_sets(cands(spark, folder), _rescored(spark, folder))
    return out.select("sample_id", "cells", "changed_cells", "first_changed_col", *[r(x).alias(x) for x in ("max_abs", "mean_abs", "mean_square")])


@register("field_summary", "K45", oracle("candidates", f"""
    SELECT sample_id, count(DISTINCT col) AS columns, count(*) AS total, min(y) AS y_min, max(y) AS y_max, {R('min(confidence)')} AS confidence_min, {R('max(confidence)')} AS confidence_max, {R('avg(confidence)')} AS confidence_mean,
      CAST(sum(('0x' || substr(md5(col::VARCHAR || ':' || y::BIGINT::VARCHAR || ':' || round_even(confidence * 1e6, 0)::BIGINT::VARCHAR), 1, 10))::BIGINT) AS BIGINT) AS fingerprint
    FROM candidates GROUP BY 1"""))
def field_summary(spark, folder):
    out = C.field_summary(cands(spark, folder))
    return out.select("sample_id", "columns", "total", "y_min", "y_max", *[r(n).alias(n) for n in ("confidence_min", "confidence_max", "confidence_mean")], "fingerprint")


@register("removal_counts", "K4", oracle("candidates", SCORED + """
    , s AS (SELECT sample_id, count(*) AS seen, count(*) FILTER (NOT confidence >= 0.25) AS low_confidence FROM candidates GROUP BY 1),
    k AS (SELECT sample_id, count(*) AS kept FROM ranked WHERE rank <= 16 GROUP BY 1)
    SELECT sample_id, seen, low_confidence, coalesce(kept, 0) AS kept, seen - low_confidence - coalesce(kept, 0) AS over_quota FROM s LEFT JOIN k USING (sample_id)"""))
def removal_counts(spark, folder):
    return C.removal_counts(cands(spark, folder)).select("sample_id", "seen", "low_confidence", "kept", "over_quota")


TWO = """pa AS (SELECT sample_id, col, y FROM trace), pb AS (SELECT sample_id, col, CASE WHEN col % 4 = 1 THEN NULL ELSE y + (col % 3) * 2 END AS y FROM trace),
    bc AS (SELECT sample_id, col, y, max(confidence) AS c FROM candidates GROUP BY 1, 2, 3)"""


def _two(spark, folder):
    a = I.trace(spark, folder)
    return a, a.withColumn("y", F.when(F.col("col") % 4 != 1, F.col("y") + (F.col("col") % 3) * 2))


@register("path_merge", "K47", oracle("candidates trace", TWO + """,
    j AS (SELECT a.sample_id, a.col, a.y AS ya, b.y AS yb, coalesce(ca.c, 0.5) AS ca, coalesce(cb.c, 0.5) AS cb FROM pa a JOIN pb b USING (sample_id, col)
      LEFT JOIN bc ca ON ca.sample_id = a.sample_id AND ca.col = a.col AND ca.y = a.y LEFT JOIN bc cb ON cb.sample_id = a.sample_id AND cb.col = a.col AND cb.y = b.y)
    SELECT sample_id, col, CASE WHEN ya IS NULL THEN yb WHEN yb IS NULL THEN ya WHEN abs(ya - yb) <= 3.0 THEN round_even((ca * ya + cb * yb) / (ca + cb + 1e-9), 0) WHEN ca >= cb THEN ya ELSE yb END AS y FROM j"""))
def path_merge(spark, folder):
    a, b = _two(spark, folder)
    return Q.merge_paths(a, b, cands(spark, folder), 2.0)


@register("path_disagreement", "K48", oracle("candidates trace", TWO + ", " + MARGIN + f""",
    j AS (SELECT a.sample_id, a.col // 16 AS block, abs(a.y - b.y) AS d, coalesce(margin, 0) AS m, a.y IS NOT NULL OR b.y IS NOT NULL AS any_ FROM pa a JOIN pb b USING (sample_id, col) LEFT JOIN mar USING (sample_id, col)),
    g AS (SELECT sample_id, block, coalesce(avg(d), 0) AS dm, coalesce(max(d), 0) AS dx, coalesce(quantile_cont(d, 0.9), 0) AS p9, count(d) / greatest(count(*) FILTER (any_), 1) AS ov, avg(m) AS mm, avg(CAST(m < 0.10 AS DOUBLE)) AS low FROM j GROUP BY 1, 2)
    SELECT sample_id, CAST(block AS INT) AS block, {R('dm', 4)} AS dis_mean, {R('dx', 4)} AS dis_max, {R('p9', 4)} AS dis_p90, {R('ov', 4)} AS overlap_ratio,
      {R('0.55 * (1 - least(greatest((mm - 0.05) / 0.20, 0), 1)) + 0.25 * low + 0.20 * least(greatest(dm / 4.0, 0), 1)', 5)} AS amb_block, CAST(dm > 2.5 OR p9 > 4 OR ov < 0.75 AS INT) AS unstable FROM g"""))
def path_disagreement(spark, folder):
    a, b = _two(spark, folder)
    out = Q.path_disagreement(a, b, C.margins(cands(spark, folder)), 1.0, 16)
    return out.select("sample_id", "block", *[r(x, 4).alias(x) for x in ("dis_mean", "dis_max", "dis_p90", "overlap_ratio")], r("amb_block", 5).alias("amb_block"), F.col("unstable").cast("int").alias("unstable"))


@register("keep_near_truth", "K46", oracle("candidates trace", HINTED + ", " + GTCOL + """,
    cl AS (SELECT c.*, gt_y, CASE WHEN abs(c.y - gt_y) <= 5 THEN 0 WHEN abs(c.y - gt_y) <= 10 THEN 1 END AS tier FROM candidates c JOIN gtc USING (sample_id, col)),
    pk AS (SELECT * FROM cl WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id, col ORDER BY tier, confidence DESC, cand_id) = 1),
    ad AS (SELECT * FROM pk p WHERE NOT EXISTS (SELECT 1 FROM final f WHERE f.sample_id = p.sample_id AND f.col = p.col AND f.y = p.y)),
    pool AS (SELECT f.sample_id, f.col, f.y, f.confidence, f.cand_id, f.source FROM final f JOIN ad USING (sample_id, col)
      UNION ALL SELECT sample_id, col, y, confidence, cand_id, source || '+debug_gt_near' FROM ad),
    rk AS (SELECT p.*, abs(p.y - gt_y) > 10 AS far, count(*) OVER (PARTITION BY sample_id, col) AS n,
        row_number() OVER (PARTITION BY sample_id, col ORDER BY CASE WHEN abs(p.y - gt_y) > 10 THEN 0 ELSE 1 END, p.confidence, p.cand_id DESC) AS w FROM pool p JOIN gtc USING (sample_id, col)),
    kp AS (SELECT * FROM rk WHERE NOT (n > 8 AND w = 1 AND far) QUALIFY row_number() OVER (PARTITION BY sample_id, col ORDER BY confidence DESC, cand_id) <= 8)
    SELECT sample_id, col, y, cand_id, """ + R("confidence") + """ AS confidence, source FROM kp
    UNION ALL SELECT f.sample_id, f.col, f.y, f.cand_id, """ + R("f.confidence") + """, f.source FROM final f WHERE NOT EXISTS (SELECT 1 FROM ad WHERE ad.sample_id = f.sample_id AND ad.col = f.col)"""))
def keep_near_truth(spark, folder):
    c = cands(spark, folder)
    return C.keep_near_truth(c, _final(spark, folder).select(*c.columns), _gt_columns(spark, folder)).select("sample_id", "col", "y", "cand_id", r("confidence").alias("confidence"), "source")
