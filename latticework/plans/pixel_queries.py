"""Pixel-table queries."""

from pyspark.sql import functions as F

from latticework.operators import pixels as X
from latticework.plans import inputs as I
from latticework.plans.inputs import R, oracle
from latticework.plans.registry import r, register


@register("crop_and_mask", "I1", oracle("pixels", """
    c AS (SELECT image_id, x - 4 AS x, y - 3 AS y, r FROM pixels WHERE x >= 4 AND x < 60 AND y >= 3 AND y < 48)
    SELECT image_id, x, y, r FROM c WHERE NOT (x >= 10 AND x < 20 AND y >= 5 AND y < 12) AND NOT (x >= 30 + image_id AND x < 40 AND y >= 20 AND y < 30)"""))
def crop_and_mask(spark, folder):
    px = I.pixels(spark, folder)
    ids = px.select("image_id").distinct()
    box = ids.select("image_id", *[F.lit(v).alias(n) for n, v in (("x0", 4), ("y0", 3), ("x1", 60), ("y1", 48))])
    legend = ids.select("image_id", F.explode(F.array(
        F.struct(F.lit(10).alias("bx0"), F.lit(5).alias("by0"), F.lit(20).alias("bx1"), F.lit(12).alias("by1")),
        F.struct((30 + F.col("image_id")).alias("bx0"), F.lit(20).alias("by0"), F.lit(40).alias("bx1"), F.lit(30).alias("by1")))).alias("b")).select("image_id", "b.*")
    return X.drop_boxes(X.crop(px, box), legend).select("image_id", "x", "y", "r")


DIST = """dst AS (SELECT *, sqrt(pow(r - 90, 2) + pow(g - 100, 2) + pow(b - 110, 2)) AS dist FROM pixels), hit AS (SELECT * FROM dst WHERE dist < 85.0)"""


def _dist(spark, folder):
    px = I.pixels(spark, folder).withColumn("dist", X.colour_distance((F.lit(90), F.lit(100), F.lit(110)))).withColumn("max_dist", F.lit(85.0))
    return px, px.where("dist < max_dist")


@register("colour_mask", "I2", oracle("pixels", DIST + f" SELECT image_id, x, y, {R('dist')} AS dist FROM hit"))
def colour_mask(spark, folder):
    return _dist(spark, folder)[1].select("image_id", "x", "y", r("dist").alias("dist"))


BG = """cor AS (SELECT p.* FROM pixels p JOIN (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY 1) d USING (image_id)
      WHERE (x < least(20, h // 8, w // 8) OR x >= w - least(20, h // 8, w // 8)) AND (y < least(20, h // 8, w // 8) OR y >= h - least(20, h // 8, w // 8))),
    bg AS (SELECT image_id, round_even(median(r), 0) AS bg_r, round_even(median(g), 0) AS bg_g, round_even(median(b), 0) AS bg_b FROM cor GROUP BY 1)"""


@register("background_threshold", "I3 I4", oracle("pixels", BG + f"""
    SELECT image_id, bg_r, bg_g, bg_b, {R('greatest(80.0, 0.6 * sqrt(pow(10 - bg_r, 2) + pow(250 - bg_g, 2) + pow(20 - bg_b, 2)))')} AS max_dist FROM bg"""))
def background_threshold(spark, folder):
    bg = X.background(I.pixels(spark, folder))
    t = X.match_threshold([F.lit(10.0), F.lit(250.0), F.lit(20.0)], [F.col("bg_r"), F.col("bg_g"), F.col("bg_b")])
    return bg.withColumn("max_dist", r(t))


@register("curve_colour", "I5", oracle("pixels", """
    pm AS (SELECT image_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM pixels WHERE abs(x - 30) <= 2 AND abs(y - 20) <= 2 GROUP BY 1),
    pale AS (SELECT image_id FROM pm WHERE 0.299 * mr + 0.587 * mg + 0.114 * mb > 100),
    dk AS (SELECT image_id, arg_min(x, row(0.299 * r + 0.587 * g + 0.114 * b, y, x)) AS cx, arg_min(y, row(0.299 * r + 0.587 * g + 0.114 * b, y, x)) AS cy FROM pixels JOIN pale USING (image_id)
      WHERE abs(x - 30) <= 30 AND abs(y - 20) <= 30 GROUP BY 1),
    p2 AS (SELECT p.image_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM pixels p JOIN dk USING (image_id) WHERE abs(x - cx) <= 2 AND abs(y - cy) <= 2 GROUP BY 1),
    al AS (SELECT * FROM pm WHERE image_id NOT IN (SELECT image_id FROM pale) UNION ALL SELECT * FROM p2)
    SELECT image_id, round_even(mr, 0) AS curve_r, round_even(mg, 0) AS curve_g, round_even(mb, 0) AS curve_b FROM al"""))
def curve_colour(spark, folder):
    px = I.pixels(spark, folder)
    pts = px.select("image_id").distinct().select("image_id", F.lit(30).alias("cx"), F.lit(20).alias("cy"))
    return X.curve_colour(px, pts, bright=100.0)


FRAMES = DIST + """, dim AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY 1),
    fr AS (SELECT image_id, y FROM hit JOIN dim USING (image_id) GROUP BY image_id, y, w HAVING count(*) / w > 0.25), h1 AS (SELECT h.* FROM hit h WHERE (image_id, y) NOT IN (SELECT (image_id, y) FROM fr)),
    fc AS (SELECT image_id, x FROM h1 JOIN dim USING (image_id) GROUP BY image_id, x, h HAVING count(*) / h > 0.24),
    h2 AS (SELECT h.* FROM h1 h WHERE NOT EXISTS (SELECT 1 FROM fc WHERE fc.image_id = h.image_id AND abs(fc.x - h.x) <= 1))"""


def _framed(spark, folder):
    px, hit = _dist(spark, folder)
    return px, X.suppress_frames(hit, X.sizes(px), 0.25, 0.24)


@register("suppress_frames", "I6", oracle("pixels", FRAMES + " SELECT image_id, x, y FROM h2"))
def suppress_frames(spark, folder):
    return _framed(spark, folder)[1].select("image_id", "x", "y")


@register("topmost_trace", "I7", oracle("pixels", FRAMES + f""",
    tp AS (SELECT image_id, x, min(y) AS t, arg_min(dist, y) AS da FROM h2 GROUP BY 1, 2)
    SELECT t.image_id, t.x, {R('CASE WHEN d.dist > 85 AND 85 > da AND d.dist - da > 1e-6 THEN t - 1 + (d.dist - 85) / (d.dist - da) ELSE t END')} AS y
    FROM tp t LEFT JOIN dst d ON d.image_id = t.image_id AND d.x = t.x AND d.y = t.t - 1"""))
def topmost_trace(spark, folder):
    px, hit = _framed(spark, folder)
    return X.topmost(hit, px).select("image_id", "x", r("y").alias("y"))


@register("closest_centroid_trace", "I8", oracle("pixels", FRAMES + f""",
    c AS (SELECT image_id, x, sum(greatest(1, 85 - dist) * y) / sum(greatest(1, 85 - dist)) AS yc FROM h2 GROUP BY 1, 2), a AS (SELECT image_id, x, arg_min(y, row(dist, y))::DOUBLE AS y_closest FROM dst GROUP BY 1, 2)
    SELECT image_id, x, {R('yc')} AS y_centroid, y_closest FROM c JOIN a USING (image_id, x)"""))
def closest_centroid_trace(spark, folder):
    px, hit = _framed(spark, folder)
    return X.closest_and_centroid(hit, px).select("image_id", "x", r("y_centroid").alias("y_centroid"), "y_closest")


def _lin(c):
    return f"CASE WHEN {c} / 255.0 > 0.04045 THEN pow(({c} / 255.0 + 0.055) / 1.055, 2.4) ELSE {c} / 255.0 / 12.92 END"


def _f(t):
    return f"CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16.0 / 116.0 END"


LAB = f"""ln_ AS (SELECT image_id, x, y, {_lin('r')} AS lr, {_lin('g')} AS lg, {_lin('b')} AS lb FROM pixels),
    xyz AS (SELECT image_id, x, y, (lr * 0.4124564 + lg * 0.3575761 + lb * 0.1804375) / 0.95047 AS vx, lr * 0.2126729 + lg * 0.7151522 + lb * 0.0721750 AS vy, (lr * 0.0193339 + lg * 0.1191920 + lb * 0.9503041) / 1.08883 AS vz FROM ln_),
    ff AS (SELECT image_id, x, y, {_f('vx')} AS fx, {_f('vy')} AS fy, {_f('vz')} AS fz FROM xyz),
    labs AS (SELECT image_id, x, y, 116.0 * fy - 16.0 AS cl, 500.0 * (fx - fy) AS ca, 200.0 * (fy - fz) AS cb FROM ff)"""


@register("lab_distance", "I9", oracle("pixels", LAB + f"""
    SELECT image_id, x, y, {R('least(sqrt(pow(cl - 40, 2) + pow(ca - 10, 2) + pow(cb + 20, 2)), sqrt(pow(cl - 70, 2) + pow(ca + 30, 2) + pow(cb - 25, 2)))', 4)} AS lab_dist FROM labs"""))
def lab_distance(spark, folder):
    px = I.pixels(spark, folder)
    protos = px.select("image_id").distinct().select("image_id", F.explode(F.array(*[
        F.struct(F.lit(a).alias("L"), F.lit(b).alias("A"), F.lit(c).alias("B")) for a, b, c in ((40.0, 10.0, -20.0), (70.0, -30.0, 25.0))])).alias("p")).select("image_id", "p.*")
    return X.prototype_distance(X.with_lab(px), protos).select("image_id", "x", "y", r("lab_dist", 4).alias("lab_dist"))


@register("colour_prototypes", "I10", oracle("pixels", LAB + f""",
    cols3 AS (SELECT image_id, unnest([CAST(floor(w * 0.2) AS INT), CAST(floor(w * 0.5) AS INT), CAST(floor(w * 0.8) AS INT)]) AS x FROM (SELECT image_id, max(x) + 1 AS w FROM pixels GROUP BY 1)),
    bs AS (SELECT l.image_id, l.x AS cx, arg_min(y, row(sqrt(pow(cl - 50, 2) + pow(ca - 5, 2) + pow(cb + 10, 2)), y)) AS cy FROM labs l JOIN cols3 USING (image_id, x) GROUP BY 1, 2),
    pr AS (SELECT b.image_id, cx, avg(cl) AS pl, avg(ca) AS pa, avg(cb) AS pb FROM bs b JOIN labs l ON l.image_id = b.image_id AND abs(l.x - cx) <= 2 AND abs(l.y - cy) <= 2 GROUP BY 1, 2),
    bg AS (SELECT image_id, median(cl) AS bl, median(ca) AS ba, median(cb) AS bb FROM labs GROUP BY 1),
    th AS (SELECT image_id, least(13.4, greatest(11.6, min(sqrt(pow(pl - bl, 2) + pow(pa - ba, 2) + pow(pb - bb, 2))) * 0.32)) AS t FROM pr JOIN bg USING (image_id) GROUP BY 1)
    SELECT image_id, cx, {R('pl', 4)} AS "L", {R('pa', 4)} AS "A", {R('pb', 4)} AS "B", {R('t', 4)} AS threshold FROM pr JOIN th USING (image_id)"""))
def colour_prototypes(spark, folder):
    px = X.with_lab(I.pixels(spark, folder).repartition("image_id"))
    ref = px.select("image_id").distinct().select("image_id", F.lit(50.0).alias("L0"), F.lit(5.0).alias("A0"), F.lit(-10.0).alias("B0"))
    protos, limit = X.prototypes(px, ref)
    return protos.join(limit, "image_id").select("image_id", "cx", *[r(c, 4).alias(c) for c in ("L", "A", "B", "threshold")])


@register("axis_lines", "I11", oracle("pixels", BG + """,
    gr AS (SELECT image_id, x, y, CAST(abs(0.299 * (r - bg_r) + 0.587 * (g - bg_g) + 0.114 * (b - bg_b)) > 60 AS DOUBLE) AS v FROM pixels JOIN bg USING (image_id)),
    rt AS (SELECT image_id, 'y' AS axis, y AS p, avg(v) AS ratio FROM gr GROUP BY 1, 2, 3 UNION ALL SELECT image_id, 'x', x, avg(v) FROM gr GROUP BY 1, 2, 3),
    md AS (SELECT image_id, 'y' AS axis, (max(y) + 1) // 2 AS mid FROM pixels GROUP BY 1 UNION ALL SELECT image_id, 'x', (max(x) + 1) // 2 FROM pixels GROUP BY 1),
    sg AS (SELECT r.*, mid, s, (p - mid) * s AS st FROM rt r JOIN md USING (image_id, axis), (VALUES (1), (-1)) t(s)),
    ht AS (SELECT image_id, axis, s, arg_min(p, st) AS hp FROM sg WHERE st >= 0 AND ratio >= 0.6 GROUP BY 1, 2, 3),
    nr AS (SELECT h.image_id, h.axis, h.s, coalesce(arg_min(g.p, (hp - g.p) * h.s) FILTER ((hp - g.p) * h.s BETWEEN 0 AND 29 AND g.ratio < 0.6), any_value(hp) - h.s) AS pos
      FROM ht h JOIN sg g ON g.image_id = h.image_id AND g.axis = h.axis AND g.s = h.s GROUP BY 1, 2, 3),
    al AS (SELECT m.image_id, m.axis, t.s, coalesce(pos, mid) AS pos FROM md m CROSS JOIN (VALUES (1), (-1)) t(s) LEFT JOIN nr n ON n.image_id = m.image_id AND n.axis = m.axis AND n.s = t.s)
    SELECT image_id, CAST(max(pos) FILTER (axis = 'y' AND s = 1) AS INT) AS x_axis_row, CAST(max(pos) FILTER (axis = 'y' AND s = -1) AS INT) AS top_row,
      CAST(max(pos) FILTER (axis = 'x' AND s = 1) AS INT) AS right_col, CAST(max(pos) FILTER (axis = 'x' AND s = -1) AS INT) AS y_axis_col FROM al GROUP BY 1"""))
def axis_lines(spark, folder):
    return X.axis_lines(I.pixels(spark, folder), 0.6, 60.0).select("image_id", "x_axis_row", "top_row", "right_col", "y_axis_col")


@register("dominant_colour", "I12", oracle("pixels", """
    tp AS (SELECT image_id, greatest(200, floor(max(greatest(r, g, b)) * 0.92)) AS bgt, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY 1),
    ink AS (SELECT p.*, w, h, 0.299 * r + 0.587 * g + 0.114 * b AS l FROM pixels p JOIN tp USING (image_id) WHERE NOT (r >= bgt AND g >= bgt AND b >= bgt)),
    q AS (SELECT image_id, quantile_cont(l, 0.25) AS q FROM ink GROUP BY 1),
    bn AS (SELECT i.image_id, r // 32 AS qr, g // 32 AS qg, b // 32 AS qb, count(*) AS n, arg_min(x, row(pow(y - h / 2.0, 2) + pow(x - w / 2.0, 2), y, x)) AS sample_x,
      arg_min(y, row(pow(y - h / 2.0, 2) + pow(x - w / 2.0, 2), y, x)) AS sample_y FROM ink i JOIN q USING (image_id) WHERE l > q.q GROUP BY 1, 2, 3, 4)
    SELECT image_id, qr * 32 + 16 AS curve_r, qg * 32 + 16 AS curve_g, qb * 32 + 16 AS curve_b, sample_x, sample_y FROM bn QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, qr, qg, qb) = 1"""))
def dominant_colour(spark, folder):
    return X.dominant_colour(I.pixels(spark, folder))


@register("ridge_response", "I13", oracle("pixels", f"""
    g AS (SELECT image_id, x, y, (r + g + b) / 3.0 AS v FROM pixels),
    d AS (SELECT image_id, x, y, abs(CASE WHEN lag(v) OVER w IS NULL THEN lead(v) OVER w - v WHEN lead(v) OVER w IS NULL THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END) AS d
      FROM g WINDOW w AS (PARTITION BY image_id, x ORDER BY y)), q AS (SELECT image_id, x, quantile_cont(d, 0.95) AS q FROM d GROUP BY 1, 2)
    SELECT image_id, x, y, {R('least(1.0, d / (q + 1e-6))', 5)} AS ridge FROM d JOIN q USING (image_id, x)"""))
def ridge_response(spark, folder):
    return X.ridge_response(I.pixels(spark, folder)).withColumn("ridge", r("ridge", 5))


@register("strip_border", "I14", oracle("pixels", """
    d AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY 1)
    SELECT image_id, x, y FROM pixels JOIN d USING (image_id) WHERE x >= 3 AND y >= 3 AND x < w - 3 AND y < h - 3"""))
def strip_border(spark, folder):
    return X.strip_border(I.pixels(spark, folder)).select("image_id", "x", "y")
