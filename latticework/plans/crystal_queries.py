"""Reflection, indexing and phase-matching queries."""

from pyspark.sql import functions as F

from latticework.functions import bragg as B
from latticework.operators import crystal as X
from latticework.operators import lattice as L
from latticework.plans import inputs as I
from latticework.plans.inputs import LATTICE_CENTERINGS, R, oracle
from latticework.plans.peak_queries import MAXIMA, maxima
from latticework.plans.registry import r, register

K = ["pattern_id"]
ANGLE = "2 * degrees(asin(1.5406 / (2 * d)))"
DSP = "1.5406 / (2 * sin(radians(two_theta / 2)))"


@register("bragg", "X1", oracle("pattern_points", f"""
    SELECT pattern_id, idx, {R(DSP)} AS d, {R('2 * ' + DSP)} AS d_second_order,
      {R('CASE WHEN intensity / 100000 > 0.7703 THEN 2 * degrees(asin(1.5406 / (2 * intensity / 100000))) END')} AS angle_back
    FROM pattern_points"""))
def bragg(spark, folder):
    t = F.col("two_theta")
    return I.pattern_points(spark, folder).select(
        "pattern_id", "idx", r(B.d_from_angle(t)).alias("d"), r(B.d_from_angle(t, order=2)).alias("d_second_order"),
        r(B.angle_from_d(F.col("intensity") / 100000)).alias("angle_back"))


ALLOWED = """NOT (h = 0 AND k = 0 AND l = 0) AND CASE centering WHEN 'I' THEN (h + k + l) % 2 = 0
      WHEN 'F' THEN (h % 2 = 0 AND k % 2 = 0 AND l % 2 = 0) OR (h % 2 = 1 AND k % 2 = 1 AND l % 2 = 1)
      WHEN 'C' THEN (h + k) % 2 = 0 WHEN 'A' THEN (k + l) % 2 = 0 WHEN 'B' THEN (h + l) % 2 = 0
      WHEN 'R' THEN (k + l - h + 300) % 3 = 0 WHEN 'HCP' THEN NOT ((h + 2 * k) % 3 = 0 AND l % 2 = 1) ELSE true END"""
D_HKL = """CASE system WHEN 'cubic' THEN (h * h + k * k + l * l) / (a * a)
      WHEN 'tetragonal' THEN (h * h + k * k) / (a * a) + (l * l) / (c * c)
      WHEN 'orthorhombic' THEN (h * h) / (a * a) + (k * k) / (b * b) + (l * l) / (c * c)
      WHEN 'hexagonal' THEN 4 * (h * h + h * k + k * k) / (3 * a * a) + (l * l) / (c * c)
      WHEN 'monoclinic' THEN (h * h) / (a * a * pow(sin(radians(beta)), 2)) + (k * k) / (b * b)
        + (l * l) / (c * c * pow(sin(radians(beta)), 2)) - 2 * h * l * cos(radians(beta)) / (a * c * pow(sin(radians(beta)), 2)) END"""
HKL10 = "hkl AS (SELECT CAST(x AS INT) AS h, CAST(y AS INT) AS k, CAST(z AS INT) AS l FROM range(0, 11) a(x), range(0, 11) b(y), range(0, 11) c(z))"
REL = """CASE centering WHEN 'F' THEN 16.0 WHEN 'I' THEN 4.0
      WHEN 'HCP' THEN greatest(0, 50 * (1 + cos(2 * pi() * (h + 2 * k) / 3 + pi() * l))) WHEN 'R' THEN 9.0
      ELSE greatest(5.0, 100 / (1 + 0.3 * (h * h + k * k + l * l))) END"""


@register("systematic_absences", "X2", oracle("lattices", HKL10 + f"""
    SELECT lattice_id, count(*) FILTER ({ALLOWED}) AS allowed, count(*) FILTER (h > k AND {ALLOWED}) AS allowed_upper
    FROM lattices, hkl GROUP BY 1"""))
def systematic_absences(spark, folder):
    return X.allowed_counts(I.lattices(spark, folder)).select("lattice_id", "allowed", "allowed_upper")


@register("plane_spacing", "X3", oracle("lattices", f"""
    v AS (SELECT *, 1 + lattice_id % 3 AS h, lattice_id % 4 AS k, lattice_id % 2 AS l FROM lattices)
    SELECT lattice_id, {R('1 / sqrt(' + D_HKL + ')')} AS d FROM v"""))
def plane_spacing(spark, folder):
    c = {n: F.col(n) for n in ("system", "a", "b", "c", "beta")}
    k = F.col("lattice_id")
    d = B.d_from_hkl(1 + k % 3, k % 4, k % 2, c["system"], c["a"], c["b"], c["c"], beta=c["beta"])
    return I.lattices(spark, folder).select("lattice_id", r(d).alias("d"))


REFL = HKL10 + f""", calc AS (SELECT lattice_id, h, k, l, centering, 1 / sqrt({D_HKL}) AS d FROM lattices, hkl WHERE {ALLOWED}),
    ang AS (SELECT *, {ANGLE} AS two_theta, {REL} AS rel FROM calc WHERE d > 1.5406 / 2),
    refl AS (SELECT * FROM ang WHERE two_theta <= 90
      QUALIFY row_number() OVER (PARTITION BY lattice_id, round(two_theta, 3) ORDER BY h, k, l) = 1)"""


@register("reflections", "X4 X8", oracle("lattices", REFL + f"""
    SELECT lattice_id, h, k, l, {R('d')} AS d, {R('two_theta')} AS two_theta, {R('rel', 4)} AS rel FROM refl"""))
def reflections(spark, folder):
    out = X.reflections(I.lattices(spark, folder), ["lattice_id"])
    return out.select("lattice_id", "h", "k", "l", r("d").alias("d"), r("two_theta").alias("two_theta"), r("rel", 4).alias("rel"))


PHASE_REFL = """cells AS (SELECT lattice_id, system, CASE WHEN system = 'hexagonal' THEN 'HCP' WHEN centering IN ('F', 'I') THEN centering
        ELSE 'P' END AS centering, a, b, c, beta FROM lattices WHERE system IN ('cubic', 'hexagonal', 'tetragonal')),
    hkl AS (SELECT CAST(x AS INT) AS h, CAST(y AS INT) AS k, CAST(z AS INT) AS l FROM range(0, 15) a(x), range(0, 15) b(y), range(0, 21) c(z)),
    calc AS (SELECT lattice_id, system, h, k, l, centering, 1 / sqrt(""" + D_HKL + """) AS d FROM cells, hkl
      WHERE (""" + ALLOWED + """) AND ((system = 'cubic' AND k <= h AND l <= k) OR (system = 'hexagonal' AND h <= 12 AND k <= 12)
        OR (system = 'tetragonal' AND k <= h))),
    ang AS (SELECT *, """ + ANGLE + """ AS two_theta FROM calc WHERE d > 1.5406 / 2),
    prefl AS (SELECT * FROM ang WHERE two_theta BETWEEN -0.5 AND 180.5
      QUALIFY row_number() OVER (PARTITION BY lattice_id, round(two_theta, 3) ORDER BY h, k, l) = 1)"""


@register("phase_reflections", "X5 X6 X7 X26", oracle("lattices", PHASE_REFL + f"""
    SELECT lattice_id, h, k, l, {R('d')} AS d, {R('two_theta')} AS two_theta, {R('''CASE system WHEN 'hexagonal'
      THEN greatest(0, 50 * (1 + cos(2 * pi() * (h + 2 * k) / 3 + pi() * l))) WHEN 'tetragonal' THEN CASE centering WHEN 'I' THEN 100 ELSE 25 END
      ELSE CASE centering WHEN 'F' THEN 16 WHEN 'I' THEN 4 ELSE 1 END END''', 4)} AS rel FROM prefl"""))
def phase_reflections(spark, folder):
    cells = I.lattices(spark, folder).where("system IN ('cubic', 'hexagonal', 'tetragonal')").withColumn(
        "centering", F.expr("CASE WHEN centering IN ('F', 'I') THEN centering ELSE 'P' END"))
    out = X.phase_reflections(cells, ["lattice_id"], 0.0, 180.0)
    return out.select("lattice_id", "h", "k", "l", r("d").alias("d"), r("two_theta").alias("two_theta"), r("rel", 4).alias("rel"))


@register("plane_families", "X9 X10", oracle("lattices", HKL10 + """,
    s AS (SELECT lattice_id, system, h, k, l, list_sort([h, k, l]) AS q FROM lattices, hkl WHERE h + k + l > 0)
    SELECT lattice_id, h, k, l, CASE WHEN system = 'cubic' THEN '{' || q[3] || q[2] || q[1] || '}'
        WHEN system = 'tetragonal' THEN '{' || greatest(h, k) || least(h, k) || l || '}' ELSE '(' || h || k || l || ')' END AS label,
      CASE WHEN q[2] = 0 THEN 6 WHEN q[1] = 0 AND q[2] = q[3] THEN 12 WHEN q[1] = 0 THEN 24 WHEN q[1] = q[2] AND q[2] = q[3] THEN 8 ELSE 24 END AS multiplicity
    FROM s"""))
def plane_families(spark, folder):
    return X.plane_families(I.lattices(spark, folder), ["lattice_id"])


OBS = MAXIMA + """, pk AS (SELECT pattern_id, idx, two_theta, intensity, 1.5406 / (2 * sin(radians(two_theta / 2))) AS d_obs
      FROM spaced JOIN pattern_points USING (pattern_id, idx))"""
CELL_OF = "(SELECT *, lattice_id - 1 AS pattern_id FROM lattices)"
TRI = """CASE WHEN system = 'triclinic' THEN (SELECT (h * ra) * (h * ra) + (k * rb) * (k * rb) + (l * rc) * (l * rc)
      + 2 * h * ra * k * rb * (ca * cb - cg) / (sa * sb) + 2 * h * ra * l * rc * (ca * cg - cb) / (sa * sg) + 2 * k * rb * l * rc * (cb * cg - ca) / (sb * sg))
      ELSE """ + D_HKL + " END"


def hkl_sql(n: int) -> str:
    m = n + 1
    return f"hklr AS (SELECT CAST(x AS INT) AS h, CAST(y AS INT) AS k, CAST(z AS INT) AS l FROM range(0, {m}) a(x), range(0, {m}) b(y), range(0, {m}) c(z) WHERE x + y + z > 0)"


def reverse_sql(peaks: str, cells: str, name: str, tol: float, top: int) -> str:
    return f"""{name}_m AS (SELECT *, cos(radians(alpha)) AS ca, cos(radians(beta)) AS cb, cos(radians(gamma)) AS cg,
        sin(radians(alpha)) AS sa, sin(radians(beta)) AS sb, sin(radians(gamma)) AS sg FROM {cells}),
    {name}_v AS (SELECT *, a * b * c * sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg) AS vol FROM {name}_m),
    {name}_r AS (SELECT *, b * c * sa / vol AS ra, a * c * sb / vol AS rb, a * b * sg / vol AS rc FROM {name}_v),
    {name}_g AS (SELECT pattern_id, system, h, k, l, 1 / sqrt({TRI}) AS d FROM {name}_r, hklr
      WHERE h <= {top} AND k <= {top} AND l <= {top} AND (system <> 'triclinic' OR (h <= 8 AND k <= 8 AND l <= 8))),
    {name}_n AS (SELECT p.pattern_id, p.idx, g.system, h, k, l, d, abs(d - d_obs) AS diff,
        CASE system WHEN 'cubic' THEN list_sort([h, k, l])::VARCHAR WHEN 'tetragonal' THEN [greatest(h, k), least(h, k), l]::VARCHAR ELSE [h, k, l]::VARCHAR END AS fam
      FROM {peaks} p JOIN {name}_g g USING (pattern_id) WHERE abs(d - d_obs) < {tol}),
    {name} AS (SELECT *, row_number() OVER (PARTITION BY pattern_id, idx ORDER BY round(diff, 9), h, k, l) AS rank FROM (
      SELECT * FROM {name}_n QUALIFY row_number() OVER (PARTITION BY pattern_id, idx, fam ORDER BY round(diff, 9), h, k, l) = 1))"""


def _observed(spark, folder):
    pk = maxima(spark, folder)
    return X.settle(pk.select("pattern_id", "idx", "two_theta", "intensity", B.d_from_angle(F.col("two_theta")).alias("d_obs")))


def _cells(spark, folder):
    return I.lattices(spark, folder).withColumn("pattern_id", F.col("lattice_id") - 1).drop("lattice_id")


@register("reverse_index", "X11", oracle("pattern_points lattices", OBS + ", " + hkl_sql(10) + f""",
    cell AS {CELL_OF}, """ + reverse_sql("pk", "cell", "rev", 0.02, 10) + f"""
    SELECT pattern_id, idx, h, k, l, {R('d')} AS d, {R('diff')} AS diff FROM rev"""))
def reverse_index(spark, folder):
    out = X.reverse_index(_observed(spark, folder).select("pattern_id", "idx", "d_obs"), _cells(spark, folder), K, 0.02)
    return out.select("pattern_id", "idx", "h", "k", "l", r("d").alias("d"), r("diff").alias("diff"))


MATCH = f"""cell AS (SELECT pattern_id, system, 'P' AS centering, a, b, c, alpha, beta, gamma FROM {CELL_OF}),
    calc AS (SELECT pattern_id, system, h, k, l, 1 / sqrt({D_HKL}) AS d FROM cell, hklr),
    ang AS (SELECT *, {ANGLE} AS theory_angle, greatest(5.0, 100 / (1 + 0.3 * (h * h + k * k + l * l))) AS rel FROM calc WHERE d > 1.5406 / 2),
    refl AS (SELECT * FROM ang WHERE theory_angle <= 90
      QUALIFY row_number() OVER (PARTITION BY pattern_id, round(theory_angle, 3) ORDER BY h, k, l) = 1),
    pairs AS (SELECT p.pattern_id, p.idx, p.two_theta, p.intensity, r.system, h, k, l, rel, theory_angle, abs(theory_angle - two_theta) AS diff
      FROM pk p JOIN refl r USING (pattern_id) WHERE abs(theory_angle - two_theta) <= 0.5)"""


@register("match_angles", "X12", oracle("pattern_points lattices", OBS + ", " + hkl_sql(10) + ", " + MATCH + f""",
    x AS (SELECT *, intensity / (rel * 10) AS q FROM pairs)
    SELECT pattern_id, idx, h, k, l, {R('theory_angle')} AS theory_angle, {R('(1 - diff / 0.5) * (0.5 + 0.5 * least(q, 1 / q))')} AS match_score FROM x"""))
def match_angles(spark, folder):
    refl = X.reflections(_cells(spark, folder).withColumn("centering", F.lit("P")), K)
    out = X.match_angles(_observed(spark, folder), refl, K, use_intensity=True)
    return out.select("pattern_id", "idx", "h", "k", "l", r("theory_angle").alias("theory_angle"), r("match_score").alias("match_score"))


AUTO = MATCH + """, fam AS (SELECT *, 1 - diff / 0.5 AS score, CASE system WHEN 'cubic' THEN list_sort([h, k, l])::VARCHAR
        WHEN 'tetragonal' THEN [greatest(h, k), least(h, k), l]::VARCHAR ELSE [h, k, l]::VARCHAR END AS f FROM pairs
      QUALIFY row_number() OVER (PARTITION BY pattern_id, idx ORDER BY 1 - diff / 0.5 DESC, theory_angle) <= 40),
    ded AS (SELECT * FROM fam QUALIFY row_number() OVER (PARTITION BY pattern_id, idx, f ORDER BY score DESC, theory_angle) = 1),
    top AS (SELECT *, row_number() OVER (PARTITION BY pattern_id, idx ORDER BY score DESC, theory_angle) AS rank FROM ded QUALIFY rank <= 5),
    rest AS (SELECT * FROM pk WHERE (pattern_id, idx) NOT IN (SELECT (pattern_id, idx) FROM top)), """ + reverse_sql(
    "rest", CELL_OF, "rev", 0.05, 10) + """,
    found AS (SELECT pattern_id, idx, h, k, l, score, rank FROM top UNION ALL SELECT pattern_id, idx, h, k, l, NULL, rank FROM rev WHERE rank <= 5)"""


@register("auto_index", "X13", oracle("pattern_points lattices", OBS + ", " + hkl_sql(10) + ", " + AUTO + f"""
    SELECT p.pattern_id, p.idx, h, k, l, rank, {R('CASE WHEN h IS NULL THEN 0 ELSE coalesce(score, 0.5) END')} AS confidence
    FROM pk p LEFT JOIN found USING (pattern_id, idx)"""))
def auto_index(spark, folder):
    obs = _observed(spark, folder)
    cells = _cells(spark, folder)
    out = X.auto_index(obs, cells.join(obs.select("pattern_id").distinct(), K), K)
    # peaks of patterns without a cell keep an empty row
    return out.select("pattern_id", "idx", "h", "k", "l", "rank", r("confidence").alias("confidence"))


@register("index_with_cell", "X14", oracle("pattern_points lattices", OBS + ", " + hkl_sql(15) + """,
    firsts AS (SELECT pattern_id, arg_min(d_obs, idx) * sqrt(3.0) AS a0 FROM pk GROUP BY 1), rcell AS (
      SELECT f.pattern_id, 'cubic' AS system, a0 AS a, NULL::DOUBLE AS b, NULL::DOUBLE AS c, NULL::DOUBLE AS alpha, NULL::DOUBLE AS beta, NULL::DOUBLE AS gamma
      FROM firsts f), """ + reverse_sql("pk", "rcell", "rev", 0.1, 15) + """
    SELECT p.pattern_id, p.idx, h, k, l, rank FROM pk p LEFT JOIN (SELECT * FROM rev WHERE rank <= 5) r USING (pattern_id, idx)"""))
def index_with_cell(spark, folder):
    obs = _observed(spark, folder)
    unknown = _cells(spark, folder).withColumn("a", F.lit(500.0))
    out = X.index_with_cell(obs.select("pattern_id", "idx", "two_theta", "intensity"), unknown, K)
    return out.select("pattern_id", "idx", "h", "k", "l", "rank")


@register("implied_edge", "X15 X16", oracle("pattern_points lattices", OBS + f""",
    v AS (SELECT p.pattern_id, p.idx, d_obs AS d, 1 + idx % 3 AS h, idx % 2 AS k, idx % 4 // 2 AS l, system, CASE WHEN p.pattern_id % 2 = 0 THEN c END AS c
      FROM pk p JOIN {CELL_OF} x USING (pattern_id)),
    e AS (SELECT *, CASE WHEN system = 'cubic' THEN d * sqrt(h * h + k * k + l * l) WHEN system = 'tetragonal' AND l = 0 THEN d * sqrt(h * h + k * k)
        WHEN system = 'tetragonal' AND 1 / (d * d) - l * l / (c * c) > 0 THEN sqrt((h * h + k * k) / (1 / (d * d) - l * l / (c * c)))
        WHEN system = 'hexagonal' AND 1 / (d * d) - l * l / (c * c) > 0 THEN sqrt(4 * (h * h + h * k + k * k) / (3 * (1 / (d * d) - l * l / (c * c)))) END AS edge FROM v)
    SELECT pattern_id, count(edge) AS solved, {R('avg(edge)')} AS mean_a, {R('CASE WHEN count(edge) > 1 THEN stddev_samp(edge) WHEN count(edge) = 1 THEN 0 END')} AS std_a,
      count(*) FILTER (edge IS NULL AND system IN ('tetragonal', 'hexagonal') AND c IS NOT NULL) AS inconsistent FROM e GROUP BY 1"""))
def implied_edge(spark, folder):
    c = _cells(spark, folder).select("pattern_id", "system", F.when(F.col("pattern_id") % 2 == 0, F.col("c")).alias("c"))
    v = _observed(spark, folder).join(c, K)
    i = F.col("idx")
    edge, why = B.implied_edge(F.col("d_obs"), 1 + i % 3, i % 2, F.floor(i % 4 / 2).cast("int"), F.col("system"), F.col("c"))
    v = v.withColumns({"edge": edge, "why": why})
    std = F.when(F.count("edge") > 1, F.stddev_samp("edge")).when(F.count("edge") == 1, 0.0)
    return v.groupBy("pattern_id").agg(F.count("edge").alias("solved"), r(F.avg("edge")).alias("mean_a"), r(std).alias("std_a"),
                                       F.count_if(F.col("why") == "inconsistent").alias("inconsistent"))


STRONG = OBS + """, used AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY intensity DESC, two_theta) AS ord FROM pk QUALIFY ord <= 14),
    sizes AS (SELECT pattern_id, count(*) AS n, max(intensity) AS imax, min(two_theta) AS lo, max(two_theta) AS hi FROM used GROUP BY 1)"""


def greedy_sql(refl: str, tol: float, key: str, shared: bool) -> str:
    """Recursive one-to-one assignment over refl(key, i, two_theta, rel)."""
    t2 = tol * tol
    on = f"r.{key} = u.pattern_id AND" if shared else ""
    return f"""opts AS (SELECT u.pattern_id * 1000 + r.{key} AS kk, u.pattern_id, r.{key} AS g, u.ord, any_value(u.intensity / s.imax) AS share,
        list({{'i': r.i, 'd': abs(r.two_theta - u.two_theta), 'r': greatest(r.rel, 1e-9)}} ORDER BY r.i) AS o
      FROM used u JOIN sizes s USING (pattern_id) JOIN {refl} r ON {on} abs(r.two_theta - u.two_theta) <= {tol} GROUP BY 1, 2, 3, 4),
    seq AS (SELECT kk, share, o, row_number() OVER (PARTITION BY kk ORDER BY ord) AS k FROM opts),
    walk AS (SELECT kk, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(0 AS DOUBLE) AS cost, CAST(0 AS DOUBLE) AS sq FROM (SELECT DISTINCT kk FROM seq)
      UNION ALL SELECT kk, k, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best[2]::BIGINT) END,
        cost + coalesce(best[1], 0), sq + coalesce(best[3] * best[3], 0) FROM (
        SELECT kk, k, taken, cost, sq, list_sort(list_transform(free, lambda x: [x.d * x.d + {0.45 * t2} * pow(share - x.r / list_max(list_transform(free, lambda y: y.r)), 2), x.i::DOUBLE, x.d]))[1] AS best
        FROM (SELECT w.kk, s.k, w.taken, w.cost, w.sq, s.share, list_filter(s.o, lambda x: NOT list_contains(w.taken, x.i)) AS free
          FROM walk w JOIN seq s ON s.kk = w.kk AND s.k = w.k + 1))),
    matched AS (SELECT o.pattern_id, o.g, len(arg_max(taken, k)) AS matched, max(n) AS n, arg_max(cost, k) + (max(n) - len(arg_max(taken, k))) * {8 * t2} AS cost,
        CASE WHEN len(arg_max(taken, k)) > 0 THEN sqrt(arg_max(sq, k) / len(arg_max(taken, k))) END AS rms
      FROM walk w JOIN (SELECT DISTINCT kk, pattern_id, g FROM opts) o USING (kk) JOIN sizes USING (pattern_id) GROUP BY 1, 2)"""


@register("greedy_match", "X17 X24", oracle("pattern_points lattices", STRONG + ", " + hkl_sql(10) + ", " + MATCH.split("pairs AS")[0].rstrip().rstrip(",") + """,
    numbered AS (SELECT pattern_id AS g0, theory_angle AS two_theta, rel, row_number() OVER (PARTITION BY pattern_id ORDER BY theory_angle) AS i FROM refl), """
    + greedy_sql("numbered", 0.5, "g0", True) + f"""
    SELECT pattern_id, matched, CAST(n AS INT) AS n, {R('cost')} AS cost, {R('rms')} AS rms_deg FROM matched"""))
def greedy_match(spark, folder):
    used = X.strongest(_observed(spark, folder), K).select("pattern_id", "order_no", "two_theta", "intensity")
    sizes = used.groupBy("pattern_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    cells = _cells(spark, folder).withColumns({"centering": F.lit("P"), "g": F.lit(1)})
    refl = X.reflections(cells, ["pattern_id", "g"])
    pairs = X.candidate_pairs(used, refl, K, ["g"], 0.5, shared=K)
    out = X.greedy_match(pairs, sizes, K, ["g"], 0.5)
    return out.select("pattern_id", "matched", "n", r("cost").alias("cost"), r("rms_deg").alias("rms_deg"))


PRESETS = "phases(g0, name, system, centering, a, c) AS (VALUES " + ", ".join(
    f"({i}, '{n}', '{s}', '{'HCP' if s == 'hexagonal' else c}', {a}, {'NULL' if z is None else z})" for i, (n, s, c, a, z) in enumerate(X.PHASES)) + """),
    hkl AS (SELECT CAST(x AS INT) AS h, CAST(y AS INT) AS k, CAST(z AS INT) AS l FROM range(0, 15) a(x), range(0, 15) b(y), range(0, 21) c(z)),
    pcalc AS (SELECT g0, system, centering, h, k, l, 1 / sqrt(CASE system WHEN 'cubic' THEN (h * h + k * k + l * l) / (a * a) WHEN 'tetragonal' THEN (h * h + k * k) / (a * a) + (l * l) / (c * c)
        ELSE 4 * (h * h + h * k + k * k) / (3 * a * a) + (l * l) / (c * c) END) AS d FROM phases, hkl
      WHERE (""" + ALLOWED + """) AND ((system = 'cubic' AND k <= h AND l <= k) OR (system = 'hexagonal' AND h <= 12 AND k <= 12) OR (system = 'tetragonal' AND k <= h))),
    pang AS (SELECT *, """ + ANGLE + """ AS two_theta, CASE system WHEN 'hexagonal' THEN greatest(0, 50 * (1 + cos(2 * pi() * (h + 2 * k) / 3 + pi() * l)))
        WHEN 'tetragonal' THEN CASE centering WHEN 'I' THEN 100 ELSE 25 END ELSE CASE centering WHEN 'F' THEN 16 WHEN 'I' THEN 4 ELSE 1 END END AS rel
      FROM pcalc WHERE d > 1.5406 / 2),
    pref AS (SELECT * FROM pang QUALIFY row_number() OVER (PARTITION BY g0, round(two_theta, 3) ORDER BY h, k, l) = 1),
    numbered AS (SELECT g0, two_theta, rel, row_number() OVER (PARTITION BY g0 ORDER BY two_theta) AS i FROM pref)"""


@register("preset_rank", "X18")
def preset_rank(spark, folder):
    """Rows only: the oracle engine fails on the recursion; tests rank known phases."""
    out = X.rank_presets(_observed(spark, folder), K)
    return out.select("pattern_id", "phase", "matched", r("cost").alias("cost"), "rank")


@register("d_ratio_class", "X19", oracle("pattern_points", OBS + """,
    six AS (SELECT pattern_id, d_obs, row_number() OVER (PARTITION BY pattern_id ORDER BY d_obs DESC) AS rk FROM pk QUALIFY rk <= 6),
    fp(no, label, v) AS (VALUES """ + ", ".join(f"({i}, '{n}', {v})" for i, (n, v) in enumerate(X.D_RATIOS)) + f"""),
    sc AS (SELECT s.pattern_id, no, label, sqrt(avg(pow(s.d_obs / f.d0 - v[s.rk], 2))) AS rmse FROM six s JOIN (SELECT pattern_id, max(d_obs) AS d0, count(*) AS n FROM six GROUP BY 1) f USING (pattern_id), fp
      WHERE f.n >= 2 GROUP BY 1, 2, 3)
    SELECT pattern_id, arg_min(label, row(rmse, no)) AS likely_system, {R('min(rmse)')} AS rmse FROM sc GROUP BY 1"""))
def d_ratio_class(spark, folder):
    out = X.d_ratio_class(_observed(spark, folder), K)
    return out.select("pattern_id", "likely_system", r("rmse").alias("rmse"))


@register("lattice_report", "X25", oracle("pattern_points lattices", STRONG + ", " + PRESETS.replace("numbered AS", "numbered0 AS") + f""",
    numbered AS (SELECT * FROM numbered0 WHERE g0 = 17), """ + greedy_sql("numbered", 0.15, "g0", False) + f"""
    SELECT pattern_id, matched AS matched_reflections, {R('rms')} AS rms_deg FROM matched"""))
def lattice_report(spark, folder):
    used = X.strongest(_observed(spark, folder), K).select("pattern_id", "order_no", "two_theta", "intensity")
    sizes = used.groupBy("pattern_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    refl = X.phase_reflections(X.phases(spark).where("phase LIKE '%magnetite%'"), ["phase"], 0.0, 180.0)
    hit = X.greedy_match(X.candidate_pairs(used, refl, K, ["phase"], 0.15), sizes, K, ["phase"], 0.15)
    rows = X.lattice_report(hit, K)
    return rows.groupBy("pattern_id").agg(
        F.count("miller").alias("matched_reflections"),
        r(F.sqrt(F.avg(F.col("delta_deg") * F.col("delta_deg")))).alias("rms_deg"))


@register("lattice_candidates", "X20 X21 X22 X23")
def lattice_candidates(spark, folder):
    """Cubic, hexagonal and tetragonal cells of every pattern, ranked; tests hold them against the whole trial grid."""
    found = X.rank_candidates(L.lattice_candidates(_observed(spark, folder), K), K)
    return found.select("pattern_id", "structure", r("a", 4).alias("a"), r("c", 4).alias("c"), "matched", "n", r("cost").alias("cost"),
                        r("score").alias("score"), r("volume", 4).alias("volume"), "rank")
