"""Size, strain, texture, stress and dislocation queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from latticework.functions.profiles import gaussian_area
from latticework.operators import micro as M
from latticework.plans import inputs as I
from latticework.plans.inputs import R, oracle
from latticework.plans.peak_queries import WIDTHS, maxima, widths
from latticework.plans.registry import r, register

K = ["pattern_id"]


def fcc_order(n: int = 64) -> list[tuple[int, int, int]]:
    """The first n face-centred cubic reflections of different angle: indices all odd or all even, largest first."""
    found: dict[int, tuple[int, int, int]] = {}
    for h in range(1, 2 * n):
        for k in range(h + 1):
            for l in range(k + 1):  # noqa: E741
                if h % 2 == k % 2 == l % 2:
                    total = h * h + k * k + l * l
                    found[total] = max(found.get(total, (h, k, l)), (h, k, l))
        if len([t for t in found if t <= h * h]) >= n:
            break
    return [found[t] for t in sorted(found)[:n]]


# more orders than a pattern has peaks
FCC_ORDER = fcc_order()

ORDERED = WIDTHS + """, ordered AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY two_theta) AS ord FROM widths),
    hkl(ord, h, k, l) AS (VALUES """ + ", ".join(f"({i + 1}, {h}, {k}, {l})" for i, (h, k, l) in enumerate(FCC_ORDER)) + """),
    indexed AS (SELECT t.*, h, k, l FROM ordered t JOIN hkl USING (ord))"""


def ordered_peaks(spark, folder):
    """All peaks of each pattern with widths and indices by angle order."""
    order = F.row_number().over(Window.partitionBy("pattern_id").orderBy("two_theta"))
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("hkl", t, strict=True)]) for t in FCC_ORDER])
    return widths(spark, folder).withColumn("_hkl", F.element_at(table, order)).select("*", "_hkl.*").drop("_hkl")


WH = ORDERED + """, whp AS (SELECT pattern_id, sin(radians(two_theta / 2)) AS x,
      radians(greatest(1e-4, sqrt(greatest(0, fwhm * fwhm - 0.01)))) * cos(radians(two_theta / 2)) AS y FROM ordered WHERE fwhm > 0),
    wh AS (SELECT pattern_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
      CASE WHEN regr_syy(y, x) > 1e-30 THEN regr_r2(y, x) ELSE 0 END AS r2, count(*) AS n, min(x) AS x_min, max(x) AS x_max
      FROM whp GROUP BY 1 HAVING count(*) >= 2 AND count(*) * regr_sxx(y, x) >= 1e-24)"""


def _wh(spark, folder):
    return M.williamson_hall(ordered_peaks(spark, folder), K, instrument=0.1, method="quadratic")


@register("williamson_hall_by_pattern", "M4 M1", oracle("pattern_points", WH + f"""
    SELECT pattern_id, n, {R('slope')} AS slope, {R('intercept')} AS intercept, {R('r2')} AS r2, {R('slope / 4')} AS microstrain,
      {R('CASE WHEN intercept > 1e-12 THEN 0.9 * 1.5406 / intercept / 10 END', 3)} AS size_nm FROM wh"""))
def williamson_hall_by_pattern(spark, folder):
    return _wh(spark, folder).select(
        "pattern_id", "n", r("slope").alias("slope"), r("intercept").alias("intercept"), r("r2").alias("r2"),
        r("microstrain").alias("microstrain"), r("size_nm", 3).alias("size_nm"))


@register("williamson_hall_line", "M5", oracle("pattern_points", WH + f"""
    SELECT pattern_id, CAST(s AS INT) AS step, {R('x_min + s / 25.0 * (x_max - x_min)')} AS x,
      {R('intercept + slope * (x_min + s / 25.0 * (x_max - x_min))')} AS y FROM wh, range(0, 26) g(s)"""))
def williamson_hall_line(spark, folder):
    return M.fitted_line(_wh(spark, folder)).select("pattern_id", "step", r("x").alias("x"), r("y").alias("y"))


@register("instrument_correction", "M1", oracle("pattern_points", WIDTHS + f"""
    SELECT pattern_id, idx, {R('greatest(1e-4, fwhm)')} AS plain, {R('greatest(1e-4, fwhm - 0.8)')} AS subtracted,
      {R('greatest(1e-4, sqrt(greatest(0, fwhm * fwhm - 0.64)))')} AS quadratic FROM widths"""))
def instrument_correction(spark, folder):
    w = F.col("fwhm")
    return widths(spark, folder).select(
        "pattern_id", "idx", r(M.corrected_width(w, 0.8, "none")).alias("plain"),
        r(M.corrected_width(w, 0.8, "subtract")).alias("subtracted"),
        r(M.corrected_width(w, 0.8, "quadratic")).alias("quadratic"))


SIZES = WIDTHS + """, sizes AS (SELECT pattern_id, idx,
      0.9 * 1.5406 / (radians(greatest(1e-4, fwhm - 0.1)) * cos(radians(two_theta / 2))) / 10 AS size_nm
      FROM widths WHERE fwhm > 0 AND two_theta > 0)"""


@register("scherrer_stats", "M2 M3", oracle("pattern_points", SIZES + f"""
    SELECT pattern_id, {R('avg(size_nm)', 4)} AS average, {R('median(size_nm)', 4)} AS median,
      {R('list_sort(list(size_nm))[count(*) // 2 + 1]', 4)} AS median_upper, {R('min(size_nm)', 4)} AS min,
      {R('max(size_nm)', 4)} AS max, {R('stddev_pop(size_nm)', 4)} AS std, count(*) AS n FROM sizes GROUP BY 1"""))
def scherrer_stats(spark, folder):
    w = widths(spark, folder).where("fwhm > 0 AND two_theta > 0")
    sizes = w.withColumn("size_nm", M.scherrer_nm(M.corrected_width(F.col("fwhm"), 0.1, "subtract"), F.col("two_theta")))
    out = M.size_statistics(sizes, K)
    return out.select("pattern_id", "n", *[r(c, 4).alias(c) for c in ("average", "median", "median_upper", "min", "max", "std")])


@register("crystallinity", "M6", oracle("pattern_points", WIDTHS + f""",
    bg AS (SELECT pattern_id, min(intensity) AS bg FROM pattern_points GROUP BY 1),
    seg AS (SELECT p.pattern_id, p.idx, (p.intensity - bg + lead(p.intensity) OVER w - bg) * 0.5 / 2 AS a
      FROM pattern_points p JOIN bg USING (pattern_id) WINDOW w AS (PARTITION BY p.pattern_id ORDER BY p.idx)),
    reach AS (SELECT w.pattern_id, w.idx,
        coalesce(max(CASE WHEN p.idx <= w.idx AND p.intensity <= bg + (w.intensity - bg) * 0.1 THEN p.idx END), 0) AS li,
        coalesce(min(CASE WHEN p.idx >= w.idx AND p.intensity <= bg + (w.intensity - bg) * 0.1 THEN p.idx END), 63) AS ri
      FROM widths w JOIN bg USING (pattern_id) JOIN pattern_points p USING (pattern_id) GROUP BY w.pattern_id, w.idx),
    inside AS (SELECT r.pattern_id, sum(s.a) AS a FROM reach r JOIN seg s ON s.pattern_id = r.pattern_id
      AND s.idx >= r.li AND s.idx < r.ri GROUP BY 1),
    total AS (SELECT pattern_id, sum(a) AS t FROM seg GROUP BY 1)
    SELECT pattern_id, {R('CASE WHEN t > 0 THEN least(1.0, greatest(0.0, coalesce(inside.a, 0) / t)) ELSE 0 END')} AS crystallinity
    FROM total LEFT JOIN inside USING (pattern_id)"""))
def crystallinity(spark, folder):
    out = M.crystallinity(I.pattern_points(spark, folder), maxima(spark, folder), K)
    return out.select("pattern_id", r("crystallinity").alias("crystallinity"))


@register("texture_index", "M7", oracle("intensity_rows", f"""
    SELECT group_id, phase_id, {R('intensity_measured / intensity_reference')} AS raw_ratio,
      {R('''intensity_measured / intensity_reference / exp(avg(ln(greatest(intensity_measured / intensity_reference, 1e-30)))
        OVER (PARTITION BY group_id))''')} AS orientation_index
    FROM intensity_rows WHERE intensity_reference > 0"""))
def texture_index(spark, folder):
    out = M.texture_index(I.intensity_rows(spark, folder))
    return out.select("group_id", "phase_id", r("raw_ratio").alias("raw_ratio"), r("orientation_index").alias("orientation_index"))


@register("qpa_fractions", "M8", oracle("intensity_rows", f"""
    SELECT group_id, phase_id, {R('intensity_measured / rir', 5)} AS weight,
      {R('intensity_measured / rir / sum(intensity_measured / rir) OVER w')} AS fraction
    FROM intensity_rows QUALIFY count(*) OVER w >= 2 AND min(intensity_measured) OVER w > 0 AND min(rir) OVER w > 0
    WINDOW w AS (PARTITION BY group_id)""".replace("QUALIFY count(*) OVER w >= 2 AND min(intensity_measured) OVER w > 0 AND min(rir) OVER w > 0\n    WINDOW w AS (PARTITION BY group_id)",
    "WINDOW w AS (PARTITION BY group_id) QUALIFY count(*) OVER w >= 2 AND min(intensity_measured) OVER w > 0 AND min(rir) OVER w > 0")))
def qpa_fractions(spark, folder):
    out = M.phase_fractions(I.intensity_rows(spark, folder))
    return out.select("group_id", "phase_id", r("weight", 5).alias("weight"), r("fraction").alias("fraction"))


@register("gaussian_area", "M9", oracle("pattern_points", WIDTHS + f"""
    SELECT pattern_id, idx, {R('CASE WHEN fwhm > 0 THEN intensity * fwhm / (2 * sqrt(2 * ln(2))) * sqrt(2 * pi()) END', 3)} AS area
    FROM widths"""))
def area(spark, folder):
    return widths(spark, folder).select("pattern_id", "idx", r(gaussian_area(F.col("intensity"), F.col("fwhm")), 3).alias("area"))


@register("sin2psi_stress", "M10", oracle("psi_scans", f"""
    p AS (SELECT scan_id, pow(sin(radians(psi_deg)), 2) AS x, 1.5406 / (2 * sin(radians(two_theta_deg / 2))) AS d FROM psi_scans),
    f AS (SELECT scan_id, regr_slope(d, x) AS s, regr_intercept(d, x) AS i, CASE WHEN regr_syy(d, x) > 1e-30 THEN regr_r2(d, x) ELSE 0 END AS r2,
      count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 2 AND count(*) * regr_sxx(d, x) >= 1e-30)
    SELECT scan_id, n, {R('i')} AS d0, {R('r2', 5)} AS r2, {R('210000.0 / 1.3 * s / i', 3)} AS stress_mpa FROM f"""))
def sin2psi_stress(spark, folder):
    out = M.psi_stress(I.psi_scans(spark, folder), 210.0, 0.3)
    return out.select("scan_id", "n", r("d0").alias("d0"), r("r2", 5).alias("r2"), r("stress_mpa", 3).alias("stress_mpa"))


GAMMA = "(h * h * k * k + h * h * l * l + k * k * l * l) / CAST(pow(h * h + k * k + l * l, 2) AS DOUBLE)"


@register("dislocation_terms", "M11", oracle("pattern_points", ORDERED + f"""
    SELECT pattern_id, idx, {R('2 * sin(radians(two_theta / 2)) / 0.15406')} AS k_value,
      {R('2 * cos(radians(two_theta / 2)) * radians(fwhm) / 0.15406')} AS delta_k, {R(GAMMA)} AS gamma,
      {R('0.256 * (1 - 1.71 * ' + GAMMA + ')')} AS contrast,
      {R("(3.0 + idx * 0.01) * 0.1 * CASE WHEN idx % 2 = 0 THEN 1 / sqrt(2) ELSE sqrt(3) / 2 END")} AS burgers_nm FROM indexed"""))
def dislocation_terms(spark, folder):
    p = ordered_peaks(spark, folder)
    g = M.orientation(F.col("h"), F.col("k"), F.col("l"))
    structure = F.when(F.col("idx") % 2 == 0, "fcc").otherwise("BCC")
    return p.select(
        "pattern_id", "idx", r(M.k_value(F.col("two_theta"), 0.15406)).alias("k_value"),
        r(M.delta_k(F.col("two_theta"), F.col("fwhm"), 0.15406)).alias("delta_k"), r(g).alias("gamma"),
        r(M.contrast_factor(g, F.lit(1.71), F.lit(0.256))).alias("contrast"),
        r(M.burgers_nm(3.0 + F.col("idx") * 0.01, structure)).alias("burgers_nm"))


@register("lattice_constant", "M12 M13", oracle("pattern_points", ORDERED + f""",
    est AS (SELECT pattern_id, 1.5406 / (2 * sin(radians(two_theta / 2))) * sqrt(h * h + k * k + l * l) AS a FROM indexed)
    SELECT pattern_id, {R('median(a)')} AS lattice_a, 'fcc' AS structure FROM est GROUP BY 1 HAVING count(*) >= 2"""))
def lattice_constant(spark, folder):
    p = ordered_peaks(spark, folder)
    out = M.lattice_constant(p, K).join(M.structure_guess(p, K), K)
    return out.select("pattern_id", r("lattice_a").alias("lattice_a"), "structure")


CONTRAST_SQL = "contrast(structure, qe, qs, ce, cs) AS (VALUES " + ", ".join(
    f"('{n}', {a}, {b}, {c}, {d})" for n, a, b, c, d in M.CONTRAST) + ")"


@register("contrast_presets", "M14 M18", oracle("pattern_points", CONTRAST_SQL + f""",
    e AS (SELECT pattern_id, idx, structure, 1.0 + intensity / 199999 AS q, qe, qs, ce, cs FROM pattern_points
      JOIN contrast ON structure = CASE idx % 2 WHEN 0 THEN 'fcc' ELSE 'bcc' END),
    f AS (SELECT *, greatest(0, least(1, (q - qe) / (qs - qe))) AS s FROM e)
    SELECT pattern_id, idx, structure, {R('s')} AS screw_fraction, {R('ce * (1 - s) + cs * s')} AS ch00,
      CASE WHEN s >= 0.9 THEN 'screw' WHEN s <= 0.1 THEN 'edge' ELSE 'mixed' END AS character FROM f"""))
def contrast_presets(spark, folder):
    p = I.pattern_points(spark, folder).select(
        "pattern_id", "idx", F.when(F.col("idx") % 2 == 0, "fcc").otherwise("bcc").alias("structure"),
        (1.0 + F.col("intensity") / 199999).alias("q"))
    p = p.join(F.broadcast(M.contrast_table(spark)), "structure")
    c = [F.col(n) for n in ("q", "q_edge", "q_screw", "ch00_edge", "ch00_screw")]
    return p.select("pattern_id", "idx", "structure", r(M.screw_fraction(*c[:3])).alias("screw_fraction"),
                    r(M.effective_ch00(*c)).alias("ch00"), M.character(*c[:3]).alias("character"))


@register("modified_wh", "M15", oracle("pattern_points", ORDERED + f""",
    kp AS (SELECT pattern_id, 2 * sin(radians(two_theta / 2)) / 0.15406 AS kk,
      2 * cos(radians(two_theta / 2)) * radians(fwhm) / 0.15406 AS dk, {GAMMA} AS g FROM indexed WHERE fwhm > 0),
    lim AS (SELECT pattern_id, least(max(dk * dk) * 0.9, 0.01) AS amax FROM kp WHERE kk > 0 AND dk > 0 GROUP BY 1 HAVING count(*) >= 3),
    grid AS (SELECT pattern_id, s * amax / 100 AS alpha, g AS x, (dk * dk - s * amax / 100) / (kk * kk) AS y
      FROM kp JOIN lim USING (pattern_id), range(0, 101) t(s)),
    fits AS (SELECT pattern_id, alpha, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
      CASE WHEN regr_syy(y, x) > 1e-30 THEN regr_r2(y, x) ELSE 0 END AS r2 FROM grid WHERE y > 0 GROUP BY 1, 2
      HAVING count(*) >= 3 AND regr_sxx(y, x) > 0),
    best AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY slope < 0 AND intercept > 0 DESC,
        CASE WHEN slope < 0 AND intercept > 0 THEN r2 END DESC, alpha) AS rk FROM fits),
    q AS (SELECT *, CASE WHEN intercept > 0 AND slope < 0 THEN -slope / intercept END AS q FROM best WHERE rk = 1)
    SELECT pattern_id, {R('alpha', 5)} AS alpha, {R('r2', 5)} AS r2, {R('q', 4)} AS q,
      {R('CASE WHEN q IS NULL THEN 0.5 ELSE greatest(0, least(1, (q - 1.71) / 0.75)) END', 4)} AS screw_fraction,
      CAST(coalesce(q < 1.71 OR q > 2.46, false) AS INT) AS q_out_of_range, CAST(r2 < 0.9 AS INT) AS low_r2 FROM q"""))
def modified_wh(spark, folder):
    out = M.modified_wh(ordered_peaks(spark, folder), K, "fcc")
    return out.select("pattern_id", r("alpha", 5).alias("alpha"), r("r2", 5).alias("r2"), r("q", 4).alias("q"),
                      r("screw_fraction", 4).alias("screw_fraction"), F.col("q_out_of_range").cast("int").alias("q_out_of_range"),
                      F.col("low_r2").cast("int").alias("low_r2"))


PROFILES = ORDERED + """, prof AS (SELECT w.pattern_id, w.idx AS peak_idx, w.two_theta AS centre, p.intensity,
      row_number() OVER (PARTITION BY w.pattern_id, w.idx ORDER BY p.idx) - 1 AS i, count(*) OVER (PARTITION BY w.pattern_id, w.idx) AS n
      FROM indexed w JOIN pattern_points p ON p.pattern_id = w.pattern_id
        AND p.two_theta BETWEEN w.two_theta - coalesce(nullif(fwhm, 0) * 3, 5) / 2 AND w.two_theta + coalesce(nullif(fwhm, 0) * 3, 5) / 2),
    lens AS (SELECT *, 2 * sin(radians(centre / 2)) / 1.5406 AS s, unnest(range(1, least(50, n // 2) + 1)) AS ln FROM prof WHERE n >= 10),
    coef AS (SELECT pattern_id, peak_idx, ln, ln * pow(0.36, 3) AS len_nm, sum(intensity * cos(2 * pi() * s * ln * pow(0.36, 3) * (i / n))) / max(n) AS re,
      sum(intensity * sin(2 * pi() * s * ln * pow(0.36, 3) * (i / n))) / max(n) AS im FROM lens GROUP BY 1, 2, 3)"""


@register("fourier_coefficients", "M16", oracle("pattern_points", PROFILES + f"""
    SELECT pattern_id, peak_idx, CAST(ln AS INT) AS order_no, {R('re', 3)} AS re, {R('im', 3)} AS im, {R('sqrt(re * re + im * im)', 3)} AS magnitude FROM coef"""))
def fourier_coefficients(spark, folder):
    width = F.coalesce(F.when(F.col("fwhm") > 0, F.col("fwhm") * 3), F.lit(5.0))
    prof = M.numbered_profiles(I.pattern_points(spark, folder), ordered_peaks(spark, folder), K, width).where("n >= 10")
    prof = prof.withColumn("order_no", F.explode(F.sequence(F.lit(1), F.least(F.lit(50), F.floor(F.col("n") / 2)).cast("int"))))
    prof = prof.withColumns({"L": F.col("order_no") * 0.36 ** 3, "inv_d": 2 * F.sin(F.radians(F.col("centre") / 2)) / 1.5406})
    out = M.fourier(prof, ["pattern_id", "peak_idx", "order_no"], "inv_d", "L")
    return out.select("pattern_id", "peak_idx", "order_no", r("re", 3).alias("re"), r("im", 3).alias("im"), r("magnitude", 3).alias("magnitude"))


@register("modified_wa", "M17", oracle("pattern_points", PROFILES + f""",
    lna AS (SELECT pattern_id, len_nm, ln(sqrt(re * re + im * im)) AS v FROM coef WHERE re * re + im * im > 0),
    ys AS (SELECT pattern_id, ln(len_nm) AS x, (avg(v) OVER (PARTITION BY pattern_id) - v) / (len_nm * len_nm) AS y FROM lna),
    fit AS (SELECT pattern_id, regr_slope(y, x) AS slope, CASE WHEN regr_syy(y, x) > 1e-30 THEN regr_r2(y, x) ELSE 0 END AS r2, count(*) AS n
      FROM ys WHERE abs(y) < 1e10 GROUP BY 1 HAVING count(*) >= 3)
    SELECT pattern_id, n, {R('slope', 4)} AS slope, {R('r2', 5)} AS r2,
      {R('CASE WHEN abs(slope) > 1e-10 THEN abs(slope) * 2 / (pi() * pow(0.36 / sqrt(2) * 1e-9, 2)) / 1e18 ELSE 0 END', 3)} AS density_per_nm2
    FROM fit"""))
def modified_wa(spark, folder):
    out = M.modified_wa(I.pattern_points(spark, folder), ordered_peaks(spark, folder), K, 3.6, "fcc")
    return out.select("pattern_id", "n", r("slope", 4).alias("slope"), r("r2", 5).alias("r2"),
                      r(F.col("dislocation_density") / 1e18, 3).alias("density_per_nm2"))
