"""Size, strain, texture, phase fractions, stress and dislocation analysis."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.bragg import CU_K_ALPHA, d_from_angle, theta
from latticework.operators.peaks import profile_cutout
from latticework.operators.scans import CHUNK, chunk_of, core, dense_index, halo, ordered, running_total
from latticework.operators.stats import attach, percentiles
from latticework.operators.walks import walk_down

MIN_WIDTH_DEG = 1e-4

# fixed values: contrast-factor presets per structure
# structure, q of pure edge, q of pure screw, C(h00) edge, C(h00) screw
CONTRAST = [
    ("bcc", 1.310, 2.647, 0.256, 0.305),
    ("fcc", 1.71, 2.46, 0.256, 0.305),
]
# fixed values: default elastic constants in GPa: structure, C11, C12, C44
ELASTIC = [
    ("fcc", 204.6, 137.7, 126.2),
    ("bcc", 231.4, 134.7, 116.4),
]


def contrast_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTRAST, "structure string, q_edge double, q_screw double, ch00_edge double, ch00_screw double")


def elastic_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ELASTIC, "structure string, c11 double, c12 double, c44 double")


def corrected_width(observed: Column, instrument: float, method: str = "none") -> Column:
    """Remove the instrument's share of a peak width; never below the floor."""
    inst = max(0.0, instrument or 0.0)
    if not inst or method == "none":
        value = observed
    elif method == "subtract":
        value = observed - inst
    else:
        value = F.sqrt(F.greatest(F.lit(0.0), observed * observed - inst * inst))
    return F.when(observed > 0, F.greatest(F.lit(MIN_WIDTH_DEG), value)).otherwise(observed)


def scherrer_nm(fwhm: Column, two_theta: Column, wavelength: float = CU_K_ALPHA, k: float = 0.9) -> Column:
    """Crystallite size in nm; 0 when the denominator vanishes."""
    beta = F.radians(fwhm) * F.cos(theta(two_theta))
    return F.when(beta == 0, 0.0).otherwise(F.lit(k * wavelength) / beta / 10)


def size_statistics(df: DataFrame, keys: list[str], size: str = "size_nm") -> DataFrame:
    """Mean, both medians (true and upper-middle), range and population std of valid sizes."""
    good = df.where((F.col(size) > 0) & (F.col(size) < float("inf")))
    basic = good.groupBy(*keys).agg(
        F.avg(size).alias("average"), F.min(size).alias("min"), F.max(size).alias("max"),
        F.stddev_pop(size).alias("std"), F.count(size).alias("n"))
    med = percentiles(good, keys, size, {"median": 0.5, "median_upper": 0.5}, upper=("median_upper",))
    return basic.join(med, keys)


def _line(df: DataFrame, keys: list[str], y: Column, x: Column) -> DataFrame:
    """Least-squares line per key with r2 (0 without variance); NULL when x is constant."""
    fit = df.withColumns({"_x": x, "_y": y}).groupBy(*keys).agg(
        F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_r2("_y", "_x").alias("_r2"), F.regr_syy("_y", "_x").alias("_syy"),
        F.regr_sxx("_y", "_x").alias("_sxx"), F.count(F.lit(1)).alias("n"),
        F.min("_x").alias("x_min"), F.max("_x").alias("x_max"))
    return fit.withColumn("r2", F.when(F.col("_syy") > 1e-30, F.col("_r2")).otherwise(F.lit(0.0)))


def williamson_hall(
    peaks: DataFrame, keys: list[str], wavelength: float = CU_K_ALPHA, k: float = 0.9,
    instrument: float = 0.0, method: str = "none", min_fwhm: float = 1e-4,
) -> DataFrame:
    """Strain and size per pattern from width against angle (two peaks at least)."""
    width = corrected_width(F.col("fwhm"), instrument, method)
    pts = peaks.where("two_theta > 0 AND fwhm > 0").withColumn("_w", width).where(F.col("_w") >= min_fwhm)
    fit = _line(pts, keys, F.radians("_w") * F.cos(theta(F.col("two_theta"))), F.sin(theta(F.col("two_theta"))))
    fit = fit.where((F.col("n") >= 2) & (F.col("n") * F.col("_sxx") >= 1e-24))
    return fit.withColumns({
        "microstrain": F.col("slope") / 4,
        "size_nm": F.when(F.col("intercept") > 1e-12, F.lit(k * wavelength) / F.col("intercept") / 10),
    }).drop("_r2", "_syy", "_sxx")


def fitted_line(fit: DataFrame, steps: int = 25) -> DataFrame:
    """The regression line sampled evenly over its x range."""
    span = F.col("x_max") - F.col("x_min")
    span = F.when(span == 0, 1e-6).otherwise(span)
    pts = fit.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    x = F.col("x_min") + F.col("step") / steps * span
    return pts.withColumn("x", x).withColumn("y", F.col("intercept") + F.col("slope") * F.col("x"))


def crystallinity(points: DataFrame, peaks: DataFrame, keys: list[str]) -> DataFrame:
    """Area of the peak regions over the whole area above the lowest sample.

    A region reaches out to 10 % of the peak; overlapping regions count twice.
    """
    low = points.groupBy(*keys).agg(F.min("intensity").alias("_bg"))
    w = ordered(keys)
    curve = points.join(low, keys).withColumn("_y", F.greatest(F.col("intensity") - F.col("_bg"), F.lit(0.0)))
    curve = core(halo(curve, "idx", 1).withColumns({
        "_dx": F.lead("two_theta").over(w) - F.col("two_theta"), "_ny": F.lead("_y").over(w)}))
    area = F.coalesce((F.col("_y") + F.col("_ny")) * F.col("_dx") / 2, F.lit(0.0))
    curve = running_total(curve, keys, "idx", area, "_cum").withColumn("_area", area)
    total = curve.groupBy(*keys).agg(F.sum("_area").alias("_total"))
    level = F.col("_bg") + (F.col("intensity") - F.col("_bg")) * 0.1
    reach = walk_down(points, peaks.join(low, keys), keys, "idx", "intensity", "two_theta", level)
    marks = reach.select(*keys, F.explode(F.array(
        F.struct(F.col("right.p").alias("p"), F.lit(1.0).alias("s")),
        F.struct(F.col("left.p").alias("p"), F.lit(-1.0).alias("s")))).alias("m"))
    marks = marks.select(*keys, F.col("m.p").alias("idx"), F.col("m.s").alias("_s"))
    inside = marks.join(curve.select(*keys, F.col("idx").cast("bigint").alias("idx"), "_cum"), [*keys, "idx"]).groupBy(*keys).agg(
        F.sum(F.col("_s") * F.col("_cum")).alias("_inside"))
    share = F.coalesce("_inside", F.lit(0.0)) / F.col("_total")
    return total.join(inside, keys, "left").select(*keys, F.when(
        F.col("_total") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))).otherwise(F.lit(0.0)).alias("crystallinity"))


def texture_index(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """Measured over reference intensity, relative to the group's geometric mean."""
    good = rows.where(F.col("intensity_measured").isNotNull() & (F.col("intensity_reference") > 0)).withColumn(
        "raw_ratio", F.col("intensity_measured") / F.col("intensity_reference"))
    norm = good.groupBy(group).agg(F.exp(F.avg(F.log(F.greatest("raw_ratio", F.lit(1e-30))))).alias("_norm"))
    return attach(good, norm, [group]).withColumn("orientation_index", F.col("raw_ratio") / F.col("_norm")).drop("_norm")


def phase_fractions(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """Intensity over reference ratio as a share of its group.

    A group with one phase or any unusable row gives nothing.
    """
    ok = (F.col("intensity_measured") > 0) & (F.col("rir") > 0)
    rows = rows.withColumn("weight", F.col("intensity_measured") / F.col("rir"))
    total = rows.groupBy(group).agg(
        F.sum("weight").alias("_sum"), F.count(F.lit(1)).alias("_n"),
        F.every(F.coalesce(ok, F.lit(False))).alias("_ok")).where("_ok AND _n >= 2 AND _sum > 0")
    return rows.join(total, group).withColumn("fraction", F.col("weight") / F.col("_sum")).drop("_sum", "_n", "_ok")


def psi_stress(scans: DataFrame, young_gpa: float, poisson: float, wavelength: float = CU_K_ALPHA,
               key: str = "scan_id") -> DataFrame:
    """Residual stress in MPa from plane spacing against the squared sine of the tilt."""
    if not (young_gpa > 0 and -1 < poisson < 0.5):
        raise ValueError("elastic constants out of range")
    pts = scans.where("two_theta_deg > 0 AND psi_deg IS NOT NULL")
    d = d_from_angle(F.col("two_theta_deg"), wavelength)
    s = F.sin(F.radians("psi_deg"))
    fit = _line(pts.withColumn("_d", d).where("_d > 0"), [key], F.col("_d"), s * s)
    fit = fit.where((F.col("n") >= 2) & (F.col("n") * F.col("_sxx") >= 1e-30) & (F.abs("intercept") >= 1e-9))
    return fit.select(
        key, F.col("intercept").alias("d0"), F.col("slope").alias("slope_d"), "r2", "n",
        (F.lit(young_gpa * 1000.0 / (1 + poisson)) * F.col("slope") / F.col("intercept")).alias("stress_mpa"))


def k_value(two_theta: Column, wavelength_nm: float) -> Column:
    return 2 * F.sin(theta(two_theta)) / wavelength_nm


def delta_k(two_theta: Column, fwhm: Column, wavelength_nm: float) -> Column:
    return 2 * F.cos(theta(two_theta)) * F.radians(fwhm) / wavelength_nm


def orientation(h: Column, k: Column, l: Column) -> Column:  # noqa: E741
    h2, k2, l2 = h * h, k * k, l * l
    n = h2 + k2 + l2
    return F.when(n == 0, 0.0).otherwise((h2 * k2 + h2 * l2 + k2 * l2) / (n * n))


def burgers_nm(edge: Column, structure: Column) -> Column:
    s = F.lower(structure)
    a = edge * 0.1
    return F.when(s == "fcc", a / math.sqrt(2)).when(s == "bcc", a * math.sqrt(3) / 2)


def contrast_factor(gamma: Column, q: Column, ch00: Column) -> Column:
    return ch00 * (1 - q * gamma)


def screw_fraction(q: Column, q_edge: Column, q_screw: Column) -> Column:
    span = q_screw - q_edge
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (q - q_edge) / span))
    return F.when(q.isNull() | (F.abs(span) < 1e-12), 0.5).otherwise(share)


def effective_ch00(q: Column, q_edge: Column, q_screw: Column, edge: Column, screw: Column) -> Column:
    f = screw_fraction(q, q_edge, q_screw)
    return edge * (1 - f) + screw * f


def lattice_constant(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """Median cubic cell edge over the indexed peaks of a pattern (two at least)."""
    n = F.col("h") * F.col("h") + F.col("k") * F.col("k") + F.col("l") * F.col("l")
    rows = peaks.where(F.col("h").isNotNull() & (F.col("two_theta") > 0)).withColumn(
        "_a", F.when(n > 0, d_from_angle(F.col("two_theta")) * F.sqrt(n)))
    enough = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").drop("_n")
    return percentiles(rows.where("_a > 0"), keys, "_a", {"lattice_a": 0.5}).join(enough, keys)


def structure_guess(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """fcc or bcc from the presence of (111) and (110); fcc when undecided."""
    is_hkl = lambda a, b, c: (F.abs("h") == a) & (F.abs("k") == b) & (F.abs("l") == c)
    seen = peaks.where(F.col("h").isNotNull()).groupBy(*keys).agg(
        F.bool_or(is_hkl(1, 1, 1)).alias("_111"), F.bool_or(is_hkl(1, 1, 0)).alias("_110"),
        F.count(F.lit(1)).alias("_n"))
    return seen.where("_n >= 2").select(*keys, F.when(F.col("_110") & ~F.col("_111"), "bcc").otherwise("fcc").alias("structure"))


def character(q: Column, q_edge: Column, q_screw: Column) -> Column:
    f = screw_fraction(q, q_edge, q_screw)
    return F.when(q.isNull() | (q <= 0), "mixed").when(f >= 0.9, "screw").when(f <= 0.1, "edge").otherwise("mixed")


def modified_wh(peaks: DataFrame, keys: list[str], structure: str, wavelength_nm: float = 0.15406) -> DataFrame:
    """Dislocation parameter q per pattern: the size term is scanned, the best line kept."""
    name, q_edge, q_screw, c_edge, c_screw = next(
        (row for row in CONTRAST if row[0] == structure.lower()), CONTRAST[1])
    rows = peaks.where("fwhm > 0 AND h IS NOT NULL").select(
        *keys, k_value(F.col("two_theta"), wavelength_nm).alias("K"),
        delta_k(F.col("two_theta"), F.col("fwhm"), wavelength_nm).alias("dK"),
        orientation(F.col("h"), F.col("k"), F.col("l")).alias("G")).where("K > 0 AND dK > 0")
    top = rows.groupBy(*keys).agg(
        F.least(F.max(F.col("dK") * F.col("dK")) * 0.9, F.lit(0.01)).alias("_amax"), F.count(F.lit(1)).alias("_n")).where("_n >= 3")
    grid = rows.join(top, keys).withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(100)))).withColumn(
        "alpha", F.col("_step") * F.col("_amax") / 100)
    y = (F.col("dK") * F.col("dK") - F.col("alpha")) / (F.col("K") * F.col("K"))
    lines = _line(grid.where(y > 0), [*keys, "alpha"], y, F.col("G")).where("n >= 3 AND _sxx > 0")
    best = lines.where("slope < 0 AND intercept > 0").groupBy(*keys).agg(
        F.max_by(F.struct("alpha", "slope", "intercept", "r2"), F.struct(F.col("r2"), -F.col("alpha"))).alias("_b"))
    plain = lines.where("alpha = 0").select(*keys, F.struct("alpha", "slope", "intercept", "r2").alias("_p"))
    out = top.select(*keys).join(best, keys, "left").join(plain, keys, "left").select(
        *keys, F.coalesce("_b", "_p").alias("f")).select(*keys, "f.*")
    sound = (F.col("intercept") > 0) & (F.col("slope") < 0)
    out = out.withColumn("q", F.when(sound, -F.col("slope") / F.col("intercept")))
    lit = [F.lit(v) for v in (q_edge, q_screw, c_edge, c_screw)]
    q = F.col("q")
    out = out.withColumns({"screw_fraction": screw_fraction(q, lit[0], lit[1]), "ch00": effective_ch00(q, *lit)})
    return out.withColumns({
        "phi": F.when((F.col("intercept") > 0) & (F.col("ch00") > 0), F.sqrt(F.col("intercept") / F.col("ch00"))),
        # scaled by ten wavelengths as the analysis defines it
        "size_nm": F.when(F.col("alpha") > 0, 0.9 / F.sqrt("alpha") * (wavelength_nm * 10)),
        "q_out_of_range": F.coalesce((q < min(q_edge, q_screw)) | (q > max(q_edge, q_screw)), F.lit(False)),
        "low_r2": F.coalesce(F.col("r2") < 0.9, F.lit(True)),
    })


def fourier(profile: DataFrame, keys: list[str], inverse_d: str, length: str, index: str = "i", count: str = "n") -> DataFrame:
    """Magnitude of the Fourier coefficient of each profile at each length."""
    phase = 2 * math.pi * F.col(inverse_d) * F.col(length) * (F.col(index) / F.col(count))
    sums = profile.groupBy(*keys).agg(
        F.sum(F.col("intensity") * F.cos(phase)).alias("_re"), F.sum(F.col("intensity") * F.sin(phase)).alias("_im"),
        F.max(count).alias("_n"))
    re, im = F.col("_re") / F.col("_n"), F.col("_im") / F.col("_n")
    return sums.select(*keys, re.alias("re"), im.alias("im"), F.sqrt(re * re + im * im).alias("magnitude"))


def numbered_profiles(points: DataFrame, peaks: DataFrame, keys: list[str], width: Column) -> DataFrame:
    cut = profile_cutout(points, peaks, keys, width)
    pk = [*keys, "peak_idx"]
    n = cut.groupBy(*pk).agg(F.count(F.lit(1)).alias("n"), F.min("centre").alias("centre1"))
    numbered = dense_index(cut, pk, ["idx"], chunk_of("idx", CHUNK), "i")
    return numbered.join(n.drop("centre1"), pk)


def modified_wa(points: DataFrame, peaks: DataFrame, keys: list[str], edge: float, structure: str,
                wavelength_nm: float = 0.15406) -> DataFrame:
    """Dislocation density per pattern from the Fourier coefficients of its peaks."""
    width = F.coalesce(F.when(F.col("fwhm") > 0, F.col("fwhm") * 3), F.lit(5.0))
    prof = numbered_profiles(points, peaks.where("h IS NOT NULL"), keys, width).where("n >= 10")
    cell = (edge * 0.1) ** 3
    orders = F.least(F.lit(50), F.floor(F.col("n") / 2)).cast("int")
    prof = prof.withColumns({
        "L_no": F.explode(F.sequence(F.lit(1), orders)),
        "inv_d": 1 / d_from_angle(F.col("centre"), wavelength_nm * 10)})
    prof = prof.withColumn("L", F.col("L_no") * cell)
    a = fourier(prof, [*keys, "peak_idx", "L_no", "L"], "inv_d", "L").where("magnitude > 0").withColumn(
        "ln_a", F.log("magnitude"))
    mean = a.groupBy(*keys).agg(F.avg("ln_a").alias("_mean"))
    y = (F.col("_mean") - F.col("ln_a")) / (F.col("L") * F.col("L"))
    pts = attach(a, mean, keys).withColumn("_y2", y).where(F.abs("_y2") < 1e10)
    fit = _line(pts, keys, F.col("_y2"), F.log("L")).where("n >= 3")
    b = (edge * 0.1 / math.sqrt(2) if structure.lower() == "fcc" else edge * 0.1 * math.sqrt(3) / 2) * 1e-9
    density = F.when(F.abs("slope") > 1e-10, F.abs("slope") * 2 / (math.pi * b * b)).otherwise(F.lit(0.0))
    return fit.select(*keys, "slope", "r2", F.coalesce(density, F.lit(0.0)).alias("dislocation_density"), "n")
