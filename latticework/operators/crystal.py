"""Reflection lists, indexing, phase matching and lattice searches.

Reflections come from small index grids joined to cells by equi keys; observed and
calculated positions meet in bucketed band joins; one-to-one matching is a fold over
the at most fourteen strongest peaks of a pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.functions import bragg as B
from latticework.session import settle, spread

PEAKS_USED = 14
INTENSITY_SHARE = 0.45
UNMATCHED = 8.0

# fixed values: common phases with literature cells: name, system, centering, a, c
PHASES = [
    ("Fe-BCC (α-Fe)", "cubic", "I", 2.866, None),
    ("Fe-FCC (γ-Fe)", "cubic", "F", 3.591, None),
    ("Al", "cubic", "F", 4.046, None),
    ("Cu", "cubic", "F", 3.615, None),
    ("Ni", "cubic", "F", 3.524, None),
    ("Cr", "cubic", "I", 2.884, None),
    ("W", "cubic", "I", 3.165, None),
    ("Mo", "cubic", "I", 3.147, None),
    ("V", "cubic", "I", 3.024, None),
    ("Ti-α (HCP)", "hexagonal", "HCP", 2.951, 4.684),
    ("Ti-β (BCC)", "cubic", "I", 3.306, None),
    ("Mg", "hexagonal", "HCP", 3.209, 5.211),
    ("Zn", "hexagonal", "HCP", 2.665, 4.947),
    ("Zr-α", "hexagonal", "HCP", 3.231, 5.147),
    ("Co-HCP", "hexagonal", "HCP", 2.507, 4.069),
    ("Martensite (C~0.2%)", "tetragonal", "I", 2.845, 2.980),
    ("FeO (wüstite)", "cubic", "F", 4.307, None),
    ("Fe₃O₄ (magnetite)", "cubic", "F", 8.396, None),
    ("α-Fe₂O₃ (hematite)", "hexagonal", "R", 5.035, 13.747),
    ("α-Al₂O₃ (corundum)", "hexagonal", "R", 4.758, 12.991),
    ("TiN", "cubic", "F", 4.242, None),
    ("TiC", "cubic", "F", 4.328, None),
    ("CrN", "cubic", "F", 4.149, None),
    ("ZrO₂ (cubic)", "cubic", "F", 5.090, None),
    ("Si", "cubic", "F", 5.431, None),
    ("Ge", "cubic", "F", 5.658, None),
]
# fixed values: spacing ratios d/d0 of the first reflections per lattice type
D_RATIOS = [
    ("FCC", [1.000, 0.816, 0.707, 0.577, 0.548, 0.500]),
    ("BCC", [1.000, 0.707, 0.577, 0.500, 0.447, 0.408]),
    ("HCP(ideal)", [1.000, 0.946, 0.832, 0.823, 0.756, 0.673]),
    ("SC", [1.000, 0.707, 0.577, 0.500, 0.447, 0.408]),
    ("TET(c/a~1)", [1.000, 0.894, 0.707, 0.640, 0.577, 0.500]),
]
# fixed values: axial ratios always tried in the hexagonal search
HCP_RATIOS = [1.568, 1.585, 1.588, 1.593, 1.623, 1.624, 1.633, 1.856, 1.886]


def phases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PHASES, "phase string, system string, centering string, a double, c double")


def _axis(name: str, upto: int | Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(upto) if isinstance(upto, int) else upto)).alias(name)


def _grid(cells: DataFrame, h: int | Column, k: int | Column, l: int | Column) -> DataFrame:  # noqa: E741
    """Index triples per cell; a bound may be a column, as k <= h."""
    out = cells.select("*", _axis("h", h))
    out = out.select("*", _axis("k", k))
    return out.select("*", _axis("l", l))


def _with_metric(cells: DataFrame, triclinic: bool) -> DataFrame:
    edges = [F.col(n) for n in ("system", "a", "b", "c", "alpha", "beta", "gamma")]
    return cells.withColumns(B.metric(*edges, triclinic=triclinic))


def _first_per_angle(df: DataFrame, key: list[str], cell: list[str]) -> DataFrame:
    """Of reflections whose angles agree to three decimals, the first index triple.

    ``cell`` names the numbers of the cell. Indices travel as one number, so that groups are
    hashed and not sorted; `spread` has put a cell's rows into one task.
    """
    code = (F.col("h") * 64 + F.col("k")) * 64 + F.col("l")
    first = df.groupBy(*key, *[c for c in ("system", "centering") if c not in key], F.round("two_theta", 3).alias("_t")).agg(
        F.min(code).alias("_hkl"), *[F.max(c).alias(c) for c in cell if c not in key]).drop("_t")
    part = lambda shift: F.shiftright("_hkl", shift).bitwiseAND(63)
    return first.withColumns({"h": part(12), "k": part(6), "l": part(0)}).drop("_hkl")


def reflections(cells: DataFrame, key: list[str], max_hkl: int = 10, max_angle: float = 90.0,
                wavelength: float = B.CU_K_ALPHA) -> DataFrame:
    """General reflection list per cell (system, centering, edges and angles as columns)."""
    metric = [f"m{n}" for n in (11, 22, 33, 12, 13, 23)]
    needed = _with_metric(cells, False).select(*key, *[c for c in ("system", "centering") if c not in key], *metric)
    g = _grid(spread(needed, key), max_hkl, max_hkl, max_hkl)
    h, k, l = F.col("h"), F.col("k"), F.col("l")  # noqa: E741
    angle = B.angle_from_d(B.d_from_metric(h, k, l), wavelength)
    g = g.where(B.may_diffract(h, k, l, wavelength)).where(B.allowed(h, k, l, F.col("centering"))).withColumn("two_theta", angle).where(F.col("two_theta") <= max_angle)
    g = _first_per_angle(g, key, metric).withColumn("d", B.d_from_metric(h, k, l))
    return g.select(*key, "h", "k", "l", "d", B.angle_from_d(F.col("d"), wavelength).alias("two_theta"),
                    B.relative_intensity(h, k, l, F.col("centering")).alias("rel"))


def phase_reflections(cells: DataFrame, key: list[str], lo: float | Column, hi: float | Column,
                      wavelength: float = B.CU_K_ALPHA) -> DataFrame:
    """Cubic (h>=k>=l), hexagonal and tetragonal (h>=k) lists used for phase matching.

    Hexagonal cells always use the close-packed rule; half a degree of margin is kept.
    """
    h, k, l = F.col("h"), F.col("k"), F.col("l")  # noqa: E741
    hexagonal = F.col("system") == "hexagonal"
    if "centering" not in key:
        cells = cells.withColumn("centering", F.when(hexagonal, "HCP").otherwise(F.col("centering")))
    bounds = {"_from": (lo if isinstance(lo, Column) else F.lit(float(lo))) - 0.5, "_to": (hi if isinstance(hi, Column) else F.lit(float(hi))) + 0.5}
    cells = cells.where("system IN ('cubic', 'hexagonal', 'tetragonal')").withColumns(bounds)
    names = [n for n in ("system", "centering", "a", "c") if n not in key]
    none = F.lit(None).cast("double")
    metric = B.metric(F.col("system"), F.col("a"), none, F.col("c"), none, none, none)
    cells = spread(cells.select(*key, *names, "_from", "_to").withColumns(metric), key)
    # one pass for all systems: the bounds of an index depend on the system; no index exceeds edge / spacing of the last angle
    finest = wavelength / (2 * F.sin(F.radians(F.least(F.greatest(F.col("_to"), F.lit(1e-3)), F.lit(180.0)) / 2)))
    reach = lambda edge: F.greatest(F.floor(F.least(edge / finest, F.lit(100.0))) + 1, F.lit(0)).cast("int")
    top = F.least(F.when(hexagonal, 12).otherwise(14), reach(F.col("a")))
    g = _grid(cells, top, F.when(hexagonal, top).otherwise(h), F.when(F.col("system") == "cubic", k).otherwise(F.least(F.lit(20), reach(F.col("c")))))
    c = F.when(hexagonal, "HCP").otherwise(F.col("centering"))
    spacing = B.d_from_hkl(h, k, l, F.col("system"), F.col("a"), none, F.col("c"))
    g = g.where(B.may_diffract(h, k, l, wavelength)).where(B.allowed(h, k, l, c)).withColumn("two_theta", B.angle_from_d(spacing, wavelength))
    g = g.where(F.col("two_theta").between(F.col("_from"), F.col("_to")))
    g = _first_per_angle(g, key, ["a", "c"]).withColumn("d", spacing).withColumn("two_theta", B.angle_from_d(F.col("d"), wavelength))
    rel = (
        F.when(F.col("system") == "hexagonal", B.hcp_factor(h, k, l))
        .when(F.col("system") == "tetragonal", F.when(c == "I", 100.0).otherwise(25.0))
        .otherwise(F.when(c == "F", 16.0).when(c == "I", 4.0).otherwise(1.0))
    )
    return g.select(*key, "h", "k", "l", "d", "two_theta", rel.alias("rel"))


def allowed_counts(cells: DataFrame, max_hkl: int = 10) -> DataFrame:
    """Cells with the numbers of index triples their centering allows, in all and with h > k.

    The triples are counted once per centering, not per cell.
    """
    ok = B.allowed(F.col("h"), F.col("k"), F.col("l"), F.col("centering"))
    kinds = _grid(cells.select("centering").distinct(), max_hkl, max_hkl, max_hkl).groupBy("centering").agg(
        F.count_if(ok).alias("allowed"), F.count_if(ok & (F.col("h") > F.col("k"))).alias("allowed_upper"))
    kinds = kinds.withColumnRenamed("centering", "_kind")
    return cells.join(F.broadcast(kinds), F.col("centering").eqNullSafe(F.col("_kind"))).drop("_kind")  # one row per centering


def plane_families(cells: DataFrame, key: list[str], max_hkl: int = 10) -> DataFrame:
    """Label and multiplicity of every plane of every cell; both are worked out once per system."""
    h, k, l = F.col("h"), F.col("k"), F.col("l")  # noqa: E741
    kinds = _grid(cells.select("system").distinct(), max_hkl, max_hkl, max_hkl).where("h + k + l > 0")
    plane = F.struct("h", "k", "l", B.family_label(h, k, l, F.col("system")).alias("label"), B.cubic_multiplicity(h, k, l).alias("multiplicity"))
    kinds = kinds.groupBy(F.col("system").alias("_kind")).agg(F.array_sort(F.collect_list(plane)).alias("_planes"))
    found = spread(cells.select(*key, "system"), key).join(F.broadcast(kinds), F.col("system").eqNullSafe(F.col("_kind")))
    return found.select(*key, F.explode("_planes").alias("_p")).select(*key, "_p.*")


def reverse_index(peaks: DataFrame, cells: DataFrame, keys: list[str], tolerance: float = 0.01,
                  max_hkl: int = 10) -> DataFrame:
    """All index triples whose spacing is within the tolerance of each peak's spacing.

    ``cells`` has one row per pattern. Equivalent planes of cubic and tetragonal cells
    count once; rank orders by closeness (to nine decimals, then by indices).
    """
    span = peaks.groupBy(*keys).agg(F.min("d_obs").alias("_dlo"), F.max("d_obs").alias("_dhi"))
    g = _grid(spread(_with_metric(cells.join(span, keys), True), keys), max_hkl, max_hkl, max_hkl)
    h, k, l = F.col("h"), F.col("k"), F.col("l")  # noqa: E741
    g = g.where(~((h == 0) & (k == 0) & (l == 0)))
    if max_hkl > 8:
        g = g.where((F.lower("system") != "triclinic") | (F.greatest(h, k, l) <= 8))
    g = g.withColumn("d", B.d_from_metric(h, k, l))
    g = g.where(F.col("d").between(F.col("_dlo") - tolerance, F.col("_dhi") + tolerance)).select(
        *keys, "system", "h", "k", "l", "d")
    w = float(tolerance)
    home = F.floor(F.col("d") / w)
    near = peaks.withColumn("_b", F.floor(F.col("d_obs") / w)).join(
        g.withColumn("_b", F.explode(F.array(home - 1, home, home + 1))).hint("merge"), [*keys, "_b"]
    ).withColumn("diff", F.abs(F.col("d") - F.col("d_obs"))).where(F.col("diff") < tolerance)
    fh, fk, fl = B.family(h, k, l, F.col("system"))
    best = near.groupBy(*keys, "idx", fh.alias("_fh"), fk.alias("_fk"), fl.alias("_fl")).agg(
        F.min_by(F.struct("h", "k", "l", "d", "diff"), F.struct(F.round("diff", 9), F.col("h"), F.col("k"), F.col("l"))).alias("_r")
    ).select(*keys, "idx", "_r.*")
    rank = F.row_number().over(Window.partitionBy(*keys, "idx").orderBy(F.round("diff", 9), "h", "k", "l"))
    return best.withColumn("rank", rank)


def match_angles(peaks: DataFrame, refl: DataFrame, keys: list[str], tolerance: float = 0.5,
                 use_intensity: bool = False) -> DataFrame:
    """Reflections within the tolerance of each peak, scored by closeness."""
    w = float(tolerance)
    home = F.floor(F.col("theory_angle") / w)
    rhs = refl.withColumnRenamed("two_theta", "theory_angle").withColumn(
        "_b", F.explode(F.array(home - 1, home, home + 1)))
    # the list grows with the cells and its estimated size ignores the index grid: never broadcast
    pairs = peaks.withColumn("_b", F.floor(F.col("two_theta") / w)).join(rhs.hint("merge"), [*keys, "_b"]).drop("_b")
    pairs = pairs.withColumn("angle_diff", F.abs(F.col("theory_angle") - F.col("two_theta"))).where(
        F.col("angle_diff") <= tolerance)
    score = 1 - F.col("angle_diff") / tolerance
    if use_intensity:
        ratio = F.col("intensity") / (F.col("rel") * 10)
        factor = 0.5 + 0.5 * F.least(ratio, 1 / ratio)
        score = F.when((F.col("rel") != 0) & (F.col("intensity") > 0), score * factor).otherwise(score)
    rank = F.row_number().over(Window.partitionBy(*keys, "idx").orderBy(F.desc("match_score"), "theory_angle"))
    return pairs.withColumn("match_score", score).withColumn("rank", rank)


def auto_index(peaks: DataFrame, cells: DataFrame, keys: list[str], tolerance: float = 0.5,
               max_hkl: int = 10) -> DataFrame:
    """Up to five index families per peak: by angle, else (per peak) by spacing.

    Every peak keeps a row; unmatched ones have NULL indices and confidence 0.
    """
    plain = cells.withColumn("centering", F.lit("P"))
    refl = reflections(plain, keys, max_hkl)
    hits = match_angles(peaks, refl, keys, tolerance).where("rank <= 40").join(
        cells.select(*keys, "system"), keys)
    fh, fk, fl = B.family(F.col("h"), F.col("k"), F.col("l"), F.col("system"))
    row = F.struct("h", "k", "l", "match_score", "theory_angle")
    best = hits.groupBy(*keys, "idx", fh.alias("_a"), fk.alias("_b"), fl.alias("_c")).agg(
        F.max_by(row, F.struct(F.col("match_score"), -F.col("theory_angle"))).alias("_r")).select(*keys, "idx", "_r.*")
    order = Window.partitionBy(*keys, "idx").orderBy(F.desc("match_score"), "theory_angle")
    top = settle(best.withColumn("rank", F.row_number().over(order)).where("rank <= 5").drop("theory_angle"))
    left = peaks.join(top.select(*keys, "idx").distinct(), [*keys, "idx"], "left_anti")
    back = reverse_index(left.withColumn("d_obs", B.d_from_angle(F.col("two_theta"))).select(*keys, "idx", "d_obs"),
                         cells, keys, 0.05, max_hkl).where("rank <= 5")
    back = back.select(*keys, "idx", "h", "k", "l", F.lit(None).cast("double").alias("match_score"), "rank")
    found = top.select(*keys, "idx", "h", "k", "l", "match_score", "rank").unionByName(back)
    out = peaks.join(found, [*keys, "idx"], "left")
    return out.withColumn("confidence", F.when(F.col("h").isNull(), 0.0).otherwise(F.coalesce("match_score", F.lit(0.5))))


def index_with_cell(peaks: DataFrame, cells: DataFrame, keys: list[str], tolerance: float = 0.5) -> DataFrame:
    """Indexing with whatever is known about the cell.

    A usable edge (0 < a <= 100): automatic indexing, and when a whole pattern stays
    without indices, spacings with a wider net. No usable edge: cubic, from the first
    peak taken as (111).
    """
    first = peaks.groupBy(*keys).agg(F.min_by("two_theta", "idx").alias("_t0"))
    known = cells.join(first, keys, "right")
    usable = F.coalesce((F.col("a") > 0) & (F.col("a") <= 100), F.lit(False))
    good = settle(known.where(usable).drop("_t0"))
    guess = known.where(~usable).select(
        *keys, F.lit("cubic").alias("system"), (B.d_from_angle(F.col("_t0")) * F.sqrt(F.lit(3.0))).alias("a"),
        *[F.lit(None).cast("double").alias(c) for c in ("b", "c", "alpha", "beta", "gamma")])
    cols = [*keys, "idx", "h", "k", "l", "rank"]
    auto = settle(auto_index(peaks.join(good.select(*keys), keys, "left_semi"), good, keys, tolerance).select(*cols))
    empty = auto.groupBy(*keys).agg(F.max("h").alias("_any")).where("_any IS NULL").select(*keys)
    retry = good.select(*guess.columns).join(empty, keys).unionByName(guess)
    obs = peaks.withColumn("d_obs", B.d_from_angle(F.col("two_theta"))).select(*keys, "idx", "d_obs")
    wide = reverse_index(obs.join(retry.select(*keys), keys, "left_semi"), retry, keys, 0.1, 15).where("rank <= 5")
    done = auto.join(empty, keys, "left_anti").where("h IS NOT NULL").unionByName(wide.select(*cols))
    return peaks.select(*keys, "idx", "two_theta").join(done, [*keys, "idx"], "left")


def strongest(peaks: DataFrame, keys: list[str], count: int = PEAKS_USED) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("intensity"), "two_theta"))
    return peaks.where("two_theta > 0").withColumn("order_no", rank).where(F.col("order_no") <= count)


def greedy_match(pairs: DataFrame, sizes: DataFrame, keys: list[str], group: list[str], tolerance: float) -> DataFrame:
    """One-to-one assignment per (pattern, group): strongest peak first, best free reflection.

    ``pairs``: (keys, group, order_no, i, delta, share, rel), one row per peak and
    reflection within the tolerance; ``share`` is the peak's intensity over the maximum.
    ``sizes``: peaks per pattern (keys, n). Unmatched peaks cost a fixed amount.
    """
    option = F.struct("i", "delta", "rel", "h", "k", "l", "two_theta")
    per_peak = pairs.groupBy(*keys, *group, "order_no").agg(
        F.max("share").alias("share"), F.max("angle").alias("angle"),
        F.array_sort(F.collect_list(option)).alias("options"))
    item = F.struct("order_no", "share", "angle", "options")
    rows = per_peak.groupBy(*keys, *group).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    tol2 = tolerance * tolerance

    def step(state: Column, item: Column) -> Column:
        free = F.filter(item["options"], lambda o: ~F.array_contains(state["used"], o["i"]))
        top = F.array_max(F.transform(free, lambda o: F.greatest(o["rel"], F.lit(1e-9))))
        scored = F.transform(free, lambda o: F.struct(
            (o["delta"] * o["delta"] + F.coalesce(
                F.lit(INTENSITY_SHARE * tol2) * F.pow(item["share"] - F.greatest(o["rel"], F.lit(1e-9)) / top, F.lit(2.0)),
                F.lit(0.0))).alias("score"),
            o["i"].alias("i"), o["delta"].alias("delta"), o["h"].alias("h"), o["k"].alias("k"), o["l"].alias("l"),
            o["two_theta"].alias("two_theta"), item["order_no"].alias("order_no"), item["angle"].alias("angle"), o["rel"].alias("rel")))
        best = F.array_min(scored)
        return F.when(best.isNull(), state).otherwise(F.struct(
            F.concat(state["used"], F.array(best["i"])).alias("used"),
            (state["cost"] + best["score"]).alias("cost"),
            (state["squares"] + best["delta"] * best["delta"]).alias("squares"),
            F.concat(state["picks"], F.array(best)).alias("picks")))

    pick = ("array<struct<score:double,i:int,delta:double,h:int,k:int,l:int,two_theta:double,"
            "order_no:int,angle:double,rel:double>>")
    start = F.struct(
        F.array().cast("array<int>").alias("used"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("squares"),
        F.array().cast(pick).alias("picks"))
    rows = rows.withColumn("_m", F.aggregate("_items", start, step)).join(sizes, keys)
    matched = F.size("_m.picks")
    return rows.select(
        *keys, *group, matched.alias("matched"), "n",
        (F.col("_m.cost") + (F.col("n") - matched) * (UNMATCHED * tol2)).alias("cost"),
        F.when(matched > 0, F.sqrt(F.col("_m.squares") / matched)).alias("rms_deg"), F.col("_m.picks").alias("picks"))


def candidate_pairs(peaks: DataFrame, refl: DataFrame, keys: list[str], group: list[str], tolerance: float,
                    shared: list[str] | None = None) -> DataFrame:
    """Peaks joined to the reflections within the tolerance.

    ``shared`` keys (when cells belong to one pattern) restrict the join further.
    """
    w = float(tolerance)
    top = peaks.groupBy(*keys).agg(F.greatest(F.max("intensity"), F.lit(1e-12)).alias("_top"))
    lhs = peaks.join(top, keys).select(
        *keys, "order_no", F.col("two_theta").alias("angle"), (F.col("intensity") / F.col("_top")).alias("share"),
        F.floor(F.col("two_theta") / w).alias("_b"))
    number = F.row_number().over(Window.partitionBy(*(shared or []), *group).orderBy("two_theta"))
    home = F.floor(F.col("two_theta") / w)
    rhs = refl.withColumn("i", number).withColumn("_b", F.explode(F.array(home - 1, home, home + 1)))
    # lists of the patterns' own cells grow with them, and their estimated size ignores the index grid
    return lhs.join(rhs.hint("merge") if shared else rhs, [*(shared or []), "_b"]).withColumn(
        "delta", F.abs(F.col("two_theta") - F.col("angle"))).where(F.col("delta") <= tolerance).drop("_b")


def rank_presets(peaks: DataFrame, keys: list[str], tolerance: float = 0.15) -> DataFrame:
    """Every common phase against every pattern, best first.

    Order: match rate in steps of 0.05, then cost, then name (a total order).
    """
    spark = peaks.sparkSession
    used = settle(strongest(peaks, keys).select(*keys, "order_no", "two_theta", "intensity"))
    refl = settle(phase_reflections(phases(spark), ["phase"], 0.0, 180.0))
    sizes = used.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.min("two_theta").alias("_lo"), F.max("two_theta").alias("_hi"))
    pairs = candidate_pairs(used, refl, keys, ["phase"], tolerance)
    hit = greedy_match(pairs, sizes.select(*keys, "n"), keys, ["phase"], tolerance).drop("n", "picks")
    angles = refl.groupBy("phase").agg(F.collect_list("two_theta").alias("_angles"))
    every = sizes.withColumn("phase", F.explode(F.array(*[F.lit(p[0]) for p in PHASES]))).join(angles, "phase").where(
        F.exists("_angles", lambda t: t.between(F.col("_lo") - 1.5, F.col("_hi") + 1.5))).drop("_angles")
    out = every.join(hit, [*keys, "phase"], "left").select(
        *keys, "phase", "n", F.coalesce("matched", F.lit(0)).alias("matched"),
        F.coalesce("cost", F.col("n") * (UNMATCHED * tolerance * tolerance)).alias("cost"), "rms_deg")
    out = out.withColumn("match_rate", F.col("matched") / F.col("n"))
    band = F.floor(F.col("match_rate") / 0.05 + 1e-9)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(band.desc(), "cost", "phase")))


def d_ratio_class(spacings: DataFrame, keys: list[str]) -> DataFrame:
    """Lattice type whose ratio pattern is closest to the six largest spacings."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("d_obs")))
    first = spacings.withColumn("_r", rank).where("_r <= 6")
    arr = first.groupBy(*keys).agg(F.sort_array(F.collect_list("d_obs"), asc=False).alias("_d")).where(F.size("_d") >= 2)
    prints = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(n).alias("label"), F.array(*map(F.lit, v)).alias("fp"))
                       for i, (n, v) in enumerate(D_RATIOS)])
    rows = arr.withColumn("_f", F.explode(prints)).select(*keys, "_d", "_f.*")
    n = F.size("_d")
    squares = F.aggregate(F.zip_with(F.col("_d"), F.slice("fp", 1, n), lambda d, f: F.pow(d / F.get("_d", 0) - f, F.lit(2.0))),
                          F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("rmse", F.sqrt(squares / n))
    return rows.groupBy(*keys).agg(F.min_by("label", F.struct("rmse", "no")).alias("likely_system"), F.min("rmse").alias("rmse"))


def size_penalty(system: Column, a: Column) -> Column:
    """Grows for implausibly large cells of each system."""
    over = lambda limit, weight: F.when(a > limit, weight * F.pow(a - limit, F.lit(2.0))).otherwise(0.0)
    return F.when(system == "hexagonal", over(4.0, 0.5)).when(system == "tetragonal", over(8.0, 0.05)).otherwise(over(6.0, 0.5))


def rank_candidates(found: DataFrame, keys: list[str], tolerance: float = 0.12) -> DataFrame:
    """Score lattice candidates (free parameters and size cost extra) and rank them.

    Order: match rate in steps of 0.04, then score, then structure (a total order).
    """
    params = F.when(F.col("system") == "cubic", 1).otherwise(2)
    score = F.col("cost") + 0.5 * params * F.col("matched") * (tolerance * tolerance) + size_penalty(F.col("system"), F.col("a"))
    a2 = F.col("a") * F.col("a")
    volume = F.when(F.col("system") == "hexagonal", F.sqrt(F.lit(3.0)) / 2 * a2 * F.col("c")).otherwise(a2 * F.col("c"))
    out = found.withColumns({"score": score, "match_rate": F.col("matched") / F.col("n"), "volume": volume})
    band = F.floor(F.col("match_rate") / 0.04 + 1e-9)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(band.desc(), "score", "structure")))


def lattice_report(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Per matched peak: index label, both spacings and their difference."""
    rows = matched.select(*keys, F.explode("picks").alias("p"))
    d_obs = B.d_from_angle(F.col("p.angle"))
    d_calc = B.d_from_angle(F.col("p.two_theta"))
    label = F.concat(F.lit("("), F.col("p.h").cast("string"), F.col("p.k").cast("string"), F.col("p.l").cast("string"), F.lit(")"))
    return rows.select(
        *keys, F.col("p.angle").alias("two_theta"), label.alias("miller"), d_obs.alias("d_measured"), d_calc.alias("d_theory"),
        F.col("p.delta").alias("delta_deg"), F.abs(d_obs - d_calc).alias("delta_d"),
        B.cubic_multiplicity(F.col("p.h"), F.col("p.k"), F.col("p.l")).alias("multiplicity"))
