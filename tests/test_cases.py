"""Small known cases: calibration, resampling, smoothing, peaks, gates, lattices, fits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import calibrate as C
from latticework.operators import candidates as K
from latticework.operators import crystal as X
from latticework.operators import lattice as L
from latticework.operators import evaluate as E
from latticework.operators import fit as FIT
from latticework.operators import micro as M
from latticework.operators import peaks as P
from latticework.operators import signal as T

PK = ["pattern_id"]
SK = ["sample_id"]


def values(df, column, *order):
    return [r[column] for r in df.orderBy(*order).collect()]


def test_parabola_apex_lies_between_samples(spark):
    t, y = P.parabolic_apex(*[F.lit(v) for v in (0.0, 1.0, 2.0, 100.0, 120.0, 115.0)])
    row = spark.range(1).select(t.alias("t"), y.alias("y")).first()
    assert 1 < row.t < 2 and row.y > 120


def test_two_separate_peaks_are_found(curve):
    t = np.linspace(1, 160, 600)
    rng = np.random.default_rng(7)
    y = 1100 + 9000 / (1 + ((t - 34.5) / 0.4) ** 2) + 7000 / (1 + ((t - 42.75) / 0.38) ** 2) + rng.normal(0, 15, t.size)
    got = values(P.numeric_curve_peaks(curve(y, t), PK), "two_theta", "two_theta")
    assert any(33.5 < g < 35.5 for g in got) and any(41.5 < g < 44 for g in got)


def test_adjacent_pair_stays_apart(curve):
    t = np.linspace(20, 35, 800)
    y = 900 + 5000 / (1 + ((t - 26.2) / 0.25) ** 2) + 4500 / (1 + ((t - 27.1) / 0.25) ** 2)
    assert P.numeric_curve_peaks(curve(y, t), PK).count() >= 2


def test_flat_and_short_curves_have_no_peaks(curve):
    assert P.numeric_curve_peaks(curve([100.0] * 50), PK).count() == 0
    assert P.numeric_curve_peaks(curve([1, 5, 1]), PK).count() == 0


def test_resample_cases(curve):
    same = curve([1.0, 2.0, 3.0], [0.0, 1.0, 2.0])
    assert values(C.resample_envelope(same, 0.0, 2.0, 3), "intensity", "idx") == [1.0, 2.0, 3.0]
    assert C.resample_envelope(curve([1.0, 2.0], [0.0, 1.0]), 0.0, 1.0, 5).count() == 5
    apex = curve([0.0, 40.0, 100.0, 40.0, 0.0], [0.0, 0.25, 0.5, 0.75, 1.0])
    assert max(values(C.resample_envelope(apex, 0.0, 1.0, 6), "intensity", "idx")) > 95


def test_flattened_top_is_restored_and_noise_is_not(spark, trace):
    y = [40.0] * 7 + [10.0] + [40.0] * 7
    t = trace(y).withColumnRenamed("y", "y_filled").withColumn("y_smooth", F.when(F.col("col") == 7, 28.0).otherwise(F.col("y_filled")))
    lim = spark.createDataFrame([(0, 4, 2.0, 0.5)], "sample_id bigint, radius int, min_prominence_px double, min_lift_px double")
    assert values(T.restore_peaks(t, SK, lim), "y_restored", "col")[7] == 10.0
    wave = [20 + 0.2 * math.sin(i) for i in range(20)]
    n = trace(wave)
    noise = n.withColumnRenamed("y", "y_filled").withColumn("y_smooth", F.col("y_filled") + 0.05)
    out = T.restore_peaks(noise, SK, T.fidelity_thresholds(n, SK))
    assert out.where("y_restored <> y_smooth").count() == 0


def test_spike_is_lowered_and_smoothing_never_lowers_peaks(trace, spark):
    t = trace([10, 10, 40, 10, 10])
    lim = spark.createDataFrame([(0, 6.5)], "sample_id bigint, spike_delta_px double")
    assert values(T.spike_repair(t, SK, lim), "y_repaired", "col") == [10, 10, 10, 10, 10]
    chain = spark.createDataFrame([(0, i, v) for i, v in enumerate([0.0, 30.0, 20.0, 0.0])], "sample_id bigint, col int, y double")
    assert values(T.spike_repair(chain, SK, lim), "y_repaired", "col") == [0.0, 10.0, 5.0, 0.0]
    out = T.default_smooth(trace([50, 55, 20, 55, 50, 52, 51]), SK)
    assert out.where("y_smooth > y").count() == 0


def test_confidence_terms_add_up(spark):
    row = spark.createDataFrame([(12.0, 30, 3.0, 4.0)], "color_dist double, y int, comp_score double, axis_dist double")
    got = row.select(K.confidence(F.lit(26.0), F.lit(0.5)).alias("c")).first().c
    want = 0.35 * math.exp(-12 / 20) + 0.25 * math.exp(-4 / 8) + 0.2 / (1 + math.exp(-0.8)) + 0.2 * (1 - math.exp(-4 / 6)) + 0.05
    assert got == pytest.approx(want)


def test_axis_maps_round_trip(spark):
    row = spark.createDataFrame([(0, 170, 90, 170, 1120, 780, 90, 5.0, 70.0, 0.0, 1000.0)],
                                "sample_id int, x0 int, y0 int, px1 int, px2 int, py1 int, py2 int, x_v1 double, x_v2 double, y_v1 double, y_v2 double")
    r = C.roundtrip(C.fit_axes(row)).first()
    assert r.total_mean_error_px == pytest.approx(0, abs=1e-9) and r.calibration_confidence == pytest.approx(1) and r.y_scale < 0


def test_fractions_and_texture_invariants(spark):
    rows = spark.createDataFrame([(1, i, 10.0 * (i + 1), 1.0 + i, 5.0 + i) for i in range(4)],
                                 "group_id int, phase_id int, intensity_measured double, rir double, intensity_reference double")
    assert sum(values(M.phase_fractions(rows), "fraction", "phase_id")) == pytest.approx(1)
    idx = values(M.texture_index(rows), "orientation_index", "phase_id")
    assert np.exp(np.mean(np.log(idx))) == pytest.approx(1)
    broken = rows.withColumn("rir", F.when(F.col("phase_id") == 2, 0.0).otherwise(F.col("rir")))
    assert M.phase_fractions(broken).count() == 0


def test_gates_treat_missing_errors_as_zero(spark):
    cols = ", ".join(f"{m} double" for m in E.MAIN)
    rows = [(1, "odd", None, 1.0, 0.9, 1.0, 0.1, 0.01, 0.1), (2, "clean", 99.0, 1.0, 0.9, 1.0, 0.1, 0.01, 0.1)]
    out = {r.sample_id: r.passed for r in E.gate_verdict(E.check_gates(spark.createDataFrame(rows, f"sample_id int, domain string, {cols}"), "strict")).collect()}
    assert out == {1: True, 2: False}


# pattern, structure, system, centering, a, c
KNOWN = [(1, "fcc", "cubic", "F", 4.046, 4.046), (2, "bcc", "cubic", "I", 2.866, 2.866), (3, "hcp", "hexagonal", "HCP", 2.951, 4.684),
         (4, "tetragonal-I", "tetragonal", "I", 3.1, 4.96)]


def known_peaks(spark):
    cells = spark.createDataFrame(KNOWN, "pattern_id bigint, structure string, system string, centering string, a double, c double")
    refl = X.phase_reflections(cells, ["pattern_id"], 20.0, 100.0).where("two_theta BETWEEN 20 AND 100 AND rel > 0")
    return refl.select("pattern_id", "two_theta", (200 - F.col("two_theta")).alias("intensity"))


def test_known_cells_are_recovered(spark):
    """The whole default grid finds cells as good as the known ones (larger multiples fit as well); small edges only, the known ones."""
    peaks = known_peaks(spark)
    for search in (L.Search(), L.Search(a_max=4.0)):
        found = {(r.pattern_id, r.structure): r for r in X.rank_candidates(L.lattice_candidates(peaks, PK, search), PK).collect()}
        for i, structure, _, _, a, c in KNOWN:
            if a > search.a_max:
                continue
            r = found[i, structure]
            assert r.matched == r.n and r.cost <= 0.04
            if search.a_max < 5 or structure in ("fcc", "hcp"):
                assert r.a == pytest.approx(a, abs=0.004) and r.c == pytest.approx(c, abs=0.02)
        assert found[3, "hcp"]["rank"] == 1
    best = {r.pattern_id: r.phase for r in X.rank_presets(peaks, PK).where("rank = 1").collect()}
    assert best[1] == "Al" and best[2].startswith("Fe-BCC")


def test_votes_bound_the_cost_of_every_cell(spark):
    """Each trial cell's votes are what a plain loop over its reflections gives, and no match costs less than its bound."""
    search = L.Search(a_min=2.8, a_max=3.4, step=0.04, kept=10**6)
    peaks = known_peaks(spark).where("pattern_id = 3").unionByName(
        spark.createDataFrame([(3, 33.3, 50.0), (3, 61.7, 20.0)], "pattern_id bigint, two_theta double, intensity double"))
    used = X.strongest(peaks, PK).select("pattern_id", "order_no", "two_theta", "intensity").cache()
    sizes = used.groupBy("pattern_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    table = L.shells(spark, search).where("structure IN ('bcc', 'hcp') AND q < 1.6").cache()
    voted = L.votes(used, PK, table, search)
    bits = {(r.structure, r.q, r.step_no): r.bits for r in voted.collect()}
    shells, angles = {}, [(r.order_no - 1, r.two_theta) for r in used.collect()]
    for r in table.collect():
        shells.setdefault((r.structure, r.q), set()).add(r.s)
    want = {}
    for (structure, q), lengths in shells.items():
        for k in range(16):
            a, code = 2.8 + k * 0.04, 0
            if structure == "hcp" and a * q > 5.5:
                continue
            theory = [2 * math.degrees(math.asin(1.5406 * s / (2 * a))) for s in lengths if 1.5406 * s / (2 * a) < 1]
            for p, t in angles:
                off = min(abs(x - t) for x in theory) / search.coarse
                code |= sum(1 << (4 * p + j) for j, share in enumerate(L.CLOSE) if off <= share)
            if code:
                want[structure, q, k] = code
    assert bits == want
    short = L.shortlist(voted, sizes, PK, search)
    matched = X.greedy_match(L.cell_pairs(used, short, table, PK, search.coarse), sizes, PK, L.CELL, search.coarse)
    both = matched.join(short, ["pattern_id", *L.CELL]).select("cost", "bound", "structure", "a").collect()
    assert len(both) == len(want) and all(r.cost >= r.bound - 1e-9 - (0.5 * max(0.0, r.a - 6) ** 2) for r in both)


def plain_cell(system, centering, grid, peaks, tolerance):
    """First cell of least cost (rounded to twelve digits) of those that explain a peak: every cell's whole list is matched."""
    rel = {"F": 16.0, "I": 100.0 if system == "tetragonal" else 4.0, "P": 25.0 if system == "tetragonal" else 1.0}
    top, planes = max(s for _, _, s in peaks), []
    for h in range(13 if system == "hexagonal" else 15):
        for k in range(13 if system == "hexagonal" else h + 1):
            for l in range(k + 1 if system == "cubic" else 21):  # noqa: E741
                if centering == "F" and len({h % 2, k % 2, l % 2}) > 1 or centering == "I" and (h + k + l) % 2:
                    continue
                if centering == "HCP" and l % 2 and (h + 2 * k) % 3 == 0:
                    continue
                strength = max(50 * (1 + math.cos(2 * math.pi * (h + 2 * k) / 3 + math.pi * l)), 1e-9) if centering == "HCP" else rel[centering]
                planes.append((4 * (h * h + h * k + k * k) / 3 if system == "hexagonal" else h * h + k * k, l * l, strength))
    lo, hi = min(t for _, t, _ in peaks) - 1, max(t for _, t, _ in peaks) + 1
    best = None
    for a, c in grid:
        theory = {}
        for p, l2, strength in planes:
            sine = 1.5406 / 2 * math.sqrt(p / a**2 + l2 / c**2)
            angle = 2 * math.degrees(math.asin(sine)) if sine < 1 else 0
            if lo <= angle <= hi:
                theory.setdefault(round(angle * 1000), (angle, strength))
        cost, used = 0.0, set()
        for _, t, intensity in sorted(peaks):
            free = [(x, s, i) for i, (x, s) in theory.items() if i not in used and abs(x - t) <= tolerance]
            if not free:
                cost += 8 * tolerance**2
                continue
            strongest = max(s for _, s, _ in free)
            score, i = min(((x - t) ** 2 + 0.45 * tolerance**2 * (intensity / top - s / strongest) ** 2, i) for x, s, i in free)
            cost += score
            used.add(i)
        if used and (best is None or round(cost, 12) < best[0]):
            best = (round(cost, 12), a, c)
    return best


def test_every_trial_cell_is_weighed(spark):
    """The search finds the trial cell that a plain loop over the whole grid finds, also where two peaks want the same reflection."""
    rng, search = random.Random(5), L.Search(a_min=2.8, a_max=3.4)
    trial = L.Trial(L.shells(spark, search).toArrow(), search)
    for _ in range(4):
        angles = sorted(rng.uniform(25, 75) for _ in range(8))
        angles[3] = angles[2] + 0.3
        peaks = [(i + 1, t, 100.0 - 12 * i) for i, t in enumerate(rng.sample(angles, 8))]
        hexagonal, tetragonal = L.axial_ratios()
        edges = [2.8 + i * 0.04 for i in range(16)]
        for structure, system, centering, shares in (("fcc", "cubic", "F", [1.0]), ("bcc", "cubic", "I", [1.0]), ("sc", "cubic", "P", [1.0]), ("hcp", "hexagonal", "HCP", hexagonal),
                                                     ("tetragonal-I", "tetragonal", "I", tetragonal), ("tetragonal-P", "tetragonal", "P", tetragonal)):
            grid = [(a, a * q) for q in shares for a in edges if system != "hexagonal" or a * q <= 5.5]
            want = plain_cell(system, centering, grid, peaks, search.coarse)
            cell = L.coarse_cell(trial, structure, [(i, t, s / 100) for i, t, s in peaks])
            got = None if cell is None else (trial.edge[cell], trial.edge[cell] * trial.kinds[trial.kind[cell]][3])
            assert (want and want[1:3]) == (got and pytest.approx(got)), structure


def test_structures_without_trial_cells_are_left_out(spark):
    """No hexagonal edge reaches 5, so that only the other structures are searched."""
    df = spark.createDataFrame([(1, 30.0, 5.0), (1, 41.0, None), (1, 52.5, 1.0)], "pattern_id bigint, two_theta double, intensity double")
    found = {r.structure: r.n for r in L.lattice_candidates(df, PK, L.Search(a_min=5.0, a_max=5.4)).collect()}
    assert "hcp" not in found and found and set(found.values()) == {3}


def test_no_number_of_cells_is_enough(spark):
    """A pattern whose best hexagonal cell has more than sixteen others of lower bound from votes in four steps of closeness."""
    peaks = [(1, 40.0, 286155.0), (2, 30.5, 253114.0), (3, 16.0, 250922.0), (4, 28.5, 242967.0), (5, 10.5, 234317.0),
             (6, 33.0, 212354.0), (7, 19.5, 207697.0), (8, 35.5, 158046.0), (9, 25.5, 145719.0), (10, 22.0, 111456.0)]
    edges = [2.5 + i * 0.04 for i in range(51)]
    grid = [(a, a * q) for q in L.axial_ratios()[0] for a in edges if a <= 4.5 + 1e-9 and a * q <= 5.5 + 1e-9]
    _, a, c = plain_cell("hexagonal", "HCP", grid, peaks, L.Search().coarse)
    df = spark.createDataFrame([(1, t, s) for _, t, s in peaks], "pattern_id bigint, two_theta double, intensity double")
    r = L.lattice_candidates(df, PK).where("structure = 'hcp'").first()
    # the fine grid reaches this far
    assert abs(r.a - a) <= 0.0601 and abs(r.c / r.a - c / a) <= 0.0401


def test_profile_fit_recovers_two_gaussians(curve):
    t = np.arange(20, 40, 0.05)
    s = 1 / (2 * math.sqrt(2 * math.log(2)))
    y = 50 + 0.5 * t + 900 * np.exp(-0.5 * ((t - 26) / (0.8 * s)) ** 2) + 500 * np.exp(-0.5 * ((t - 33) / (1.2 * s)) ** 2)
    pts = curve(y, t)
    fits = FIT.fit_peaks(pts, P.local_maxima(pts, PK, min_height=0.3, min_distance=5)).orderBy("centre").collect()
    assert [f.centre for f in fits] == pytest.approx([26, 33], abs=1e-2)
    assert [f.fwhm for f in fits] == pytest.approx([0.8, 1.2], abs=2e-2)
