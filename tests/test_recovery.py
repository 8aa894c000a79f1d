"""Recovery operators against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import recovery as V
from latticework.operators import scans

CANDS = "sample_id bigint, col int, y int, confidence double, comp_score double, source string, cand_id bigint, rank int"
RANGES = 'sample_id bigint, start int, end int'
WIDTH = 80


def candidates(seed, sample=1, most=6, height=60):
    rnd, rows = random.Random(seed), []
    for c in range(WIDTH):
        own = [(sample, c, rnd.randrange(height), round(rnd.random(), 3), 1.0, rnd.choice(["raw", "peak_apex"])) for _ in range(rnd.randint(0, most))]
        rows += [(*r, len(rows) + k, k + 1) for k, r in enumerate(own)]
    return rows


def a_path(seed, sample=1, height=60, holes=0.2):
    rnd = random.Random(seed)
    return [(sample, c, None if rnd.random() < holes else float(rnd.randrange(height))) for c in range(WIDTH)]


@pytest.fixture
def path_of(spark):
    return lambda *paths: spark.createDataFrame([r for p in paths for r in p], "sample_id bigint, col int, y double")


@pytest.mark.parametrize("chunk", [4096, 8])
def test_regions(spark, monkeypatch, path_of, chunk):
    monkeypatch.setattr(scans, "CHUNK", chunk)
    rnd = random.Random(1)
    runs = {s: [(a, a + rnd.randrange(12)) for a in (rnd.randrange(68) for _ in range(8))] for s in (1, 2, 3)}
    rows = spark.createDataFrame([(s, a, b) for s, rs in runs.items() for a, b in rs], RANGES)
    spine = path_of(*[a_path(s, s) for s in (1, 2, 3, 4)])
    got = V.recovery_regions(rows, spine, least=3, most=4, guard_col=10).collect()
    for s, rs in runs.items():
        covered = {c for a, b in rs if b - a + 1 >= 3 and b >= 10 for c in range(max(a, 10), b + 1)}
        want = [(a, next(b for b in range(a, 99) if b + 1 not in covered)) for a in sorted(covered) if a - 1 not in covered]
        assert sorted((r.start, r.end) for r in got if r.sample_id == s) == want
    pieces = sorted((r.start, r.end) for r in V.clipped(spark.createDataFrame([(1, 3, 12), (1, 20, 20)], RANGES), 4).collect())
    assert pieces == [(3, 6), (7, 10), (11, 12), (20, 20)]


def test_guard_verdicts(spark, path_of):
    low = [(s, c, 50.0 if 20 <= c < 40 or s == 2 else 10.0) for s in (1, 2) for c in range(WIDTH)] + [(3, c, None) for c in range(WIDTH)]
    runs = spark.createDataFrame([(1, 20, 39, 20), (2, 0, 0, 1), (3, 5, 40, 36)], RANGES + ", length int")
    regions = spark.createDataFrame([(1, 20, 39), (1, 35, 60), (2, 0, 9), (3, 5, 9)], RANGES)
    out = V.guarded_regions(regions, path_of(low), runs, 60, 0.7, 0.1, 0.5).collect()
    assert {(r.sample_id, r.start): r.verdict for r in out} == {(1, 20): "kept", (1, 35): "not_bottom_dominated", (2, 0): "low_bottom_score", (3, 5): "kept"}


def test_pool_additions(spark):
    pool, now = candidates(2, most=9), candidates(3, most=3)
    columns = spark.createDataFrame([(1, c) for c in range(0, WIDTH, 2)] * 2, "sample_id bigint, col int")
    out = V.pool_additions(spark.createDataFrame(now, CANDS), spark.createDataFrame(pool, CANDS), columns, 60, 0.7, most=2, top=5)
    want = set()
    for c in range(0, WIDTH, 2):
        best = sorted((r for r in pool if r[1] == c), key=lambda r: (-r[3], r[6]))[:5]
        limit, seen, taken = max(0.06, 0.2 * max((r[3] for r in best), default=0)), {r[2] for r in now if r[1] == c}, 0
        for r in best:
            if r[2] < 42 and r[3] >= limit and r[2] not in seen and taken < 2:
                want.add((c, r[2], r[6]))
                seen.add(r[2])
                taken += 1
    rows = out.collect()
    assert {(r.col, r.y, r.cand_id) for r in rows} == want and {r.source for r in rows} == {"path_v1_filtered_non_bottom"}


@pytest.mark.parametrize("chunk", [4096, 8])
def test_islands(spark, monkeypatch, path_of, chunk):
    monkeypatch.setattr(scans, "CHUNK", chunk)
    pool, path = candidates(4, most=8), a_path(5)
    regions = [(0, 35), (40, 79)]
    out = V.islands(spark.createDataFrame(pool, CANDS), spark.createDataFrame([(1, a, b) for a, b in regions], RANGES), path_of(path), 60, 0.7, 3, 24.0, 5.0).collect()
    want = {}
    for a, b in regions:
        levels = {}
        for c in range(a, b + 1):
            top = sorted((r for r in pool if r[1] == c and r[2] < 42), key=lambda r: (-r[3], r[6]))[:5]
            if top:
                levels[c] = (float(np.median([r[2] for r in top])), top[0][3])
        for c in sorted(levels):
            if c - 1 in levels:
                continue
            cols = list(range(c, next(x for x in range(c, 99) if x not in levels)))
            if len(cols) < 3:
                continue
            ys = [levels[x][0] for x in cols]
            sel = [path[x][2] for x in cols if path[x][2] is not None]
            apart = np.median(sel) - np.median(ys) if sel else None
            verdict = "unstable_y_trajectory" if max(abs(np.diff(ys))) > 24 else "low_y_separation" if apart is not None and apart < 5 else "island"
            want[a, c, cols[-1]] = (float(np.median(ys)), verdict, round(float(np.median([levels[x][1] for x in cols])), 9))
    assert {(r.start, r.island_start, r.island_end): (r.level, r.verdict, round(r.confidence_median, 9)) for r in out} == want
    assert len({v for _, v, _ in want.values()}) >= 2


def test_blend_and_comparison(spark, path_of):
    path, new = a_path(6), a_path(7, holes=0.3)
    zones = [(1, 3, 20, "low_margin_streak+score_spike"), (1, 30, 33, "score_spike"), (1, 60, 79, "low_valid_ratio")]
    z = spark.createDataFrame(zones, RANGES + ", trigger string")
    got = {r.col: r.y_blended for r in V.blended(path_of(path), path_of(new), z).collect()}
    want = {c: y for _, c, y in path}
    for _, a, b, _ in zones:
        for c in range(a, b + 1):
            y, ry = path[c][2], new[c][2]
            if ry is None:
                continue
            near = c - a if c - a < 5 else b - c if b - c < 5 else None
            want[c] = ry if near is None or y is None else float(round((1 - near / 5) * y + near / 5 * ry))
    assert got == want
    cands = [r for r in candidates(8) if not 60 <= r[1] <= 75]
    final = spark.createDataFrame(cands, CANDS)
    rows = {r.start: r for r in V.branch_comparison(path_of(path), path_of(new), z, final).collect()}
    assert [rows[a].failure for a in (3, 30, 60)] == ["wrong_branch_lock_in", "grid_confusion", "candidate_starvation"]
    for _, a, b, _ in zones:
        ov, rv = (sum(p[c][2] is not None for c in range(a, b + 1)) for p in (path, new))
        conf = sum(next((r[3] for r in cands if r[1] == c and r[2] == path[c][2]), 0.0) for c in range(a, b + 1)) / (b - a + 1)
        r = rows[a]
        assert (r.original_valid, r.recovery_valid, r.prefer) == (ov, rv, "recovery" if rv > ov else "original")
        assert r.original_confidence == pytest.approx(conf) and r.recovery_confidence == pytest.approx(0.5 * rv / (b - a + 1))


def test_rates_and_predicates(spark, path_of):
    path, top = a_path(9), [(1, c, float(c % 60)) for c in range(0, WIDTH, 2)]
    r = V.divergence(path_of(path), path_of(top), 10, 30).first()
    off = [abs(path[c][2] - y) for _, c, y in top if path[c][2] is not None]
    assert (r.mean_abs_diff, r.divergence_near, r.divergence_far) == pytest.approx((np.mean(off), np.mean(np.array(off) >= 10), np.mean(np.array(off) >= 30)))
    rows = spark.createDataFrame([(1, 12, 0.0, 0.0), (2, 0, 0.003, None), (3, None, None, 0.06), (4, 11, 0.002, 0.05), (5, None, None, None)], "i int, d int, j double, f double")
    assert [x.u for x in rows.select("i", V.unstable(F.col("d"), F.col("j"), F.col("f")).alias("u")).orderBy("i").collect()] == [True, True, True, False, False]
    runs = spark.createDataFrame([(1, 0, 50), (2, 0, 300), (3, 100, 400)], RANGES)
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "sample_id bigint")
    assert {x.sample_id: x.short_tail for x in V.short_tails(ids, runs, 200).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_edge_guard(spark, path_of):
    path = a_path(10)
    sides = spark.createDataFrame([(1, "left", 30.0, 1.0), (1, "right", 20.0, 9.0), (2, "left", None, None)], "sample_id bigint, side string, stable_median double, sigma double")
    got = {(r.sample_id, r.side): r for r in V.edge_peak_guard(path_of(path), sides, WIDTH, 5, 9, 60.0, 4.0).collect()}
    for side, cols, level, sigma in (("left", range(14), 30.0, 3.0), ("right", range(66, 80), 20.0, 9.0)):
        ys = {c: path[c][2] for c in cols if path[c][2] is not None}
        bend = max([abs(ys[c] - 2 * ys[c + 1] + ys[c + 2]) for c in ys if c + 1 in ys and c + 2 in ys], default=0.0)
        ratio = max(abs(y - level) for y in ys.values()) / sigma
        r = got[1, side]
        assert (r.curvature_max, r.prominence_ratio) == pytest.approx((bend, ratio)) and r.peak_like == (bend >= 60 or ratio >= 4)
    assert got[2, "left"].peak_like is False


@pytest.mark.parametrize("chunk", [4096, 8])
def test_near_truth(spark, monkeypatch, path_of, chunk):
    monkeypatch.setattr(scans, "CHUNK", chunk)
    cands = candidates(11)
    rnd = random.Random(12)
    by = {c: [r for r in cands if r[1] == c] for c in range(WIDTH)}
    path = [(1, c, float(rnd.choice(by[c])[2]) if by[c] and rnd.random() < 0.7 else None) for c in range(WIDTH)]
    truth = [(1, c, float(rnd.randrange(60))) for c in range(WIDTH) if rnd.random() < 0.9]
    near = V.near_truth(path_of(path), spark.createDataFrame(cands, CANDS), spark.createDataFrame(truth, "sample_id bigint, col int, gt_y double"), near=12)
    rows = {r.col: r for r in near.collect()}
    gt, p1, p2, g1, g2, hits = {c: y for _, c, y in truth}, None, None, None, None, []
    jumps = []
    for c in range(WIDTH):
        close = [r for r in by[c] if c in gt and abs(r[2] - gt[c]) <= 12]
        alt = max(close, key=lambda r: (r[3], -r[7]), default=None)
        r = rows[c]
        hits.append(alt is not None)
        if alt is None:
            assert r.near_y is None and r.transition_cost is None and r.jump is None
            g1 = g2 = None
        else:
            assert (r.near_y, r.near_rank, r.distance) == (alt[2], alt[7], abs(alt[2] - gt[c]))
            assert r.transition_cost == pytest.approx(0 if p1 is None else (0.35 if alt[5] == "peak_apex" else 1.0) * abs(alt[2] - p1))
            assert r.curvature_cost == pytest.approx(0 if p1 is None or p2 is None else 0.2 * abs((alt[2] - p1) - (p1 - p2)))
            assert r.jump == (None if g1 is None else abs(alt[2] - g1)) and r.bend == (None if g1 is None or g2 is None else abs((alt[2] - g1) - (g1 - g2)))
            jumps += [] if g1 is None else [abs(alt[2] - g1)]
            g2, g1 = g1, alt[2]
        if path[c][2] is not None:
            p2, p1 = p1, path[c][2]
    whole = V.feasibility(near).first()
    longest = lambda mask: max(len(s) for s in "".join("x" if m else " " for m in mask).split())
    assert (whole.near_columns, whole.longest_run, whole.longest_gap) == (sum(hits), longest(hits), longest([not h for h in hits]))
    assert whole.mean_jump == pytest.approx(np.mean(jumps))
