"""Distributed building blocks against plain Python on small random data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import joins, paths, scans
from latticework.operators import peaks as P
from latticework.operators import signal as T
from latticework.operators.stats import percentiles
from latticework.operators.walks import prominences, walk_down

PK = ["pattern_id"]


def plain_prominence(y, i):
    def side(step):
        low, at, j = y[i], i, i
        while 0 <= j < len(y) and y[j] <= y[i]:
            if y[j] < low:
                low, at = y[j], j
            j += step
        return low, at

    (ll, la), (rl, ra) = side(-1), side(1)
    return y[i] - max(ll, rl), la, ra


def plain_maxima(y):
    out, i = [], 1
    while i < len(y) - 1:
        if y[i - 1] < y[i]:
            j = i
            while j + 1 < len(y) and y[j + 1] == y[i]:
                j += 1
            if j < len(y) - 1 and y[j + 1] < y[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    return out


@pytest.mark.parametrize("size", [4, 7, 4096])
def test_prominence_and_plateaus(spark, curve, size):
    rnd = random.Random(size)
    y = [float(rnd.randint(0, 12)) for _ in range(90)]
    df = curve(y)
    tops = P.plateau_maxima(df, PK, "idx", "intensity")
    got = prominences(df, tops, PK, "idx", "intensity", size=size).orderBy("idx").collect()
    assert [r.idx for r in got] == plain_maxima(y)
    for r in got:
        assert (r.prominence, r.left_base, r.right_base) == plain_prominence(y, r.idx)


@pytest.mark.parametrize("size", [5, 4096])
def test_walk_down(curve, size):
    rnd = random.Random(3)
    y = [float(rnd.randint(1, 30)) for _ in range(60)]
    df = curve(y)
    tops = P.local_maxima(df, PK)
    for r in walk_down(df, tops, PK, "idx", "intensity", "two_theta", F.col("intensity") / 2, size=size).collect():
        i, half = r.idx, y[r.idx] / 2
        left = i
        while left > 0 and y[left] > half:
            left -= 1
        right = i
        while right < len(y) - 1 and y[right] > half:
            right += 1
        assert (r.left.p, r.right.p) == (left, right)


@pytest.mark.parametrize("size", [6, 4096])
def test_chunk_size_never_changes_results(spark, trace, monkeypatch, size):
    monkeypatch.setattr(scans, "CHUNK", size)
    rnd = random.Random(1)
    y = [None if rnd.random() < 0.4 else float(rnd.randint(0, 50)) for _ in range(80)]
    got = [r.y_filled for r in T.gap_fill(trace(y), ["sample_id"], max_gap=3).orderBy("col").collect()]
    want = list(y)
    i = 0
    while i < len(y):
        j = i
        while j < len(y) and y[j] is None:
            j += 1
        if j > i and j - i <= 3:
            a, b = (y[i - 1] if i else None), (y[j] if j < len(y) else None)
            for k in range(i, j):
                want[k] = a + (k - i + 1) / (j - i + 1) * (b - a) if a is not None and b is not None else (a if a is not None else b)
        i = max(j, i + 1)
    assert got == pytest.approx(want)
    med = T.rolling_median_iqr(trace(y), ["sample_id"], 11).orderBy("col").collect()
    for r in med:
        win = [v for v in y[max(0, r.col - 5): r.col + 6] if v is not None]
        assert r.roll_median == (pytest.approx(np.median(win)) if win else None)
    runs = {(r.start, r.end) for r in paths.mask_runs(trace(y), ["sample_id"], "col", F.col("y").isNull()).collect()}
    marks, i = set(), 0
    while i < len(y):
        if y[i] is None:
            j = i
            while j + 1 < len(y) and y[j + 1] is None:
                j += 1
            marks.add((i, j))
            i = j
        i += 1
    assert runs == marks


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(5)
    data = {1: rng.normal(0, 1e3, 501), 2: np.repeat([3.0, -2.0, 3.0], 40), 3: np.array([7.0])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "k int, v double")
    for r in percentiles(df, ["k"], "v", {"a": 0.04, "b": 0.5, "c": 0.95}).collect():
        assert [r.a, r.b, r.c] == pytest.approx(list(np.percentile(data[r.k], [4, 50, 95])))


def test_nearest_interpolate_and_band_join(spark):
    rnd = random.Random(2)
    q = [(1, i, rnd.uniform(0, 300)) for i in range(40)]
    ref = sorted({round(rnd.uniform(0, 300), 3) for _ in range(25)})
    left = spark.createDataFrame(q, "k int, i int, x double")
    right = spark.createDataFrame([(1, x, x * x) for x in ref], "k int, rx double, ry double")
    near = {r.i: r.nearest_dist for r in joins.nearest(left, right, ["k"], "x", "rx").collect()}
    line = {r.i: r.y_interp for r in joins.interpolate(left, right, ["k"], "x", "rx", "ry").collect()}
    for _, i, x in q:
        assert near[i] == pytest.approx(min(abs(x - v) for v in ref))
        assert line[i] == pytest.approx(np.interp(x, ref, np.square(ref)))
    pairs = {(r.i, r.rx) for r in joins.band_join(left, right, ["k"], "x", "rx", 4.0).collect()}
    assert pairs == {(i, v) for _, i, x in q for v in ref if abs(x - v) <= 4.0}


def plain_path(columns, width, height):
    """columns: list of lists of (y, conf, comp); returns the reported heights."""
    limit = paths.window_limit(width)

    def border(y):
        d = min(y, height - 1 - y)
        return 0.0 if d >= 12 else 3.0 * (1 - d / 12)

    table = []
    for c, opts in enumerate(columns):
        here = {}
        for y, conf, comp in opts:
            base = 0.88 * (1 - conf)
            if c == 0 or not table[c - 1]:
                here[y] = (base + border(y), None, comp)
                continue
            best = None
            for py, (cost, prev, pcomp) in table[c - 1].items():
                if abs(y - py) > limit:
                    continue
                t = cost + abs(y - py) + (0.2 * abs(y - 2 * py + prev) if prev is not None else 0) + base + (1.2 if abs(comp - pcomp) > 0.58 else 0) + border(y)
                if best is None or t < best[0] - 1e-15:
                    best = (t, py, comp)
            if best is None:
                py = min(table[c - 1], key=lambda k: table[c - 1][k][0])
                best = (table[c - 1][py][0] + base + abs(y - py), py, comp)
            here[y] = best
        table.append(here)
    out = [None] * len(columns)
    c = max(i for i, h in enumerate(table) if h)
    y = min(table[c], key=lambda k: table[c][k][0])
    while y is not None:
        out[c] = y
        y, c = table[c][y][1], c - 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_min_cost_path(spark, seed):
    rnd = random.Random(seed)
    columns = []
    for c in range(30):
        n = 0 if (seed == 2 and c in (4, 11)) else rnd.randint(1, 5)
        ys = rnd.sample(range(0, 100), n)
        columns.append([(y, round(rnd.random(), 3), round(rnd.random() * 3, 3)) for y in ys])
    rows = [(7, c, y, conf, comp, "raw", i + 1) for c, opts in enumerate(columns) for i, (y, conf, comp) in enumerate(opts)]
    final = spark.createDataFrame(rows, "sample_id bigint, col int, y int, confidence double, comp_score double, source string, rank int")
    spine = spark.createDataFrame([(7, c) for c in range(30)], "sample_id bigint, col int")
    got = [r.y for r in paths.min_cost_path(final, spine, 30, 100).orderBy("col").collect()]
    assert got == plain_path(columns, 30, 100)
