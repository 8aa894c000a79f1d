"""Plans and results that must hold when the tables grow."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions import bragg as B
from latticework.operators import candidates as K
from latticework.operators import crystal as X
from latticework.operators import evidence as EV
from latticework.operators import lattice as L
from latticework.operators import peaks as P
from latticework.operators import paths as Q
from latticework.operators import pixels as PX
from latticework.operators import recovery as V
from latticework.operators import scans
from latticework.operators.walks import prominences
from latticework.session import spread


@pytest.fixture
def cells(spark):
    return spark.range(50).select(
        F.col("id").alias("pattern_id"), F.element_at(F.array(*map(F.lit, ("cubic", "tetragonal", "hexagonal"))), (F.col("id") % 3 + 1).cast("int")).alias("system"),
        F.lit("P").alias("centering"), (2.5 + F.col("id") / 50).alias("a"), F.lit(3.1).alias("b"), F.lit(3.4).alias("c"),
        *[F.lit(90.0).alias(n) for n in ("alpha", "beta", "gamma")])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reflection_lists_are_not_broadcast(spark, cells):
    peaks = cells.select("pattern_id", F.lit(0).alias("idx"), F.lit(1).alias("order_no"), F.lit(40.0).alias("two_theta"), F.lit(1.0).alias("intensity"))
    refl = X.reflections(cells, ["pattern_id"])
    assert "SortMergeJoin" in plan(X.match_angles(peaks, refl, ["pattern_id"]))
    pairs = X.candidate_pairs(peaks, refl.withColumn("g", F.lit(1)), ["pattern_id"], ["g"], 0.5, shared=["pattern_id"])
    assert "SortMergeJoin" in plan(pairs)


@pytest.mark.parametrize("listed", [lambda c: X.reflections(c, ["pattern_id"]), lambda c: X.phase_reflections(c, ["pattern_id"], 0.0, 180.0)])
def test_cells_are_spread_before_the_index_grid(spark, cells, listed):
    """No row of the grid is shuffled or sorted; only the cells are."""
    text = plan(listed(cells.coalesce(1)))
    assert "SortAggregate" not in text and text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text


def test_spread_grows_with_the_rows(spark):
    assert spread(spark.range(100), ["id"]).rdd.getNumPartitions() == 4
    assert spread(spark.range(20000), ["id"]).rdd.getNumPartitions() == 10


def test_absences_and_families_are_worked_out_per_kind(spark, cells):
    assert "explode" not in plan(X.allowed_counts(cells)).split("BroadcastExchange")[0]
    odd = cells.limit(3).withColumn("centering", F.when(F.col("pattern_id") > 0, "I"))
    got = {r.pattern_id: r.allowed for r in X.allowed_counts(odd).collect()}
    triples = [(h, k, l) for h in range(11) for k in range(11) for l in range(11) if h + k + l]
    assert got == {0: len(triples), 1: sum(sum(t) % 2 == 0 for t in triples), 2: sum(sum(t) % 2 == 0 for t in triples)}
    grid = X._grid(cells.select("pattern_id", "system"), 10, 10, 10).where("h + k + l > 0")
    h, k, l = F.col("h"), F.col("k"), F.col("l")  # noqa: E741
    want = grid.select("pattern_id", "h", "k", "l", B.family_label(h, k, l, F.col("system")).alias("label"), B.cubic_multiplicity(h, k, l).alias("multiplicity"))
    found = X.plane_families(cells, ["pattern_id"])
    assert found.count() == want.count() and found.exceptAll(want).isEmpty()


def test_metrics_add_lines_in_table_order(spark, tmp_path):
    """Averages on a gate's value must not depend on how the files are split."""
    import random

    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from latticework.plans import inputs as I

    rng = random.Random(5)
    keys = [k for k in range(400) for _ in range(6)]
    rng.shuffle(keys)
    hundredths = lambda top: [rng.randint(0, top) / 100 for _ in keys]
    lines = pa.table({"l_orderkey": keys, "l_linenumber": pa.array([1] * len(keys), pa.int32()), "l_quantity": [float(rng.randint(1, 50)) for _ in keys],
                      "l_discount": hundredths(10), "l_tax": hundredths(8)})
    pq.write_table(lines, tmp_path / "lineitem.parquet", row_group_size=100)
    pq.write_table(pa.table({"o_orderkey": list(range(400)), "o_orderpriority": ["3-MEDIUM"] * 400}), tmp_path / "orders.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    want = dict(con.execute(f"SELECT l_orderkey, 1 - avg(l_discount) * 8 FROM '{tmp_path}/lineitem.parquet' GROUP BY 1").fetchall())
    old = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for name in old:
            spark.conf.set(name, "4096")
        got = {r.sample_id: r.peak_recall for r in I.metrics(spark, str(tmp_path)).collect()}
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    assert got == want


def test_votes_of_a_pattern_stay_in_one_task(spark, cells, monkeypatch):
    """The lattice search deals the peaks, not their votes."""
    plans = []
    real = L.settle
    monkeypatch.setattr(L, "settle", lambda df: (plans.append(plan(df)), real(df))[1])
    peaks = cells.limit(3).select("pattern_id", F.explode(F.array(*map(F.lit, (30.0, 35.0, 41.0)))).alias("two_theta"), F.lit(1.0).alias("intensity"))
    plans.append(plan(L.lattice_candidates(peaks, ["pattern_id"], L.Search(a_min=2.8, a_max=3.0))))
    moved = [line for text in plans for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("pattern_id" in line and "cell_no" in line for line in moved)


def test_index_bounds_leave_no_reflection_out(spark, cells):
    """Indices are bounded by the last angle asked for: cutting the whole list at that angle gives the same."""
    for hi in (20.0, 60.0, 179.5):
        whole = X.phase_reflections(cells, ["pattern_id"], 0.0, 180.0).where(F.col("two_theta") <= hi).drop("rel")
        got = X.phase_reflections(cells, ["pattern_id"], 0.0, hi - 0.5).where(F.col("two_theta") <= hi).drop("rel")
        assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()


def test_continuity_looks_heights_up_in_bulk(spark):
    """No per-row search of the columns beside a candidate; missing heights and empty columns keep their rows."""
    rng = random.Random(7)
    rows = [(s, c, rng.choice([None, *range(30)]), n + 1, 0.5) for s in range(3) for c in range(0, 40) if c % 9 for n in range(rng.randint(1, 5))]
    rows = [(s, c, y, i, f) for i, (s, c, y, _, f) in enumerate(rows)]
    cands = spark.createDataFrame(rows, "sample_id bigint, col int, y int, cand_id bigint, confidence double")
    out = EV.continuity_score(cands)
    assert "lambda" not in plan(out)
    columns = {}
    for s, c, y, _, _ in rows:
        columns.setdefault((s, c), []).append(y)
    got = {r.cand_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for s, c, y, i, f in rows:
        near = lambda d: min((abs(v - y) for v in columns.get((s, c + d), []) if v is not None), default=99) if y is not None else 99  # noqa: B023, E731
        hits = [(near(e), abs(e)) for d in (1, 2, 3) for e in (-d, d) if near(e) <= 8]
        dense = sum(v is not None and abs(v - y) <= 2 for v in columns[s, c]) / len(columns[s, c]) if y is not None else 0.0
        assert got[i].support_hits == len(hits) and got[i].density == dense
        assert got[i].support == pytest.approx(sum((1 - j / 8) / d for j, d in hits), rel=1e-12)
        assert got[i].jump_penalty == pytest.approx(sum(j / d for j, d in hits) / max(len(hits), 1) / 8, rel=1e-12)


def test_ordered_steps_store_what_they_read_twice(spark):
    """What a chained step reads several times is worked out once: its source isn't part of the later plan."""
    i = F.col("id")
    final = spark.range(300).select((i % 3).alias("sample_id"), F.floor(i / 6).cast("int").alias("col"), (i % 7).cast("int").alias("y"), i.alias("cand_id"),
                                    (i % 2 + 1).cast("int").alias("rank"), (i / 300).alias("confidence"), F.lit("raw").alias("source"))
    path = final.groupBy("sample_id", "col").agg(F.max("y").cast("double").alias("y"))
    truth = path.withColumnRenamed("y", "gt_y")
    reasons = path.select("sample_id", "col", F.array(F.lit("a")).alias("reasons"), F.array(F.lit("b")).alias("reasons_raw"))
    made = {"sessions": scans.sessions(path, ["sample_id"], "col", F.lit(1)), "near_truth": V.near_truth(path, final, truth), "keep": K.keep_near_truth(final, final, truth),
            "risk": Q.risk_summary(reasons, 64), "trend": EV.band_trend(final, 64, 60, sigma=6.0, share=0.6, run=3, most=0.9)}
    assert {name: plan(df).count("Range (") for name, df in made.items()} == dict.fromkeys(made, 0)


def test_peaks_meet_their_columns_by_one_exchange(spark):
    """No peak is copied for each row around it; repeated pixels, peaks between rows and columns without light as before."""
    rng = random.Random(11)
    rows = [(i, x, y, *[rng.choice([None, *range(5)]) if i == 2 else rng.randint(0, 4) for _ in "rgb"])
            for i in range(3) for x in range(4) for y in range(40) if rng.random() < 0.6 for _ in range(rng.choice([1, 1, 2]))]
    px = spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int")
    peaks = [(rng.randint(0, 3), rng.choice([None, 0, 1, 2, 3, 4]), rng.choice([None, 0.5, 2.5, 7.2, 20.0, 39.6, 50.0])) for _ in range(150)]
    out = P.refine_on_pixels(spark.createDataFrame(peaks, "image_id int, x int, y double"), px)
    assert plan(out).count("Exchange") == 1 and "Generate" not in plan(out)
    light = [(i, x, y, None if None in (r, g, b) else 0.2989 * r + 0.5870 * g + 0.1140 * b) for i, x, y, r, g, b in rows]
    order = lambda v: (v is not None, v or 0.0)
    want = {}
    for i, x, y in peaks:
        column = [(q, v) for j, c, q, v in light if (j, c) == (i, x)]
        known = [v for _, v in column if v is not None]
        near = [(q, v) for q, v in column if y is not None and abs(q - round(y)) <= 5]
        if known and near and len(near) * sum((j, c) == (i, x) and v is not None and round(v) == round(y) for j, c, v in peaks) >= 3:
            mid = statistics.median(known)
            centre = max((v for q, v in near if q == round(y) and v is not None), default=mid)
            dark = min(near, key=lambda p: (order(p[1]), p[0]))[0]
            want[i, x, round(y)] = float(dark if centre <= mid else max(near, key=lambda p: (order(p[1]), -p[0]))[0])
    assert {(r.image_id, r.x, r.y0): r.y_refined for r in out.collect()} == want


def test_colour_prototypes_read_the_pixels_once(spark, monkeypatch):
    """Width, medians and the columns around the prototypes come from one exchange of the pixels; images of one column too."""
    rng = random.Random(12)
    size = {0: (64, 50), 1: (1, 7), 2: (11, 9), 3: (6, 1)}
    lab = {(i, x, y): (rng.uniform(0, 100), rng.uniform(-60, 60), rng.uniform(-60, 60)) for i, (w, h) in size.items() for x in range(w) for y in range(h)}
    px = spark.createDataFrame([(*at, *v) for at, v in lab.items()], "image_id int, x int, y int, L double, A double, B double")
    reference = spark.createDataFrame([(i, 50.0, 5.0, -10.0) for i in size], "image_id int, L0 double, A0 double, B0 double")
    plans = []
    real = PX.settle
    monkeypatch.setattr(PX, "settle", lambda df: (plans.append(plan(df)), real(df))[1])
    protos, limit = PX.prototypes(px, reference)
    assert plans[0].count("Exchange") == 1
    assert not any(",L#" in line and "bgL#" not in line for text in plans[1:] for line in text.splitlines() if "Scan ExistingRDD" in line)
    got = {(r.image_id, r.cx): (r.L, r.A, r.B) for r in protos.collect()}
    want, gaps = {}, {}
    for i, (w, h) in size.items():
        mid = [statistics.median(v[c] for (j, _, _), v in lab.items() if j == i) for c in range(3)]
        for cx in {int(w * s) for s in (0.2, 0.5, 0.8)}:
            cy = min(range(h), key=lambda y: (math.dist(lab[i, cx, y], (50, 5, -10)), y))  # noqa: B023
            near = [v for (j, x, y), v in lab.items() if j == i and abs(x - cx) <= 2 and abs(y - cy) <= 2]
            want[i, cx] = tuple(pytest.approx(sum(v[c] for v in near) / len(near)) for c in range(3))
            gaps.setdefault(i, []).append(math.dist([sum(v[c] for v in near) / len(near) for c in range(3)], mid))
    assert got == want
    assert {r.image_id: r.threshold for r in limit.collect()} == {i: pytest.approx(min(13.4, max(11.6, min(g) * 0.32))) for i, g in gaps.items()}


def test_merged_peaks_find_once_on_the_stored_trace(spark, monkeypatch):
    """Both traces share one pass of the finder, and neither reads the source again."""
    calls = []
    real = P.find_peaks
    monkeypatch.setattr(P, "find_peaks", lambda *a, **k: (calls.append(a[1]), real(*a, **k))[1])
    i = F.col("id")
    trace = spark.range(120).select((i % 2).alias("sample_id"), F.floor(i / 2).alias("col"), (40 - 30 * F.abs(F.sin(i / 9)) * (0.4 + i % 50 / 100)).alias("y_raw"))
    out = P.merged_peaks(trace.withColumn("y_smooth", F.col("y_raw") + 1), ["sample_id"])
    rows = out.collect()
    assert calls == [["sample_id", "source"]] and "Range (" not in plan(out)
    high = {(r.sample_id, r.col): r.y_raw for r in trace.collect()}
    assert rows and all(r.y_pixel == high[r.sample_id, r.col] for r in rows)


def test_local_floors_sort_windows_in_bulk(spark):
    """Floors equal those of a plain loop, across chunk borders and for missing values and single samples; no row gathers its window."""
    rng = random.Random(13)
    curves = {0: 5000, 1: 66, 2: 1, 3: 2}
    rows = [(k, i, None if k == 1 and i % 11 == 4 else round(rng.uniform(0, 100), 2)) for k, n in curves.items() for i in range(n)]
    out = P.local_thresholds(spark.createDataFrame(rows, "pattern_id int, idx long, y double"), ["pattern_id"], pos="idx")
    assert "percentile(" not in plan(out)
    got = {(r.pattern_id, r.idx): r.local_floor for r in out.collect()}
    assert len(got) == len(rows)
    for k, n in curves.items():
        ys = [y for j, _, y in rows if j == k]
        known = [y for y in ys if y is not None]
        base = 0.015 * (max(known) - min(known))
        for i in [i for i in range(n) if n < 100 or i % 37 == 0 or 4050 < i < 4140]:
            seen = ys[max(0, i - 30) : i + 31]
            steps = [b - a for a, b in zip(seen, seen[1:]) if None not in (a, b)]
            lo, hi = np.quantile([y for y in seen if y is not None], [0.10, 0.95])
            mad = statistics.median(abs(d - statistics.median(steps)) for d in steps) if steps else 0.0
            want = max(base, 0.12 * max(hi - lo, 1e-9), 3.0 * 1.4826 * mad) if len(seen) > 1 else base
            assert got[k, i] == pytest.approx(want, rel=1e-12)


def test_tops_look_further_only_at_flat_stretches(spark):
    """Strict tops come from one exchange; tops and middles equal a plain loop over flat stretches, across chunks and missing values."""
    rng = random.Random(14)
    curves = [[rng.choice([None, 1, 2, 3] if k == 2 else [1, 2, 3, 4]) for _ in range(n)] for k, n in enumerate((4200, 60, 200))]
    curves.append([1] * 10 + [5] * 4190 + [2] * 10)
    df = spark.createDataFrame([(k, i, y) for k, ys in enumerate(curves) for i, y in enumerate(ys)], "k int, idx int, y int")
    assert plan(P.plateau_maxima(df, ["k"], "idx", "y", flat=False)).count("Exchange") == 1
    got = {flat: {(r.k, r.idx) for r in P.plateau_maxima(df, ["k"], "idx", "y", flat).collect()} for flat in (False, True)}
    want = {False: set(), True: set()}
    for k, ys in enumerate(curves):
        i = 0
        while i < len(ys):
            j = i
            while j + 1 < len(ys) and ys[j + 1] == ys[i]:
                j += 1
            if 0 < i and j + 1 < len(ys) and None not in (ys[i - 1], ys[i], ys[j + 1]) and ys[i] > max(ys[i - 1], ys[j + 1]):
                want[True].add((k, (i + j) // 2))
                if i == j:
                    want[False].add((k, i))
            i = j + 1
    assert got == want


def test_prominences_sweep_a_chunk_once(spark):
    rows = [(k, i, float((i * 7919) % 101)) for k, n in ((0, 30), (1, 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, idx long, y double")
    out = prominences(df, df.where("y > 80").select("k", "idx"), ["k"], "idx", "y", size=16)
    assert "MapInPandas" not in plan(out)
    whole = prominences(df, df.where("y > 80").select("k", "idx"), ["k"], "idx", "y")
    assert out.count() and out.exceptAll(whole.select(out.columns)).isEmpty() and out.count() == whole.count()
