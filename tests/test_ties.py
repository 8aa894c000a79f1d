"""Queries beside their oracle text on tables full of equal values."""

import os

import pytest

from latticework.operators import evidence as E
from latticework.plans import ORACLES, QUERIES, evidence_queries
from latticework.plans.check import compare, oracle_connection
from latticework.plans.inputs import R
from latticework.plans.registry import r
from latticework.session import configure

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def changed(tmp_path, name, select):
    """The smallest tables with one of them replaced."""
    import duckdb

    for file in os.listdir(FOLDER):
        if file != f"{name}.parquet":
            os.symlink(f"{FOLDER}/{file}", tmp_path / file)
    duckdb.execute(f"COPY ({select.format(table=f'{FOLDER}/{name}.parquet')}) TO '{tmp_path}/{name}.parquet'")
    return str(tmp_path)


@pytest.fixture
def stepped(tmp_path):
    """Curves of few distinct heights, so that many tops are flat."""
    heights = "list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 50) / 50 AS FLOAT))"
    return changed(tmp_path, "embeddings", f"SELECT * REPLACE (CAST({heights} AS FLOAT[]) AS embedding) FROM '{{table}}' WHERE vec_id < 150")


@pytest.mark.parametrize("name", ["find_peaks_prominence", "cluster_nms", "major_peaks", "numeric_curve_peaks"])
def test_flat_tops(spark, stepped, name):
    ok, text = compare(spark, oracle_connection(stepped), stepped, name)
    assert ok, text


def test_flat_top_of_a_numeric_curve(spark, tmp_path):
    """The middle of a flat top is a peak of the curve, as scipy's finder has it; flat shoulders and borders aren't."""
    heights = "list_transform(range(64), lambda i: CASE WHEN i BETWEEN 20 AND 24 THEN 0.5 WHEN i BETWEEN 40 AND 41 THEN 0.25 WHEN i >= 60 OR i = 19 THEN 0.375 ELSE 0.125 END)"
    folder = changed(tmp_path, "embeddings", f"SELECT * REPLACE (CAST({heights} AS FLOAT[]) AS embedding) FROM '{{table}}' WHERE vec_id = 0")
    assert [row.idx for row in QUERIES["numeric_curve_peaks"](spark, folder).orderBy("idx").collect()] == [22, 40]
    ok, text = compare(spark, oracle_connection(folder), folder, "numeric_curve_peaks")
    assert ok, text


def test_output_rounding_is_that_of_the_oracle(spark):
    """Just below a half, at a half, and on both sides of zero."""
    import duckdb

    values = [33.229687499999997, 0.0000005, 2.5e-7, -33.229687499999997, 123456.0125, 1e15 + 0.3, -2e-7, 7.0]
    got = [row[0] for row in spark.createDataFrame([(v,) for v in values], "v double").select(r("v")).collect()]
    want = [duckdb.execute(f"SELECT {R('CAST(? AS DOUBLE)')}", [v]).fetchall()[0][0] for v in values]
    assert got == want


def test_paths_of_equal_cost(spark, tmp_path):
    """One sample whose steps of 0.35 and bends of 0.2 add up to equal costs only when they are added exactly."""
    source = "/root/testdata/sf0.1/lineitem.parquet"
    if not os.path.exists(source):
        pytest.skip("test tables not present")
    folder = changed(tmp_path, "lineitem", f"SELECT * REPLACE (l_partkey + 20000 AS l_partkey) FROM '{source}' WHERE l_suppkey = 180")
    for name in ("min_cost_path", "trend_path"):
        ok, text = compare(spark, oracle_connection(folder), folder, name)
        assert ok, text


def test_trend_to_the_last_bit(spark):
    """The pull of a trend decides between paths of equal cost, so its sums are those of the SQL to the last bit."""
    sql = ORACLES["band_trend"]
    want = {row[:2]: row[2] for row in oracle_connection(FOLDER).execute(sql[: sql.rindex("SELECT sample_id, col, wide")] + "SELECT sample_id, col, trend_y FROM sm").fetchall()}
    trend = E.band_trend(evidence_queries._final(configure(spark), FOLDER), evidence_queries.WIDTH, evidence_queries.HEIGHT, **evidence_queries.TREND)
    assert {(row.sample_id, row.col): row.trend_y for row in trend.collect()} == want
