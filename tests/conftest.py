import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from latticework.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", shuffle_partitions=4)


@pytest.fixture
def curve(spark):
    def make(values, xs=None, key=0):
        xs = xs if xs is not None else [10 + 0.5 * i for i in range(len(values))]
        rows = [(key, i, float(x), float(v)) for i, (x, v) in enumerate(zip(xs, values, strict=True))]
        return spark.createDataFrame(rows, "pattern_id bigint, idx int, two_theta double, intensity double")

    return make


@pytest.fixture
def trace(spark):
    def make(values, key=0):
        rows = [(key, i, None if v is None else float(v)) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "sample_id bigint, col int, y double")

    return make
