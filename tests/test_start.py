"""Start from another folder: workers must get the package from the session, not from a path."""

import os
import subprocess
import sys

import pytest

FOLDER = "/root/testdata/sf0.001"
ENTRY = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
CODE = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {ENTRY!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", entry.queries()["find_peaks_prominence"](spark, {FOLDER!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
def test_query_with_python_workers_from_an_empty_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_no_private_checkpoint_folder_on_a_cluster():
    from latticework.session import checkpoint_folder

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_folder(Session())
