"""Session settings the jobs rely on.

Only runtime SQL settings are touched, and only those that let Spark re-plan at
run time: skewed joins are split, small post-shuffle partitions are merged and
a join side is broadcast only after its real size is known.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # division by zero and failed casts give NULL, which every guard below expects
    "spark.sql.ansi.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context.

    Spark's own file server hands the archive out, so nothing has to be installed
    or be on a path where the workers start.
    """
    context = spark.sparkContext
    if getattr(context, "_latticework_shipped", False):
        return
    package = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        shutil.copytree(package, Path(folder, "in", package.name), ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(), package.name)), "zip", Path(folder, "in"))
    context.addPyFile(archive)
    context._latticework_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a private one only on a local master, where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="latticework-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; the driver's file system removes it when the session ends."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Store a derived table that later steps read several times and cut its lineage.

    Mostly tables with one row per key or per peak; of full sample size only the
    numbered sequences of the path detectors. Neither the work nor the plan is
    repeated, and as the files live in the shared checkpoint folder, lost executors
    do not matter.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, keys: list[str], rows: int = 2000) -> DataFrame:
    """Dealt by key over tasks of about `rows` rows: small rows that much work hangs on.

    The number is fixed, so that the tasks aren't merged again, and grows with the rows, so
    that what they are expanded to stays within a task's memory.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("latticework")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LATTICEWORK_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
