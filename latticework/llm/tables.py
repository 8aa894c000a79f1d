"""Stored intermediates, components and small shared steps of the operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from latticework.session import checkpoint_folder


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; the driver's file system removes it when the session ends."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: columnar, without lineage.

    What led to it is then garbage: the driver collects it, so that Spark's cleaner can
    remove its shuffle files from the executors' disks.
    """
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a stored table that no later step reads."""
    context = df.sparkSession.sparkContext
    for name in {file.rsplit("/", 1)[0] for file in df.inputFiles()[:1]}:
        target = context._jvm.org.apache.hadoop.fs.Path(name)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table, as (node, component = smallest node).

    Alternating large-star and small-star rounds: each attaches neighbours to the
    smallest node seen, as grouped minima and joins, so a hub of any degree is
    never gathered. The number of rounds grows with the logarithm of the diameter.
    """
    checkpoint_folder(edges.sparkSession)
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = now.checkpoint()
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct().checkpoint()
        )
        state = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0x3FFFFFFF))),
            F.sum(F.shiftrightunsigned(F.xxhash64("v", "u"), 34)),
        ).first()
        if state == before:
            break
        before = state
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _labels(labels: DataFrame, label: str) -> DataFrame:
    return labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text, label of all labelled documents; shuffled at every size, as the ids may outgrow a broadcast."""
    return docs.select("doc_id", "text").join(_labels(labels, label).hint("merge"), "doc_id")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """doc_id, text, label of at most `bound` labelled documents, the first by hash; the ids fit a broadcast."""
    one = _labels(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(one), "doc_id")
