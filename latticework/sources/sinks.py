"""Sinks: result records, reports and appended risk rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scrub(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL, inside arrays too."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    fixes = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            fixes[f.name] = F.when(~bad(F.col(f.name)), F.col(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            fixes[f.name] = F.transform(f.name, lambda v: F.when(~bad(v), v))
    return df.withColumns(fixes) if fixes else df


def write_results(df: DataFrame, path: str) -> None:
    """One JSON record per sample; absent blocks are left out."""
    scrub(df).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """Report rows with the statistics under their older name as well."""
    if "metric_stats" in report.columns and "core_metrics_stats" not in report.columns:
        report = report.withColumn("core_metrics_stats", F.col("metric_stats"))
    scrub(report).write.mode("overwrite").json(path)


def append_risk_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def write_points(points: DataFrame, path: str, key: str = "pattern_id") -> None:
    """Curves clustered by key, so that later jobs read few files per curve."""
    points.repartition(F.col(key)).sortWithinPartitions(key, "idx").write.mode("overwrite").parquet(path)
