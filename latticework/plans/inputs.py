"""Domain views over the given tables, for Spark and (as text) for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators.scans import dense_index


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pattern_points(spark: SparkSession, folder: str) -> DataFrame:
    """Curves (pattern_id, idx, two_theta, intensity), 64 samples each."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("pattern_id"), F.posexplode("embedding").alias("idx", "x")
    ).select(
        "pattern_id",
        "idx",
        (10 + 0.5 * F.col("idx")).cast("double").alias("two_theta"),
        F.floor(F.abs(F.col("x").cast("double")) * 1000000).cast("double").alias("intensity"),
    )


def event_series(spark: SparkSession, folder: str) -> DataFrame:
    """Irregular-length curves, one per user, in time order."""
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("pattern_id"), "ts", "event_id", F.col("value").alias("intensity")
    )
    # with shorter chunks almost every event is a chunk of its own, and their counts are as many as the events
    week = F.floor(F.unix_timestamp("ts") / 604800).cast("bigint")
    return dense_index(events, ["pattern_id"], ["ts", "event_id"], week, "idx").select(
        "pattern_id", "idx", "intensity"
    )


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Scored alternatives per (sample, column)."""
    li = table(spark, folder, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("sample_id"),
        (F.col("l_partkey") % 64).cast("int").alias("col"),
        F.col("l_quantity").cast("int").alias("y"),
        (F.col("l_discount") * 10).alias("confidence"),
        (F.col("l_tax") * 100).alias("comp_score"),
        F.col("l_linenumber").cast("double").alias("axis_dist"),
        (F.col("l_extendedprice") / 5000).alias("color_dist"),
        F.when(F.col("l_returnflag") == "N", "raw")
        .when(F.col("l_returnflag") == "A", "skeleton")
        .otherwise("both")
        .alias("source"),
        (
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 16777216
            + F.round(F.col("l_extendedprice") * 100).cast("bigint")
        ).alias("cand_id"),
    )


def trace(spark: SparkSession, folder: str) -> DataFrame:
    """Best candidate per column with NULL holes, one row for each of the 64 columns."""
    best = candidates(spark, folder).groupBy("sample_id", "col").agg(
        F.max_by("y", F.struct("confidence", -F.col("cand_id"))).alias("y")
    )
    hole = ((F.col("col") + F.col("sample_id")) % 11).isin(5, 6)
    spine = best.select("sample_id").distinct().withColumn(
        "col", F.explode(F.sequence(F.lit(0), F.lit(63)))
    )
    return spine.join(best, ["sample_id", "col"], "left").select(
        "sample_id", "col", F.when(~hole, F.col("y").cast("double")).alias("y")
    )


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """50 curves stacked as one 50 x 64 image."""
    p = pattern_points(spark, folder)
    return p.select(
        F.floor(F.col("pattern_id") / 50.0).cast("int").alias("image_id"),
        F.col("idx").alias("x"),
        (F.col("pattern_id") % 50).cast("int").alias("y"),
        (F.col("intensity").cast("bigint") % 256).cast("int").alias("r"),
        (F.floor(F.col("intensity") / 256).cast("bigint") % 256).cast("int").alias("g"),
        (F.floor(F.col("intensity") / 1024).cast("bigint") % 256).cast("int").alias("b"),
    )


def calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Axis calibration, one per sample."""
    s = table(spark, folder, "supplier")
    lit = lambda v: F.lit(v).cast("int")
    return s.select(
        F.col("s_suppkey").alias("sample_id"),
        lit(170).alias("x0"), lit(90).alias("y0"), lit(1120).alias("x1"), lit(780).alias("y1"),
        lit(170).alias("px1"), lit(1120).alias("px2"), lit(780).alias("py1"), lit(90).alias("py2"),
        (5 + F.col("s_nationkey")).cast("double").alias("x_v1"),
        (70 + F.col("s_nationkey")).cast("double").alias("x_v2"),
        F.lit(0.0).alias("y_v1"),
        (F.abs("s_acctbal") + 1).alias("y_v2"),
    )


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Seven gate metrics per sample plus a domain.

    Gates compare the averages with round numbers, so the last bit of a sum decides: the few
    lines of an order are added in the order of the table, however its files are split.
    """
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    place = (F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    line = F.struct(*place, *[F.col(c) for c in ("l_quantity", "l_linenumber", "l_discount", "l_tax")])
    lines = table(spark, folder, "lineitem").select("l_orderkey", line.alias("line")).groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list("line")).alias("lines"))

    def avg(name: str) -> Column:
        known = F.filter(F.transform("lines", lambda x: x[name].cast("double")), lambda v: v.isNotNull())
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))

    means = lines.select("l_orderkey", *[avg(c).alias(c) for c in ("l_quantity", "l_linenumber", "l_discount", "l_tax")],
                         F.array_max(F.transform("lines", lambda x: x["l_linenumber"])).alias("last"))
    li = means.select(
        "l_orderkey",
        (F.col("l_quantity") / 2).alias("curve_y_mae_px"),
        (F.col("l_linenumber") * 2).alias("major_peak_x_error"),
        (1 - F.col("l_discount") * 8).alias("peak_recall"),
        (F.col("last") * 4).cast("double").alias("max_gap_px"),
        (F.col("l_tax") * 30).alias("calibration_roundtrip_error"),
        F.col("l_discount").alias("numeric_y_mae_norm"),
        (F.col("l_tax") * 10).alias("major_peak_x_error_2theta"),
    )
    domain = (
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "clean")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "styled")
        .otherwise("real_like")
    )
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("sample_id"), domain.alias("domain"),
        *[c for c in li.columns if c != "l_orderkey"],
    )


def gt_points(spark: SparkSession, folder: str) -> DataFrame:
    """The neighbouring curve, shifted by 0.1 degree, plays ground truth."""
    return pattern_points(spark, folder).where("pattern_id > 0").select(
        (F.col("pattern_id") - 1).alias("pattern_id"),
        "idx",
        (F.col("two_theta") + 0.1).alias("two_theta"),
        "intensity",
    )


def psi_scans(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("scan_id"),
        (F.col("l_linenumber") * 10).cast("double").alias("psi_deg"),
        (60 + F.col("l_discount")).alias("two_theta_deg"),
    )


def intensity_rows(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    part = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("group_id"),
        F.col("l_partkey").alias("phase_id"),
        F.col("l_extendedprice").alias("intensity_measured"),
        (1 + F.col("l_tax") * 10).alias("rir"),
        F.col("p_retailprice").alias("intensity_reference"),
    )


LATTICE_SYSTEMS = ["cubic", "tetragonal", "orthorhombic", "hexagonal", "monoclinic", "triclinic"]
LATTICE_CENTERINGS = ["P", "I", "F", "C", "A", "B", "R", "HCP"]


def lattices(spark: SparkSession, folder: str) -> DataFrame:
    """One unit cell per part: system and centering from its key, edges from its price."""
    p = table(spark, folder, "part")
    k = F.col("p_partkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    return p.select(
        k.alias("lattice_id"),
        pick(LATTICE_SYSTEMS, k % 6).alias("system"),
        pick(LATTICE_CENTERINGS, k % 8).alias("centering"),
        (2.5 + (k % 97) * 0.02).alias("a"),
        (2.6 + (k % 89) * 0.02).alias("b"),
        (3.1 + (k % 83) * 0.02).alias("c"),
        (80 + k % 15).cast("double").alias("alpha"),
        (85 + k % 20).cast("double").alias("beta"),
        (82 + k % 17).cast("double").alias("gamma"),
    )


# --- the same views as text for the oracle engine -------------------------------------

ORACLE_VIEWS = {
    "pattern_points": """SELECT vec_id AS pattern_id, CAST(i - 1 AS INT) AS idx,
        CAST(10 + 0.5 * (i - 1) AS DOUBLE) AS two_theta,
        CAST(floor(abs(CAST(embedding[i] AS DOUBLE)) * 1000000) AS DOUBLE) AS intensity
        FROM embeddings, range(1, 65) r(i)""",
    "event_series": """SELECT user_id AS pattern_id,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
        value AS intensity FROM events""",
    "candidates": """SELECT l_suppkey AS sample_id, CAST(l_partkey % 64 AS INT) AS col,
        CAST(l_quantity AS INT) AS y, l_discount * 10 AS confidence, l_tax * 100 AS comp_score,
        CAST(l_linenumber AS DOUBLE) AS axis_dist, l_extendedprice / 5000 AS color_dist,
        CASE l_returnflag WHEN 'N' THEN 'raw' WHEN 'A' THEN 'skeleton' ELSE 'both' END AS source,
        (l_orderkey * 8 + l_linenumber) * 16777216
          + CAST(round(l_extendedprice * 100) AS BIGINT) AS cand_id
        FROM lineitem""",
    "trace": """SELECT sample_id, col,
        CASE WHEN (col + sample_id) % 11 IN (5, 6) THEN NULL ELSE CAST(y AS DOUBLE) END AS y
        FROM (SELECT DISTINCT sample_id, CAST(g.i AS INT) AS col
              FROM candidates, range(0, 64) g(i)) s
        LEFT JOIN (SELECT sample_id, col, y, row_number() OVER (PARTITION BY sample_id, col
              ORDER BY confidence DESC, cand_id) AS rk FROM candidates
              QUALIFY rk = 1) c USING (sample_id, col)""",
    "pixels": """SELECT CAST(floor(pattern_id / 50.0) AS INT) AS image_id, idx AS x,
        CAST(pattern_id % 50 AS INT) AS y,
        CAST(CAST(intensity AS BIGINT) % 256 AS INT) AS r,
        CAST(CAST(floor(intensity / 256) AS BIGINT) % 256 AS INT) AS g,
        CAST(CAST(floor(intensity / 1024) AS BIGINT) % 256 AS INT) AS b FROM pattern_points""",
    "calibration": """SELECT s_suppkey AS sample_id, 170 AS x0, 90 AS y0, 1120 AS x1, 780 AS y1,
        170 AS px1, 1120 AS px2, 780 AS py1, 90 AS py2,
        CAST(5 + s_nationkey AS DOUBLE) AS x_v1, CAST(70 + s_nationkey AS DOUBLE) AS x_v2,
        CAST(0 AS DOUBLE) AS y_v1, abs(s_acctbal) + 1 AS y_v2 FROM supplier""",
    "metrics": """SELECT o_orderkey AS sample_id,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'clean'
             WHEN o_orderpriority = '3-MEDIUM' THEN 'styled' ELSE 'real_like' END AS domain,
        avg(l_quantity) / 2 AS curve_y_mae_px,
        avg(CAST(l_linenumber AS DOUBLE)) * 2 AS major_peak_x_error,
        1 - avg(l_discount) * 8 AS peak_recall,
        CAST(max(l_linenumber) * 4 AS DOUBLE) AS max_gap_px,
        avg(l_tax) * 30 AS calibration_roundtrip_error, avg(l_discount) AS numeric_y_mae_norm,
        avg(l_tax) * 10 AS major_peak_x_error_2theta
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        GROUP BY o_orderkey, o_orderpriority""",
    "gt_points": """SELECT pattern_id - 1 AS pattern_id, idx, two_theta + 0.1 AS two_theta,
        intensity FROM pattern_points WHERE pattern_id > 0""",
    "psi_scans": """SELECT l_orderkey AS scan_id, CAST(l_linenumber * 10 AS DOUBLE) AS psi_deg,
        60 + l_discount AS two_theta_deg FROM lineitem""",
    "intensity_rows": """SELECT l_orderkey AS group_id, l_partkey AS phase_id,
        l_extendedprice AS intensity_measured, 1 + l_tax * 10 AS rir,
        p_retailprice AS intensity_reference FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "lattices": """SELECT p_partkey AS lattice_id,
        ['cubic','tetragonal','orthorhombic','hexagonal','monoclinic','triclinic']
          [CAST(p_partkey % 6 + 1 AS INT)] AS system,
        ['P','I','F','C','A','B','R','HCP'][CAST(p_partkey % 8 + 1 AS INT)] AS centering,
        CAST(2.5 AS DOUBLE) + (p_partkey % 97) * CAST(0.02 AS DOUBLE) AS a,
        CAST(2.6 AS DOUBLE) + (p_partkey % 89) * CAST(0.02 AS DOUBLE) AS b,
        CAST(3.1 AS DOUBLE) + (p_partkey % 83) * CAST(0.02 AS DOUBLE) AS c,
        CAST(80 + p_partkey % 15 AS DOUBLE) AS alpha, CAST(85 + p_partkey % 20 AS DOUBLE) AS beta,
        CAST(82 + p_partkey % 17 AS DOUBLE) AS gamma FROM part""",
}

_NEEDS = {
    "trace": ["candidates"],
    "pixels": ["pattern_points"],
    "gt_points": ["pattern_points"],
}


def oracle(views: str, body: str) -> str:
    """Prefix ``body`` (a SELECT, or named subqueries and a SELECT) with the views it reads."""
    names: list[str] = []
    for view in views.split():
        for name in [*_NEEDS.get(view, []), view]:
            if name not in names:
                names.append(name)
    parts = [f"{n} AS ({ORACLE_VIEWS[n]})" for n in names]
    body = body.strip()
    if body[:6].upper() == "SELECT":
        head = f"WITH RECURSIVE {', '.join(parts)} " if parts else ""
        return head + body
    return f"WITH RECURSIVE {', '.join([*parts, body])}"


def R(expr: str, digits: int = 6) -> str:
    """Oracle-side rounding without negative zero."""
    return f"(CAST(round({expr}, {digits}) AS DOUBLE) + 0.0)"
