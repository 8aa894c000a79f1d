"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS].
"""

from __future__ import annotations

import json
import os
import time

from latticework.plans import QUERIES
from latticework.session import local_session

HEADLINE = [
    "williamson_hall_by_pattern", "detect_peaks", "numeric_curve_peaks", "find_peaks_prominence", "fwhm",
    "scherrer_stats", "crystallinity", "analyzer_smooth", "resample_envelope", "gap_fill", "reflections",
    "auto_index", "d_ratio_class", "candidate_topk", "candidate_final", "candidate_margins", "min_cost_path",
    "risk_segments", "topmost_trace", "numeric_mae", "peak_prf", "gate_check", "metric_stats", "qpa_fractions",
    "texture_index", "sin2psi_stress",
]

# the table whose rows are the keys of a query, by query or else by its first column
KEY_TABLES = {
    "gate_check": "orders", "pattern_id": "embeddings", "sample_id": "supplier", "group_id": "orders", "scan_id": "orders",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    keyed: dict[str, str] = {}
    for name in HEADLINE:
        started = time.time()
        df = QUERIES[name](spark, folder)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        keyed[name] = KEY_TABLES.get(name) or KEY_TABLES.get(df.columns[0], "")
    sizes = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in {*keyed.values()} if t}
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "keys_per_second": {n: round(sizes[keyed[n]] / t, 1) for n, t in times.items() if keyed[n]},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
