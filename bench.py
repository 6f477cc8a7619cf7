"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query is written to the no-op sink, so all rows and columns are computed.
"""
import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "ttc_score", "macro_summary", "gt_distribution", "latency_summary", "frame_min_ttc", "error_episodes",
    "risk_states", "risk_events", "event_metrics", "associate_detections", "path_gate", "contained_path_gate",
    "guard_sweep", "semantic_state", "semantic_fusion", "causal_ttc_robust", "looming_tau", "kalman_distance",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from roadrisk.plans.catalog import QUERIES

    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
