"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["vpc_percentile_bands", "vpc_replicate", "observed_percentiles", "sim_percentiles",
            "event_table", "sim_input", "collection_window_strict", "paired_difference",
            "prediction_join_time", "superposed_oral", "loess_half_hours",
            "residual_trend_minutes", "quantile_curves", "box_stats", "fit_hill",
            "truncated_pairs"]


def main() -> None:
    from studyframe.plans.catalog import QUERIES
    from studyframe.session import build_session

    spark = build_session("studyframe-bench", **{
        "spark.master": f"local[{CPUS}]", "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/events.parquet").groupBy("event_type").count().collect()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
