"""Time the headline queries; prints one JSON line.

Reads the tables in $BENCH_SF_DIR on local[$BENCH_CPUS].  Every query runs once to warm up, then three
times into the no-op sink (all rows are computed, none are shipped to Python); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from telemill import build_session
from telemill.plans.registry import REGISTERED

HEADLINE = [
    "service_nodes",
    "service_edges",
    "query_spans",
    "assemble_trace",
    "trace_summaries",
    "search_traces",
    "incremental_summaries",
    "p99_by_operation",
    "latency_anomalies",
    "dependency_changes",
    "search_logs",
    "keyword_search_documents",
    "extract_fields",
    "log_context",
    "severity_counts",
    "attr_hash",
    "tail_sample",
    "otlp_traces",
    "select_points",
    "matrix",
    "rollup_5m",
    "rollup_1d",
    "multi_window_agg",
    "rate",
    "histogram_quantile",
    "vector_ratio",
    "rule_eval",
    "alert_transitions",
    "outbox",
    "stream_severity_counts",
    "silenced",
    "nearby_logs",
]
RUNS = 3


def run(spark, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    REGISTERED[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINE:
        run(spark, name, sf_dir)
        timings[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(RUNS)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
