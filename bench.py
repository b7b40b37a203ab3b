"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS: local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gridwarden.plans.catalog import QUERIES  # noqa: E402
from gridwarden.session import build_session  # noqa: E402

HEADLINE = [
    "ingestion_report",
    "validate_filter",
    "quarantine",
    "write_partitioned",
    "rush_hour_factor",
    "hotspot_impact",
    "hourly_trend",
    "recency_growth",
    "leaderboard",
    "heatmap_sample",
    "promotion_gate",
    "train_forecast",
    "cluster_hotspots",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("validate_filter", "leaderboard"):  # warm-up of the JVM, untimed
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
