"""Seconds per headline query: median of timed runs after one warm-up, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from avisgrid.catalog import QUERIES  # noqa: E402
from avisgrid.session import START_CONF  # noqa: E402

HEADLINE = (
    "refine_reviews",
    "refine_documents",
    "land_run",
    "stg_latest_version",
    "apply_verdicts",
    "fact_reviews",
    "fact_classifications",
    "fact_tickets",
    "dm_direction_synthese",
    "dm_marketing_voc",
    "dm_finance_litiges",
    "dm_sav_tickets",
    "spike_alerts",
    "tickets",
    "new_tickets",
    "dq_report",
)
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in START_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark: SparkSession, name: str, sf_dir: str) -> float:
    """Build and run a query; every column of the result is produced."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in names:
        timed(spark, name, sf_dir)
        seconds[name] = round(
            statistics.median(timed(spark, name, sf_dir) for _ in range(RUNS)), 3
        )
    print(
        json.dumps(
            {
                "metric": "total of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
