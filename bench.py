"""Time the headline queries and print one JSON line.

Every query starts from the raw tables and includes building its inputs. ``plan`` holds the
seconds until a query returned its DataFrame, which include the tables it stages on
the way; ``run`` those of the final job.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "daily_history",
    "funnel_daily",
    "growth_ladder",
    "correlation_sweep",
    "two_window_signature",
    "analog_topk_min_gap",
    "model_a",
    "model_r",
    "switch_bizday",
    "switch_regime",
    "report_frame",
    "param_sweep_monthly",
    "param_sweep_window",
    "param_search_ranges",
    "analog_forecast",
    "batch_backtest",
    "anchor_feature_table",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidecast-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # without the origin of every expression, which costs half of the calls into the JVM
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from tidecast.catalog import QUERIES

    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    plan: dict[str, float] = {}
    for name in names:
        start = time.time()
        df = QUERIES[name].run(spark, directory)
        plan[name] = round(time.time() - start, 3)
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    sf = os.path.basename(directory.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "plan": plan,
        "run": {k: round(v - plan[k], 3) for k, v in seconds.items()},
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
