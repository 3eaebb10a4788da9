"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then $BENCH_RUNS times (3); the median counts.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from latticemix.session import remove_intermediate  # noqa: E402
from workload.queries import all_queries  # noqa: E402

HEADLINE = (
    "minmax_normalize",
    "log_mixed_density",
    "posterior_cell",
    "assign_by_cell",
    "joint_posterior",
    "log_likelihood",
    "em_step",
    "fit_mixed",
    "fit_mixed_moving",
    "predict",
    "contingency",
    "pair_counts",
    "external_indices",
    "model_quality",
    "cluster_scatter",
    "davies_bouldin",
    "silhouette",
    "with_row_id",
    "scan_continuous",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("latticemix-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    run = lambda name: registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("model_quality")  # start the JVM and the Python workers
    times = {}
    for name in HEADLINE:
        run(name)
        taken = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            start = time.perf_counter()
            run(name)
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        remove_intermediate(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
