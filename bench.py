"""Benchmark: wall time of the headline queries on the test tables.

Prints one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Every query is
run to completion into the ``noop`` sink, once to warm up and then BENCH_RUNS times
(default 3); the best run counts. ``value`` is the sum over the queries. ``planning`` is the
part of it that building and optimizing the plan takes, measured apart.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lintlake.plans import corpus
from lintlake.plans.queries import queries

HEADLINE = (
    "lines", "line_context", "imports", "try_regions", "brace_blocks", "code_blocks", "diff_lines",
    "diff_findings", "diff_summary", "findings_all", "findings_sorted", "findings_security",
    "findings_min_conf_80", "check_error_handling", "summary", "summary_by_file",
    "summary_by_source", "severity_groups", "rule_SEC003", "rule_QA005", "rule_QA006",
)


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        # The test tables are small: smaller splits give every core a part.
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()

    def run(name: str) -> None:
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    def plan(name: str) -> None:
        known[name](spark, sf_dir)._jdf.queryExecution().executedPlan()

    seconds, planning = {}, {}
    for name in HEADLINE:
        run(name)
        seconds[name] = round(min(timed(lambda: run(name)) for _ in range(runs)), 3)
        planning[name] = round(min(timed(lambda: plan(name)) for _ in range(runs)), 3)

    size = corpus.files(spark, sf_dir).agg(
        F.count("*").alias("files"),
        F.sum(F.size(F.split("content", "\n"))).alias("lines"),
        F.sum(F.octet_length("content")).alias("bytes"),
    ).first()
    review = seconds["findings_all"]
    print(
        json.dumps(
            {
                "metric": "review_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "planning": planning,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "files": size["files"],
                "lines": size["lines"],
                "bytes": size["bytes"],
                "review_files_per_sec": round(size["files"] / review),
                "review_lines_per_sec": round(size["lines"] / review),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
