"""Times headline queries and prints one JSON line; BENCH_SF_DIR and BENCH_CPUS set tables and cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINES = ["unified_records", "crosswalk_join", "name_normalization", "candidate_pairs", "candidate_report", "signal_counts", "decision_counts", "arm_report", "match_sweep", "review_sweep", "split_counts", "hard_negatives", "source_links", "active_merges"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from ledgerlink.queries import QUERIES

    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors' code paths
    took = {}
    for name in HEADLINES:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
