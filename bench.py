"""Times headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE))
SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "relation_forward", "relation_backward", "nearest_multi_pred", "reach_forward", "def_use_by_address", "mask_coverage", "code_islands", "node_count_sampled", "exact_or_neighbour",
    "index_lookup", "ks_two_sample", "relation_match_diff", "impact_rank", "interval_containment",
]


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from rootloom.plans import catalog

    run = lambda name: catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])  # warms the JVM
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(SF).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
