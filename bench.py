"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from arbora.plans.catalogue import QUERIES

HEADLINE = [
    "scan_project_alias", "sel_logic", "sel_counting", "rule_decision", "rule_two_phase", "lookup_count", "lookup_latest", "index_get_join", "anti_unordered", "interval_join",
    "flatten_three_levels", "flatten_recursive_star", "count_multilevel", "group_collect", "agg_sum_avg_min_max", "matrix_totals", "level_filter", "share_of_parent", "carry_forward",
    "topk_per_group", "text_match_extract_replace", "log_records", "declared_query",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run compiles code
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
