"""Times headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tessera.queries import QUERIES

#: The five executor scenarios (scan, filter, filter with projection, hash join, aggregation) and the flagship.
HEADLINES = {"scan_lineitem": "lineitem", "filter_selectivity": "lineitem", "scan_filter_project": "lineitem", "join_hash_inner": "lineitem", "agg_group_count": "events", "agg_count_sum_many_groups": "lineitem", "join_group_count": "orders", "top_k": "orders", "unique_violations_batch": "lineitem", "fk_orphans": "lineitem"}
SAMPLES = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rates = {}, {}
    for name, table in HEADLINES.items():
        took = []
        for _ in range(1 + SAMPLES):  # the first one warms up
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(sorted(took[1:])[SAMPLES // 2], 4)
        rates[name] = round(spark.read.parquet(f"{sf_dir}/{table}.parquet").count() / seconds[name])
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "rows_per_sec": rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
