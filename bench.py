"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    from pyspark.sql import SparkSession

    from marlstone.queries import inventory, tpch

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    some = ["join_multi_way", "agg_group_multi", "agg_count_distinct", "window_running", "window_row_number", "distinct_pair", "set_intersect_all", "top_n", "sub_correlated_avg"]
    queries = {**tpch.QUERIES, **{k: inventory.QUERIES[k] for k in some}}
    took = {}
    for name, q in queries.items():
        runs = []
        for _ in range(3):  # the first run compiles
            began = time.perf_counter()
            q(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 4)
    print(json.dumps({"metric": "analytics_suite_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
