"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quadlake import catalogue

HEADLINE = ["bgp_star", "bgp_chain", "wide_star_optionals", "filter_theta", "optional", "union", "minus", "exists", "not_exists", "aggregates", "count_distinct", "having", "order_limit_offset", "graph_var", "path_seq", "path_plus", "lang_matches", "construct", "events_users", "hexastore_view", "compare_all", "intersect", "pat_po", "pat_o", "id_join", "id_chain", "all_hexastore"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    queries["bgp_star"](spark, sf).write.format("noop").mode("overwrite").save()
    times, loads = {}, {}
    for name, load in (("quads", catalogue.whole_store), ("ids", catalogue.id_store)):  # loading is no query: apart from the total
        began = time.perf_counter()
        load(spark, sf)
        loads[name] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "loads": loads, "sf": sf}))


if __name__ == "__main__":
    main()
