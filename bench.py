"""Time the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.

python bench.py --workload times the flagship join instead: WORKLOAD rows on either side, keys 1 to WORKLOAD, once each.
"""

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

from kvjoin import catalog
from kvjoin.operators import joins

WORKLOAD = 12_002_342

HEADLINE = [
    "join_phj", "join_smj", "join_nphj", "join_mpsm", "join_phj_part_lineitem", "join_phj_supplier_lineitem", "join_phj_customer_orders", "join_chain",
    "hash_probe", "probe_stats", "hash_build", "h_glb", "partition_histogram", "partition_slots", "packet_histogram", "sort_quick",
    "groupby_key2", "hash_unique", "arith_expr", "sel_double", "encode_string", "run_plan",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}
    if sys.argv[1:] == ["--workload"]:
        build = spark.range(1, WORKLOAD + 1).selectExpr("id AS lvalue", "id * 3 AS rvalue")
        probe = spark.range(1, WORKLOAD + 1).selectExpr(f"id * 7919 % {WORKLOAD} + 1 AS lvalue", "id AS rvalue")
        for name in ("phj", "smj", "nphj", "mpsm"):
            took = []
            for _ in range(3):
                began = time.perf_counter()
                joins.join(build, probe, name).write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - began)
            times[name] = round(min(took[1:]), 3)
        print(json.dumps({"metric": "workload_join_seconds", "rows": WORKLOAD, "unit": "sec", "queries": times, "cpus": int(cpus)}))
        return
    for name in sys.argv[1:] or HEADLINE:
        took = []
        for _ in range(4):
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(median(took[1:]), 4)  # the first run warms up
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
