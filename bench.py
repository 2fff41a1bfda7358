"""Headline queries on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lattica.plans import catalog
from lattica.session import build_session

HEADLINE = ["x02_tpch_q3", "x03_tpch_q10", "d01_group_aggregate", "d14_cube", "d12_distinct_aggregates", "c01_inner_join", "c17_interval_join", "o07_top_k", "w05_tumble", "w07_hop", "w08_sliding_panes", "w09_session", "w02_over_rows", "x01_wordcount", "u05_except_all", "g07_connected_components", "g12_triangles", "g24_knn", "s24_cep_next"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["d01_group_aggregate"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's threads
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
