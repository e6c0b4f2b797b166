"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Each query is run once to warm up and then timed over RUNS runs, of which the median counts. Results are consumed whole
by a sink that drops them.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from quernstone.plans.session import session
from quernstone.queries import QUERIES

RUNS = 3
HEADLINE = [
    "kv_multi_get", "kv_range_incl", "kv_upsert", "kv_batch_lastwins", "kv_floor_asof", "kv_range_join",
    "ver_diff", "ver_merge", "ver_merge_multibase", "ver_time_travel",
    "slot_page_fwd", "slot_page_rev", "slot_page_slot_rev", "slot_page_by_tiers", "slot_page_by_group", "slot_tiers",
    "dag_view", "dag_prune", "vec_knn_l2", "vec_knn_filtered", "vec_knn_batch_l2", "trie_smt_root", "trie_mpt_root",
]


def main() -> None:
    data, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(median(times[1:]), 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(data.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
