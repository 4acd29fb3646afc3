"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from chronoweave.plans import catalogue
from chronoweave.session import session

HEADLINE = [
    "measurement_summary", "gap_cluster", "precedes_edges", "asof_nearest", "band_semi", "interval_join_episode", "rollup_best_per_day", "serialize_blocks", "greedy_chunks",
    "kw_search_snippet", "bm25_topk", "budget_pack", "tokenize_count", "earliest_per_key", "span_per_key", "two_hop", "bfs_hops", "connected_components",
    "weighted_similarity", "multi_net_rank", "jaccard", "cohort_table1", "eval_grouping_sets", "index_percentiles", "dist_drift",
]


def main() -> None:
    where = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["count_by_type"](spark, where).count()  # the session's own start is not a query's time
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": where.rstrip("/").rpartition("sf")[2]}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
