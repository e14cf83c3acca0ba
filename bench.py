"""Times the headline queries once warm, without cached indexes. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tessera.plans.catalogue import QUERIES
from tessera.session import local_session

HEADLINE = [
    "tokenize_stats", "bm25_index_stats", "bm25_topk", "bm25_multi_term_max", "knn_topk", "rrf_fusion", "hybrid_search", "eval_summary", "latency_percentiles",
    "trace_cost", "hash_diff", "upsert_merge", "embed_cache_probe", "call_graph_inversion", "bfs_expand", "structural_priority", "context_packing",
]


def main() -> None:
    cpus, sf = int(os.environ.get("BENCH_CPUS", "8")), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cpus=cpus, partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            spark.catalog.clearCache()  # an index that an earlier query has built doesn't count
            begun = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begun, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
