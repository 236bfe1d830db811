"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores. Arguments name other queries to run; `all` runs every registered one.
"""

from __future__ import annotations

import json
import os
import sys
import time

from kartoteka.registry import registered
from kartoteka.session import local_session

HEADLINE = (
    "list_page", "filter_ci_top", "keyword_distinct", "keyword_pattern", "modified_since", "best_per_key", "coverage",
    "dim_override", "star_join", "wide_to_map", "map_to_list", "pairs_to_map", "cards", "full_load", "insert_if_absent",
    "upsert", "incremental_upsert", "contract_report", "compose_text", "hash_embed", "cosine_topk", "cosine_topk_blocks",
    "ann_topk", "embed_new", "semantic_search", "name_search", "route_questions", "validate_submissions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries = registered()
    names = list(queries) if sys.argv[1:] == ["all"] else sys.argv[1:] or list(HEADLINE)
    spark = local_session("bench", cpus=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").collect()  # start the session before the clock does

    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
