"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from tessera.queries import QUERIES
from tessera.session import local_session

HEADLINE = ["bm25_topk", "hybrid_retrieve", "vector_topk", "keyword_search", "passages", "chunk_fixed", "chunk_recursive", "chunk_conversation", "auto_chunk", "records_projection", "html_to_text", "event_log_sessions", "jsonl_tolerant_read", "star_join", "hash_embedding", "quality_report", "tokenize", "plan_queries"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    QUERIES["star_join"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the JVM warms up
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(found[1]) if found else None}))


if __name__ == "__main__":
    main()
