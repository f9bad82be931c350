"""Time the headline queries: one JSON line for ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from engramspark import get_session  # noqa: E402
from engramspark.catalog.queries import QUERIES  # noqa: E402

HEADLINE = (
    "document_extraction",  # first use: indexes all documents
    "retrieved_passages", "filtered_retrieval", "candidate_facts", "dense_passages", "packed_contexts",
    "fact_dedupe", "fact_edges", "passage_edges", "out_weights", "store_stats", "edge_ledger",
    "ppr_scores", "cosine_topk", "knn_synonyms", "minmax_scores", "tag_matches", "consolidated_topics",
    "forget_candidates", "forget_cascade", "pressure_points", "pressure_points_one_store", "turn_snapshots",
    "exchange_chunks", "budget_pack", "notes_search", "keyword_recall", "progress_fold", "entity_ids",
    "knn_synonyms_blocks", "progress_stream_frames",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = get_session(
        f"local[{cpus}]", "bench",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in only:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
