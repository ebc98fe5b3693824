"""Time the headline queries; one JSON line on stdout.

BENCH_SF_DIR names the table folder and BENCH_CPUS the cores. Every query is built and
run to its last row (into the no-op sink) in one session, in the order listed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textmatch.config import local_session  # noqa: E402
from workload.queries import REGISTRY  # noqa: E402

HEADLINE = [
    "clean_text_docs",
    "standardize_titles",
    "group_concat",
    "prepared_corpus",
    "content_dedup_docs",
    "vocabulary_terms",
    "tfidf_vectors",
    "tfidf_boost",
    "chunk_documents",
    "hash_embed",
    "cosine_topk",
    "cosine_topk_blocked",
    "tfidf_topk",
    "match_lite_documents",
    "match_benchmark",
    "match_streamed",
    "evaluate_all",
    "best_threshold",
    "word_overlap_match",
    "evaluated_model",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "textmatch-bench")
    times: dict[str, float] = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
