"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the tables; BENCH_CPUS: local cores; BENCH_QUERIES: names, or "all".
Each query runs twice and the better time counts; results go to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from glossaline.session import local_session  # noqa: E402
from glossaline.workloads import QUERIES  # noqa: E402

HEADLINE = [
    "segment_normalize_hash", "segment_duplicates", "skip_text_reasons", "redact_secrets", "chunk_rejoin", "mojibake_scan", "tm_lookup", "tm_upsert", "translate_cached",
    "glossary_match_topk", "super_batch_split", "job_progress", "resume_set", "attempt_health", "latency_ewma", "provider_rank", "waterfall_outcome",
    "catalog_merge", "caption_links", "reading_order", "paragraphs", "translation_plan", "text_fit", "visual_diff",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    times: dict[str, float] = {}
    for name in names:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
