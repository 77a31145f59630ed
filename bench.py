"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spinecat.plans import registry  # noqa: E402
from spinecat.session import local_session  # noqa: E402

HEADLINE = [
    "shop_dashboard",
    "top_zero_result_queries",
    "top_consulted_titles",
    "recent_events",
    "dedup_against_catalog",
    "dedup_sequential",
    "weekly_cohort",
    "innovation_metrics",
    "bulk_search",
    "public_catalog",
    "apply_edits",
    "response_parse",
    "extraction_scores",
    "document_keys",
    "process_batches_books",
    "stream_ingest",
    "stream_dedup",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores))
    # Starts the JVM's executors and compiler; not one of the timed queries.
    registry.QUERIES["batch_summary"](spark, folder).collect()
    times = {}
    for name in names:
        began = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
