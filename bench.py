"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line.

Each query runs once unmeasured (code generation, file cache) and then twice; the better
time counts and includes building the plan.  Results are written to the no-op sink, so
every column of every row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from specweave.queries import REGISTRY
from specweave.session import local_session

HEADLINE = [
    "exact_match",
    "fuzzy_topk",
    "fuzzy_topk_urls",
    "vector_topk_columns",
    "candidate_merge",
    "judge_guard",
    "retention_period",
    "report_rows",
    "report_union",
    "summary_stats",
    "event_sequence",
    "tag_upsert",
    "relationship_counts",
    "reconcile",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs[1:]), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
