"""Times the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is run ``$BENCH_RUNS`` times to its full result (Spark's ``noop`` sink, nothing is collected) and the best
run counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workload.check_oracle import local_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "label_counts", "counts_by_country_slot", "dedup_titles", "cap_per_group", "relevant_articles",
    "domain_best_rank", "lexicon_sum", "lexicon_score", "token_counts", "nested_roundtrip", "net_score_series",
    "subject_match", "translated_titles", "outlet_extract", "batch_slot_counts",
]
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("newsmood-bench", os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(RUNS):
            start = time.perf_counter()
            run(QUERIES[name](spark, sf))
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name} {best:.2f}s", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf)
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": float(scale.group(1)) if scale else sf}))


if __name__ == "__main__":
    main()
