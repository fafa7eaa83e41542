"""Times the headline queries and prints one JSON line.

Every query writes all its columns to the no-op sink, so nothing is pruned or
collected. The first run of a query compiles its plan; the best of the runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pagemill.session import local_session
from workload import QUERIES

HEADLINE = (
    "page_identity", "change_counts", "normalize_url", "normalize_link", "html_nodes", "link_decisions", "drop_reasons",
    "page_links", "page_metadata", "strip_boilerplate", "primary_container", "article_markdown", "documents",
    "expand_sitemaps", "crawl_frontier", "run_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=cpus)
    n_pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            elapsed = time.perf_counter() - started
            best = elapsed if best is None else min(best, elapsed)
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "pages": n_pages,
                "pages_per_sec": {name: round(n_pages / seconds, 1) for name, seconds in times.items()},
            }
        )
    )


if __name__ == "__main__":
    main()
