"""Times the headline queries and prints one JSON line. BENCH_SF_DIR names the data, BENCH_CPUS the cores, BENCH_RUNS the runs."""

from __future__ import annotations

import json
import os
import statistics
import time

from lattica.plans import registry
from lattica.session import local_session

HEADLINE = ("q_keywords", "q_keywords_corpus", "q_links_final", "q_global_nodes", "q_global_edges", "q_note_graph_nodes", "q_expand", "q_search_semantic", "q_search_keyword", "q_versions")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    found = registry.queries()
    times = {}
    found["q_keywords"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    for name in HEADLINE:
        each = []
        for _ in range(runs):
            began = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - began)
        times[name] = round(statistics.median(each), 3)
    print(json.dumps({"metric": "total seconds of the headline queries, median of runs", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
