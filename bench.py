"""Benchmark of the headline queries.

Warm session, each query written to the ``noop`` sink, median of ``BENCH_RUNS``
(default 5) timed runs after one warm-up run; session start is reported apart.
Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["process_point", "process_bin", "dashboard_extract", "chart_series", "pair_ranking",
            "report_lines", "prepare_observations"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    t0 = time.perf_counter()
    from starlit.session import build_session
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus, app="starlit-bench")
    session_sec = time.perf_counter() - t0

    from starlit.plans.queries import QUERIES

    timings: dict[str, float] = {}
    for name in names:
        build = QUERIES[name]
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
        samples = []
        for _ in range(runs):
            t = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t)
        timings[name] = round(statistics.median(samples), 4)

    value = round(sum(timings.values()), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    import pyarrow.parquet as pq
    events = pq.ParquetFile(os.path.join(sf_dir, "events.parquet")).metadata.num_rows
    rates = {q: round(events / timings[q]) for q in ("process_point", "process_bin", "prepare_observations")
             if q in timings and timings[q] > 0}
    print(json.dumps({"metric": "headline_queries_median_sum", "value": value, "unit": "sec",
                      "queries": timings, "sf": sf, "session_start_sec": round(session_sec, 3),
                      "runs": runs, "cpus": cpus, "input_rows": events, "rows_per_sec": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
