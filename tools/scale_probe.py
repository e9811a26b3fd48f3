"""Throughput of both pipeline modes on a larger table derived from the test events.

    python tools/scale_probe.py [copies] [sf_dir]

Each event is repeated ``copies`` times (explode of a sequence, no join) with a
new event id and a new object per copy (so objects keep their size and the row
count grows); the derived table is written once to the shared checkpoint folder
and read back, then each mode is written to the noop sink and timed.
"""

from __future__ import annotations

import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 20
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    strategies = sys.argv[3].split(",") if len(sys.argv) > 3 else ["auto"]
    from pyspark.sql import functions as F

    from starlit.plans import lightcurve
    from starlit.schema import Params
    from starlit.session import build_session, scratch_path
    from starlit.sources import adapters

    spark = build_session()
    ev = adapters.table(spark, sf_dir, "events")
    n = ev.count()
    big = ev.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(
        (F.col("event_id") + F.col("copy") * F.lit(n)).alias("event_id"), "ts",
        (F.col("user_id") + F.col("copy") * F.lit(1_000_000)).alias("user_id"), "event_type", "value", "props")
    path = scratch_path(spark, f"scale/{uuid.uuid4().hex}")
    big.write.parquet(os.path.join(path, "events.parquet"))
    rows = spark.read.parquet(os.path.join(path, "events.parquet")).count()
    print(f"derived rows: {rows}")
    for strategy in strategies:
        for mode in ("point", "bin"):
            for i in range(2):
                t = time.perf_counter()
                obs = adapters.observations(spark, path)
                lightcurve.process(obs, "obs", mode, Params(bin_width=0.5), strategy=strategy) \
                    .write.format("noop").mode("overwrite").save()
                sec = time.perf_counter() - t
                print(f"{strategy} {mode} run {i}: {sec:.2f} s, {rows / sec:,.0f} rows/s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
