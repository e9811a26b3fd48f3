"""Positions without a window per key, quantiles of many groups at once, conversion of many datasets in the same jobs."""

import os
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from starlit.operators import extract, sample
from starlit.operators.positions import in_order, place, positions
from starlit.operators import trend
from starlit.operators.quantile import finite_facts, grouped_quantile
from starlit.plans import lightcurve
from starlit.plans.convert import convert
from starlit.plans.light_curve_writer import encode_light_curve
from starlit.schema import Params
from starlit.sources import adapters, tables

from core_data import SF_SMALL, SF_SMOKE

INF = float("inf")


def jobs_of(spark, name, run):
    """Number of Spark jobs that ``run`` starts."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(name))


def test_grouped_quantile(spark):
    groups = {"a": [1.0, 2.0, INF, 3.0], "b": [-INF] * 3 + [1.0, 2.0], "c": [7.0] * 40, "d": [float(k * k % 101) for k in range(501)],
              "e": [1e308, -1e308, 5.0], "f": [None, float("nan")], None: [0.25 * k for k in range(100)], "g": [INF, INF], "h": [4.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(5)
    for q in (0.5, 0.25):
        for buckets, finish in ((4, 3), (64, 10), (65536, 10 ** 6)):
            got = grouped_quantile(df, "k", "v", q, buckets=buckets, finish_limit=finish)
            for k, vs in groups.items():
                vs = sorted(v for v in vs if v is not None and v == v)
                if not vs:
                    assert got[k] is None
                    continue
                at = (len(vs) - 1) * q
                a, b, f = vs[int(at)], vs[int(np.ceil(at))], at - int(at)
                assert got[k] == (a if a == b else (1 - f) * a + f * b), (k, q, buckets)
    facts = {r["k"]: tuple(r[c] for c in finite_facts("v")) for r in df.groupBy("k").agg(*[a.alias(c) for c, a in finite_facts("v").items()]).collect()}
    assert grouped_quantile(df, "k", "v", known=facts) == grouped_quantile(df, "k", "v")
    assert grouped_quantile(df.limit(0), "k", "v") == {}


def test_grouped_quantile_jobs_do_not_follow_groups(spark):
    few, many = (spark.range(20_000).select((F.col("id") % n).alias("k"), (F.col("id") * 7919 % 10_007).cast("double").alias("v")) for n in (2, 400))
    runs = [jobs_of(spark, f"groups-{n}", lambda d=d: grouped_quantile(d, "k", "v", buckets=65536, finish_limit=10)) for n, d in ((2, few), (400, many))]
    assert runs[1] <= 2 * runs[0], runs  # smaller histograms may take another round, groups take none of their own
    got = grouped_quantile(many, "k", "v", finish_limit=10)
    want = {r["k"]: r["m"] for r in many.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == want


def write_folders(base, datasets):
    dirs = {}
    for n in range(datasets):
        d = base / f"raw{n:02d}"
        d.mkdir(parents=True)
        err = np.full(6, np.nan) if n % 7 == 3 else np.array([0.1, np.nan, 0.2, 0.4, 0.3, np.nan]) * (n + 1)
        flux = np.array([1.0, 2.0, 3.0, 4.0, 5.0, np.nan]) + n
        columns = {"TIME": np.arange(6.0)[::-1].copy(), "SAP_FLUX": flux, "SAP_FLUX_ERR": err}
        content = encode_light_curve(columns, {c: "D" for c in columns}, {"KEPLERID": 1 + n % 5, "QUARTER": 1 + n % 3}, {})
        (d / "kplr1.fits").write_bytes(content if n % 10 != 9 else content[:3000])
        dirs[f"d{n:02d}"] = str(d)
    return dirs


def test_many_datasets_are_converted_in_the_same_jobs(spark, tmp_path):
    counts = {}
    for n in (3, 50):
        dirs, out = write_folders(tmp_path / str(n), n), str(tmp_path / f"out{n}")
        done: list = []
        counts[n] = jobs_of(spark, f"convert-{n}", lambda: done.extend(convert(spark, dirs, out, preview_rows=2).collect()))
        status = {r["dataset"]: r["status"] for r in done}
        assert {d for d, s in status.items() if s == "failed"} == {f"d{k:02d}" for k in range(n) if k % 10 == 9}
        rows = spark.read.parquet(f"{out}/observations").collect()
        for k in range(n):
            own = [r for r in rows if r["dataset"] == f"d{k:02d}"]
            assert len(own) == (0 if k % 10 == 9 else 5)
            errs = sorted(r["flux_err"] for r in own)
            if own and k % 7 == 3:
                assert errs == [0.0] * 5
            elif own:
                known = [0.1 * (k + 1), 0.2 * (k + 1), 0.4 * (k + 1), 0.3 * (k + 1)]
                assert errs == pytest.approx(sorted([*known, statistics.median(known)]))
        previews = spark.read.option("header", True).csv(f"{out}/preview").groupBy("dataset").count().collect()
        assert {r["count"] for r in previews} == {2} and len(previews) == sum(k % 10 != 9 for k in range(n))
    # reading or writing many folders may take a listing job or two more, not one per dataset
    assert counts[50] <= counts[3] + 6, counts


def test_prepared_output_is_in_canonical_order(spark, tmp_path):
    out = str(tmp_path / "o")
    tables.write_parquet(in_order(adapters.observations(spark, SF_SMOKE), list(tables.CANONICAL_ORDER), 4), out)
    files = sorted(f for f in os.listdir(out) if f.startswith("part-"))
    assert len(files) > 1
    last = None
    for f in files:
        rows = [tuple(r) for r in spark.read.parquet(f"{out}/{f}").select(*tables.CANONICAL_ORDER).toPandas().itertuples(index=False)]
        keys = [(o, q, -1.0 if t != t else t) for o, q, t in rows]
        assert keys == sorted(keys) and (last is None or last <= keys[0])
        last = keys[-1]


def test_csv_files_start_with_a_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("é", 1, "x"), ("b", 2, "y")], "name string, n int, part string")
    tables.write_csv(df, str(tmp_path / "c"), partition_by="part")
    for folder in ("part=x", "part=y"):
        (f,) = [f for f in os.listdir(tmp_path / "c" / folder) if f.endswith(".csv")]
        assert (tmp_path / "c" / folder / f).read_bytes().startswith("﻿name,n\n".encode())
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert back.columns[0].lstrip("﻿") == "name" and back.count() == 2


@pytest.fixture(scope="module")
def skewed(spark):
    """Processed series in which one object holds a third of all objects' rows."""
    from starlit.plans.queries import skewed_obs
    out = lightcurve.process(skewed_obs(spark, SF_SMALL), "obs", "point", Params(bin_width=0.5))
    return extract.extract_project(out).checkpoint()


def keyed(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_hot_object_takes_range_partitions_in_every_downsample(spark, skewed):
    hot = 30  # the merged object is over it: ``auto`` goes by range partitions
    columns = ("object_id", "quarter", "time_bin")
    assert skewed.groupBy("object_id").count().agg(F.max("count")).first()[0] > hot
    same = [
        (sample.even_downsample(skewed, 7, hot_rows=hot), sample.even_downsample(skewed, 7, strategy="window")),
        (sample.downsample_by_object(skewed, 500, 5, hot_rows=hot), sample.downsample_by_object(skewed, 500, 5, strategy="window")),
        (extract.dashboard_extract(skewed, 500, 5, hot_rows=hot), extract.dashboard_extract(skewed, 500, 5, strategy="window")),
    ]
    for ranked, window in same:
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan, plan
        assert keyed(ranked, *columns) == keyed(window, *columns) and ranked.count() < skewed.count()
    ranked, window = (extract.chart_series(skewed, 50, **how) for how in ({"hot_rows": hot}, {"strategy": "window"}))
    assert "Window" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert keyed(ranked, "series", "x", "y") == keyed(window, "series", "x", "y")
    order = ["quarter", "time_bin"]
    assert keyed(positions(skewed, "object_id", order, hot_rows=hot), *columns, "position", "total") \
        == keyed(positions(skewed, "object_id", order, strategy="window"), *columns, "position", "total")


def test_placed_partitions_are_even(spark):
    """One key with a third of all rows: no partition holds twice the median."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 200).cast("string")).alias("k"),
                                    (F.col("id") * 7919 % 60_013).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = place(df, ["k"], ["v"], 12)
        sizes = [r["count"] for r in placed.rows.groupBy("_part").count().collect()]
        assert len(sizes) == 12 and max(sizes) <= 2 * statistics.median(sizes)
        got = placed.positions().filter("k = 'hot'").orderBy("v").select("position", "total").collect()
        assert [tuple(r) for r in got] == [(n, 20_000) for n in range(20_000)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", None), ("a", 5), ("a", 5)], "k string, v int")
    got = {(r["k"], r["v"], r["position"], r["total"]) for r in place(df, ["k"], ["v"]).positions().collect()}
    assert got == {(None, 1, 0, 2), (None, 2, 1, 2), ("a", None, 0, 3), ("a", 5, 1, 3), ("a", 5, 2, 3)}
    assert place(df.limit(0), ["k"], ["v"]).positions().count() == 0
    assert extract.chart_series(spark.createDataFrame([], "object_id string, time_bin double, flux_norm double, rolling_flux double, "
                                                          "is_anomaly boolean, quarter int"), 5).count() == 0


@pytest.mark.parametrize("window", [101, 102, 301, 2501])
def test_sliding_medians_equal_sorted_frames(window, monkeypatch):
    rng = np.random.default_rng(window)
    v = np.round(rng.normal(size=4000), 2)
    v[rng.integers(0, 4000, 300)], v[rng.integers(0, 4000, 20)], v[rng.integers(0, 4000, 20)] = np.nan, INF, -INF
    keys = np.zeros(4000, dtype=bool)
    keys[[0, 1, 40, 41, 1500, 3999]] = True
    for least in (1, 3, 200):
        got = trend.framed_medians(keys, v, *trend.frame_bounds(window), least)
        monkeypatch.setattr(trend, "SLIDING_FROM", 10 ** 9)
        want = trend.framed_medians(keys, v, *trend.frame_bounds(window), least)
        monkeypatch.undo()
        np.testing.assert_array_equal(got, want)


def test_cost_of_long_frames_is_nearly_flat():
    import time
    v, keys = np.random.default_rng(1).normal(size=60_000), np.arange(60_000) == 0
    took = {}
    for window in (101, 2501):
        t = time.process_time()
        trend.framed_medians(keys, v, *trend.frame_bounds(window), 3)
        took[window] = time.process_time() - t
    assert took[2501] < 5 * took[101], took


def test_long_window_equals_the_window_route(spark):
    obs = adapters.observations(spark, SF_SMOKE)
    by = [{tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in lightcurve.process(
        obs, "obs", "point", Params(bin_width=0.5, window=101, vectorize_rows=n)).collect()} for n in (0, 10 ** 9)]
    assert by[0] == by[1]


def test_discovery_reads_footers_in_tasks(spark, tmp_path):
    one = spark.createDataFrame([("a", 1.0)], "object_id string, time_bin double").coalesce(1)
    one.write.parquet(str(tmp_path / "seed"))
    (part,) = [f for f in os.listdir(tmp_path / "seed") if f.endswith(".parquet")]
    content = (tmp_path / "seed" / part).read_bytes()
    for k in range(64):
        (tmp_path / f"k{k:02d}_dash_data.parquet").write_bytes(content if k not in (7, 40) else b"no table")
    skipped: list = []
    found: list = []
    jobs = jobs_of(spark, "discover", lambda: found.append(tables.discover_extracts(spark, str(tmp_path), skipped=skipped)))
    assert jobs <= 2 * 2 * 7 + 2, jobs  # two broken ones among 64: halving, not one job for each file
    assert sorted(os.path.basename(p)[:3] for p, _ in skipped) == ["k07", "k40"]
    assert found[0].select("dataset_key").distinct().count() == 62
    for k in (7, 40):
        (tmp_path / f"k{k:02d}_dash_data.parquet").unlink()
    assert jobs_of(spark, "discover-clean", lambda: tables.discover_extracts(spark, str(tmp_path))) <= 4  # listing and footers, to check and to read
