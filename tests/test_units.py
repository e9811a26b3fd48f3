"""Hand-made unit cases for the pipeline semantics."""

import math

import pytest
from pyspark.sql import functions as F

from starlit.operators import clean, sample
from starlit.plans import lightcurve
from starlit.schema import Params

COLS = "dataset string, source_file string, object_id string, quarter int, time double, flux double, flux_err double, quality double"


def obs(spark, rows):
    return spark.createDataFrame(rows, COLS)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_single_row_object(spark):
    out = lightcurve.process_point(obs(spark, [("d", "f", "a", 1, 1.0, 10.0, 0.1, 0.0)]), "d").collect()
    assert len(out) == 1
    r = out[0]
    assert r.flux_norm == 0.0 and r.rolling_flux == 0.0 and r.is_anomaly is False


def test_constant_flux_no_anomaly(spark):
    data = [("d", "f", "a", 1, float(i), 5.0, 0.1, 0.0) for i in range(5)]
    out = lightcurve.process_point(obs(spark, data), "d").collect()
    assert all(r.flux_norm == 0.0 and not r.is_anomaly for r in out)
    outb = lightcurve.process_bin(obs(spark, data), "d").collect()
    assert all(r.residual == 0.0 and not r.is_anomaly for r in outb)


def test_two_points_keep_value(spark):
    data = [("d", "f", "a", 1, 0.0, 1.0, 0.1, 0.0), ("d", "f", "a", 1, 1.0, 3.0, 0.1, 0.0)]
    out = sorted(lightcurve.process_point(obs(spark, data), "d").collect(), key=lambda r: r.time_bin)
    assert [r.rolling_flux for r in out] == [r.flux_norm for r in out]


def test_all_bad_quality_keeps_all(spark):
    data = [("d", "f", "a", 1, float(i), float(i), 0.1, 4.0) for i in range(6)]
    assert clean.good_quality(clean.clean_observations(obs(spark, data))).count() == 6


def test_fractional_quality_truncates(spark):
    data = [("d", "f", "a", 1, 0.0, 1.0, 0.1, 0.5), ("d", "f", "a", 1, 1.0, 1.0, 0.1, -0.9),
            ("d", "f", "a", 1, 2.0, 1.0, 0.1, 1.0)]
    kept = clean.good_quality(clean.clean_observations(obs(spark, data)))
    assert sorted(r.time for r in kept.collect()) == [0.0, 1.0]


def test_nan_and_null(spark):
    nan = float("nan")
    data = [("d", "f", "a", 1, nan, 1.0, 0.1, 0.0), ("d", "f", "a", 1, None, 1.0, 0.1, 0.0),
            ("d", "f", "a", 1, 1.0, nan, 0.1, 0.0), ("d", "f", "a", 1, 2.0, None, 0.1, 0.0),
            ("d", "f", "a", 1, 3.0, 1.0, nan, nan), ("d", "f", "a", 1, 4.0, 2.0, None, None)]
    c = clean.clean_observations(obs(spark, data))
    got = sorted(rows(c, "time", "flux_err", "quality"))
    assert got == [(3.0, None, 0.0), (4.0, None, 0.0)]


def test_flux_err_all_missing(spark):
    data = [("d", "f", "a", 1, float(i), float(i % 3), None, 0.0) for i in range(6)]
    prep = lightcurve.prepare_observations(obs(spark, data))
    assert {r.flux_err for r in prep.collect()} == {0.0}
    assert {r.flux_err for r in lightcurve.process_point(obs(spark, data), "d").collect()} == {None}
    assert {r.flux_err for r in lightcurve.process_bin(obs(spark, data), "d").collect()} == {0.0}


def test_null_quarter_single_group(spark):
    data = [("d", "f", "a", None, 0.01, 1.0, 0.1, 0.0), ("d", "f", "a", -1, 0.02, 2.0, 0.1, 0.0),
            ("d", "f", "b", None, 0.01, 1.0, 0.1, 0.0)]
    out = lightcurve.process_point(obs(spark, data), "d").collect()
    assert sorted((r.object_id, r.quarter, r.points_count) for r in out) == [("a", -1, 2), ("b", -1, 1)]


def test_bin_multiples(spark):
    from starlit.operators.binning import with_time_bin
    df = spark.createDataFrame([(1.0,), (0.9999999,), (0.05,)], "time double")
    got = sorted(r.bin_id for r in with_time_bin(df, 0.05).collect())
    assert got == [1, 19, 20]


def test_window_across_quarters(spark):
    data = [("d", "f", "a", 1 if i < 15 else 2, float(i), float((i * 7) % 11), 0.1, 0.0) for i in range(30)]
    two = lightcurve.process_point(obs(spark, data), "d", Params(bin_width=0.5)).orderBy("time_bin").collect()
    one_q = [(d, s, o, 1, t, f, e, q) for (d, s, o, _, t, f, e, q) in data]
    one = lightcurve.process_point(obs(spark, one_q), "d", Params(bin_width=0.5)).orderBy("time_bin").collect()
    assert [r.rolling_flux for r in two] == [r.rolling_flux for r in one]


@pytest.mark.parametrize("k,expected", [(2, [0, 49]), (1, [0]), (60, list(range(50)))])
def test_even_downsample(spark, k, expected):
    df = spark.range(50).select(F.lit("a").alias("object_id"), F.lit(1).alias("quarter"),
                                F.col("id").cast("double").alias("time_bin"))
    got = sorted(int(r.time_bin) for r in sample.even_downsample(df, k).collect())
    assert got == expected


def test_per_object_limit(spark):
    df = spark.range(70858).select((F.col("id") % 3).cast("string").alias("object_id"), F.lit(1).alias("quarter"),
                                   F.col("id").cast("double").alias("time_bin"))
    out = sample.downsample_by_object(df, 50000)
    counts = {r.object_id: r["count"] for r in out.groupBy("object_id").count().collect()}
    assert counts == {"0": 16666, "1": 16666, "2": 16666}


def test_split_pair(spark):
    from starlit.functions.expr import split_pair
    df = spark.createDataFrame([("Pandas + Dash",), ("pandas +",), ("a+b+c",), (None,), (" Spark\t+ plotly ",)],
                               "pair string")
    a, b = split_pair(F.col("pair"))
    got = [tuple(r) for r in df.select(a, b).collect()]
    assert got == [("pandas", "dash"), ("pandas", ""), ("a+b+c", ""), ("", ""), ("spark", "plotly")]


def test_missing_required_column(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 0.0)], "object_id string, time double, flux double, quality double")
    with pytest.raises(ValueError, match="flux_err"):
        lightcurve.process_point(df, "d")


def test_exact_quantile_matches_numpy(spark):
    import numpy as np
    from starlit.operators.quantile import exact_quantile_value
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(0, 1, 3000), np.full(2000, 0.25), rng.exponential(1e6, 500)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    for q in (0.5, 0.1, 0.9):
        want = float(np.quantile(vals, q))
        for buckets, finish in ((8, 1), (8, 300), (65536, 1_000_000)):
            got = exact_quantile_value(df, "x", q, buckets=buckets, finish_limit=finish)
            assert math.isclose(got, want, rel_tol=1e-12, abs_tol=1e-12), (q, buckets, finish)
    # the profile's (count, min, max) can seed the search
    from starlit.operators.clean import profile
    assert profile is not None
    got = exact_quantile_value(df, "x", 0.5, buckets=8, finish_limit=50,
                               known=(len(vals), float(vals.min()), float(vals.max())))
    assert math.isclose(got, float(np.quantile(vals, 0.5)), rel_tol=1e-12)


def test_missing_input_and_empty_guards(spark, tmp_path):
    from starlit.plans import jobs
    with pytest.raises(FileNotFoundError):
        jobs.read_input(spark, str(tmp_path / "nope.parquet"))
    empty = spark.createDataFrame([], "object_id string")
    with pytest.raises(ValueError, match="empty"):
        jobs.require_rows(empty, "processed output")


def test_process_and_extract_jobs(spark, tmp_path):
    from starlit.plans import jobs
    from starlit.sources import adapters
    src = str(tmp_path / "obs.parquet")
    adapters.observations(spark, "/root/testdata/sf0.001").write.parquet(src)
    summ = jobs.process_file(spark, src, str(tmp_path / "processed"), "small", "bin")
    assert summ["rows_input"] == 1000 and summ["rows_output"] > 0
    meta = jobs.build_dashboard_extract(spark, summ["output_file"], str(tmp_path / "dash"), "small", "spark")
    assert meta["rows_saved_for_dashboard"] == summ["rows_output"]


def test_analyze_job(spark, tmp_path):
    import os
    from starlit.plans import jobs
    paths = jobs.analyze_run_log(spark, os.path.join(os.path.dirname(__file__), "golden", "all_pair_metrics_clean.csv"),
                                 str(tmp_path / "analysis"))
    ranking = spark.read.option("header", True).csv(paths["pair_ranking"])
    assert ranking.count() == 9


def test_combine_skips_missing_logs(spark, tmp_path):
    from starlit.operators import runlog
    good = tmp_path / "a.csv"
    good.write_text("\ufeffdataset,pair,status\nsmall,pandas + dash,success\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("", encoding="utf-8")
    logs = [runlog.read_run_log_if_exists(spark, str(p)) for p in (good, tmp_path / "empty.csv", tmp_path / "none.csv")]
    assert logs[1] is None and logs[2] is None
    out = runlog.combine_run_logs(logs)
    assert out.columns == ["dataset", "pair", "status"] and out.count() == 1


def test_dashboard_summary_table(spark):
    from starlit.operators import extract
    summary = spark.createDataFrame([("7", 12345, 5000, "1, 2", 3, 0.1234565, None, "spark")],
                                    "object_id string, rows_in_range long, rows_plotted long, quarters string, "
                                    "anomaly_rows_plotted long, mean_flux_norm double, std_flux_norm double, "
                                    "processing_method string")
    rows = {r.metric: r.value for r in extract.dashboard_summary_table(summary, "small_spark").collect()}
    assert rows["Rows in selected range"] == "12,345" and rows["Rows plotted"] == "5,000"
    assert rows["Mean normalized flux"] == "0.123457" and rows["Std normalized flux"] == "nan"
    assert len(rows) == 10


def test_with_split_pair_matches_column_form(spark):
    from starlit.functions.expr import with_split_pair
    df = spark.createDataFrame([("Pandas + Dash",), ("pandas +",), ("a+b+c",), (None,), (" Spark\t+ plotly\n",)],
                               "pair string")
    got = [(r.p, r.v) for r in with_split_pair(df, "pair", "p", "v").collect()]
    assert got == [("pandas", "dash"), ("pandas", ""), ("a+b+c", ""), ("", ""), ("spark", "plotly")]
