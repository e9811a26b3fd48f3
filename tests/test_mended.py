"""Faults found by review that must not come back."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from starlit.operators import quantile, runlog, sample
from starlit.operators.extract import series_extent
from starlit.operators.trend import framed_medians
from starlit.plans import lightcurve
from starlit.plans.convert import convert
from starlit.plans.light_curve_writer import encode_light_curve
from starlit.schema import Params
from starlit.session import build_session
from starlit.sources import adapters, fits, tables

from core_data import SF_SMOKE
from test_strategies import rows


@pytest.mark.parametrize("values", [
    [1.0, 2.0, float("inf"), 3.0], [float("-inf"), float("inf"), 1.0], [float("inf")] * 5, [7.0] * 50,
    [float("-inf")] * 3 + [1.0, 2.0], [1e308, -1e308, 5.0], [0.1 * k for k in range(1001)]])
def test_median_ends(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = quantile.exact_quantile_value(df, "v", 0.5, buckets=4, finish_limit=3)
    ordered = sorted(values)
    a, b = ordered[(len(values) - 1) // 2], ordered[len(values) // 2]
    want = a if a == b else 0.5 * a + 0.5 * b
    assert got == want or (math.isnan(got) and math.isnan(want))


def test_median_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert quantile.exact_quantile_value(df, "v") is None


def test_framed_medians_keep_infinity_apart_from_missing():
    v = np.array([1.0, np.inf, np.inf, np.nan, 2.0])
    keys = np.array([True, False, False, False, False])
    got = framed_medians(keys, v, 2, 2, 3)
    assert got[1] == np.inf and got[2] == np.inf and got[4] == 2.0


def test_routes_agree_whatever_the_declared_distribution(spark):
    obs = adapters.observations(spark, SF_SMOKE)
    plain = rows(lightcurve.process(obs, "obs", "bin", Params(bin_width=0.5), strategy="window"))
    settings = {"spark.sql.requireAllClusterKeysForDistribution": "true", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert rows(lightcurve.process(obs, "obs", "bin", Params(bin_width=0.5, vectorize_rows=0))) == plain
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def file_bytes(columns, forms, primary):
    return encode_light_curve(columns, forms, primary)


def raw_folder(tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    t = np.arange(4, dtype="float64")
    (d / "kplr000000123-q4_llc.fits").write_bytes(file_bytes({"TIME": t, "SAP_FLUX": t + 1}, {"TIME": "D", "SAP_FLUX": "D"}, {"KEPLERID": 123, "QUARTER": 4}))
    return d


def test_uri_folders(spark, tmp_path):
    d = raw_folder(tmp_path)
    dirs = {"small": f"file://{d}", "medium": f"file://{tmp_path}/none"}
    assert fits.good_rows(fits.read_light_curves(spark, dirs)).count() == 4
    files = fits.list_files(spark, dirs, with_content=False)
    inventory = {r.dataset: r.fits_files for r in fits.file_inventory(spark, files, list(dirs)).collect()}
    assert inventory == {"small": 1, "medium": 0}


def test_discovery_reports_what_it_skips(spark, tmp_path):
    spark.createDataFrame([("1", 0.5)], "object_id string, time_bin double").write.parquet(f"{tmp_path}/a_dash_data.parquet")
    (tmp_path / "b_dash_data.parquet").write_bytes(b"not a table")
    skipped: list = []
    found = tables.discover_extracts(spark, f"file://{tmp_path}", skipped=skipped)
    assert [tuple(r) for r in found.select("dataset_key", "object_id").collect()] == [("a", "1")]
    assert [os.path.basename(p) for p, _ in skipped] == ["b_dash_data.parquet"]
    assert tables.discover_extracts(spark, f"file://{tmp_path}/none") is None


def test_convert_decodes_once_and_previews_each_dataset(spark, tmp_path):
    d = raw_folder(tmp_path)
    e = tmp_path / "raw2"
    e.mkdir()
    t = np.arange(9, dtype="float64")
    (e / "kplr000000999-q1_llc.fits").write_bytes(file_bytes({"TIME": t, "SAP_FLUX": t + 1}, {"TIME": "D", "SAP_FLUX": "D"}, {"KEPLERID": 999, "QUARTER": 1}))
    (e / "kplr000000998-q1_llc.fits").write_bytes(b"junk")
    out = str(tmp_path / "out")
    convert(spark, {"small": str(d), "medium": str(e)}, out, preview_rows=3).collect()
    preview = spark.read.option("header", True).csv(f"{out}/preview")
    assert {r["dataset"]: r["n"] for r in preview.groupBy("dataset").agg(F.count("*").alias("n")).collect()} == {"small": 3, "medium": 3}
    assert [f for f in os.listdir(f"{out}/conversion_errors") if f.startswith("dataset=")] == ["dataset=medium"]


def card(text):
    return text.ljust(80).encode()


def test_hand_written_file_bytes(spark, tmp_path):
    """Bytes written here, not by the engine: a primary array, types X E I K, TSCAL and TZERO."""
    pad = lambda b, fill=b" ": b + fill * (-len(b) % 2880)
    primary = pad(b"".join([card("SIMPLE  =                    T"), card("BITPIX  =                   16"), card("NAXIS   =                    1"),
                            card("NAXIS1  =                    3"), card("KEPLERID=                   42"), card("END")]))
    primary += pad(np.array([1, 2, 3], dtype=">i2").tobytes(), b"\0")
    head = ["XTENSION= 'BINTABLE'", "BITPIX  =                    8", "NAXIS   =                    2", "NAXIS1  =                   16",
            "NAXIS2  =                    2", "PCOUNT  =                    0", "GCOUNT  =                    1", "TFIELDS =                    4",
            "TTYPE1  = 'FLAGS'", "TFORM1  = '9X'", "TTYPE2  = 'time'", "TFORM2  = 'E'", "TTYPE3  = 'SAP_FLUX'", "TFORM3  = 'I'",
            "TSCAL3  =                  0.5", "TZERO3  =                 10.0", "TTYPE4  = 'QUALITY'", "TFORM4  = 'K'", "QUARTER =                    7", "END"]
    rows_ = b"".join(b"\xff\x80" + np.array([t], ">f4").tobytes() + np.array([f], ">i2").tobytes() + np.array([q], ">i8").tobytes()
                     for t, f, q in ((1.5, 4, 0), (2.5, -6, 3)))
    d = tmp_path / "raw"
    d.mkdir()
    (d / "x.fits").write_bytes(primary + pad(b"".join(map(card, head))) + pad(rows_, b"\0"))
    got = fits.read_light_curves(spark, {"small": str(d)}).select("object_id", "quarter", "time", "flux", "quality", "error").collect()
    assert [tuple(r) for r in got] == [("42", 7, 1.5, 12.0, 0.0, None), ("42", 7, 2.5, 7.0, 3.0, None)]


def test_text_and_typed_inputs(spark):
    table = spark.createDataFrame([("1", "n/a", "2.5"), ("2", "1.5", "NaN")], "object_id string, time string, sap_flux string")
    assert [tuple(r) for r in tables.to_observations(table).select("time", "flux").collect()] == [(None, 2.5), (1.5, None)]
    typed = spark.createDataFrame([("small", 1.0)], "dataset string, total_time_sec double")
    text = spark.createDataFrame([("large", "n/a")], "dataset string, total_time_sec string")
    assert {tuple(r) for r in runlog.combine_run_logs([typed, None, text]).collect()} == {("small", 1.0), ("large", None)}
    assert runlog.combine_run_logs([None]) is None


def test_run_log_skips_are_reported(spark, tmp_path):
    skipped: list = []
    assert runlog.read_run_log_if_exists(spark, str(tmp_path / "none.csv"), skipped) is None
    assert skipped[0][1] == "no such file"


def test_empty_series_extent(spark):
    empty = spark.createDataFrame([], "time_bin double")
    assert tuple(series_extent(empty).first()) == (0.0, 1.0, 0.01)


def test_random_downsample_exact_size(spark):
    df = spark.range(5000).select((F.col("id") % 2).cast("string").alias("object_id"), F.lit(1).alias("quarter"), (F.col("id") / 7).alias("time_bin"))
    got = sample.random_downsample(df, 300)
    assert {r["object_id"]: r["n"] for r in got.groupBy("object_id").agg(F.count("*").alias("n")).collect()} == {"0": 300, "1": 300}


def test_session_leaves_settings_to_the_submitter(spark):
    assert build_session().conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
