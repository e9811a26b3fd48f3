"""Light-curve file ingest on hand-built files (good, corrupt, lower-case names, SAP only)."""

import os

import numpy as np

from starlit.plans.convert import conversion_summary, convert
from starlit.plans.light_curve_writer import encode_light_curve
from starlit.sources import fits


def write(path, content):
    with open(path, "wb") as f:
        f.write(content)


def make_dir(tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    t = np.arange(5, dtype="float64")
    f = np.array([1.0, 2.0, np.nan, 4.0, 5.0])
    good = encode_light_curve({"TIME": t, "PDCSAP_FLUX": f, "PDCSAP_FLUX_ERR": f / 10,
                                    "SAP_QUALITY": np.array([0, 0, 1, 0, 0])},
                                   {"TIME": "D", "PDCSAP_FLUX": "D", "PDCSAP_FLUX_ERR": "D", "SAP_QUALITY": "J"},
                                   {"KEPLERID": 123, "QUARTER": 4})
    lower = encode_light_curve({"time": t, "pdcsap_flux": f}, {"time": "D", "pdcsap_flux": "E"},
                                    {"QUARTER": 0})
    sap = encode_light_curve({"TIME": t, "SAP_FLUX": f * 2, "QUALITY": np.zeros(5, "int16")},
                                  {"TIME": "D", "SAP_FLUX": "D", "QUALITY": "I"}, {"KEPLERID": 7, "QUARTER": 2})
    write(d / "kplr000000123-q4_llc.fits", good)
    write(d / "kplr000000456-q0_llc.fits", lower)
    write(d / "kplr000000007-q2_llc.FITS", sap)
    write(d / "kplr000000999-broken.fits", good[:4000])
    write(d / "notes.txt", b"not a light curve")
    return str(d)


def test_parse_and_errors(spark, tmp_path):
    d = make_dir(tmp_path)
    parsed = fits.read_light_curves(spark, {"small": d})
    good = fits.good_rows(parsed)
    assert sorted(r.source_file for r in good.select("source_file").distinct().collect()) == [
        "kplr000000007-q2_llc.FITS", "kplr000000123-q4_llc.fits", "kplr000000456-q0_llc.fits"]
    errs = fits.error_rows(parsed).collect()
    assert [e.file for e in errs] == ["kplr000000999-broken.fits"]
    by_file = {r.source_file: r for r in good.groupBy("source_file").agg(
        {"object_id": "max", "quarter": "max", "flux_err": "count", "quality": "sum"}).collect()}
    lower = by_file["kplr000000456-q0_llc.fits"]
    assert lower["max(object_id)"] == "000000456" and lower["max(quarter)"] == -1
    assert lower["count(flux_err)"] == 0 and lower["sum(quality)"] == 0.0
    g = by_file["kplr000000123-q4_llc.fits"]
    assert g["max(object_id)"] == "123" and g["max(quarter)"] == 4 and g["sum(quality)"] == 1.0
    # quarter 0 kept on request
    kz = fits.good_rows(fits.read_light_curves(spark, {"small": d}, keep_zero_quarter=True))
    assert {r.quarter for r in kz.filter("source_file like '%456%'").collect()} == {0}


def test_summary_status(spark, tmp_path):
    d = make_dir(tmp_path)
    empty = tmp_path / "empty"
    empty.mkdir()
    dirs = {"small": d, "medium": str(empty)}
    parsed = fits.read_light_curves(spark, dirs)
    files = fits.list_files(spark, dirs, with_content=False)
    summ = {r.dataset: r for r in conversion_summary(spark, parsed, files, list(dirs)).collect()}
    assert summ["small"].status == "success_with_errors" and summ["small"].fits_files == 4
    assert summ["small"].rows == 12 and summ["small"].objects == 3
    assert summ["medium"].status == "no_files" and summ["medium"].rows == 0


def test_convert_writes_outputs(spark, tmp_path):
    d = make_dir(tmp_path)
    out = str(tmp_path / "out")
    summ = convert(spark, {"small": d}, out).collect()
    assert summ[0].status == "success_with_errors"
    assert summ[0].size_mb > 0 and summ[0].output_file.endswith("dataset=small")
    assert spark.read.option("header", True).csv(os.path.join(out, "conversion_errors")).count() == 1
    assert spark.read.parquet(os.path.join(out, "observations")).count() == 12
    assert spark.read.option("header", True).csv(os.path.join(out, "preview")).count() == 12


def test_all_failed_writes_nothing(spark, tmp_path):
    d = tmp_path / "bad"
    d.mkdir()
    write(d / "kplr000000001-x.fits", b"garbage")
    out = str(tmp_path / "out")
    summ = convert(spark, {"small": str(d)}, out).collect()
    assert summ[0].status == "failed" and summ[0].rows == 0
    assert not os.path.exists(os.path.join(out, "conversion_errors"))
