"""Light-curve files in batches: written from key runs, decoded many files to an Arrow batch, decoded once a summary."""

import datetime

import numpy as np
import pyarrow as pa

from starlit.operators import extract
from starlit.plans import queries as q
from starlit.plans.light_curve_writer import encode_light_curve
from starlit.schema import EXTRACT_COLUMNS
from starlit.sources import adapters, fits


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def events(spark, folder, users: int, days=(0, 11, 25), times: int = 1) -> str:
    begin = datetime.datetime(2024, 1, 1, 1)
    rows = [(7 + n, begin + datetime.timedelta(days=d, hours=h), u, ("view", "click", "error")[n % 3], 40.0 + n % 7, "{}")
            for n, (u, d, h) in enumerate((u, d, h) for u in range(users) for d in days for h in range(times))]
    spark.createDataFrame(rows, adapters.TABLE_SCHEMAS["events"]).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def observed(keys, first: int = 0) -> pa.RecordBatch:
    n = len(keys)
    values = [float(first + i) for i in range(n)]
    return pa.RecordBatch.from_pydict({
        "dataset": ["d"] * n, "object_id": [k for k, _ in keys], "quarter": pa.array([k for _, k in keys], pa.int32()),
        "time": values, "flux": pa.array([None if i == 1 else v for i, v in enumerate(values)], pa.float64()), "flux_err": values,
        "quality": pa.array([None] * n, pa.float64())})


def test_key_runs_span_batches():
    batches = [observed([("1", 1), ("1", 1), ("1", 2)]), observed([("1", 2)], 3), observed([], 4), observed([("1", 2), ("2", 2)], 4)]
    runs = list(q._key_runs(iter(batches)))
    assert [(r[:3], r[3][0].tolist()) for r in runs] == [
        (("d", "1", 1), [0.0, 1.0]), (("d", "1", 2), [2.0, 3.0, 4.0]), (("d", "2", 2), [5.0])]
    assert np.isnan(runs[0][3][1][1]) and runs[0][3][3].tolist() == [-999, -999]


def test_many_files_decode_to_one_batch():
    def one(rows):
        t = np.arange(rows, dtype="float64")
        return encode_light_curve({"TIME": t, "SAP_FLUX": np.where(t == 1, np.nan, t)}, {"TIME": "D", "SAP_FLUX": "D"}, {"KEPLERID": 5})

    contents = [one(3), one(0), one(3)[:3000], *[one(2)] * 197]
    files = pa.RecordBatch.from_pydict({"path": [f"x/f{i}.fits" for i in range(200)], "content": contents, "dataset": ["d"] * 200})
    out = list(fits._decode_batches(iter([files])))
    assert len(out) == 1  # was one per file
    rows = out[0].to_pylist()
    assert [r["flux"] for r in rows[:3]] == [0.0, None, 2.0] and [r["quality"] for r in rows[:3]] == [0.0] * 3
    assert rows[3]["source_file"] == "f2.fits" and rows[3]["error"] and rows[3]["time"] is None and rows[3]["object_1"] is None
    assert len(rows) == 3 + 1 + 197 * 2 and {r["object_1"] for r in rows[4:]} == {"5"}


def test_no_python_call_per_group(spark, tmp_path):
    d = events(spark, tmp_path / "t", users=8)
    for name in ("ingest_light_curves", "ingest_errors", "header_fallback"):
        text = plan(q.QUERIES[name](spark, d))
        assert "InPandas" not in text and text.count("MapInArrow") == 2
    assert q.QUERIES["ingest_light_curves"](spark, d).count() == 8 * 3 - 1
    assert [r.file for r in q.QUERIES["ingest_errors"](spark, d).collect()] == ["kplr000000005-q3_llc.fits"]


def test_summary_decodes_once(spark, tmp_path):
    d = events(spark, tmp_path / "t", users=8, times=2)
    out = q.QUERIES["conversion_summary"](spark, d)
    assert plan(out).count("MapIn") == 1  # the file inventory; every other step reads the decoded rows
    found = {r.dataset: (r.fits_files, r.objects, r.status) for r in out.collect()}
    assert found == {"small": (9, 3, "success"), "medium": (9, 3, "success"), "large": (6, 2, "success_with_errors"), "empty": (0, 0, "no_files")}


def test_dashboard_summary_of_all_rows(spark, tmp_path):
    d = events(spark, tmp_path / "t", users=1, days=range(30), times=3)
    got = q.QUERIES["dashboard_summary"](spark, d).first()
    assert got.rows_plotted == got.rows_in_range > 25
    rows = [("obs", "7", 1, t / 10, float(t), 0.0, 0.1, 1, 0, t % 10 == 0, "spark") for t in range(6000)]
    df = spark.createDataFrame(rows, "dataset string, object_id string, quarter int, time_bin double, flux_norm double, rolling_flux double, "
                               "flux_err double, points_count long, anomaly_count long, is_anomaly boolean, processing_method string")
    assert set(df.columns) == set(EXTRACT_COLUMNS)
    whole = extract.dashboard_summary(df, max_points=None).first()
    assert (whole.rows_plotted, whole.anomaly_rows_plotted, whole.mean_flux_norm) == (6000, 600, 2999.5)
