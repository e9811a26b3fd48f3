"""Incremental ingest: each file is ingested once across runs."""

import numpy as np

from starlit.plans.light_curve_writer import encode_light_curve
from starlit.streaming import stream_light_curves


def lc(oid, n):
    t = np.arange(n, dtype="float64")
    return encode_light_curve({"TIME": t, "PDCSAP_FLUX": t + 1.0}, {"TIME": "D", "PDCSAP_FLUX": "D"},
                                   {"KEPLERID": oid, "QUARTER": 1})


def test_incremental_ingest(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "kplr000000001-q1_llc.fits").write_bytes(lc(1, 10))
    (raw / "kplr000000002-q1_llc.fits").write_bytes(lc(2, 5))
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    q = stream_light_curves(spark, {"small": str(raw)}, out, ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(f"{out}/observations").count() == 15
    (raw / "kplr000000003-q1_llc.fits").write_bytes(lc(3, 7))
    (raw / "kplr000000004-q1_llc.fits").write_bytes(b"SIMPLE  =                    T" + b" " * 10)
    q = stream_light_curves(spark, {"small": str(raw)}, out, ckpt)
    q.awaitTermination(120)
    obs = spark.read.parquet(f"{out}/observations")
    assert obs.count() == 22
    assert sorted(r.object_id for r in obs.select("object_id").distinct().collect()) == ["1", "2", "3"]
    assert spark.read.parquet(f"{out}/errors").count() == 1
