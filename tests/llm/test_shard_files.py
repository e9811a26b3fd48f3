"""Shard files: the caller's columns stay, whatever their names, and every file follows the curve."""

import os

from llm_cases import docs_frame
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_clashing_columns_stay(spark, odd_rows, tmp_path):
    from starlit.llm.hilbert import write_shards
    docs = docs_frame(spark, odd_rows).withColumns({"_id": F.lit("own id"), "_crc": F.lit(5), "_c": F.lit(6), "_position": F.lit(7), "SHARD_": F.lit(8)})
    write_shards(docs, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert set(back.columns) == {*docs.columns, "shard__"}
    key = lambda df: sorted(map(str, df.select(*docs.columns).collect()))
    assert key(back) == key(docs)


def test_files_follow_the_curve(spark, tmp_path):
    from starlit.llm.hilbert import assign_shards, write_shards
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    place = {r["doc_id"]: (r["shard"], r["position"]) for r in assign_shards(docs).collect()}
    out = str(tmp_path / "s")
    write_shards(docs, out)
    seen = 0
    for folder in sorted(f for f in os.listdir(out) if f.startswith("shard=")):
        for name in (f for f in os.listdir(f"{out}/{folder}") if f.endswith(".parquet")):
            ids = [r["doc_id"] for r in spark.read.parquet(f"{out}/{folder}/{name}").select("doc_id").toLocalIterator()]
            assert {place[i][0] for i in ids} == {int(folder.split("=")[1])}
            assert [place[i][1] for i in ids] == sorted(place[i][1] for i in ids)
            seen += len(ids)
    assert seen == len(place)
