"""A dashboard refresh over a written extract reads the object's rows, not the table."""

import pytest
from pyspark.sql import functions as F

from starlit.operators import extract

OBJECTS, ROWS = 40, 3_000


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("extract") / "e")
    n = F.col("id")
    df = spark.range(OBJECTS * ROWS).select(
        F.lit("obs").alias("dataset"), (n % OBJECTS + 100).cast("string").alias("object_id"), (n % 4).cast("int").alias("quarter"),
        F.floor(n / OBJECTS).cast("double").alias("time_bin"), F.sin(n.cast("double")).alias("flux_norm"), F.cos(n.cast("double")).alias("rolling_flux"),
        F.lit(0.1).alias("flux_err"), F.lit(1).cast("long").alias("points_count"), F.lit(0).cast("long").alias("anomaly_count"),
        (n % 97 == 0).alias("is_anomaly"), F.when(n % 10 < 7, F.lit("spark")).otherwise(F.lit("dask")).alias("processing_method"))
    extract.write_extract(df, out, group_bytes=32_768, page_rows=500, partitions=3)
    return out


def rows_read(df):
    """(rows of the result, rows that the scans gave), of a plan run with its own metrics."""
    qe = df._jdf.queryExecution()
    result = qe.executedPlan().executeCollectPublic()
    plan = qe.executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves, total = plan.collectLeaves(), 0
    todo = [leaves.apply(k) for k in range(leaves.size())]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            inner = node.plan().collectLeaves()
            todo += [inner.apply(k) for k in range(inner.size())]
        elif node.metrics().contains("numOutputRows"):
            total += node.metrics().apply("numOutputRows").value()
    return len(result), total


def test_one_object_reads_its_row_groups(spark, path):
    got, read = rows_read(extract.read_series(spark, path, "117"))
    assert got == ROWS and read <= 2 * ROWS + 2_000  # its groups, and those it shares with its neighbours
    got, read = rows_read(extract.read_series(spark, path, "117", 1000.0, 1099.0))
    assert got == 100 and read <= 2_000
    assert rows_read(extract.read_series(spark, path, "999"))[1] == 0  # outside the statistics
    assert rows_read(extract.read_series(spark, path, "117x"))[1] <= 3_000


def test_refresh_is_lazy_ordered_and_complete(spark, path):
    sc = spark.sparkContext
    sc.setJobGroup("refresh", "refresh")
    try:
        df = spark.read.schema(spark.read.parquet(path).schema).parquet(path)
        before = len(sc.statusTracker().getJobIdsForGroup("refresh"))
        plotted, anomalies, summary = extract.dashboard_query(df, None, 10.0, 2000.0, 50)
        assert len(sc.statusTracker().getJobIdsForGroup("refresh")) == before
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    rows = plotted.collect()
    assert len(rows) == 50 and {r["object_id"] for r in rows} == {"100"}
    assert [r["time_bin"] for r in rows] == sorted(r["time_bin"] for r in rows) and 10 <= rows[0]["time_bin"] and rows[-1]["time_bin"] <= 2000
    assert [tuple(r) for r in anomalies.collect()] == [tuple(r) for r in rows if r["is_anomaly"]]
    one = summary.first()
    assert (one["rows_in_range"], one["rows_plotted"], one["processing_method"]) == (1991, 50, "spark")
    given = extract.dashboard_query(df, "110", None, None, 10)[0].collect()
    assert len(given) == 10 and {r["object_id"] for r in given} == {"110"}
    assert extract.dashboard_query(df, "nobody")[2].count() == 0


def test_method_is_that_of_the_dataset(spark, path):
    df = spark.read.parquet(path)
    only = df.filter("processing_method = 'dask'")
    assert extract.dashboard_summary(only, dataset=df, max_points=5).first()["processing_method"] == "spark"
    assert extract.dashboard_summary(only, max_points=5).first()["processing_method"] == "dask"
