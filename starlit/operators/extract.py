"""Dashboard/chart extracts and the small queries a dashboard asks of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlit.functions.expr import as_double, as_quarter
from starlit.operators.positions import in_order
from starlit.operators.sample import HOT_ROWS, SERIES_ORDER, downsample_by_object, even_downsample, random_downsample
from starlit.schema import DASH_MAX_POINTS, DASH_MIN_PER_OBJECT, EXTRACT_COLUMNS, require_columns


def extract_project(processed: DataFrame) -> DataFrame:
    """Prune to the 11 extract columns, normalise types, drop rows without time_bin/flux_norm."""
    require_columns(processed.columns, EXTRACT_COLUMNS, "processed series")
    out = processed.select(
        "dataset",
        F.col("object_id").cast("string").alias("object_id"),
        as_quarter("quarter").alias("quarter"),
        as_double("time_bin").alias("time_bin"),
        as_double("flux_norm").alias("flux_norm"),
        as_double("rolling_flux").alias("rolling_flux"),
        as_double("flux_err").alias("flux_err"),
        F.coalesce(F.col("points_count").try_cast("long"), F.lit(0)).alias("points_count"),
        F.coalesce(F.col("anomaly_count").try_cast("long"), F.lit(0)).alias("anomaly_count"),
        F.coalesce(F.col("is_anomaly").cast("boolean"), F.lit(False)).alias("is_anomaly"),
        "processing_method",
    )
    return out.filter(F.col("time_bin").isNotNull() & F.col("flux_norm").isNotNull())


def dashboard_extract(processed: DataFrame, max_points: int = DASH_MAX_POINTS,
                      min_per_object: int = DASH_MIN_PER_OBJECT, strategy: str = "auto", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Extract for the dashboard: projection + per-object reduction."""
    return downsample_by_object(extract_project(processed), max_points, min_per_object, strategy=strategy, hot_rows=hot_rows)


def extract_metadata(before: DataFrame, extract: DataFrame, dataset: str, method: str,
                     source: str = "", output: str = "", objects_output: str = "") -> DataFrame:
    """One-row metadata of an extract, scalars only: counts, time extent, the first five ids and the sorted quarters as
    text. The ids themselves are a table beside it (``extract_objects``), of which the row names the path."""
    rows_before = before.select(F.count(F.lit(1))).scalar()
    preview = object_preview(extract).scalar()
    return extract.agg(
        F.count(F.lit(1)).alias("rows_saved_for_dashboard"),
        F.sum(F.col("is_anomaly").cast("long")).alias("anomaly_rows"),
        F.min("time_bin").alias("min_time"),
        F.max("time_bin").alias("max_time"),
        F.count_distinct("object_id").alias("n_objects"),
        F.array_join(F.transform(F.array_sort(F.collect_set("quarter")), lambda q: q.cast("string")), ",").alias("quarters"),
    ).select(
        F.lit(dataset).alias("dataset"), F.lit(method).alias("processing_method"),
        F.lit("dash").alias("visualization_method"),
        F.lit("interactive_web_dashboard").alias("visualization_type"),
        F.lit(source).alias("source_processed_file"), F.lit(output).alias("output_file"),
        F.lit(objects_output).alias("objects_file"),
        rows_before.alias("rows_before_downsample"), "rows_saved_for_dashboard",
        F.coalesce("anomaly_rows", F.lit(0)).cast("long").alias("anomaly_rows"),
        "min_time", "max_time", "n_objects", preview.alias("object_preview"), "quarters",
    )


def extract_objects(extract: DataFrame) -> DataFrame:
    """The ids of an extract, one row each, sorted over its partitions."""
    return extract.select(F.col("object_id").cast("string").alias("object_id")).distinct().orderBy("object_id")


def object_counts(df: DataFrame, key: str = "object_id") -> DataFrame:
    return df.groupBy(F.col(key).cast("string").alias(key)).agg(F.count(F.lit(1)).alias("rows"))


def top_object(df: DataFrame, key: str = "object_id") -> DataFrame:
    """Most observed object (ties -> smallest id); one row (object_id, rows)."""
    return object_counts(df, key).orderBy(F.desc("rows"), F.asc(key)).limit(1)


def object_list(df: DataFrame, key: str = "object_id") -> DataFrame:
    """Distinct object ids sorted as text (a distributed range sort); the smallest is the default."""
    ids = df.select(F.col(key).cast("string").alias(key)).distinct()
    first = ids.select(F.min(key)).scalar()
    return ids.withColumn("is_default", F.col(key) == first).orderBy(key)


def object_preview(df: DataFrame, key: str = "object_id", n: int = 5) -> DataFrame:
    """Comma-joined first n sorted object ids (a sorted set capped at n per partial step)."""
    firsts = df.select(F.col(key).cast("string").alias(key)).distinct().orderBy(key).limit(n)
    return firsts.agg(F.array_join(F.array_sort(F.collect_list(key)), ", ").alias("object_preview"))


def time_extent(df: DataFrame, key: str = "object_id") -> DataFrame:
    """Per object: min/max time_bin and slider step max((max - min) / 1000, 0.001)."""
    return df.groupBy(key).agg(F.min("time_bin").alias("min_time"), F.max("time_bin").alias("max_time")) \
        .withColumn("step", F.greatest((F.col("max_time") - F.col("min_time")) / 1000.0, F.lit(0.001)))


def series_extent(df: DataFrame) -> DataFrame:
    """One row for a whole series: min/max time_bin and slider step; (0, 1, 0.01) for an empty one."""
    lo, hi = F.min("time_bin"), F.max("time_bin")
    return df.agg(F.coalesce(lo, F.lit(0.0)).alias("min_time"), F.coalesce(hi, F.lit(1.0)).alias("max_time"),
                  F.when(hi.isNotNull(), F.greatest((hi - lo) / 1000.0, F.lit(0.001))).otherwise(0.01).alias("step"))


def quarters_text(quarters_col) -> F.Column:
    """Aggregate: distinct non-negative quarters, sorted, joined with ', ' ('unknown' if none)."""
    qs = F.array_sort(F.collect_set(F.when(quarters_col >= 0, quarters_col)))
    joined = F.array_join(F.transform(qs, lambda q: q.cast("string")), ", ")
    return F.when(F.size(qs) > 0, joined).otherwise(F.lit("unknown"))


def mode_value(col) -> F.Column:
    """Aggregate: most frequent non-null value, ties -> smallest; 'unknown' when none."""
    return F.coalesce(F.mode(col, deterministic=True), F.lit("unknown"))


def series_for(df: DataFrame, object_id, key: str = "object_id") -> DataFrame:
    """One object's series (object id compared as text)."""
    oid = object_id if isinstance(object_id, F.Column) else F.lit(str(object_id))
    text = F.col(key) if dict(df.dtypes)[key] == "string" else F.col(key).cast("string")  # a bare column is pushed to the scan
    return df.filter(text == oid)


def time_range(df: DataFrame, start, end) -> DataFrame:
    """Closed range start <= time_bin <= end."""
    return df.filter(F.col("time_bin").between(start, end))


def chart_points(processed: DataFrame, max_points: int, strategy: str = "auto", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows a chart of the most observed object plots, at most max_points, evenly spaced in its series. Its id and
    size come from one count per object; the id reaches the scan as a literal."""
    top = top_object(processed).first()
    if top is None:
        return processed.limit(0)
    subset = processed.filter(F.col("object_id").cast("string").eqNullSafe(F.lit(top["object_id"])))
    if top["rows"] <= max_points:
        return subset
    return even_downsample(subset, max_points, order=SERIES_ORDER, strategy=strategy, hot_rows=hot_rows, most=top["rows"])


def chart_series(processed: DataFrame, max_points: int, strategy: str = "auto", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Long table for a chart of the most observed object: series flux / trend / anomaly."""
    sampled = chart_points(processed, max_points, strategy, hot_rows)
    point = lambda series, y: F.struct(F.lit(series).alias("series"), F.col("time_bin").alias("x"), F.col(y).alias("y"))
    points = F.array(point("flux", "flux_norm"), point("trend", "rolling_flux"), F.when(F.col("is_anomaly"), point("anomaly", "flux_norm")))
    return sampled.select("object_id", F.explode(F.filter(points, lambda p: p.isNotNull())).alias("p")).select("object_id", "p.*")


def chart_metadata(points: DataFrame, dataset: str, processing_method: str, visualization_method: str,
                   visualization_type: str, output_file: str = "", metadata_file: str | None = None,
                   rows_before_downsample: int | None = None) -> DataFrame:
    """One row about a visualisation of plotted ``points``: what a run log says of it (see ``assemble_run_log``).
    ``object_id``: the first five ids, comma-joined."""
    firsts = points.select(F.col("object_id").cast("string").alias("object_id")).distinct().orderBy("object_id").limit(5)
    ids = firsts.agg(F.array_join(F.array_sort(F.collect_list("object_id")), ", ")).scalar()
    return points.agg(F.count(F.lit(1)).alias("points_plotted"), F.count_if("is_anomaly").alias("anomaly_points_plotted")).select(
        F.lit(dataset).alias("dataset"), F.lit(processing_method).alias("processing_method"),
        F.lit(visualization_method).alias("visualization_method"), F.lit(visualization_type).alias("visualization_type"),
        ids.alias("object_id"), "points_plotted", "anomaly_points_plotted",
        F.lit(rows_before_downsample).cast("long").alias("rows_before_downsample"),
        F.lit(output_file).alias("visualization_file"), F.lit(metadata_file).cast("string").alias("visualization_metadata_file"))


def dashboard_summary(df: DataFrame, start=None, end=None, max_points: int | None = 5000,
                      method_col: str = "processing_method", dataset: DataFrame | None = None) -> DataFrame:
    """Per object: rows in the time range, rows plotted after the random limit (all of them when ``max_points`` is
    None), quarters, anomalies plotted, mean and std of flux_norm plotted, and the processing method of the whole
    ``dataset`` (of ``df`` if not given), whatever the range or objects."""
    whole = df if dataset is None else dataset
    method = whole.select(mode_value(F.col(method_col))).scalar()
    ranged = df if start is None else time_range(df, start, end)
    in_range = ranged.groupBy("object_id").agg(F.count(F.lit(1)).alias("rows_in_range"))
    plotted = ranged if max_points is None else random_downsample(ranged, max_points)
    stats = plotted.groupBy("object_id").agg(
        F.count(F.lit(1)).alias("rows_plotted"),
        quarters_text(F.col("quarter")).alias("quarters"),
        F.sum(F.col("is_anomaly").cast("long")).alias("anomaly_rows_plotted"),
        F.avg("flux_norm").alias("mean_flux_norm"),
        F.stddev_samp("flux_norm").alias("std_flux_norm"),
    )
    return in_range.join(stats, "object_id").withColumn("processing_method", method)


def default_object(df: DataFrame, key: str = "object_id") -> F.Column:
    """The first object id as text, as a lazy scalar."""
    return df.select(F.min(F.col(key).cast("string"))).scalar()


def dashboard_query(df: DataFrame, object_id=None, start=None, end=None, max_points: int = 5000):
    """One dashboard refresh: (plotted rows, anomaly rows, summary) for one object (the first one by default) and
    range, rows in time order. Nothing runs until a result is read; over an extract that ``write_extract`` wrote
    only the object's row groups are."""
    subset = series_for(df, default_object(df) if object_id is None else object_id)
    if start is not None:
        subset = time_range(subset, start, end)
    plotted = random_downsample(subset, max_points)
    order = ["time_bin", "quarter"]
    summary = dashboard_summary(subset, max_points=max_points, dataset=df)
    return plotted.orderBy(*order), plotted.filter(F.col("is_anomaly")).orderBy(*order), summary


# Row groups of an extract hold about this many bytes: small enough that one object's reads skip the others'.
EXTRACT_GROUP_BYTES = 4 << 20
EXTRACT_PAGE_ROWS = 2_000


def write_extract(extract: DataFrame, path: str, group_bytes: int = EXTRACT_GROUP_BYTES, page_rows: int = EXTRACT_PAGE_ROWS,
                  partitions: int | None = None, mode: str = "overwrite") -> None:
    """Write an extract clustered by object and time: range partitioned and sorted, so that row groups and pages hold
    runs of objects and times and their min/max statistics tell them apart, with a Bloom filter on the id."""
    ordered = in_order(extract, ["object_id", "time_bin", "quarter"], partitions)
    (ordered.write.mode(mode).option("parquet.block.size", str(group_bytes)).option("parquet.page.row.count.limit", str(page_rows))
     .option("parquet.block.size.row.check.min", "100").option("parquet.bloom.filter.enabled#object_id", "true").parquet(path))


def read_series(spark, path: str, object_id: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """One object's rows of a written extract, and of a time range if given: both reach the scan as pushed filters."""
    rows = series_for(spark.read.parquet(path), object_id)
    return rows if start is None else time_range(rows, start, end)


def dashboard_summary_table(summary: DataFrame, dataset_key: str, visualization: str = "dash") -> DataFrame:
    """The dashboard's (metric, value) text table for each object of a ``dashboard_summary`` result:
    counts with thousands separators, mean and std with six decimals."""
    from starlit.functions.expr import fixed, thousands

    texts = summary.select(
        "object_id",
        F.lit(dataset_key).alias("Dataset"), F.col("object_id").alias("Object ID"),
        thousands("rows_in_range").alias("Rows in selected range"),
        thousands("rows_plotted").alias("Rows plotted"),
        F.col("quarters").alias("Quarters"),
        thousands("anomaly_rows_plotted").alias("Anomaly rows plotted"),
        fixed("mean_flux_norm", 6, "nan").alias("Mean normalized flux"),
        fixed("std_flux_norm", 6, "nan").alias("Std normalized flux"),
        F.col("processing_method").alias("Processing method"),
        F.lit(visualization).alias("Visualization method"))
    metrics = [c for c in texts.columns if c != "object_id"]
    return texts.unpivot("object_id", metrics, "metric", "value")
