"""Summary tables and report lines of a cleaned run log, of its rows or of one small
table of partial aggregates that a single scan gives (``run_partials``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlit.functions.expr import fixed, with_split_pair

BEST_COLUMNS = ["dataset", "pair", "processing_time_sec", "visualization_time_sec", "total_time_sec",
                "processing_memory_peak_mb"]
BEST_BY_METHOD_COLUMNS = ["dataset", "processing_method", "visualization_method", "pair",
                          "processing_time_sec", "visualization_time_sec", "total_time_sec",
                          "processing_memory_peak_mb"]


# Metrics of a run and what tables of means call them.
METRICS = {"processing_time_sec": "processing_time_sec", "visualization_time_sec": "visualization_time_sec",
           "total_time_sec": "total_time_sec", "processing_memory_peak_mb": "memory_peak_mb"}


def run_partials(clean: DataFrame) -> DataFrame:
    """What all summaries need of a cleaned run log, in one pass: per dataset and pair the count, sum, least and
    greatest value of every metric and the row that comes first by total time. Everything below merges these rows, of
    which there are as many as datasets times pairs, so a log of any length is scanned once. Methods are read off the
    pair's text here, once per pair."""
    per = clean.groupBy("dataset", "pair").agg(
        *[f(m).alias(f"{name}_{m}") for m in METRICS for name, f in (("n", F.count), ("sum", F.sum), ("min", F.min), ("max", F.max))],
        F.min(F.struct(*[x for m in ("total_time_sec", "processing_time_sec", "visualization_time_sec", "processing_memory_peak_mb")
                         for x in (F.col(m).isNull().alias(f"no_{m}"), F.col(m).alias(m))])).alias("best"))
    return with_split_pair(per, "pair", "processing_method", "visualization_method")


def merged(log: DataFrame) -> DataFrame:
    """Partial rows of a cleaned run log, or what is given if it is those already."""
    return log if _is_partial(log) else run_partials(log)


def _is_partial(log: DataFrame) -> bool:
    return "best" in log.columns


def mean(log: DataFrame, metric: str) -> Column:
    """Mean of a metric over runs or merged partial rows (NULL without values)."""
    return F.try_divide(F.sum(f"sum_{metric}"), F.sum(f"n_{metric}")) if _is_partial(log) else F.avg(metric)


def least(log: DataFrame, metric: str) -> Column:
    return F.min(f"min_{metric}" if _is_partial(log) else metric)


def greatest(log: DataFrame, metric: str) -> Column:
    return F.max(f"max_{metric}" if _is_partial(log) else metric)


def best_of(*first: str) -> Column:
    """Least row by total time, then the given columns, then the other metrics (missing ones last), of merged partial rows."""
    parts = [F.col("best.no_total_time_sec").alias("a"), F.col("best.total_time_sec").alias("total_time_sec")]
    for n, c in enumerate(first):
        parts += [F.col(c).isNull().alias(f"no_{n}"), F.col(c).alias(c)]
    return F.min(F.struct(*parts, F.col("best").alias("rest")))


def _best_rows(log: DataFrame, keys: list[str], first: list[str], columns: list[str]) -> DataFrame:
    if not _is_partial(log):
        return first_per_group(log, keys, ["total_time_sec"], columns)
    found = log.groupBy(*keys).agg(best_of(*first).alias("b"))
    at = {c: F.col(c) if c in keys else F.col(f"b.{c}") if c in first or c == "total_time_sec" else F.col(f"b.rest.{c}") for c in columns}
    return found.select(*[at[c].alias(c) for c in columns])


def first_per_group(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Whole best row per group: the row with the smallest (order..., other columns...) key.

    A ``min_by`` aggregate keeps one candidate per group per task (map-side
    combine), so a group holding most of the rows is never sorted in one task.
    NULLs sort last, as in an ascending SQL sort.
    """
    rank_cols = list(order) + [c for c in columns if c not in keys and c not in order]
    rank_key = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in rank_cols])
    others = [c for c in columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*others), rank_key).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in others]).select(*columns)


def best_pair_by_dataset(log: DataFrame) -> DataFrame:
    return _best_rows(log, ["dataset"], ["pair"], BEST_COLUMNS)


def best_pair_by_method(log: DataFrame) -> DataFrame:
    return _best_rows(log, ["dataset", "processing_method"], ["visualization_method", "pair"], BEST_BY_METHOD_COLUMNS)


def processing_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("dataset", "processing_method").agg(
        mean(log, "processing_time_sec").alias("mean_processing_time_sec"),
        least(log, "processing_time_sec").alias("min_processing_time_sec"),
        mean(log, "total_time_sec").alias("mean_total_time_sec"),
        least(log, "total_time_sec").alias("min_total_time_sec"),
        mean(log, "processing_memory_peak_mb").alias("mean_memory_peak_mb"),
    )


def visualization_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("dataset", "visualization_method").agg(
        mean(log, "visualization_time_sec").alias("mean_visualization_time_sec"),
        least(log, "visualization_time_sec").alias("min_visualization_time_sec"),
        mean(log, "total_time_sec").alias("mean_total_time_sec"),
        least(log, "total_time_sec").alias("min_total_time_sec"),
    )


def pair_ranking(log: DataFrame) -> DataFrame:
    """Mean/max total per pair, ranked 1..n by mean total (ties by pair).

    The rank window has no partition, but it runs on the aggregated table: one
    row per distinct pair (processing methods x visualisation methods).
    """
    agg = log.groupBy("pair", "processing_method", "visualization_method").agg(
        mean(log, "total_time_sec").alias("mean_total_time_sec"),
        greatest(log, "total_time_sec").alias("max_total_time_sec"),
        mean(log, "processing_time_sec").alias("mean_processing_time_sec"),
        mean(log, "visualization_time_sec").alias("mean_visualization_time_sec"),
        mean(log, "processing_memory_peak_mb").alias("mean_memory_peak_mb"),
    )
    return agg.withColumn("rank", F.row_number().over(
        Window.orderBy("mean_total_time_sec", "pair", "processing_method", "visualization_method")).cast("long"))


def fastest_method(log: DataFrame) -> DataFrame:
    """Per dataset, the processing method with the smallest mean processing time."""
    summary = processing_summary(log)
    return first_per_group(summary, ["dataset"], ["mean_processing_time_sec"], summary.columns)


def mean_by(log: DataFrame, key: str, metric: str, out: str) -> DataFrame:
    return log.groupBy(key).agg(mean(log, metric).alias(out))


def chart_labels(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.concat_ws(" | ", F.col("dataset"), F.col("pair")))


def report_lines(partials: DataFrame) -> DataFrame:
    """The numbers behind the written conclusions, as (section, ord, subject, detail, seconds, memory_mb).

    Four groupings of the partial rows in one expand (grouping sets): best pair of a dataset, means of a pair (of
    which the best counts), of a dataset's methods (the fastest counts) and of a visualisation. The partial rows are
    read once, whatever they come from."""
    keys = ["dataset", "pair", "processing_method", "visualization_method"]
    sets = [["dataset"], ["pair", "processing_method", "visualization_method"], ["dataset", "processing_method"], ["visualization_method"]]
    partials = merged(partials)
    grouped = partials.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(
        F.grouping_id().alias("g"), best_of("pair").alias("b"), *[mean(partials, m).alias(f"mean_{m}") for m in METRICS])
    # grouping_id: a bit is set for each of the keys, in order, that a grouping leaves out
    number = [sum((c not in s) << (len(keys) - 1 - n) for n, c in enumerate(keys)) for s in sets]
    of = lambda n, c: F.col("g").eqNullSafe(F.lit(number[n])) if c is None else F.when(F.col("g") == number[n], c)
    pick = lambda *cs: F.coalesce(*[of(n, c) for n, c in enumerate(cs) if c is not None])
    lines = grouped.select(
        pick(*[F.lit(x) for x in ("best_pair", "overall_best", "fastest_processing", "visualization")]).alias("section"),
        # one line per group of these; of pairs and of a dataset's methods the first by rank
        F.when(of(1, None), F.lit(None)).when(of(3, None), F.col("visualization_method")).otherwise(F.col("dataset")).alias("group"),
        F.when(of(1, None), F.struct(F.col("mean_total_time_sec").isNull().alias("no"), F.col("mean_total_time_sec").alias("x"), F.col("pair").alias("y"), F.col("processing_method").alias("z")))
        .when(of(2, None), F.struct(F.col("mean_processing_time_sec").isNull().alias("no"), F.col("mean_processing_time_sec").alias("x"), F.col("processing_method").alias("y"), F.lit("").alias("z"))).alias("rank"),
        F.when(of(1, None), F.col("pair")).when(of(3, None), F.col("visualization_method")).otherwise(F.col("dataset")).alias("subject"),
        F.when(of(0, None), F.col("b.pair")).when(of(2, None), F.col("processing_method")).otherwise(F.lit("")).alias("detail"),
        F.when(of(0, None), F.col("b.total_time_sec")).when(of(1, None), F.col("mean_total_time_sec"))
        .when(of(2, None), F.col("mean_processing_time_sec")).otherwise(F.col("mean_visualization_time_sec")).alias("seconds"),
        F.when(of(0, None), F.col("b.rest.processing_memory_peak_mb")).when(of(1, None), F.col("mean_processing_memory_peak_mb")).alias("memory_mb"))
    best = lines.groupBy("section", "group").agg(F.min(F.struct("rank", "subject", "detail", "seconds", "memory_mb")).alias("l")).select(
        "section", "l.subject", "l.detail", "l.seconds", "l.memory_mb")
    by = F.when(F.col("section") == "visualization", F.col("seconds")).otherwise(F.lit(0.0))
    w = Window.partitionBy("section").orderBy(by, "subject")
    return best.withColumn("ord", F.row_number().over(w).cast("long"))


def format_report(lines: DataFrame) -> DataFrame:
    """Text of each report line: seconds as %.6f, memory as %.3f, 'no data' when missing."""
    return lines.withColumns({"seconds_text": fixed("seconds", 6), "memory_text": fixed("memory_mb", 3)})
