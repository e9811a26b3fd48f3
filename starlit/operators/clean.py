"""Cleaning: coercion, defaults, invalid rows, quality filter, flux_err fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlit.functions.expr import as_double, as_quarter, quality_ok, sql_as_double, sql_as_quarter, with_sql
from starlit.operators.quantile import global_median
from starlit.schema import NUMERIC_COLUMNS, REQUIRED_PIPELINE_COLUMNS, require_columns


# Good quality: the flag truncated to a whole number is 0.
QUALITY_OK_SQL = "coalesce(try_cast(quality AS BIGINT) = 0, false)"


def coerce_numeric(df: DataFrame, columns=NUMERIC_COLUMNS) -> DataFrame:
    """Numeric coercion of the given columns: bad text and NaN -> NULL, type double."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: as_double(c, types[c]) for c in columns if c in types})


def with_defaults(df: DataFrame) -> DataFrame:
    """Absent quarter -> -1, absent source_file -> '', absent flux_err -> NULL, absent quality -> 0."""
    cols = set(df.columns)
    add = {}
    if "quarter" not in cols:
        add["quarter"] = F.lit(-1)
    if "source_file" not in cols:
        add["source_file"] = F.lit("")
    if "flux_err" not in cols:
        add["flux_err"] = F.lit(None).cast("double")
    if "quality" not in cols:
        add["quality"] = F.lit(0.0)
    return df.withColumns(add) if add else df


def normalize_keys(df: DataFrame) -> DataFrame:
    """object_id as text, quarter as int with missing -> -1 (before any grouping)."""
    return df.withColumns({
        "object_id": F.col("object_id").cast("string"),
        "quarter": as_quarter("quarter"),
    })


def drop_invalid(df: DataFrame, subset=("object_id", "time", "flux")) -> DataFrame:
    cond = None
    for c in subset:
        part = F.col(c).isNotNull()
        cond = part if cond is None else cond & part
    return df.filter(cond)


def fill_quality(df: DataFrame) -> DataFrame:
    return df.withColumn("quality", F.coalesce(F.col("quality"), F.lit(0.0)))


def any_true(df: DataFrame, cond: Column) -> Column:
    """Lazy scalar: does any row satisfy cond (false on empty input)."""
    return F.coalesce(df.select(F.bool_or(cond)).scalar(), F.lit(False))


def good_quality(df: DataFrame, any_ok: bool | None = None) -> DataFrame:
    """Keep quality-0 rows; when no row of the whole input is good, keep every row.

    ``any_ok`` comes from a profile pass when the caller has one; otherwise the
    global fallback is a lazy scalar subquery (one partial-aggregated pass), not
    a join.
    """
    if any_ok is None:
        ok = quality_ok("quality")
        return df.filter(ok | ~any_true(df, ok))
    return df.filter(QUALITY_OK_SQL) if any_ok else df


def profile(df: DataFrame, key: str = "object_id"):
    """One pass of the global facts the pipeline needs (a dict of scalars).

    Per-object partial aggregates (one row per object, map-side combined) are
    folded into: rows and good-quality rows (total and largest object), and the
    non-missing flux_err count, sum, min and max, each for all rows and for good
    rows.  The largest object decides whether the trend needs the hot-object path,
    without a separate pass.
    """
    ok = QUALITY_OK_SQL
    per = df.groupBy(key).agg(*[F.expr(e) for e in (
        "count(1) AS n", f"count(CASE WHEN {ok} THEN 1 END) AS n_ok",
        "count(flux_err) AS ne", f"count(CASE WHEN {ok} THEN flux_err END) AS ne_ok",
        "sum(flux_err) AS se", f"sum(CASE WHEN {ok} THEN flux_err END) AS se_ok",
        "min(flux_err) AS lo", f"min(CASE WHEN {ok} THEN flux_err END) AS lo_ok",
        "max(flux_err) AS hi", f"max(CASE WHEN {ok} THEN flux_err END) AS hi_ok")])
    row = per.selectExpr(
        "coalesce(sum(n), 0) AS n", "coalesce(sum(n_ok), 0) AS n_ok", "coalesce(max(n), 0) AS max_n",
        "coalesce(max(n_ok), 0) AS max_n_ok", "coalesce(sum(ne), 0) AS ne", "coalesce(sum(ne_ok), 0) AS ne_ok",
        "sum(se) AS se", "sum(se_ok) AS se_ok", "min(lo) AS lo", "min(lo_ok) AS lo_ok",
        "max(hi) AS hi", "max(hi_ok) AS hi_ok").first()
    any_ok = row["n_ok"] > 0
    pick = (lambda a, b: row[b] if any_ok else row[a])
    ne, se = pick("ne", "ne_ok"), pick("se", "se_ok")
    return {"any_ok": any_ok, "rows": pick("n", "n_ok"), "max_object_rows": pick("max_n", "max_n_ok"),
            "err_count": ne, "err_mean": (se / ne) if ne else None,
            "err_range": (ne, pick("lo", "lo_ok"), pick("hi", "hi_ok")),
            "all_rows": row["n"], "all_max_object_rows": row["max_n"], "all_err_count": row["ne"],
            "all_err_range": (row["ne"], row["lo"], row["hi"])}


def fill_flux_err(df: DataFrame, policy: str, count: int | None = None, mean: float | None = None,
                  value_range: tuple | None = None) -> DataFrame:
    """Fill missing flux_err with a global statistic of the input.

    policy: ``median_or_zero`` (median; all missing -> 0), ``median`` (all missing
    stays missing), ``mean`` (mean; all missing -> 0).  ``count``/``mean`` may be
    passed from a profile pass to save a job.
    """
    if policy == "mean" and count is not None:
        stat = F.lit(mean if count else 0.0).cast("double")
    elif policy in ("median", "median_or_zero") and count is not None:
        from starlit.operators.quantile import median_column
        stat = median_column(df, "flux_err", count, known=value_range)
        if policy == "median_or_zero":
            stat = F.coalesce(stat, F.lit(0.0))
    elif policy == "mean":
        stat = F.coalesce(df.select(F.avg("flux_err")).scalar(), F.lit(0.0))
    elif policy in ("median", "median_or_zero"):
        stat = global_median(df, "flux_err")
        if policy == "median_or_zero":
            stat = F.coalesce(stat, F.lit(0.0))
    else:
        raise ValueError(f"unknown flux_err policy: {policy}")
    return df.withColumn("flux_err", F.coalesce(F.col("flux_err"), stat))


def clean_observations(df: DataFrame) -> DataFrame:
    """Coerce, add defaults, drop rows without object_id/time/flux, fill quality
    (one projection and one filter)."""
    require_columns(df.columns, REQUIRED_PIPELINE_COLUMNS)
    df = with_defaults(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    exprs = {c: sql_as_double(c, types[c]) for c in NUMERIC_COLUMNS}
    exprs["quality"] = f"coalesce({exprs['quality']}, 0.0D)"
    exprs["object_id"] = "CAST(object_id AS STRING)"
    exprs["quarter"] = sql_as_quarter("quarter")
    return with_sql(df, exprs).filter("object_id IS NOT NULL AND time IS NOT NULL AND flux IS NOT NULL")


def observations_schema_cast(df: DataFrame) -> DataFrame:
    """Canonical observation columns and types (D2)."""
    df = with_defaults(df)
    if "dataset" not in df.columns:
        df = df.withColumn("dataset", F.lit(None).cast(T.StringType()))
    df = normalize_keys(coerce_numeric(df))
    return df.select("dataset", F.col("source_file").cast("string").alias("source_file"),
                     "object_id", "quarter", "time", "flux", "flux_err", "quality")
