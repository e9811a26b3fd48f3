"""DuckDB twins of the registered queries (the correctness oracle).

Each entry is standalone ANSI SQL over the shared test tables.  The adapter
CTEs mirror ``starlit.sources.adapters``; float outputs are rounded to 6 digits
on both sides.
"""

from __future__ import annotations

BIN_W = "0.5::DOUBLE"

# --- adapters ---------------------------------------------------------------
OBS = """obs AS (
  SELECT (['small','medium','large'])[(user_id % 3)::INT + 1] AS dataset,
         event_type AS source_file, user_id::VARCHAR AS object_id,
         (floor(((epoch_us(ts) - 1704067200000000) / 86400000000.0::DOUBLE) / 10) + 1)::INT AS quarter,
         CASE WHEN event_id % 101 <> 0 THEN (epoch_us(ts) - 1704067200000000) / 86400000000.0::DOUBLE END AS "time",
         CASE WHEN event_id % 97 <> 0 THEN value END AS flux,
         CASE WHEN event_type <> 'click' THEN value * 0.01::DOUBLE END AS flux_err,
         CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS quality
  FROM events)"""

OBS_RAW = OBS + """,
obs_raw AS (
  SELECT dataset, source_file, object_id, quarter, "time"::VARCHAR AS "time",
         COALESCE(flux::VARCHAR, 'n/a') AS flux, flux_err::VARCHAR AS flux_err, quality::VARCHAR AS quality
  FROM obs)"""

EPHEMERIS = """ephemeris AS (
  SELECT DISTINCT user_id::VARCHAR AS object_id, 50.0::DOUBLE AS base_flux,
         1.5::DOUBLE + (user_id % 20)::DOUBLE AS period,
         0.001::DOUBLE * (1.0::DOUBLE + (user_id % 20)::DOUBLE) AS depth,
         0.01::DOUBLE + (user_id % 6)::DOUBLE * 0.01::DOUBLE AS duration
  FROM events)"""

RUN_METRICS = """run_metrics AS (
  SELECT l_returnflag AS dataset, 'm' || l_linenumber::VARCHAR || ' + ' || lower(l_linestatus) AS pair,
         l_extendedprice / 100000.0::DOUBLE AS processing_time_sec,
         l_discount AS visualization_time_sec,
         round(l_extendedprice / 100000.0::DOUBLE + l_discount, 6) AS total_time_sec,
         l_quantity AS processing_memory_peak_mb,
         CASE WHEN l_tax >= 0.07 THEN 'ERROR' ELSE 'Success' END AS status
  FROM lineitem)"""

# --- shared pipeline stages -------------------------------------------------
def obs_variant(name: str, replace: str) -> str:
    """A derived observation view: obs with some columns replaced."""
    return f"{name} AS (SELECT * REPLACE ({replace}) FROM obs)"


def clean_ctes(src: str = "obs", p: str = "") -> str:
    """{p}clean (drop + defaults), {p}flag (quality ok), {p}good (filter with global fallback)."""
    return f"""{p}clean AS (
  SELECT dataset, object_id, COALESCE(quarter, -1) AS quarter, source_file, "time", flux, flux_err,
         COALESCE(quality, 0.0::DOUBLE) AS quality
  FROM {src} WHERE object_id IS NOT NULL AND "time" IS NOT NULL AND flux IS NOT NULL),
{p}flag AS (SELECT *, COALESCE(TRY_CAST(trunc(quality) AS BIGINT) = 0, false) AS ok FROM {p}clean),
{p}good AS (SELECT * FROM {p}flag WHERE ok OR NOT COALESCE((SELECT bool_or(ok) FROM {p}flag), false))"""


def fill_cte(policy: str, src: str, name: str) -> str:
    if policy == "median":
        stat = f"(SELECT median(flux_err) FROM {src})"
    else:
        stat = f"COALESCE((SELECT avg(flux_err) FROM {src}), 0.0::DOUBLE)"
    return f"""{name} AS (
  SELECT object_id, quarter, "time", flux, COALESCE(flux_err, {stat}) AS flux_err, source_file FROM {src})"""


def z_cte(src: str, name: str) -> str:
    return f"""{name} AS (
  SELECT *, COALESCE((flux - avg(flux) OVER o) / NULLIF(stddev_samp(flux) OVER o, 0), 0.0::DOUBLE) AS flux_norm
  FROM {src} WINDOW o AS (PARTITION BY object_id))"""


def rolling(value: str, part: str, order: str) -> str:
    frame = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)"
    return (f"COALESCE(CASE WHEN count({value}) OVER {frame} >= 3 THEN median({value}) OVER {frame} END, "
            f"{value})")


def outlier(resid: str = "residual") -> str:
    return (f"COALESCE(abs({resid}) > 3.0 * NULLIF(stddev_samp({resid}) OVER (PARTITION BY object_id), 0), "
            "false)")


def point_ctes(z: str, p: str = "") -> str:
    return f"""{p}r AS (
  SELECT *, {rolling("flux_norm", "object_id", 'quarter, "time", flux')} AS rolling_flux FROM {z}),
{p}res AS (SELECT *, flux_norm - rolling_flux AS residual FROM {p}r),
{p}pt AS (SELECT *, {outlier()} AS is_anomaly FROM {p}res),
{p}pbins AS (
  SELECT object_id, quarter, floor("time" / {BIN_W})::BIGINT AS bin_id,
         avg(flux_norm) AS flux_norm, avg(rolling_flux) AS rolling_flux, avg(flux_err) AS flux_err,
         count(*) AS points_count, sum(is_anomaly::BIGINT)::BIGINT AS anomaly_count,
         count(DISTINCT source_file) AS source_files
  FROM {p}pt GROUP BY object_id, quarter, floor("time" / {BIN_W})::BIGINT),
{p}point_out AS (
  SELECT object_id, quarter, bin_id * {BIN_W} AS time_bin, flux_norm, rolling_flux, flux_err,
         points_count, anomaly_count, source_files, anomaly_count > 0 AS is_anomaly,
         'obs' AS dataset, 'spark' AS processing_method
  FROM {p}pbins)"""


def bin_ctes(z: str, p: str = "") -> str:
    return f"""{p}zb AS (SELECT *, COALESCE(abs(flux_norm) > 3.0, false) AS prelim FROM {z}),
{p}bb AS (
  SELECT object_id, quarter, floor("time" / {BIN_W})::BIGINT AS bin_id,
         avg(flux_norm) AS flux_norm, avg(flux_err) AS flux_err, count(flux) AS points_count,
         sum(prelim::BIGINT)::BIGINT AS anomaly_count, count(DISTINCT source_file) AS source_files
  FROM {p}zb GROUP BY object_id, quarter, floor("time" / {BIN_W})::BIGINT),
{p}br AS (SELECT *, {rolling("flux_norm", "object_id", "quarter, bin_id")} AS rolling_flux FROM {p}bb),
{p}bres AS (SELECT *, flux_norm - rolling_flux AS residual FROM {p}br),
{p}bin_out AS (
  SELECT object_id, quarter, bin_id * {BIN_W} AS time_bin, flux_norm, flux_err, points_count,
         anomaly_count, source_files, 'obs' AS dataset, 'spark' AS processing_method, rolling_flux, residual,
         {outlier()} AS residual_outlier, {outlier()} OR anomaly_count > 0 AS is_anomaly
  FROM {p}bres)"""


POINT_PIPE = ",\n".join([OBS, clean_ctes(), fill_cte("median", "good", "filled"), z_cte("filled", "z"),
                         point_ctes("z")])
BIN_PIPE = ",\n".join([OBS, clean_ctes(), fill_cte("mean", "good", "filled"), z_cte("filled", "z"),
                       bin_ctes("z")])
BOTH_PIPES = ",\n".join([OBS, clean_ctes(), fill_cte("median", "good", "filled"), z_cte("filled", "z"),
                         point_ctes("z"), fill_cte("mean", "good", "bfilled"), z_cte("bfilled", "bz"),
                         bin_ctes("bz")])


def r6(col: str, alias: str | None = None) -> str:
    return f"round({col}, 6) AS {alias or col}"


def rounded(cols: str) -> str:
    return ", ".join(r6(c.strip()) for c in cols.split(","))


POINT_SELECT = ("SELECT object_id, quarter, time_bin, " + rounded("flux_norm, rolling_flux, flux_err")
                + ", points_count, anomaly_count, source_files, is_anomaly, dataset, processing_method FROM point_out")
BIN_SELECT = ("SELECT object_id, quarter, time_bin, " + rounded("flux_norm, flux_err")
              + ", points_count, anomaly_count, source_files, dataset, processing_method, "
              + rounded("rolling_flux, residual") + ", is_anomaly FROM bin_out")
SQL: dict[str, str] = {}

SQL["process_point"] = f"WITH {POINT_PIPE}\n{POINT_SELECT}"
SQL["process_bin"] = f"WITH {BIN_PIPE}\n{BIN_SELECT}"

# --- batch: scans, cleaning, normalisation, trend ----------------------------------------
PT_FILLED = ",\n".join([OBS, clean_ctes(), fill_cte("median", "good", "filled")])
PT_Z = ",\n".join([PT_FILLED, z_cte("filled", "z")])
PT_TREND = ",\n".join([PT_Z, point_ctes("z")])
OBS_COLS = 'dataset, source_file, object_id, quarter, "time", flux, flux_err, quality'

SQL["scan_parquet"] = "SELECT event_id, user_id, value FROM events WHERE value > 50.0"

SQL["coerce_numeric"] = f"""WITH {OBS_RAW}
SELECT object_id, quarter,
       CASE WHEN isnan(TRY_CAST("time" AS DOUBLE)) THEN NULL ELSE TRY_CAST("time" AS DOUBLE) END AS "time",
       CASE WHEN isnan(TRY_CAST(flux AS DOUBLE)) THEN NULL ELSE TRY_CAST(flux AS DOUBLE) END AS flux,
       CASE WHEN isnan(TRY_CAST(flux_err AS DOUBLE)) THEN NULL ELSE TRY_CAST(flux_err AS DOUBLE) END AS flux_err,
       CASE WHEN isnan(TRY_CAST(quality AS DOUBLE)) THEN NULL ELSE TRY_CAST(quality AS DOUBLE) END AS quality
FROM obs_raw"""

SQL["default_columns"] = f"""WITH {OBS}
SELECT object_id, -1 AS quarter, '' AS source_file, "time", flux, NULL::DOUBLE AS flux_err,
       0.0::DOUBLE AS quality FROM obs"""

SQL["normalize_quarter"] = f"""WITH {OBS}
SELECT object_id, "time", COALESCE(TRY_CAST(trunc(TRY_CAST(q AS DOUBLE)) AS INT), -1) AS quarter
FROM (SELECT *, CASE WHEN source_file = 'view' THEN NULL WHEN source_file = 'signup' THEN 'q?'
                     ELSE quarter::VARCHAR END AS q FROM obs)"""

SQL["drop_invalid"] = f"""WITH {OBS}
SELECT * FROM obs WHERE object_id IS NOT NULL AND "time" IS NOT NULL AND flux IS NOT NULL"""

SQL["fill_quality"] = f"""WITH {OBS}
SELECT * REPLACE (COALESCE(quality, 0.0::DOUBLE) AS quality) FROM obs"""

SQL["good_quality"] = f"""WITH {OBS},
{clean_ctes()}
SELECT {OBS_COLS} FROM good"""

SQL["good_quality_fallback"] = f"""WITH {OBS},
{obs_variant("obs4", "4.0::DOUBLE AS quality")},
{clean_ctes("obs4")}
SELECT {OBS_COLS} FROM good"""

SQL["fill_err_median"] = f"""WITH {OBS},
d AS (SELECT * FROM obs WHERE "time" IS NOT NULL AND flux IS NOT NULL)
SELECT dataset, source_file, object_id, quarter, {rounded('"time", flux')},
       round(COALESCE(flux_err, COALESCE((SELECT median(flux_err) FROM d), 0.0::DOUBLE)), 6) AS flux_err,
       round(quality, 6) AS quality
FROM d"""

SQL["fill_err_median_strict"] = f"""WITH {OBS},
{clean_ctes()}
SELECT dataset, source_file, object_id, quarter, {rounded('"time", flux')},
       round(COALESCE(flux_err, (SELECT median(flux_err) FROM good)), 6) AS flux_err, round(quality, 6) AS quality
FROM good"""

SQL["fill_err_mean"] = f"""WITH {OBS},
{clean_ctes()}
SELECT dataset, source_file, object_id, quarter, {rounded('"time", flux')},
       round(COALESCE(flux_err, COALESCE((SELECT avg(flux_err) FROM good), 0.0::DOUBLE)), 6) AS flux_err,
       round(quality, 6) AS quality
FROM good"""

SQL["global_err_stats"] = f"""WITH {OBS},
{clean_ctes()}
SELECT round(avg(flux_err), 6) AS flux_err_mean, count(flux_err) AS flux_err_count,
       round(median(flux_err), 6) AS flux_err_median FROM good"""

SQL["object_stats"] = f"""WITH {PT_FILLED}
SELECT object_id, count(flux) AS n_obs, round(avg(flux), 6) AS flux_mean, round(stddev_samp(flux), 6) AS flux_std
FROM filled GROUP BY object_id"""

SQL["join_stats"] = f"""WITH {PT_FILLED},
st AS (SELECT object_id, count(flux) AS n_obs, avg(flux) AS flux_mean, stddev_samp(flux) AS flux_std
       FROM filled GROUP BY object_id)
SELECT f.object_id, f.quarter, {rounded('f."time", f.flux, f.flux_err').replace('AS f.', 'AS ')}, f.source_file,
       st.n_obs, {rounded('st.flux_mean, st.flux_std').replace('AS st.', 'AS ')}
FROM filled f LEFT JOIN st ON f.object_id = st.object_id"""

SQL["zscore"] = f"""WITH {PT_Z}
SELECT object_id, quarter, "time", flux, round(flux_norm, 6) AS flux_norm FROM z"""

SQL["flag_z"] = f"""WITH {PT_Z}
SELECT object_id, "time", round(flux_norm, 6) AS flux_norm, abs(flux_norm) > 3.0 AS is_anomaly FROM z"""

SQL["time_bin"] = f"""WITH {OBS},
{clean_ctes()}
SELECT object_id, "time", floor("time" / {BIN_W})::BIGINT AS bin_id,
       floor("time" / {BIN_W})::BIGINT * {BIN_W} AS time_bin FROM clean"""

SQL["rolling_median"] = f"""WITH {PT_Z}
SELECT object_id, quarter, "time", round(flux_norm, 6) AS flux_norm,
       round(CASE WHEN count(flux_norm) OVER f >= 3 THEN median(flux_norm) OVER f END, 6) AS rolling_median
FROM z WINDOW f AS (PARTITION BY object_id ORDER BY quarter, "time", flux
                    ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)"""

SQL["rolling_median_filled"] = f"""WITH {PT_TREND}
SELECT object_id, "time", round(rolling_flux, 6) AS rolling_flux FROM pt"""

SQL["residual"] = f"""WITH {PT_TREND}
SELECT object_id, "time", round(residual, 6) AS residual FROM pt"""

SQL["residual_outlier"] = f"""WITH {PT_TREND}
SELECT object_id, "time", round(residual, 6) AS residual, is_anomaly AS residual_outlier FROM pt"""

SQL["rolling_median_blocked"] = f"""WITH {PT_TREND}
SELECT object_id, "time", round(rolling_flux, 6) AS rolling_flux, round(residual, 6) AS residual,
       is_anomaly AS residual_outlier FROM pt"""

SQL["bin_anomaly"] = f"""WITH {BIN_PIPE}
SELECT object_id, quarter, time_bin, anomaly_count > 0 AS raw_flag, is_anomaly FROM bin_out"""

SQL["bin_agg_point"] = f"""WITH {POINT_PIPE}
SELECT object_id, quarter, time_bin, {rounded("flux_norm, rolling_flux, flux_err")},
       points_count, anomaly_count, source_files, is_anomaly FROM point_out"""

SQL["bin_agg_bin"] = f"""WITH {BIN_PIPE}
SELECT object_id, quarter, bin_id * {BIN_W} AS time_bin, {rounded("flux_norm, flux_err")}, points_count,
       anomaly_count, source_files FROM bb"""

PREP = f"""{OBS},
p0 AS (SELECT * FROM obs WHERE "time" IS NOT NULL AND flux IS NOT NULL),
p1 AS (SELECT dataset, source_file, object_id, COALESCE(quarter, -1) AS quarter, "time", flux,
              COALESCE(flux_err, COALESCE((SELECT median(flux_err) FROM p0), 0.0::DOUBLE)) AS flux_err,
              COALESCE(quality, 0.0::DOUBLE) AS quality FROM p0),
p2 AS (SELECT *, COALESCE((flux - avg(flux) OVER o) / NULLIF(stddev_samp(flux) OVER o, 0), 0.0::DOUBLE) AS flux_norm
       FROM p1 WINDOW o AS (PARTITION BY object_id)),
prep AS (SELECT *, abs(flux_norm) > 3.0 AS is_anomaly FROM p2)"""

SQL["canonical_order"] = f"""WITH {PREP}
SELECT object_id, quarter, "time",
       row_number() OVER (PARTITION BY object_id ORDER BY quarter, "time", flux) AS position FROM prep"""

SQL["canonical_order_ranked"] = SQL["canonical_order"]

SQL["fill_err_median_grouped"] = f"""WITH {OBS},
{clean_ctes()}
SELECT quarter, count(flux_err) AS values, round(median(flux_err), 6) AS median_flux_err FROM good GROUP BY quarter"""

SQL["prepare_by_dataset"] = f"""WITH {OBS},
p0 AS (SELECT * FROM obs WHERE "time" IS NOT NULL AND flux IS NOT NULL),
md AS (SELECT dataset, median(flux_err) AS m FROM p0 GROUP BY dataset),
p1 AS (SELECT p0.* REPLACE (COALESCE(quarter, -1) AS quarter, COALESCE(flux_err, m, 0.0::DOUBLE) AS flux_err,
              COALESCE(quality, 0.0::DOUBLE) AS quality) FROM p0 JOIN md USING (dataset)),
p2 AS (SELECT *, COALESCE((flux - avg(flux) OVER o) / NULLIF(stddev_samp(flux) OVER o, 0), 0.0::DOUBLE) AS flux_norm
       FROM p1 WINDOW o AS (PARTITION BY dataset, object_id))
SELECT dataset, source_file, object_id, quarter, "time", flux, round(flux_err, 6) AS flux_err, quality,
       round(flux_norm, 6) AS flux_norm, abs(flux_norm) > 3.0 AS is_anomaly FROM p2"""

SQL["prepare_observations"] = f"""WITH {PREP}
SELECT dataset, source_file, object_id, quarter, "time", flux, round(flux_err, 6) AS flux_err, quality,
       round(flux_norm, 6) AS flux_norm, is_anomaly FROM prep"""

SQL["run_summary"] = f"""WITH {BOTH_PIPES}
SELECT 'obs' AS dataset, (SELECT count(*) FROM obs) AS rows_input, (SELECT count(*) FROM good) AS rows_after_cleaning,
       count(*) AS rows_output, count(DISTINCT object_id) AS objects, count(DISTINCT quarter) AS quarters,
       COALESCE(sum(is_anomaly::BIGINT), 0)::BIGINT AS anomaly_rows, 'point' AS mode FROM point_out
UNION ALL
SELECT 'obs', (SELECT count(*) FROM obs), (SELECT count(*) FROM good), count(*), count(DISTINCT object_id),
       count(DISTINCT quarter), COALESCE(sum(is_anomaly::BIGINT), 0)::BIGINT, 'bin' FROM bin_out"""

# --- batch: extracts, sampling, dashboard ---------------------------------------------------
EX = POINT_PIPE + """,
ex AS (
  SELECT dataset, object_id, COALESCE(quarter, -1) AS quarter, time_bin, flux_norm, rolling_flux, flux_err,
         COALESCE(points_count, 0) AS points_count, COALESCE(anomaly_count, 0) AS anomaly_count,
         COALESCE(is_anomaly, false) AS is_anomaly, processing_method
  FROM point_out WHERE time_bin IS NOT NULL AND flux_norm IS NOT NULL),
pos AS (
  SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY time_bin, quarter) - 1 AS _r,
         count(*) OVER (PARTITION BY object_id) AS _n FROM ex)"""
EX_COLS = ("dataset, object_id, quarter, time_bin, " + rounded("flux_norm, rolling_flux, flux_err")
           + ", points_count, anomaly_count, is_anomaly, processing_method")


def even_keep_sql(r: str, n: str, k: str) -> str:
    """Position among the generated ones: of i = 0 .. k - 2 the whole part of i * (n - 1) / (k - 1), and the last."""
    at = (f"list_append(list_transform(range(0, {k}::BIGINT - 1), lambda i: floor(i::DOUBLE * (({n} - 1)::DOUBLE / greatest({k} - 1, 1)::DOUBLE))::BIGINT), "
          f"CASE WHEN {k} = 1 THEN 0 ELSE {n} - 1 END)")
    return f"({n} <= {k} OR list_contains({at}, {r}))"


BY_OBJECT_LIMIT = "greatest(20, floor(2000 / greatest((SELECT count(DISTINCT object_id) FROM ex), 1)))"
POS_LIMIT = f"(SELECT *, {BY_OBJECT_LIMIT} AS _k FROM pos)"
BY_OBJECT_KEEP = f"((SELECT count(*) FROM ex) <= 2000 OR {even_keep_sql('_r', '_n', '_k')})"

SQL["extract_project"] = f"WITH {EX}\nSELECT {EX_COLS} FROM ex"
SQL["dashboard_extract"] = f"WITH {EX}\nSELECT {EX_COLS} FROM {POS_LIMIT} WHERE {BY_OBJECT_KEEP}"
SQL["downsample_by_object"] = f"WITH {EX}\nSELECT object_id, quarter, time_bin FROM {POS_LIMIT} WHERE {BY_OBJECT_KEEP}"
SQL["even_downsample"] = f"WITH {EX}\nSELECT object_id, quarter, time_bin FROM pos WHERE {even_keep_sql('_r', '_n', '7')}"

SQL["even_downsample_ranked"] = SQL["even_downsample"]

SQL["extract_metadata"] = f"""WITH {EX},
ds AS (SELECT * FROM {POS_LIMIT} WHERE {BY_OBJECT_KEEP})
SELECT 'obs' AS dataset, 'spark' AS processing_method, 'dash' AS visualization_method,
       'interactive_web_dashboard' AS visualization_type, (SELECT count(*) FROM ex) AS rows_before_downsample,
       count(*) AS rows_saved_for_dashboard, COALESCE(sum(is_anomaly::BIGINT), 0)::BIGINT AS anomaly_rows,
       min(time_bin) AS min_time, max(time_bin) AS max_time, count(DISTINCT object_id) AS n_objects,
       array_to_string(list_sort(list_distinct(list(object_id)))[1:5], ', ') AS object_preview,
       array_to_string(list_sort(list_distinct(list(quarter))), ',') AS quarters
FROM ds"""

SQL["object_series"] = f"""WITH {EX}
SELECT {EX_COLS} FROM ex WHERE object_id = (SELECT min(object_id) FROM ex)"""

SQL["time_range_subset"] = f"""WITH {EX}
SELECT object_id, quarter, time_bin FROM ex WHERE time_bin BETWEEN 5.0 AND 20.0"""

SQL["anomaly_points"] = f"""WITH {EX}
SELECT object_id, time_bin, round(flux_norm, 6) AS flux_norm FROM ex WHERE is_anomaly"""

SQL["time_extent"] = f"""WITH {EX}
SELECT object_id, round(min(time_bin), 6) AS min_time, round(max(time_bin), 6) AS max_time,
       round(greatest((max(time_bin) - min(time_bin)) / 1000.0, 0.001), 6) AS step
FROM ex GROUP BY object_id"""

SQL["object_list"] = f"""WITH {EX}
SELECT DISTINCT object_id, object_id = (SELECT min(object_id) FROM ex) AS is_default FROM ex"""

SQL["object_preview"] = f"""WITH {EX}
SELECT array_to_string(list_sort(list(object_id)), ', ') AS object_preview
FROM (SELECT DISTINCT object_id FROM ex ORDER BY object_id LIMIT 5)"""

SQL["quarters_text"] = f"""WITH {EX}
SELECT object_id,
       COALESCE(array_to_string(list_sort(list_distinct(list(quarter) FILTER (WHERE quarter >= 0))), ', '),
                'unknown') AS quarters
FROM ex GROUP BY object_id"""

SQL["top_object"] = f"""WITH {POINT_PIPE}
SELECT object_id, count(*) AS rows FROM point_out GROUP BY object_id ORDER BY rows DESC, object_id LIMIT 1"""

SQL["chart_series"] = f"""WITH {POINT_PIPE},
top AS (SELECT object_id FROM point_out GROUP BY object_id ORDER BY count(*) DESC, object_id LIMIT 1),
s AS (SELECT p.*, row_number() OVER (ORDER BY time_bin, quarter) - 1 AS _r, count(*) OVER () AS _n
      FROM point_out p WHERE object_id IN (SELECT object_id FROM top)),
k AS (SELECT * FROM s WHERE {even_keep_sql('_r', '_n', '20')})
SELECT object_id, 'flux' AS series, time_bin AS x, round(flux_norm, 6) AS y FROM k
UNION ALL SELECT object_id, 'trend', time_bin, round(rolling_flux, 6) FROM k
UNION ALL SELECT object_id, 'anomaly', time_bin, round(flux_norm, 6) FROM k WHERE is_anomaly"""

SQL["chart_metadata"] = f"""WITH {POINT_PIPE},
top AS (SELECT object_id FROM point_out GROUP BY object_id ORDER BY count(*) DESC, object_id LIMIT 1),
s AS (SELECT p.*, row_number() OVER (ORDER BY time_bin, quarter) - 1 AS _r, count(*) OVER () AS _n
      FROM point_out p WHERE object_id IN (SELECT object_id FROM top)),
k AS (SELECT * FROM s WHERE {even_keep_sql('_r', '_n', '20')})
SELECT 'obs' AS dataset, 'spark' AS processing_method, 'plotly' AS visualization_method, 'interactive_html' AS visualization_type,
       any_value(object_id) AS object_id, count(*) AS points_plotted, count(*) FILTER (is_anomaly) AS anomaly_points_plotted,
       'chart.html' AS visualization_file, NULL::VARCHAR AS visualization_metadata_file FROM k"""

SQL["chart_series_ranked"] = SQL["chart_series"]

# the seeded sample: rank of a row in its object by the hash of its identity
HASHED = """hashed AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY md5(concat_ws(':', '42', object_id, quarter::VARCHAR,
             round(time_bin * 1e6)::BIGINT::VARCHAR)), quarter, time_bin) AS rk, count(*) OVER (PARTITION BY object_id) AS n FROM {0})"""


def summary_sql(rows: str, k: int) -> str:
    return f"""{HASHED.format(rows)},
summary AS (
  SELECT object_id, any_value(n) AS rows_in_range, count(*) AS rows_plotted,
         COALESCE(array_to_string(list_sort(list_distinct(list(quarter) FILTER (WHERE quarter >= 0))), ', '), 'unknown') AS quarters,
         sum(is_anomaly::BIGINT)::BIGINT AS anomaly_rows_plotted, avg(flux_norm) AS mean_flux_norm,
         stddev_samp(flux_norm) AS std_flux_norm, (SELECT mode(processing_method) FROM ex) AS processing_method
  FROM hashed WHERE rk <= {k} GROUP BY object_id)"""


SUMMARY_COLS = """object_id, rows_in_range, rows_plotted, quarters, anomaly_rows_plotted, round(mean_flux_norm, 6) AS mean_flux_norm,
       round(std_flux_norm, 6) AS std_flux_norm, processing_method"""
REFRESH = EX + """,
near AS (SELECT * FROM ex WHERE object_id = (SELECT min(object_id) FROM ex) AND time_bin BETWEEN 3.0 AND 27.0)"""

SQL["dashboard_summary"] = f"""WITH {EX}
SELECT object_id, count(*) AS rows_in_range, count(*) AS rows_plotted,
       COALESCE(array_to_string(list_sort(list_distinct(list(quarter) FILTER (WHERE quarter >= 0))), ', '),
                'unknown') AS quarters,
       sum(is_anomaly::BIGINT)::BIGINT AS anomaly_rows_plotted, round(avg(flux_norm), 6) AS mean_flux_norm,
       round(stddev_samp(flux_norm), 6) AS std_flux_norm, mode(processing_method) AS processing_method
FROM ex GROUP BY object_id"""
SQL["dashboard_refresh_summary"] = f"WITH {REFRESH},\n{summary_sql('near', 25)}\nSELECT {SUMMARY_COLS} FROM summary"
SQL["dashboard_plotted"] = f"""WITH {REFRESH},
{HASHED.format('near')}
SELECT object_id, quarter, time_bin, round(flux_norm, 6) AS flux_norm, is_anomaly FROM hashed WHERE rk <= 25"""
SQL["dashboard_anomalies"] = f"""WITH {EX},
most AS (SELECT object_id FROM ex GROUP BY object_id ORDER BY count(*) FILTER (is_anomaly) DESC, object_id DESC LIMIT 1)
SELECT object_id, quarter, time_bin, round(flux_norm, 6) AS flux_norm FROM ex WHERE is_anomaly AND object_id = (SELECT object_id FROM most)"""
SQL["dashboard_summary_table"] = f"""WITH {EX},
{summary_sql('ex', 5000)},
t AS (SELECT object_id, 'obs' AS "Dataset", object_id AS "Object ID", format('{{:,}}', rows_in_range) AS "Rows in selected range",
        format('{{:,}}', rows_plotted) AS "Rows plotted", quarters AS "Quarters", format('{{:,}}', anomaly_rows_plotted) AS "Anomaly rows plotted",
        COALESCE(printf('%.6f', round(mean_flux_norm, 6)), 'nan') AS "Mean normalized flux",
        COALESCE(printf('%.6f', round(std_flux_norm, 6)), 'nan') AS "Std normalized flux",
        processing_method AS "Processing method", 'dash' AS "Visualization method" FROM summary)
SELECT object_id, metric, value FROM (UNPIVOT t ON COLUMNS(* EXCLUDE (object_id)) INTO NAME metric VALUE value)"""

# --- batch: run logs and analytics -------------------------------------------------------------
SPLIT = """CASE WHEN {p} IS NULL THEN '' WHEN len(string_split({p}, '+')) = 2
                THEN lower(trim(string_split({p}, '+')[1], ' \t\n\r'))
                ELSE lower(trim({p}, ' \t\n\r')) END"""
SPLIT2 = """CASE WHEN {p} IS NULL THEN '' WHEN len(string_split({p}, '+')) = 2
                 THEN lower(trim(string_split({p}, '+')[2], ' \t\n\r')) ELSE '' END"""
CLEAN_LOG = RUN_METRICS + f""",
withm AS (
  SELECT lower(dataset) AS dataset, pair, processing_time_sec, visualization_time_sec, total_time_sec,
         processing_memory_peak_mb, lower(status) AS status,
         {SPLIT.format(p='pair')} AS processing_method, {SPLIT2.format(p='pair')} AS visualization_method
  FROM run_metrics),
cl AS (SELECT * FROM withm WHERE status = 'success' AND total_time_sec IS NOT NULL)"""

BEST_COLS = "dataset, pair, processing_time_sec, visualization_time_sec, total_time_sec, processing_memory_peak_mb"
BEST_M_COLS = ("dataset, processing_method, visualization_method, pair, processing_time_sec, "
               "visualization_time_sec, total_time_sec, processing_memory_peak_mb")

SQL["split_pair"] = f"""WITH {RUN_METRICS},
v AS (SELECT CASE (processing_memory_peak_mb::BIGINT % 4) WHEN 0 THEN pair WHEN 1 THEN pair || ' +x'
                  WHEN 2 THEN NULL ELSE upper(pair) || ' +' END AS pair FROM run_metrics)
SELECT pair, {SPLIT.format(p='pair')} AS processing_method, {SPLIT2.format(p='pair')} AS visualization_method FROM v"""

SQL["successful_runs"] = f"""WITH {RUN_METRICS}
SELECT * FROM run_metrics WHERE lower(status) = 'success' AND total_time_sec IS NOT NULL"""

SQL["clean_run_log"] = f"WITH {CLEAN_LOG}\nSELECT * FROM cl"

SQL["custom_order"] = f"""WITH {CLEAN_LOG}
SELECT dataset, pair, total_time_sec,
       CASE dataset WHEN 'small' THEN 0 WHEN 'medium' THEN 1 WHEN 'large' THEN 2 ELSE 99 END AS dataset_order,
       CASE processing_method WHEN 'pandas' THEN 0 WHEN 'dask' THEN 1 WHEN 'spark' THEN 2 ELSE 99 END AS method_order,
       CASE visualization_method WHEN 'matplotlib' THEN 0 WHEN 'plotly' THEN 1 WHEN 'dash' THEN 2 ELSE 99 END
         AS viz_order
FROM cl"""

SQL["best_pair_by_dataset"] = f"""WITH {CLEAN_LOG}
SELECT {BEST_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY total_time_sec, pair, processing_time_sec,
                               visualization_time_sec, processing_memory_peak_mb) AS rn FROM cl)
WHERE rn = 1"""

SQL["best_pair_by_method"] = f"""WITH {CLEAN_LOG}
SELECT {BEST_M_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, processing_method ORDER BY total_time_sec,
                               visualization_method, pair, processing_time_sec, visualization_time_sec,
                               processing_memory_peak_mb) AS rn FROM cl)
WHERE rn = 1"""

PROC_SUMMARY = """SELECT dataset, processing_method, avg(processing_time_sec) AS mean_processing_time_sec,
       min(processing_time_sec) AS min_processing_time_sec, avg(total_time_sec) AS mean_total_time_sec,
       min(total_time_sec) AS min_total_time_sec, avg(processing_memory_peak_mb) AS mean_memory_peak_mb
FROM cl GROUP BY dataset, processing_method"""

SQL["processing_summary"] = f"""WITH {CLEAN_LOG}, ps AS ({PROC_SUMMARY})
SELECT dataset, processing_method, {rounded("mean_processing_time_sec, min_processing_time_sec, mean_total_time_sec, min_total_time_sec, mean_memory_peak_mb")}
FROM ps"""

SQL["visualization_summary"] = f"""WITH {CLEAN_LOG}
SELECT dataset, visualization_method, round(avg(visualization_time_sec), 6) AS mean_visualization_time_sec,
       round(min(visualization_time_sec), 6) AS min_visualization_time_sec,
       round(avg(total_time_sec), 6) AS mean_total_time_sec, round(min(total_time_sec), 6) AS min_total_time_sec
FROM cl GROUP BY dataset, visualization_method"""

RANKING = """ranking AS (
  SELECT *, row_number() OVER (ORDER BY mean_total_time_sec, pair, processing_method, visualization_method) AS rank
  FROM (SELECT pair, processing_method, visualization_method, avg(total_time_sec) AS mean_total_time_sec,
               max(total_time_sec) AS max_total_time_sec, avg(processing_time_sec) AS mean_processing_time_sec,
               avg(visualization_time_sec) AS mean_visualization_time_sec,
               avg(processing_memory_peak_mb) AS mean_memory_peak_mb
        FROM cl GROUP BY pair, processing_method, visualization_method))"""

SQL["pair_ranking"] = f"""WITH {CLEAN_LOG}, {RANKING}
SELECT pair, processing_method, visualization_method,
       {rounded("mean_total_time_sec, max_total_time_sec, mean_processing_time_sec, mean_visualization_time_sec, mean_memory_peak_mb")},
       rank FROM ranking"""

FASTEST = """fastest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY mean_processing_time_sec, processing_method,
                                 min_processing_time_sec, mean_total_time_sec, min_total_time_sec,
                                 mean_memory_peak_mb) AS rn FROM ps) WHERE rn = 1)"""

SQL["fastest_method"] = f"""WITH {CLEAN_LOG}, ps AS ({PROC_SUMMARY}), {FASTEST}
SELECT dataset, processing_method, {rounded("mean_processing_time_sec, min_processing_time_sec, mean_total_time_sec, min_total_time_sec, mean_memory_peak_mb")}
FROM fastest"""

SQL["avg_total_by_method"] = f"""WITH {CLEAN_LOG}
SELECT processing_method, round(avg(total_time_sec), 6) AS mean_total_time_sec FROM cl GROUP BY processing_method"""
SQL["avg_memory_by_method"] = f"""WITH {CLEAN_LOG}
SELECT processing_method, round(avg(processing_memory_peak_mb), 6) AS mean_memory_peak_mb FROM cl
GROUP BY processing_method"""
SQL["avg_viz_by_method"] = f"""WITH {CLEAN_LOG}
SELECT visualization_method, round(avg(visualization_time_sec), 6) AS mean_visualization_time_sec FROM cl
GROUP BY visualization_method"""

SQL["chart_labels"] = f"""WITH {CLEAN_LOG}
SELECT dataset, pair, total_time_sec, dataset || ' | ' || pair AS label FROM cl"""

SQL["report_lines"] = f"""WITH {CLEAN_LOG}, ps AS ({PROC_SUMMARY}), {FASTEST}, {RANKING},
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY total_time_sec, pair,
                 processing_time_sec, visualization_time_sec, processing_memory_peak_mb) AS rn FROM cl) WHERE rn = 1),
lines AS (
  SELECT 'best_pair' AS section, dataset AS subject, pair AS detail, total_time_sec AS seconds,
         processing_memory_peak_mb AS memory_mb, dataset AS _sort, 0.0 AS _num FROM best
  UNION ALL
  SELECT 'overall_best', pair, '', mean_total_time_sec, mean_memory_peak_mb, pair, 0.0 FROM ranking WHERE rank = 1
  UNION ALL
  SELECT 'fastest_processing', dataset, processing_method, mean_processing_time_sec, NULL::DOUBLE, dataset, 0.0
  FROM fastest
  UNION ALL
  SELECT 'visualization', visualization_method, '', m, NULL::DOUBLE, visualization_method, m
  FROM (SELECT visualization_method, avg(visualization_time_sec) AS m FROM cl GROUP BY visualization_method))
SELECT section, subject, detail, round(seconds, 6) AS seconds, round(memory_mb, 6) AS memory_mb,
       row_number() OVER (PARTITION BY section ORDER BY _num, _sort) AS ord
FROM lines"""

SQL["format_metrics"] = SQL["report_lines"].replace("round(seconds, 6) AS seconds, round(memory_mb, 6) AS memory_mb", """
       round(seconds, 6) AS seconds, round(memory_mb, 6) AS memory_mb, CASE WHEN seconds IS NULL THEN 'no data' ELSE printf('%.6f', round(seconds, 6)) END AS seconds_text,
       CASE WHEN memory_mb IS NULL THEN 'no data' ELSE printf('%.3f', round(memory_mb, 3)) END AS memory_text""")

SQL["combine_run_logs"] = f"""WITH {RUN_METRICS},
withm AS (
  SELECT lower(dataset) AS dataset, pair, processing_time_sec, visualization_time_sec, total_time_sec,
         processing_memory_peak_mb, lower(status) AS status,
         {SPLIT.format(p='pair')} AS processing_method, {SPLIT2.format(p='pair')} AS visualization_method
  FROM run_metrics)
SELECT * FROM withm WHERE processing_method IN ('m1', 'm2')
UNION ALL BY NAME
SELECT * EXCLUDE (processing_memory_peak_mb) FROM withm WHERE processing_method IN ('m3', 'm4')
UNION ALL BY NAME
SELECT * EXCLUDE (visualization_time_sec) FROM withm WHERE processing_method NOT IN ('m1', 'm2', 'm3', 'm4')"""

SQL["mode_method"] = f"""WITH {CLEAN_LOG},
c AS (SELECT dataset, processing_method, count(*) AS n FROM withm WHERE processing_method IS NOT NULL
      GROUP BY dataset, processing_method)
SELECT dataset, processing_method FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, processing_method) AS rn FROM c) WHERE rn = 1"""

SQL["assemble_run_log"] = """WITH
p AS (
  SELECT l_returnflag AS dataset, 'm' || l_linenumber::VARCHAR AS processing_method,
         max(l_linenumber) <> 6 AS input_exists, round(sum(l_extendedprice) / 1.0e7, 6) AS processing_time_sec,
         max(l_quantity) AS processing_memory_peak_mb,
         CASE WHEN max(l_linenumber) = 7 THEN 'error' ELSE 'success' END AS status,
         CASE WHEN max(l_linenumber) = 7 THEN 'processing failed' END AS error,
         'in.parquet' AS input_file, 'out.parquet' AS output_file, count(*) AS rows_input, count(*) FILTER (l_tax < 0.07) AS rows_after_cleaning,
         count(*) FILTER (l_tax < 0.05) AS rows_output, count(DISTINCT l_suppkey) AS objects,
         count(DISTINCT quarter(l_shipdate)) AS quarters, count(*) FILTER (l_discount > 0.09) AS anomaly_rows
  FROM lineitem GROUP BY 1, 2),
v AS (
  SELECT l_returnflag AS dataset, 'm' || l_linenumber::VARCHAR AS processing_method,
         (['matplotlib', 'plotly', 'dash'])[(l_suppkey % 3)::INT + 1] AS visualization_method,
         round(avg(l_discount), 6) AS visualization_time_sec, max(l_tax) AS visualization_memory_peak_mb,
         CASE WHEN min(l_quantity) <= 1.0 THEN 'error' ELSE 'success' END AS status,
         CASE WHEN min(l_quantity) <= 1.0 THEN 'visualization failed' END AS error,
         count(*) FILTER (l_quantity > 10) AS points_plotted, count(*) FILTER (l_quantity > 45) AS anomaly_points_plotted, count(*) AS n
  FROM lineitem GROUP BY 1, 2, 3),
j AS (
  SELECT p.dataset, p.processing_method, p.input_exists AND p.status = 'success' AS ok, NOT p.input_exists AS missing,
         p.processing_time_sec AS pt, p.processing_memory_peak_mb AS pm, p.error AS perr,
         v.visualization_method AS vm, v.visualization_time_sec, v.visualization_memory_peak_mb,
         v.status AS vstatus, v.error AS verr, p.input_file, p.output_file, p.rows_input, p.rows_after_cleaning, p.rows_output,
         p.objects, p.quarters, p.anomaly_rows, v.points_plotted, v.anomaly_points_plotted, v.n,
         v.status = 'success' AND (p.dataset <> 'N' OR vm <> 'matplotlib') AS drawn
  FROM p LEFT JOIN v ON p.dataset = v.dataset AND p.processing_method = v.processing_method
                      AND p.input_exists AND p.status = 'success'),
k AS (SELECT *, CASE WHEN ok AND vm IS NOT NULL THEN vm ELSE '' END AS viz FROM j)
SELECT dataset, processing_method, viz AS visualization_method,
       processing_method || ' +' || CASE WHEN viz <> '' THEN ' ' || viz ELSE '' END AS pair,
       round(CASE WHEN missing THEN NULL ELSE pt END, 6) AS processing_time_sec,
       round(CASE WHEN missing THEN NULL ELSE pm END, 6) AS processing_memory_peak_mb,
       round(visualization_time_sec, 6) AS visualization_time_sec,
       round(visualization_memory_peak_mb, 6) AS visualization_memory_peak_mb,
       round(CASE WHEN ok THEN round(pt + visualization_time_sec, 6) WHEN missing THEN NULL ELSE pt END, 6)
         AS total_time_sec,
       CASE WHEN ok AND vstatus = 'success' THEN 'success' ELSE 'error' END AS status,
       CASE WHEN ok THEN verr ELSE perr END AS error,
       CASE WHEN ok THEN input_file END AS input_file, CASE WHEN ok THEN output_file END AS output_file,
       CASE WHEN ok THEN rows_input::DOUBLE END AS rows_input, CASE WHEN ok THEN rows_after_cleaning::DOUBLE END AS rows_after_cleaning,
       CASE WHEN ok THEN rows_output::DOUBLE END AS rows_output, CASE WHEN ok THEN objects::DOUBLE END AS objects,
       CASE WHEN ok THEN quarters::DOUBLE END AS quarters, CASE WHEN ok THEN anomaly_rows::DOUBLE END AS anomaly_rows,
       CASE WHEN drawn THEN viz || '.out' END AS visualization_file,
       CASE WHEN drawn AND viz = 'dash' THEN 'meta.json' END AS visualization_metadata_file,
       CASE WHEN drawn THEN CASE WHEN viz = 'dash' THEN 'interactive_web_dashboard' ELSE 'chart' END END AS visualization_type,
       CASE WHEN drawn THEN points_plotted::DOUBLE END AS points_plotted, CASE WHEN drawn THEN anomaly_points_plotted::DOUBLE END AS anomaly_points_plotted,
       CASE WHEN drawn AND viz = 'dash' THEN n::DOUBLE END AS rows_before_downsample
FROM k"""

SQL["scan_run_metrics"] = f"WITH {RUN_METRICS}\nSELECT * FROM run_metrics"

# --- batch: ephemeris ----------------------------------------------------------------------------
EPH_JOIN = ",\n".join([OBS, clean_ctes(), EPHEMERIS]) + """,
je AS (SELECT c.*, e.base_flux, e.period, e.depth, e.duration FROM clean c LEFT JOIN ephemeris e
       ON c.object_id = e.object_id),
fold AS (
  SELECT *, (CASE WHEN "time" % period < 0 THEN (("time" % period) + period) % period ELSE "time" % period END)
            / period AS phase FROM je),
fold2 AS (SELECT *, phase < duration AS in_transit FROM fold),
fold3 AS (
  SELECT *, base_flux * (1.0 + 0.002 * sin(2.0 * pi() * "time" / period)
                         + CASE WHEN in_transit THEN -depth ELSE 0.0 END) AS model_flux FROM fold2)"""

SQL["join_ephemeris"] = f"""WITH {EPH_JOIN}
SELECT object_id, "time", flux, period, depth, duration, base_flux FROM je"""
SQL["phase_fold"] = f"""WITH {EPH_JOIN}
SELECT object_id, "time", round(phase, 6) AS phase FROM fold"""
SQL["transit_flag"] = f"""WITH {EPH_JOIN}
SELECT object_id, "time", in_transit FROM fold2"""
SQL["model_residual"] = f"""WITH {EPH_JOIN}
SELECT object_id, "time", round(model_flux, 6) AS model_flux, round(flux - model_flux, 6) AS model_residual
FROM fold3"""
SQL["quarter_from_time"] = f"""WITH {OBS},
{clean_ctes()}
SELECT object_id, "time" * 30.0 AS t,
       (((floor("time" * 30.0 / 90.0) % 18) + 18) % 18 + 1)::INT AS quarter FROM clean"""

# --- batch: sources and sinks ----------------------------------------------------------------------
FILES = OBS + """,
fo AS (SELECT *, object_id::INT AS u FROM obs),
ing AS (
  SELECT dataset, 'kplr' || lpad(u::VARCHAR, 9, '0') || '-q' || quarter::VARCHAR || '_llc.fits' AS source_file,
         CASE WHEN u % 4 = 3 OR (u = 0 AND u % 4 <> 1) THEN lpad(u::VARCHAR, 9, '0') ELSE object_id END
           AS object_id,
         CASE WHEN u % 4 = 2 THEN -1 ELSE quarter END AS quarter,
         "time", flux, CASE WHEN u % 4 = 3 THEN NULL ELSE flux_err END AS flux_err,
         CASE WHEN u % 4 = 3 THEN 0.0::DOUBLE ELSE quality END AS quality
  FROM fo WHERE NOT (u % 10 = 5 AND quarter = 3)),
bad AS (
  SELECT DISTINCT dataset, 'kplr' || lpad(u::VARCHAR, 9, '0') || '-q' || quarter::VARCHAR || '_llc.fits' AS file
  FROM fo WHERE u % 10 = 5 AND quarter = 3),
nfiles AS (SELECT dataset, count(*) AS fits_files FROM (SELECT DISTINCT dataset, object_id, quarter FROM obs)
           GROUP BY dataset)"""

SQL["ingest_light_curves"] = f"WITH {FILES}\nSELECT * FROM ing"
SQL["ingest_errors"] = f"WITH {FILES}\nSELECT dataset, file FROM bad"
SQL["header_fallback"] = f"WITH {FILES}\nSELECT DISTINCT source_file, object_id, quarter FROM ing"
SQL["file_inventory"] = f"""WITH {FILES}
SELECT dataset, fits_files, 'listed' AS status FROM nfiles
UNION ALL SELECT 'empty', 0, 'no_files'"""
SQL["resolve_columns"] = f"""WITH {OBS}
SELECT dataset, object_id, quarter, "time", flux, flux_err, quality FROM obs"""
SQL["conversion_summary"] = f"""WITH {FILES},
p0 AS (SELECT * FROM ing WHERE "time" IS NOT NULL AND flux IS NOT NULL),
p2 AS (SELECT *, COALESCE((flux - avg(flux) OVER o) / NULLIF(stddev_samp(flux) OVER o, 0), 0.0::DOUBLE) AS z
       FROM p0 WINDOW o AS (PARTITION BY object_id)),
st AS (SELECT dataset, count(*) AS rows, count(DISTINCT object_id) AS objects, count(DISTINCT quarter) AS quarters,
              sum((abs(z) > 3.0)::BIGINT)::BIGINT AS anomaly_rows FROM p2 GROUP BY dataset),
er AS (SELECT dataset, count(*) AS errors FROM bad GROUP BY dataset),
ds AS (SELECT dataset, fits_files FROM nfiles UNION ALL SELECT 'empty', 0)
SELECT ds.dataset, ds.fits_files::BIGINT AS fits_files, COALESCE(rows, 0)::BIGINT AS rows,
       COALESCE(objects, 0)::BIGINT AS objects, COALESCE(quarters, 0)::BIGINT AS quarters,
       COALESCE(anomaly_rows, 0)::BIGINT AS anomaly_rows,
       CASE WHEN ds.fits_files = 0 THEN 'no_files' WHEN st.dataset IS NULL THEN 'failed'
            WHEN COALESCE(errors, 0) > 0 THEN 'success_with_errors' ELSE 'success' END AS status
FROM ds LEFT JOIN st ON ds.dataset = st.dataset LEFT JOIN er ON ds.dataset = er.dataset"""
SQL["preview_head"] = f"""WITH {PREP}
SELECT object_id, quarter, "time", flux, round(flux_norm, 6) AS flux_norm FROM prep
ORDER BY object_id, quarter, "time" LIMIT 5000"""
SQL["union_parts"] = f"WITH {OBS}\nSELECT * FROM obs"

SQL["dashboard_query"] = f"""WITH {EX}
SELECT object_id, quarter, time_bin, {rounded("flux_norm, rolling_flux")}, is_anomaly FROM ex
WHERE object_id = (SELECT min(object_id) FROM ex)"""

# --- one object holding a third of all rows ------------------------------------------------------------
SKEW_OBS = OBS.replace("obs AS (", "obs0 AS (", 1) + """,
obs AS (SELECT * REPLACE (CASE WHEN object_id::INT % 3 = 0 THEN '0' ELSE object_id END AS object_id) FROM obs0)"""
SKEW_POINT = ",\n".join([SKEW_OBS, clean_ctes(), fill_cte("median", "good", "filled"), z_cte("filled", "z"),
                         point_ctes("z")])
SKEW_BIN = ",\n".join([SKEW_OBS, clean_ctes(), fill_cte("mean", "good", "filled"), z_cte("filled", "z"),
                       bin_ctes("z")])
SQL["process_point_skewed"] = f"WITH {SKEW_POINT}\n{POINT_SELECT}"
SQL["process_bin_skewed"] = f"WITH {SKEW_BIN}\n{BIN_SELECT}"

SQL["process_point_vectorized"] = SQL["process_point"]
SQL["process_bin_vectorized"] = SQL["process_bin"]

# --- constant series and infinite values --------------------------------------------------------------------
FLAT_OBS = OBS.replace("obs AS (", "obs0 AS (", 1) + """,
obs AS (SELECT * REPLACE (CASE WHEN flux IS NULL THEN flux WHEN object_id::INT % 5 = 0 THEN 1234.7::DOUBLE
                               WHEN object_id::INT % 7 = 3 AND quarter = 2 THEN 'Infinity'::DOUBLE ELSE flux END AS flux) FROM obs0)"""
# a series with an infinite value has no usable standard deviation: all of its z-scores are 0
FLAT_Z = """z AS (
  SELECT *, CASE WHEN bool_or(isinf(flux)) OVER o THEN 0.0::DOUBLE ELSE COALESCE(
           (flux - avg(CASE WHEN NOT isinf(flux) THEN flux END) OVER o)
           / NULLIF(stddev_samp(CASE WHEN NOT isinf(flux) THEN flux END) OVER o, 0), 0.0::DOUBLE) END AS flux_norm
  FROM filled WINDOW o AS (PARTITION BY object_id))"""
_FLAT = {"point": ",\n".join([FLAT_OBS, clean_ctes(), fill_cte("median", "good", "filled"), FLAT_Z, point_ctes("z")]) + "\n" + POINT_SELECT,
         "bin": ",\n".join([FLAT_OBS, clean_ctes(), fill_cte("mean", "good", "filled"), FLAT_Z, bin_ctes("z")]) + "\n" + BIN_SELECT}
for _mode, _sql in _FLAT.items():
    for _strategy in ("window", "vectorized", "blocked"):
        SQL[f"process_{_mode}_flat_{_strategy}"] = "WITH " + _sql

# --- written and read back; seeded sample ---------------------------------------------------------------------
SQL["sink_parquet"] = f"""WITH {PREP}
SELECT dataset, object_id, quarter, "time", flux FROM prep"""
SQL["discover_extracts"] = f"""WITH {BOTH_PIPES}
SELECT 'obs_point' AS dataset_key, count(*) AS rows FROM point_out
UNION ALL SELECT 'obs_bin', count(*) FROM bin_out"""
SQL["random_downsample"] = f"""WITH {EX},
hashed AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY md5(concat_ws(':', '42', object_id, quarter::VARCHAR,
             round(time_bin * 1e6)::BIGINT::VARCHAR)), quarter, time_bin) AS rk FROM ex)
SELECT object_id, quarter, time_bin FROM hashed WHERE rk <= 7"""
