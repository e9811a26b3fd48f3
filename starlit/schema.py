"""Table schemas and pipeline parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values that the results depend on (defaults of the light-curve pipeline):
#   time bin width 0.05 days, z threshold 3.0, rolling window 25 rows,
#   rolling min_periods 3, dashboard limit 50,000 points (1,000 minimum per object),
#   chart limits 5,000 (static) and 10,000 (interactive) points, random seed 42.
DEFAULT_BIN_WIDTH = 0.05
DEFAULT_Z_THRESHOLD = 3.0
DEFAULT_WINDOW = 25
DEFAULT_MIN_PERIODS = 3
DASH_MAX_POINTS = 50_000
DASH_MIN_PER_OBJECT = 1_000
STATIC_CHART_MAX_POINTS = 5_000
INTERACTIVE_CHART_MAX_POINTS = 10_000
SAMPLE_SEED = 42

# Column names and order of the inputs and outputs (this list, EXTRACT_COLUMNS, RUN_METRICS and
# RUN_METRICS_REQUIRED below).
REQUIRED_PIPELINE_COLUMNS = ["object_id", "time", "flux", "flux_err", "quality"]
NUMERIC_COLUMNS = ["time", "flux", "flux_err", "quality"]


@dataclass(frozen=True)
class Params:
    """Knobs of the clean -> normalise -> bin -> trend -> flag lightcurve."""

    bin_width: float = DEFAULT_BIN_WIDTH
    z_threshold: float = DEFAULT_Z_THRESHOLD
    window: int = DEFAULT_WINDOW
    min_periods: int = DEFAULT_MIN_PERIODS
    # Objects with more rows than this are trended by the skew-safe blocked
    # window (ordinals + halo rows) instead of one window partition per object.
    hot_object_rows: int = 2_000_000
    # Rows per block of the blocked window.
    block_rows: int = 200_000
    # From this many rows on, ``auto`` computes the per-object trend in one vectorised
    # pass per partition (NumPy over Arrow batches) instead of the window operator,
    # whose framed median rebuilds an aggregation buffer for every row.
    vectorize_rows: int = 1_000_000
    # Target rows per partition of the hot-object path (range partitions and block partitions).
    range_rows: int = 5_000_000

    @property
    def half_window(self) -> int:
        return self.window // 2


OBSERVATIONS = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("object_id", T.StringType()),
    T.StructField("quarter", T.IntegerType()),
    T.StructField("time", T.DoubleType()),
    T.StructField("flux", T.DoubleType()),
    T.StructField("flux_err", T.DoubleType()),
    T.StructField("quality", T.DoubleType()),
])

PREPARED = T.StructType(OBSERVATIONS.fields + [
    T.StructField("flux_norm", T.DoubleType()),
    T.StructField("is_anomaly", T.BooleanType()),
])

# Columns of the dashboard extract, in output order.
EXTRACT_COLUMNS = [
    "dataset", "object_id", "quarter", "time_bin", "flux_norm", "rolling_flux",
    "flux_err", "points_count", "anomaly_count", "is_anomaly", "processing_method",
]

RUN_METRICS = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("processing_method", T.StringType()),
    T.StructField("visualization_method", T.StringType()),
    T.StructField("pair", T.StringType()),
    T.StructField("processing_time_sec", T.DoubleType()),
    T.StructField("processing_memory_peak_mb", T.DoubleType()),
    T.StructField("visualization_time_sec", T.DoubleType()),
    T.StructField("visualization_memory_peak_mb", T.DoubleType()),
    T.StructField("total_time_sec", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("input_file", T.StringType()),
    T.StructField("output_file", T.StringType()),
    T.StructField("rows_input", T.LongType()),
    T.StructField("rows_after_cleaning", T.LongType()),
    T.StructField("rows_output", T.LongType()),
    T.StructField("objects", T.LongType()),
    T.StructField("quarters", T.LongType()),
    T.StructField("anomaly_rows", T.LongType()),
    T.StructField("visualization_file", T.StringType()),
    T.StructField("visualization_metadata_file", T.StringType()),
    T.StructField("visualization_type", T.StringType()),
    T.StructField("points_plotted", T.LongType()),
    T.StructField("anomaly_points_plotted", T.LongType()),
    T.StructField("rows_before_downsample", T.LongType()),
])

RUN_METRICS_REQUIRED = [
    "dataset", "pair", "processing_time_sec", "visualization_time_sec",
    "total_time_sec", "processing_memory_peak_mb", "status",
]

EPHEMERIS = T.StructType([
    T.StructField("object_id", T.StringType()),
    T.StructField("base_flux", T.DoubleType()),
    T.StructField("period", T.DoubleType()),
    T.StructField("depth", T.DoubleType()),
    T.StructField("duration", T.DoubleType()),
])


def require_columns(df_columns, required, what="input") -> None:
    """Raise ValueError naming every missing column (checked before any job runs)."""
    missing = [c for c in required if c not in df_columns]
    if missing:
        raise ValueError(
            f"{what} lacks {', '.join(missing)}; its columns are {', '.join(map(str, df_columns)) or 'none'}"
        )
