"""Column expressions shared by the operators (all JVM-side built-ins)."""

from starlit.functions.expr import (  # noqa: F401
    as_double,
    bin_id,
    bin_time,
    nan_to_null,
    quality_ok,
    safe_zscore,
    split_pair,
)
