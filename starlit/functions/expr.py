"""Scalar column expressions.

Rule zero: NaN becomes NULL at the first touch, so no later aggregate or
comparison ever sees NaN (Spark's ``abs(NaN) > 3`` is true, ``mean`` of a
column holding NaN is NaN).  Everything here is a built-in expression and
stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    c = col_of(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def as_double(c, dtype: T.DataType | None = None) -> Column:
    """Numeric coercion: text that is not a number becomes NULL, NaN becomes NULL.

    ``try_cast`` instead of ``cast``: under ANSI mode a plain cast of bad text
    raises.
    """
    c = col_of(c)
    if isinstance(dtype, T.DoubleType):
        return nan_to_null(c)
    return nan_to_null(c.try_cast("double"))


def as_quarter(c) -> Column:
    """Quarter as int; missing or non-numeric -> -1 (applied before any grouping)."""
    return F.coalesce(col_of(c).try_cast("double").try_cast("int"), F.lit(-1))


def quality_ok(q) -> Column:
    """Good quality = the flag truncated to a whole number is 0 (0.5 and -0.9 pass)."""
    return F.coalesce(col_of(q).try_cast("long") == 0, F.lit(False))


def safe_zscore(x, mean, std) -> Column:
    """(x - mean) / std, 0.0 where std is NULL (single row), NaN (an infinite value) or 0."""
    return F.coalesce(F.try_divide(col_of(x) - col_of(mean), usable_std(std)), F.lit(0.0))


def usable_std(std) -> Column:
    """A standard deviation to divide by or compare with: NULL where it is NaN or 0."""
    return F.nullif(nan_to_null(std), F.lit(0.0))


def bin_id(time, width: float) -> Column:
    """Integer time-bin index floor(time / width); group on this, never on the float bin."""
    return F.floor(col_of(time) / F.lit(float(width)))


def bin_time(bid, width: float) -> Column:
    """Left edge of the bin, floor(time / width) * width, as double."""
    return col_of(bid) * F.lit(float(width))


# Whitespace removed around pair parts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITESPACE = " \t\n\x0b\x0c\r"


def strip(c) -> Column:
    """Remove leading/trailing whitespace (not only spaces); character-set trim, no regex."""
    return F.trim(col_of(c), F.lit(WHITESPACE))


def split_pair(pair) -> tuple[Column, Column]:
    """'Pandas + Dash' -> ('pandas', 'dash'); not exactly two parts -> (whole, ''); NULL -> ('', '')."""
    pair = col_of(pair)
    two = (F.length(pair) - F.length(F.translate(pair, "+", ""))) == 1     # exactly one '+'
    first = F.when(pair.isNull(), F.lit("")).when(two, F.lower(strip(F.substring_index(pair, "+", 1)))) \
        .otherwise(F.lower(strip(pair)))
    second = F.when(pair.isNull(), F.lit("")).when(two, F.lower(strip(F.substring_index(pair, "+", -1)))) \
        .otherwise(F.lit(""))
    return first, second


def fixed(c, digits: int, missing: str = "no data") -> Column:
    """Fixed-point text ('%.6f' / '%.3f') with a marker for missing values. The value is rounded to a whole number of
    last digits first, so that its text doesn't depend on how a formatter rounds decimal expansions."""
    c = col_of(c)
    # format_string renders NULL as the text 'null', so test for it first
    return F.when(c.isNull(), F.lit(missing)).otherwise(F.format_string(f"%.{digits}f", round_scaled(c, digits)))


def thousands(c) -> Column:
    """Integer with thousands separators ('12,345')."""
    return F.format_number(col_of(c), 0)


def round_scaled(c, digits: int) -> Column:
    """round(c, digits) as round(c * 10^digits) / 10^digits, half away from zero.

    Spark's own round on doubles rounds the decimal text of the value, so
    0.2522155 (stored as 0.25221549999...) becomes 0.252216; scaling first keeps
    such values on the side their binary value lies on, the same rule SQL
    engines such as DuckDB apply.
    """
    scale = F.lit(float(10 ** digits))
    return F.round(col_of(c) * scale, 0) / scale


# --- SQL-text forms -----------------------------------------------------------------------------
# The same expressions as SQL text: a projection of many columns is then one call into
# the JVM instead of several per function, which keeps plan construction cheap.
# Double literals carry the D suffix (a bare 1.0 is a DECIMAL in Spark SQL).

def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_nan_to_null(e: str) -> str:
    return f"nanvl({e}, CAST(NULL AS DOUBLE))"


def sql_as_double(name: str, dtype: T.DataType) -> str:
    if isinstance(dtype, T.DoubleType):
        return sql_nan_to_null(q(name))
    return sql_nan_to_null(f"try_cast({q(name)} AS DOUBLE)")


def sql_as_quarter(name: str) -> str:
    return f"coalesce(try_cast(try_cast({q(name)} AS DOUBLE) AS INT), -1)"


def sql_round(e: str, digits: int) -> str:
    scale = f"{float(10 ** digits)!r}D"
    return f"(round(({e}) * {scale}, 0) / {scale})"


def select_sql(df, columns: dict[str, str]):
    """Project ``{output name: SQL expression}`` in one call."""
    return df.selectExpr(*[f"{e} AS {q(n)}" for n, e in columns.items()])


def with_sql(df, columns: dict[str, str]):
    """Add or replace columns given as SQL text, keeping the column order."""
    out = {c: q(c) for c in df.columns}
    out.update(columns)
    return select_sql(df, out)


# The same whitespace set as SQL text for trim(BOTH ... FROM ...).
WHITESPACE_SQL = "' \\t\\n\\u000B\\u000C\\r'"


def with_split_pair(df, pair: str, first: str, second: str):
    """Add the two parts of a 'processing + visualisation' pair text (rules as ``split_pair``);
    the split is computed once in its own projection."""
    tmp = "_pair_parts"
    parts = with_sql(df, {tmp: f"split({q(pair)}, '[+]', -1)"})
    t = lambda e: f"lower(trim(BOTH {WHITESPACE_SQL} FROM {e}))"
    return with_sql(parts, {
        first: f"CASE WHEN {q(pair)} IS NULL THEN '' WHEN size({tmp}) = 2 THEN {t(tmp + '[0]')} "
               f"ELSE {t(q(pair))} END",
        second: f"CASE WHEN {q(pair)} IS NULL THEN '' WHEN size({tmp}) = 2 THEN {t(tmp + '[1]')} ELSE '' END",
    }).drop(tmp)
