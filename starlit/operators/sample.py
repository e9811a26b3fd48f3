"""Downsampling of per-object series for charts and dashboards.

The even downsample keeps exactly the rows NumPy's ``linspace`` would index, a predicate over positions in the
series; long series get their positions from range partitions instead of one sorted window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlit.operators.positions import positions
from starlit.schema import Params

HOT_ROWS = Params().hot_object_rows
SERIES_ORDER = ["time_bin", "quarter"]


def _as_col(k) -> Column:
    return k if isinstance(k, Column) else F.lit(int(k))


def even_keep(r: Column, n: Column, k) -> Column:
    """Is 0-based position r among int(linspace(0, n - 1, k)) when n > k (all rows when n <= k)?

    step = (n-1)/(k-1) in double arithmetic; position r is hit by index i when
    floor(i * step) == r, and only i in {floor(r/step), floor(r/step) + 1} can.
    The last index is exactly n - 1; k = 1 keeps only the first row.
    """
    k = _as_col(k)
    step = (n - 1).cast("double") / F.greatest(k - 1, F.lit(1)).cast("double")
    i0 = F.floor(r.cast("double") / step)
    hit = lambda i: (i <= k - 2) & (F.floor(i.cast("double") * step) == r)
    return (n <= k) | ((k == 1) & (r == 0)) | ((k >= 2) & ((r == n - 1) | hit(i0) | hit(i0 + 1)))


def even_downsample(df: DataFrame, k, key: str = "object_id", order=SERIES_ORDER, strategy: str = "auto",
                    hot_rows: int = HOT_ROWS, most: int | None = None) -> DataFrame:
    """Evenly spaced downsample of every key's series to at most k rows. A series with more than ``hot_rows`` rows is
    numbered over range partitions, never sorted in one task (see ``positions``)."""
    p = positions(df, key, list(order), "_r", "_n", strategy, hot_rows, most)
    return p.filter(even_keep(F.col("_r"), F.col("_n"), k)).drop("_r", "_n")


def downsample_by_object(df: DataFrame, max_points: int, min_per_object: int = 1000, key: str = "object_id",
                         order=SERIES_ORDER, strategy: str = "auto", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Dashboard reduction: only when the table has more than max_points rows, every object is
    evenly downsampled to max(min_per_object, max_points // n_objects) rows. One count per object decides all of
    it: a table within the limit is returned as it is."""
    per = df.groupBy(F.col(key).cast("string").alias(key)).agg(F.count(F.lit(1)).alias("n"))
    facts = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count("*").alias("k")).first()
    if facts["n"] <= max_points:
        return df
    limit = max(min_per_object, max_points // max(facts["k"], 1))
    if facts["most"] <= limit:
        return df
    return even_downsample(df, limit, key, order, strategy, hot_rows, facts["most"])


def random_downsample(df: DataFrame, k: int, seed: int = 42, key: str = "object_id",
                      ident=("quarter", "time_bin"), salts: int = 64) -> DataFrame:
    """Exactly min(n, k) rows per key, chosen by a seeded hash of the row identity.

    Deterministic and independent of partitioning (a hash rank, not a sampler
    state); it cannot reproduce NumPy's generator, only its contract. Identity columns enter the hash as
    integers, fractional ones in millionths. The best k of each of ``salts`` shares of a key are found first,
    so the final ranking of a hot key sees at most ``salts * k`` rows.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    whole = lambda c: F.round(F.col(c) * 1e6).cast("long") if isinstance(types[c], T.FractionalType) else F.col(c)
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), *[whole(c).cast("string") for c in ident]))
    ranked = df.withColumn("_h", h).withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(salts)))
    share = Window.partitionBy(key, "_salt").orderBy("_h", *ident)
    best = ranked.withColumn("_rk", F.row_number().over(share)).filter(F.col("_rk") <= k)
    w = Window.partitionBy(key).orderBy("_h", *ident)
    return best.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k).drop("_rk", "_h", "_salt")
