"""Positions of rows in the sorted series of their key, without a task that holds one whole key.

Rows are range partitioned on (keys, order) and sorted inside partitions, so a key with a third of all rows is spread
over as many partitions as its rows fill. Every row is numbered inside its partition as it is written
(``monotonically_increasing_id`` counts a partition's rows in order; the written table freezes the numbers). One
small aggregate, a row per key and partition, then says where each key starts in a partition and how many of its rows
lie in partitions before: a row's position is a subtraction and an addition, and its key's total is known with it.

Rows that are equal in keys and order share a run of positions in an arbitrary but fixed order. Null keys are a key,
null order values sort as the given columns say. No Python runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlit.sources.scratch import written

ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number in the partition below
BROADCAST_SPANS = 200_000


@dataclass
class Placed:
    """rows: the table with ``_part`` and ``_at`` (number in the partition), in written order.
    spans: keys, ``_part``, ``_first`` (``_at`` of the key's first row), ``_rows`` (in this partition), ``_before``
    (of the key, in partitions before) and ``_total`` (of the key)."""

    rows: DataFrame
    spans: DataFrame
    keys: list[str]

    def positions(self, position: str = "position", total: str = "total") -> DataFrame:
        """The rows with their 0-based position in their key's series and the key's number of rows."""
        spans = self.spans.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(self.keys)],
                                  F.col("_part").alias("_p"), "_first", "_before", "_total")
        same = F.col("_part") == F.col("_p")
        for n, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
        names = [c for c in self.rows.columns if c not in ("_part", "_at")]
        if spans.count() <= BROADCAST_SPANS:  # a row per key and partition; beyond the bound both sides shuffle
            spans = F.broadcast(spans)
        return self.rows.join(spans, same).select(
            *names, (F.col("_before") + F.col("_at") - F.col("_first")).alias(position), F.col("_total").alias(total))


def place(df: DataFrame, keys: list[str], order: list[Column | str], partitions: int | None = None) -> Placed:
    """Range partition, sort, number and write ``df``; ``partitions`` defaults to the session's (AQE may merge them)."""
    by = [*[F.col(k).asc_nulls_first() for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order]]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    rows = written(ranged.sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "placed")
    rows = rows.select(*df.columns, F.shiftright("_id", ROW_BITS).alias("_part"),
                       F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_at"))
    per = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    spans = per.select(
        *keys, "_part", "_first", "_rows",
        F.coalesce(F.sum("_rows").over(key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(key).alias("_total"))
    return Placed(rows, written(spans, "spans"), keys)


def in_order(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` in one total order over its partitions, for sinks: every file is sorted and files follow one another."""
    by = [F.col(c) for c in order]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by)


def positions(df: DataFrame, key: str, order: list[Column | str], position: str = "position", total: str = "total",
              strategy: str = "auto", hot_rows: int = 2_000_000, most: int | None = None) -> DataFrame:
    """The rows with their 0-based position in their key's series and its number of rows. ``window`` sorts a key in
    one task, ``ranked`` goes by range partitions; ``auto`` takes the window while no key has more than ``hot_rows``
    rows (``most``: rows of the largest key, if known). Both number rows alike, but for ties in ``order``."""
    if strategy == "auto":
        if most is None:
            most = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        strategy = "window" if most <= hot_rows else "ranked"
    if strategy == "ranked":
        return place(df, [key], order).positions(position, total)
    if strategy != "window":
        raise ValueError(f"unknown strategy: {strategy}")
    own = Window.partitionBy(key)
    return df.withColumns({position: (F.row_number().over(own.orderBy(*order)) - 1).cast("long"), total: F.count(F.lit(1)).over(own)})
