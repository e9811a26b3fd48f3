"""Sharding by a Hilbert curve over document metadata.

Source, language and size are quantised to ``BITS`` bits each (equal-depth, so every level holds about the
same number of rows), combined into one curve index, and the rows, ordered along the curve, are cut into
runs. Neighbours on the curve are close in all three dimensions, so each shard covers a compact box of
metadata and a filter on any of the three prunes shards and row groups by min/max statistics.

Rows get their exact position along the curve without a global sort: cells (curve indices, at most
``2**(3*BITS)``) are counted, cells with many rows are split into sub-cells by a hash of the id, and a row's
position is the number of rows in earlier cells and sub-cells plus its row number inside its own sub-cell.
The shuffle carries ids, sizes and checksums, never texts; no task holds more than one sub-cell of a few
``sqrt(rows)`` rows, however hot one source is.

Defined results: a null text has size 1 and the checksum of no bytes; null or missing metadata is a level of
its own, before all others; equal rows are interchangeable; an empty table gives no rows; other columns are
ignored by ``assign_shards`` and kept by ``write_shards``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from starlit.llm.common import add_missing, stash

BITS = 5
SHARDS = 8


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """(digit, next state) of the n-dimensional Hilbert curve's automaton, indexed by state * 2**n + cell bits.
    A state is (rotation d, entry corner e); digits follow the Gray code of the sub-cells."""
    full = 1 << n
    mask = full - 1

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    inverse = {gray(i): i for i in range(full)}

    def turn(x: int, k: int) -> int:  # rotate left
        k %= n
        return ((x << k) | (x >> (n - k))) & mask

    def axis(w: int) -> int:
        if w == 0:
            return 0
        i = w if w % 2 else w - 1
        ones = 0
        while i & 1:
            ones, i = ones + 1, i >> 1
        return ones % n

    digit, nxt = [], []
    for d in range(n):
        for e in range(full):
            for cell in range(full):
                w = inverse[turn(cell ^ e, n - (d + 1) % n)]
                entry = 0 if w == 0 else gray(2 * ((w - 1) // 2))
                e2 = e ^ turn(entry, d + 1)
                d2 = (d + axis(w) + 1) % n
                digit.append(w)
                nxt.append(d2 * full + e2)
    return digit, nxt


def curve_index(dims: list[str], bits: int = BITS) -> Column:
    """Hilbert index of integer columns in ``[0, 2**bits)``: one automaton step per bit level."""
    n = len(dims)
    digit, nxt = curve_tables(n)
    cell = " | ".join(f"shiftleft(cast(shiftright({c}, b) & 1 as int), {n - 1 - k})" for k, c in enumerate(dims))
    at = f"acc.s * {1 << n} + ({cell})"
    arr = lambda xs: "array(" + ",".join(map(str, xs)) + ")"
    return F.expr(
        f"aggregate(sequence({bits - 1}, 0, -1), named_struct('h', 0L, 's', 0), (acc, b) -> named_struct("
        f"'h', acc.h * {1 << n} + get({arr(digit)}, {at}), 's', get({arr(nxt)}, {at})), acc -> acc.h)")


def _levels(df: DataFrame, column: str, out: str, bits: int) -> DataFrame:
    """Equal-depth levels of a metadata column: where the middle of the value's rows lies in code point order.
    Works on one row per distinct value."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    order = Window.orderBy(F.col(column).asc_nulls_first())
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy())
    level = F.floor((before + F.col("_n") / 2) * (1 << bits) / total).cast("int")
    return counts.select(F.col(column).alias(f"_{column}"), F.least(level, F.lit((1 << bits) - 1)).alias(out))


def assign_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, cell (curve index), position (exact rank along the
    curve), shard and slot. Shards are runs of the curve whose row counts differ by at most one."""
    docs = add_missing(docs, doc_id="bigint", text="string", lang="string", source="string")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = stash(docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "shard-meta")
    n_cuts = (1 << bits) - 1
    facts = base.agg(F.count("*").alias("n"), F.percentile_approx(
        "size", [(i + 1) / (n_cuts + 1) for i in range(n_cuts)], 10_000).alias("cuts")).first()
    total, cuts = facts["n"], sorted(set(facts["cuts"] or []))
    size_level = "size(filter(array(" + ",".join(f"{c}L" for c in cuts) + "), c -> c < size))" if cuts else "0"

    levelled = (base
                .join(_levels(base, "source", "q_source", bits), F.col("source").eqNullSafe(F.col("_source")))
                .join(_levels(base, "lang", "q_lang", bits), F.col("lang").eqNullSafe(F.col("_lang")))
                .withColumn("q_size", F.expr(size_level).cast("int")))
    placed = stash(levelled.select("doc_id", "size", "text_crc32",
                                   curve_index(["q_source", "q_lang", "q_size"], bits).alias("cell")), "shard-cells")

    # rows per sub-cell grow with the square root of the table: neither sub-cells nor their number gets large
    room = max(1024, 8 * math.isqrt(total))
    cells = placed.groupBy("cell").agg(F.count("*").alias("cell_rows")).select(
        "cell", F.ceil(F.col("cell_rows") / room).cast("int").alias("subs"))
    # at most 2**(3*bits) rows whatever the input: a fixed size bound
    split = placed.join(F.broadcast(cells), "cell").withColumn(
        "sub", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("subs").cast("long")).cast("int")).drop("subs")
    counts = split.groupBy("cell", "sub").agg(F.count("*").alias("sub_rows"))
    in_cell = Window.partitionBy("cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_start = counts.groupBy("cell").agg(F.sum("sub_rows").alias("rows")).select(
        "cell", F.coalesce(F.sum("rows").over(along), F.lit(0)).alias("cell_start"))
    starts = counts.withColumn("sub_start", F.coalesce(F.sum("sub_rows").over(in_cell), F.lit(0))).join(
        cell_start, "cell").select("cell", "sub", (F.col("cell_start") + F.col("sub_start")).alias("start"))

    own = Window.partitionBy("cell", "sub").orderBy("doc_id", "text_crc32", "size")
    ranked = split.join(starts, ["cell", "sub"]).withColumn(
        "position", F.col("start") + F.row_number().over(own) - 1)
    shard = F.expr(f"(position * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {max(total, 1)} + {shards - 1}) div {shards}")  # first position of the shard
    return (ranked.withColumn("shard", shard.cast("int"))
            .withColumn("slot", (F.col("position") - first).cast("long"))
            .select("doc_id", "size", "text_crc32", "cell", F.col("position").cast("long"), "shard", "slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bits: int = BITS) -> None:
    """Write whole documents as Parquet, one folder ``<shard column>=<n>`` per shard, each file ordered along the curve so
    that row groups carry tight min/max statistics. Equal (doc_id, checksum) rows share their shard and slot range. All
    of the caller's columns are kept; the shard column is ``shard``, with as many underscores after it as it takes to
    be none of them."""
    free = max((len(c) for c in docs.columns), default=0) * "_"  # longer than any name of the caller's
    names = {c: f"{free}_{c}" for c in ("id", "crc", "found_id", "found_crc", "position")}
    shard = "shard"
    while shard.lower() in {c.lower() for c in docs.columns}:
        shard += "_"
    plan = assign_shards(docs, shards, bits).groupBy("doc_id", "text_crc32").agg(
        F.min("shard").alias(shard), F.min("position").alias(names["position"]))
    plan = plan.select(F.col("doc_id").alias(names["found_id"]), F.col("text_crc32").alias(names["found_crc"]), shard, names["position"])
    own = add_missing(docs, doc_id="bigint", text="string").select(
        *docs.columns, F.col("doc_id").cast("bigint").alias(names["id"]), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias(names["crc"]))
    joined = own.join(plan, F.col(names["id"]).eqNullSafe(F.col(names["found_id"])) & (F.col(names["crc"]) == F.col(names["found_crc"])))
    # sorted by shard first, as the writer asks, so that it doesn't sort again and the order along the curve stays
    ordered = joined.repartitionByRange(shard, names["position"]).sortWithinPartitions(shard, names["position"])
    ordered.select(*docs.columns, shard).write.partitionBy(shard).parquet(path)


def op7_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    from starlit.llm.common import table
    out = assign_shards(table(spark, sf_dir, "documents"))
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))
