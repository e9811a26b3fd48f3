"""Centered rolling-median trend, residuals and residual outliers.

z-scores, residual standard deviations and flags are Spark aggregates in every strategy, so the strategies
differ only in how the framed median is computed:

* ``window`` - one window partition per object (one exchange on object_id;
  z-score, rolling median and residual std all reuse it); all in the JVM.
* ``vectorized`` - rows are repartitioned by object (an explicit exchange, whatever the input's partitioning)
  and sorted; one ``mapInArrow`` pass per partition computes the framed medians with NumPy (the window
  operator rebuilds a buffer for every row).
* ``blocked`` - for hot objects: exact row ordinals within the object
  (range partitioning over the full sort key + per-partition offsets), then
  fixed-size blocks of ``block_rows`` rows with the ``window // 2`` neighbouring
  rows of each adjacent block copied in as halo, so every partition is bounded
  no matter how many rows one object has.

``auto`` routes objects with more than ``hot_object_rows`` rows to ``blocked`` and the rest to
``vectorized`` for inputs of ``vectorize_rows`` rows or more, else ``window``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlit.functions.expr import usable_std
from starlit.schema import Params


SLIDING_FROM = 101  # rows of a frame from which sliding costs less than sorting every frame


def frame_bounds(window: int) -> tuple[int, int]:
    """Rows before / after the current row of a centered window (pandas convention)."""
    after = (window - 1) // 2
    return window - 1 - after, after


def _outlier(residual: Column, std: Column, z: float) -> Column:
    return F.coalesce(F.abs(residual) > F.lit(float(z)) * usable_std(std), F.lit(False))


def _framed_median(value: str, w, params: Params) -> Column:
    """Median of the frame where it holds at least min_periods values, else the value itself."""
    return F.coalesce(_median_of(value, w, params), F.col(value))


def _median_of(value: str, w, params: Params) -> Column:
    return F.when(F.count(value).over(w) >= params.min_periods, F.percentile(value, 0.5).over(w))


def rolling_median(df: DataFrame, params: Params, value: str, key: str, order: list[str],
                   out: str = "rolling_median") -> DataFrame:
    """The centered rolling median itself, NULL where the frame holds fewer than min_periods values."""
    before, after = frame_bounds(params.window)
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-before, after)
    return df.withColumn(out, _median_of(value, w, params))


def trend_window(df: DataFrame, params: Params, value: str, key: str, order: list[str],
                 with_zscore_of: str | None = None) -> DataFrame:
    """All per-object windows on one partitioning and one sort order (one exchange, one sort)."""
    from starlit.functions.expr import q, with_sql

    before, after = frame_bounds(params.window)
    head = f"PARTITION BY {q(key)} ORDER BY {', '.join(q(c) for c in order)}"
    whole = f"({head} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    frame = f"({head} ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    v = q(value)
    if with_zscore_of:
        x = q(with_zscore_of)
        df = with_sql(df, {value: f"coalesce(try_divide({x} - avg({x}) OVER {whole}, "
                                  f"nullif(nanvl(stddev_samp({x}) OVER {whole}, CAST(NULL AS DOUBLE)), 0.0D)), 0.0D)"})
    df = with_sql(df, {"rolling_flux": f"coalesce(CASE WHEN count({v}) OVER {frame} >= {int(params.min_periods)} "
                                       f"THEN percentile({v}, 0.5D) OVER {frame} END, {v})"})
    resid = f"({v} - rolling_flux)"
    z = f"{float(params.z_threshold)!r}D"
    return with_sql(df, {
        "residual": resid,
        "residual_outlier": f"coalesce(abs({resid}) > {z} * nullif(nanvl(stddev_samp({resid}) OVER {whole}, "
                            "CAST(NULL AS DOUBLE)), 0.0D), false)",
    })


def framed_medians(keys, v, before: int, after: int, min_periods: int):
    """Centered rolling medians on rows sorted by (key, order) that hold whole objects (NumPy, vectorised).

    ``keys``: boolean array, True where a new object starts (index 0 included); ``v``: the series, NaN where
    missing.  The median over at most before + 1 + after rows of the object, the value itself where fewer than
    min_periods values are there; of an even count it is 0.5 * a + 0.5 * b, as in Spark's percentile.  Short frames
    are sorted side by side; from SLIDING_FROM rows on the frame is kept sorted while it slides.
    """
    import numpy as np

    if before + 1 + after >= SLIDING_FROM:
        return _sliding_medians(keys, v, before, after, min_periods)

    starts = np.flatnonzero(keys)
    n = len(keys)
    ends = np.r_[starts[1:], n]
    obj = np.repeat(np.arange(len(starts)), ends - starts)
    rolling = np.empty(n)
    first, last = starts[obj], ends[obj]
    offsets = np.arange(-before, after + 1)
    step = max(1, 2_000_000 // len(offsets))             # bound the n x window matrix
    for a0 in range(0, n, step):
        a1 = min(n, a0 + step)
        idx = np.arange(a0, a1)[:, None] + offsets[None, :]
        inside = (idx >= first[a0:a1, None]) & (idx < last[a0:a1, None])
        frame = np.where(inside, v[np.clip(idx, 0, n - 1)], np.nan)
        held = (~np.isnan(frame)).sum(axis=1)
        frame.sort(axis=1)                               # NaN, the missing, sorts behind infinity
        low = np.take_along_axis(frame, np.maximum((held - 1) // 2, 0)[:, None], axis=1)[:, 0]
        high = np.take_along_axis(frame, (held // 2).clip(0, len(offsets) - 1)[:, None], axis=1)[:, 0]
        with np.errstate(invalid="ignore"):
            median = np.where(low == high, low, 0.5 * low + 0.5 * high)
        rolling[a0:a1] = np.where((held >= min_periods) & (held > 0), median, v[a0:a1])
    return rolling


def _sliding_medians(keys, v, before: int, after: int, min_periods: int):
    """``framed_medians`` by one sorted frame per object: a row's step takes one value out and puts one in by binary
    search, so the cost of a row hardly follows the frame's length."""
    from bisect import bisect_left, insort

    import numpy as np

    starts = np.flatnonzero(keys)
    out = v.copy()
    for first, last in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
        series, frame = v[first:last].tolist(), []
        for x in series[:after]:
            if x == x:
                insort(frame, x)
        for i in range(len(series)):
            if i + after < len(series) and (x := series[i + after]) == x:
                insort(frame, x)
            if i > before and (x := series[i - before - 1]) == x:
                del frame[bisect_left(frame, x)]
            held = len(frame)
            if held and held >= min_periods:
                low, high = frame[(held - 1) // 2], frame[held // 2]
                out[first + i] = low if low == high else 0.5 * low + 0.5 * high
    return out


def _median_batches(key, value: str, params: Params, out_names: list[str]):
    """mapInArrow body: rows arrive sorted by (key, order); an object cut by a batch boundary is
    carried into the next batch so each object is processed whole.  String columns stay Arrow
    arrays; only the numeric columns are viewed as NumPy."""
    before, after = frame_bounds(params.window)
    keys = [key] if isinstance(key, str) else list(key)

    def compute(rb):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        n = rb.num_rows
        starts = np.zeros(n, dtype=bool)
        starts[0] = True
        if n > 1:
            for name in keys:
                k = rb.column(name)
                starts[1:] |= np.asarray(pc.fill_null(pc.not_equal(k.slice(1), k.slice(0, n - 1)), True))
        v = rb.column(value).to_numpy(zero_copy_only=False).astype("float64")
        rolling = framed_medians(starts, v, before, after, params.min_periods)
        cols = {name: rb.column(name) for name in rb.schema.names}
        cols["rolling_flux"] = pa.array(rolling, type=pa.float64(), mask=np.isnan(rolling))
        return pa.RecordBatch.from_arrays([cols[c] for c in out_names], names=out_names)

    def run(batches):
        import pyarrow as pa

        pending: list = []          # batches of a group that may continue in the next batch

        def row_key(rb, i):
            return tuple(rb.column(name)[i].as_py() for name in keys)

        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            tail = row_key(rb, n - 1)
            if pending and row_key(rb, 0) == tail and row_key(pending[-1], pending[-1].num_rows - 1) == tail:
                pending.append(rb)  # the whole batch continues the pending group: no copy yet
                continue
            rb = pa.Table.from_batches(pending + [rb]).combine_chunks().to_batches()[0] if pending else rb
            n = rb.num_rows
            lo, hi = 0, n - 1
            while lo < hi:          # first row of the last group (rows are sorted)
                mid = (lo + hi) // 2
                if row_key(rb, mid) == tail:
                    hi = mid
                else:
                    lo = mid + 1
            pending = [rb.slice(lo)]
            if lo:
                yield compute(rb.slice(0, lo))
        if pending:
            rest = pa.Table.from_batches(pending).combine_chunks().to_batches()[0]
            if rest.num_rows:
                yield compute(rest)

    return run


def vectorized_rolling(df: DataFrame, params: Params, value: str, key, order: list[str],
                       partitions: int | None = None) -> DataFrame:
    """Adds rolling_flux.  The rows are repartitioned by the key here, always: mapInArrow requires no
    distribution of its own, so none of an earlier operator is relied on.  ``key`` may be a list: each
    distinct combination is a series."""
    from pyspark.sql import types as T

    keys = [key] if isinstance(key, str) else list(key)
    schema = T.StructType([f for f in df.schema.fields if f.name != "rolling_flux"]
                          + [T.StructField("rolling_flux", T.DoubleType())])
    ready = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    ready = ready.sortWithinPartitions(*keys, *order)
    return ready.mapInArrow(_median_batches(keys, value, params, schema.names), schema)


def with_residuals(rolled: DataFrame, params: Params, value: str, key: str) -> DataFrame:
    """residual and residual_outlier from rolling_flux: one aggregate per object, joined back."""
    rolled = rolled.withColumn("residual", F.col(value) - F.col("rolling_flux"))
    rstd = rolled.groupBy(key).agg(F.stddev_samp("residual").alias("_rstd"))
    return rolled.join(rstd, key, "left") \
        .withColumn("residual_outlier", _outlier(F.col("residual"), F.col("_rstd"), params.z_threshold)) \
        .drop("_rstd")


def trend_vectorized(df: DataFrame, params: Params, value: str, key: str, order: list[str],
                     with_zscore_of: str | None = None) -> DataFrame:
    """Same answer as ``trend_window``: only the framed median is computed in Arrow batches.  The rolled rows are
    written once to the shared checkpoint folder, because the residual aggregate and the join both read them."""
    from starlit.operators.normalize import zscore
    from starlit.session import ensure_checkpoint_dir

    if with_zscore_of:
        df = zscore(df, with_zscore_of, value, key, strategy="join")
    ensure_checkpoint_dir(df.sparkSession)
    rolled = vectorized_rolling(df, params, value, key, order).checkpoint(eager=True)
    return with_residuals(rolled, params, value, key)


def _local_positions(key: str):
    """Position of each row within its run of equal keys in a sorted partition (carried across batches)."""

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last_key, carry = None, 0
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            keys = pdf[key].to_numpy()
            starts = np.empty(n, dtype=bool)
            starts[0] = keys[0] != last_key
            starts[1:] = keys[1:] != keys[:-1]
            idx = np.arange(n)
            run_start = np.maximum.accumulate(np.where(starts, idx, 0))
            pos = idx - run_start
            if not starts[0]:
                first_run = run_start == 0
                pos[first_run] += carry
            last_key = keys[-1]
            carry = int(pos[-1]) + 1
            pdf["_pid"] = np.int32(pid)
            pdf["_local"] = pos.astype("int64")
            yield pdf

    return run


def ordinals(df: DataFrame, key: str, order: list[str], partitions: int) -> DataFrame:
    """Exact 0-based row ordinal within each key, in ``order``; skew-safe.

    Range partitioning on (key, *order, row id) spreads even one huge key over
    many balanced partitions; each row learns its position inside its partition
    (vectorised helper), the partitions are checkpointed to the shared folder so
    retries and both consumers see the same partition ids, and a small table of
    per-(partition, key) counts gives each partition's offset.
    """
    from pyspark.sql import types as T

    from starlit.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    sort_key = [key, *order, "_mid"]
    ranged = (df.withColumn("_mid", F.monotonically_increasing_id())
              .repartitionByRange(partitions, *sort_key).sortWithinPartitions(*sort_key))
    schema = T.StructType(ranged.schema.fields + [T.StructField("_pid", T.IntegerType()),
                                                  T.StructField("_local", T.LongType())])
    local = ranged.mapInPandas(_local_positions(key), schema).checkpoint(eager=True)
    counts = local.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))) \
        .filter(F.col("_off") > 0).drop("_n")
    # Only keys that continue from an earlier partition get an offset: at most one
    # per partition boundary, so the table is bounded by the partition count.
    out = local.join(F.broadcast(offsets), ["_pid", key], "left")
    return out.withColumn("_ord", F.col("_local") + F.coalesce(F.col("_off"), F.lit(0))) \
        .drop("_off", "_local", "_pid")


def blocked_rolling(df: DataFrame, params: Params, value: str, key: str, order: list[str],
                    partitions: int, vectorized: bool = False) -> DataFrame:
    """Rolling median over bounded (key, block) window partitions with halo rows."""
    before, after = frame_bounds(params.window)
    size = max(params.block_rows, 2 * (before + after) + 1)
    o = ordinals(df, key, order, partitions)
    blk = F.floor(F.col("_ord") / size)
    r = F.col("_ord") - blk * size
    targets = F.array(
        F.struct(blk.alias("_blk"), F.lit(True).alias("_home")),
        F.when((r < after) & (blk > 0), F.struct((blk - 1).alias("_blk"), F.lit(False).alias("_home"))),
        F.when(r >= size - before, F.struct((blk + 1).alias("_blk"), F.lit(False).alias("_home"))),
    )
    copies = o.withColumn("_t", F.explode(F.filter(targets, lambda t: t.isNotNull()))) \
        .withColumns({"_blk": F.col("_t._blk"), "_home": F.col("_t._home")}).drop("_t")
    if vectorized:
        rolled = vectorized_rolling(copies, params, value, [key, "_blk"], ["_ord"], partitions)
    else:
        w = Window.partitionBy(key, "_blk").orderBy("_ord").rowsBetween(-before, after)
        rolled = copies.repartition(partitions, key, "_blk").withColumn("rolling_flux", _framed_median(value, w, params))
    return rolled.filter(F.col("_home")).drop("_blk", "_home", "_ord", "_mid")


def trend_blocked(df: DataFrame, params: Params, value: str, key: str, order: list[str],
                  partitions: int, with_zscore_of: str | None = None, vectorized: bool = False) -> DataFrame:
    from starlit.operators.normalize import zscore

    if with_zscore_of:
        df = zscore(df, with_zscore_of, value, key, strategy="join")
    # the residual aggregate and the join both read the rolled rows: the median pass runs once
    rolled = blocked_rolling(df, params, value, key, order, partitions, vectorized).checkpoint(eager=True)
    return with_residuals(rolled, params, value, key)


def hot_keys(df: DataFrame, key: str, threshold: int):
    """(keys with more than ``threshold`` rows, their total rows), or (None, 0) when there are none."""
    hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > threshold)
    rows = hot.agg(F.sum("_n").alias("rows")).first()["rows"]
    return (None, 0) if rows is None else (hot.select(key), int(rows))


def add_trend(df: DataFrame, params: Params, value: str = "flux_norm", key: str = "object_id",
              order: list[str] | None = None, strategy: str = "auto",
              with_zscore_of: str | None = None, max_rows: int | None = None,
              total_rows: int | None = None) -> DataFrame:
    """Adds rolling_flux (missing -> value), residual and residual_outlier.

    With ``with_zscore_of`` the value column is first computed as the per-object
    z-score of that column (same partitioning, no extra exchange).  ``max_rows``
    (largest object, from a profile pass) lets ``auto`` skip the hot-key job when
    no object can be hot; ``total_rows`` picks the vectorised pass for large inputs.
    """
    order = order or ["quarter", "time"]
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if strategy == "window":
        return trend_window(df, params, value, key, order, with_zscore_of)
    if strategy == "vectorized":
        return trend_vectorized(df, params, value, key, order, with_zscore_of)
    if strategy == "blocked":
        return trend_blocked(df, params, value, key, order, partitions, with_zscore_of)
    if strategy != "auto":
        raise ValueError(f"unknown trend strategy: {strategy}")
    large = (total_rows or 0) >= params.vectorize_rows
    hot, hot_rows = (None, 0) if (max_rows is not None and max_rows <= params.hot_object_rows) else \
        hot_keys(df, key, params.hot_object_rows)
    if hot is None:
        if large:
            return trend_vectorized(df, params, value, key, order, with_zscore_of)
        return trend_window(df, params, value, key, order, with_zscore_of)
    plain = trend_vectorized if large else trend_window
    # a plain join: AQE broadcasts the hot list when it is small and splits hot keys when it is not
    tagged = df.join(hot.withColumn("_hot", F.lit(True)), key, "left")
    normal = plain(tagged.filter(F.col("_hot").isNull()).drop("_hot"), params, value, key, order, with_zscore_of)
    # size the hot path by its rows, not by the session default
    hot_parts = max(partitions, -(-hot_rows // max(1, params.range_rows)))
    heavy = trend_blocked(tagged.filter(F.col("_hot")).drop("_hot"), params, value, key, order,
                          hot_parts, with_zscore_of, vectorized=large)
    return normal.unionByName(heavy)
