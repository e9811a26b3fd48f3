"""Exact global quantiles without funnelling the column into one task.

Spark's exact ``percentile``/``median`` keeps every distinct value of a group in
one buffer; for a global (ungrouped) median that is one task holding the whole
column.  Here the exact value is found by histogram refinement: every round is
a grouped count over at most ``buckets`` value ranges (partial aggregation on
the executors), the driver reads at most ``buckets`` (count, min, max) rows and
narrows the range that holds the wanted rank.  Infinite values are ranked apart, so the
ranges are finite and every round narrows them.  Once a range holds at most
``finish_limit`` values, one bounded task picks the wanted ones.  Inputs of every size take this route.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _locate(values: DataFrame, lo: float, hi: float, ranks: list[int], buckets: int):
    """One refinement round over the values in [lo, hi]; returns {rank: (lo', hi', rank')}."""
    v = F.col("v")
    half_lo, half_span = lo / 2.0, hi / 2.0 - lo / 2.0   # halves avoid overflow of hi - lo
    b = F.least(F.floor((v / 2.0 - F.lit(half_lo)) / F.lit(half_span) * F.lit(buckets)),
                F.lit(buckets - 1)).cast("int")
    hist = (values.filter(v.between(lo, hi)).groupBy(b.alias("b"))
            .agg(F.count("*").alias("n"), F.min(v).alias("mn"), F.max(v).alias("mx"))
            .orderBy("b").collect())
    out = {}
    for rank in ranks:
        seen = 0
        for row in hist:
            if rank < seen + row["n"]:
                out[rank] = (row["mn"], row["mx"], rank - seen, row["n"])
                break
            seen += row["n"]
    return out


def _finish(values: DataFrame, lo: float, hi: float, ranks: list[int]) -> dict[int, float]:
    """Exact values at 0-based ranks inside [lo, hi] when the range holds few values: sorted and picked in
    one bounded task, so only the wanted values reach the driver."""
    v = F.col("v")
    got = values.filter(v.between(lo, hi)).agg(F.sort_array(F.collect_list(v)).alias("s")).select(
        *[F.get("s", F.lit(r)).alias(f"r{r}") for r in ranks]).first()
    return {r: got[f"r{r}"] for r in ranks}


def exact_quantile_value(df: DataFrame, column: str, q: float = 0.5, buckets: int = 65536,
                         finish_limit: int = 1_000_000, known: tuple | None = None):
    """Exact quantile with linear interpolation (same definition as percentile / quantile_cont).

    ``known`` = (count, min, max) of the non-missing values saves the first pass.
    Each round narrows the range holding the wanted rank to one histogram bucket;
    once that bucket holds at most ``finish_limit`` values they are sorted in one
    bounded task.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    if known is None:
        row = values.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        known = (row["n"], row["lo"], row["hi"])
    n, lo, hi = known
    if not n:
        return None
    pos = (n - 1) * q
    k0, k1 = int(math.floor(pos)), int(math.ceil(pos))
    below = above = 0
    if math.isinf(lo) or math.isinf(hi):
        low, high = F.col("v") == float("-inf"), F.col("v") == float("inf")
        row = values.agg(F.count_if(low).alias("below"), F.count_if(high).alias("above"),
                         F.min(F.when(~low & ~high, F.col("v"))).alias("lo"),
                         F.max(F.when(~low & ~high, F.col("v"))).alias("hi")).first()
        below, above, lo, hi = row["below"], row["above"], row["lo"], row["hi"]
    found: dict[int, float] = {k: float("-inf") if k < below else float("inf") for k in {k0, k1}
                               if k < below or k >= n - above}
    # target rank -> (range low, range high, rank inside the range, values in the range)
    pending = {k: (lo, hi, k - below, n - below - above) for k in {k0, k1} - set(found)}
    while pending:
        groups: dict[tuple, list] = {}
        for k, (a, b, r, cnt) in pending.items():
            if a == b:
                found[k] = a
            else:
                groups.setdefault((a, b, cnt), []).append((k, r))
        pending = {}
        for (a, b, cnt), items in groups.items():
            if cnt <= finish_limit:
                exact = _finish(values, a, b, [r for _, r in items])
                found.update({k: exact[r] for k, r in items})
                continue
            located = _locate(values, a, b, [r for _, r in items], buckets)
            for k, r in items:
                if located.get(r, (a, b, 0, cnt))[:2] == (a, b):
                    raise RuntimeError(f"no progress towards rank {k} of {column} between {a} and {b}")
                pending[k] = located[r]
    frac = pos - k0
    if k0 == k1:
        return found[k0]
    a, b = found[k0], found[k1]
    return a if a == b else (1.0 - frac) * a + frac * b


def global_median(df: DataFrame, column: str) -> Column:
    """Exact median of a column as a literal for expressions over ``df`` (NULL when there is no value)."""
    return F.lit(exact_quantile_value(df, column, 0.5)).cast("double")


def median_column(df: DataFrame, column: str, count: int, known: tuple | None = None) -> Column:
    """``global_median`` given the non-missing count and, if known, (count, min, max)."""
    return F.lit(exact_quantile_value(df, column, 0.5, known=known) if count else None).cast("double")


def finite_facts(column: str) -> dict[str, Column]:
    """Aggregates that seed ``grouped_quantile``: values, infinite ones below and above, least and greatest finite one."""
    v = F.col(column).cast("double")
    v = F.when(~F.isnan(v), v)
    finite = F.when((v > float("-inf")) & (v < float("inf")), v)
    return {"n": F.count(v), "below": F.count_if(v == float("-inf")), "above": F.count_if(v == float("inf")),
            "lo": F.min(finite), "hi": F.max(finite)}


def grouped_quantile(df: DataFrame, key: str, column: str, q: float = 0.5, known: dict | None = None,
                     buckets: int = 65536, finish_limit: int = 1_000_000) -> dict:
    """Exact quantile of a column for every value of ``key`` side by side: {key: value}, None without values.

    The ranges of all groups are refined together: a round is one job whatever the number of groups, a grouped count
    over at most ``buckets`` ranges in all. Groups whose range holds at most ``finish_limit`` values wait for the last
    job, in which one task per group sorts that range. ``known``: {key: (n, below, above, lo, hi)} as
    ``finite_facts`` gives them saves the first pass; the driver holds a few numbers for each group.
    """
    v = F.col(column).cast("double")
    values = df.select(F.col(key).alias("k"), v.alias("v")).filter("v is not null and not isnan(v)")
    if known is None:
        known = {r["k"]: tuple(r[c] for c in ("n", "below", "above", "lo", "hi"))
                 for r in df.groupBy(F.col(key).alias("k")).agg(*[a.alias(c) for c, a in finite_facts(column).items()]).collect()}
    found: dict[tuple, float] = {}
    pending: dict[tuple, tuple] = {}  # (key, rank) -> (range low, range high, rank in the range, values in the range)
    for k, (n, below, above, lo, hi) in known.items():
        for rank in {math.floor((n - 1) * q), math.ceil((n - 1) * q)} if n else ():
            if rank < below or rank >= n - above:
                found[k, rank] = float("-inf") if rank < below else float("inf")
            else:
                pending[k, rank] = (lo, hi, rank - below, n - below - above)
    while pending:
        found.update({target: lo for target, (lo, hi, _, _) in pending.items() if lo == hi})
        pending = {t: p for t, p in pending.items() if t not in found}
        open_ = {(t[0], p[0], p[1]) for t, p in pending.items() if p[3] > finish_limit}
        if not open_:
            break
        for (k, lo, hi), hist in _histograms(values, open_, buckets).items():
            for target, p in [(t, p) for t, p in pending.items() if (t[0], p[0], p[1]) == (k, lo, hi)]:
                rank = p[2]
                for _, count, least, most in hist:
                    if rank < count:
                        break
                    rank -= count
                if (least, most, count) == (lo, hi, p[3]):
                    raise RuntimeError(f"no progress in {column} of {k} between {lo} and {hi}")
                pending[target] = (least, most, rank, count)
    if pending:
        found.update(_picked(values, pending))
    out = {}
    for k, (n, *_) in known.items():
        if not n:
            out[k] = None
            continue
        at = (n - 1) * q
        a, b, frac = found[k, math.floor(at)], found[k, math.ceil(at)], at - math.floor(at)
        out[k] = a if a == b else (1.0 - frac) * a + frac * b
    return out


def _ranges(values: DataFrame, ranges: list[tuple]) -> DataFrame:
    """The values inside the ranges (key, low, high) of their group, with the range's number ``t``."""
    rows = [(n, *r) for n, r in enumerate(ranges)]
    kind = values.schema["k"].dataType.simpleString()
    held = values.sparkSession.createDataFrame(rows, f"t int, g {kind}, lo double, hi double")
    # one row per range, two ranges per group at most
    return values.join(F.broadcast(held), F.col("k").eqNullSafe(F.col("g")) & F.col("v").between(F.col("lo"), F.col("hi")))


def _histograms(values: DataFrame, ranges: set[tuple], buckets: int) -> dict[tuple, list]:
    """{range: [(bucket, count, least, greatest), ...] in order} of all ranges in one job."""
    ranges = sorted(ranges, key=str)
    each = max(16, buckets // len(ranges))
    place = F.floor((F.col("v") / 2.0 - F.col("lo") / 2.0) / (F.col("hi") / 2.0 - F.col("lo") / 2.0) * F.lit(each))
    hist = (_ranges(values, ranges).groupBy("t", F.least(place, F.lit(each - 1)).cast("int").alias("b"))
            .agg(F.count("*").alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx")).orderBy("t", "b").collect())
    out: dict[tuple, list] = {r: [] for r in ranges}
    for row in hist:
        out[ranges[row["t"]]].append((row["b"], row["n"], row["mn"], row["mx"]))
    return out


def _picked(values: DataFrame, pending: dict[tuple, tuple]) -> dict[tuple, float]:
    """The values at the wanted ranks of small ranges, all groups in one job."""
    ranges = sorted({(t[0], p[0], p[1]) for t, p in pending.items()}, key=str)
    number = {r: n for n, r in enumerate(ranges)}
    wanted: dict[int, list] = {}
    for t, p in pending.items():
        wanted.setdefault(number[t[0], p[0], p[1]], []).append((p[2], t))
    ranks = values.sparkSession.createDataFrame([(n, [r for r, _ in w]) for n, w in wanted.items()], "t int, ranks array<bigint>")
    got = (_ranges(values, ranges).groupBy("t").agg(F.sort_array(F.collect_list("v")).alias("s")).join(F.broadcast(ranks), "t")
           .select("t", F.transform("ranks", lambda r: F.get("s", r.cast("int"))).alias("at")).collect())
    return {target: row["at"][n] for row in got for n, (_, target) in enumerate(wanted[row["t"]])}
