"""Windowed traversal of an archive, calendar windows and window frames over samples in long form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.codes import grouping_key
from ..functions.times import floor_div, nonempty_windows, ns_of, ts_of
from .intervals import interval_join
from .prefix import running_sum


def windows(spark, tmin: int, tmax: int, tinc: int, tpad: int = 0, snap: bool = False) -> DataFrame:
    """(iwin, wmin_ns, wmax_ns, qmin_ns, qmax_ns): steps of tinc over [tmin, tmax), the last cut short, with padding in q."""
    if snap:
        tmin, tmax = tmin // tinc * tinc, -(-tmax // tinc) * tinc
    one = spark.range(1).select(F.lit(tmin).cast("long").alias("lo"), F.lit(tmax).cast("long").alias("hi"))
    rows = one.select("*", F.explode(F.sequence(F.lit(0), nonempty_windows(F.col("lo"), F.col("hi"), tinc) - 1)).alias("iwin"))
    wmin = F.col("lo") + F.col("iwin").cast("long") * tinc
    out = rows.select("iwin", wmin.alias("wmin_ns"), F.least(wmin + tinc, F.col("hi")).alias("wmax_ns"))
    return out.withColumns({"qmin_ns": F.col("wmin_ns") - tpad, "qmax_ns": F.col("wmax_ns") + tpad})


def chopper(spans: DataFrame, tmin: int, tmax: int, tinc: int, tpad: int = 0, snap: bool = False, grouping: str | None = None) -> DataFrame:
    """Content per window and group: each entry cut to each padded window it overlaps, as cut_min_ns and cut_max_ns."""
    met = interval_join(spans, windows(spans.sparkSession, tmin, tmax, tinc, tpad, snap))
    group = grouping_key(F.col("codes"), grouping) if grouping else F.lit("")
    return met.withColumns({"group": group, "cut_min_ns": F.greatest("tmin_ns", "qmin_ns"), "cut_max_ns": F.least("tmax_ns", "qmax_ns")}).drop("qmin_ns", "qmax_ns")


def calendar(spans: DataFrame, unit: str) -> DataFrame:
    """spans with one row per calendar day, month or year they touch, cut to it: the windows of an archive's files."""
    step = F.expr({"day": "INTERVAL 1 DAY", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}[unit])
    first, last = F.date_trunc(unit, ts_of(F.col("tmin_ns"))), F.date_trunc(unit, ts_of(F.greatest(F.col("tmax_ns") - 1, F.col("tmin_ns"))))
    cut = spans.withColumn("__w", F.explode(F.sequence(first.cast("timestamp_ntz"), last.cast("timestamp_ntz"), step)))
    lo, hi = ns_of(F.col("__w")), ns_of(F.col("__w") + step)
    return cut.withColumns({"wmin_ns": lo, "wmax_ns": hi, "cut_min_ns": F.greatest("tmin_ns", lo), "cut_max_ns": F.least("tmax_ns", hi)}).drop("__w")


#: Rows of a key that one task frames at once, if frames are dealt out.
ROWS = 1 << 20


def framed(df: DataFrame, keys: list[str], order: str, before: int, after: int, values: dict[str, Callable[[WindowSpec], Column]], width: int | None = None, rows: int = ROWS) -> DataFrame:
    """df with __rank, from 1 on per key in the order of a column without ties, and values: functions of a window by key and order,
    whose frames reach no farther than ``before`` rows back and ``after`` rows on.

    With a width (of blocks of the order column, a long) no task holds a whole key: ranks are running sums by such blocks, then
    every key is cut into runs of ``rows`` ranks, which take along copies of as many neighbours as frames need.
    """
    if width is None:
        w = W.partitionBy(*keys).orderBy(order)
        return df.withColumns({"__rank": F.row_number().over(w).cast("long"), **{n: f(w) for n, f in values.items()}})
    rows = max(rows, before + after + 1)
    ranked = running_sum(df.withColumn("__one", F.lit(1).cast("long")), keys, order, {"__one": "__rank"}, width).drop("__one")
    at = F.col("__rank") - 1
    wide = ranked.withColumn("__run", F.explode(F.sequence(F.greatest(floor_div(at - after, rows), F.lit(0)), floor_div(at + before, rows))))
    w = W.partitionBy(*keys, "__run").orderBy(order)
    out = wide.withColumns({n: f(w) for n, f in values.items()})
    return out.where(F.col("__run") == floor_div(at, rows)).drop("__run")


def moving_sum(df: DataFrame, y: str, n: int, keys: list[str], order: str, name: str = "total", **dealt) -> DataFrame:
    """Sum of n samples around each, (n - 1) // 2 of them after it; fewer at the ends."""
    after = (n - 1) // 2
    before = n - 1 - after
    return framed(df, keys, order, before, after, {name: lambda w: F.sum(y).over(w.rowsBetween(-before, after))}, **dealt).drop("__rank")


def moving_avg(df: DataFrame, y: str, n: int, keys: list[str], order: str, name: str = "avg", **dealt) -> DataFrame:
    """Mean of samples i - h + 1 to i - h + n, h = n // 2, at i from h to h + N - n - 1; beyond, the nearest such value.

    All zeros where a key has n samples or fewer.
    """
    h = n // 2
    out = framed(df, keys, order, max(h - 1, 0), n - h, {"__m": lambda w: F.avg(y).over(w.rowsBetween(1 - h, n - h))}, **dealt)
    # the first and the last whole means are those of ranks h + 1 and N - (n - h); a key of n samples or fewer has none
    counts = out.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.max("__rank").alias("__n"))
    on = [out[k].eqNullSafe(counts[f"__k{i}"]) for i, k in enumerate(keys)]
    counted = out.join(counts, on).drop(*(f"__k{i}" for i in range(len(keys))))
    first, last = F.lit(h + 1), F.col("__n") - (n - h)
    edges = counted.where((F.col("__rank") == first) | (F.col("__rank") == last)).groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.max(F.when(F.col("__rank") == first, F.col("__m"))).alias("__lo"), F.max(F.when(F.col("__rank") == last, F.col("__m"))).alias("__hi"))
    on = [counted[k].eqNullSafe(edges[f"__k{i}"]) for i, k in enumerate(keys)]
    whole = counted.join(edges, on, "left")
    value = F.when(F.col("__n") <= n, 0.0).when(F.col("__rank") < first, F.col("__lo")).when(F.col("__rank") > last, F.col("__hi")).otherwise(F.col("__m"))
    return whole.select(*(c for c in df.columns if c != name), value.alias(name))


def _scaled(short: str, long: str, nshort: int, nlong: int, scaling: int) -> Column:
    r = F.when(F.col(long) != 0, F.col(short) / F.col(long))
    return {1: r * (nshort / nlong), 2: (r - 1) / (nlong / nshort - 1), 3: F.greatest((r - 1) / (nlong / nshort - 1), F.lit(0.0))}[scaling]


def sta_lta_centered(df: DataFrame, y: str, nshort: int, nlong: int, keys: list[str], order: str, quad: bool = True, scaling: int = 1, name: str = "ratio", **dealt) -> DataFrame:
    """Ratio of a short and a long moving average of the squares, scaled three ways."""
    sq = df.withColumn("__y", F.col(y) * F.col(y) if quad else F.col(y))
    both = moving_avg(moving_avg(sq, "__y", nshort, keys, order, "__s", **dealt), "__y", nlong, keys, order, "__l", **dealt)
    return both.withColumn(name, _scaled("__s", "__l", nshort, nlong, scaling)).drop("__y", "__s", "__l")


def sta_lta_right(df: DataFrame, y: str, nshort: int, nlong: int, keys: list[str], order: str, quad: bool = True, scaling: int = 1, name: str = "ratio", **dealt) -> DataFrame:
    """The same with both windows ending at the sample; rows without a whole long window are left out."""
    v = F.col(y) * F.col(y) if quad else F.col(y)
    means = {"__s": lambda w: F.avg(v).over(w.rowsBetween(1 - nshort, 0)), "__l": lambda w: F.avg(v).over(w.rowsBetween(1 - nlong, 0))}
    out = framed(df, keys, order, nlong - 1, 0, means, **dealt).where(F.col("__rank") >= nlong)
    return out.withColumn(name, _scaled("__s", "__l", nshort, nlong, scaling)).drop("__rank", "__s", "__l")


def crossings(df: DataFrame, y: str, threshold: float, keys: list[str], order: str, **dealt) -> DataFrame:
    """Rows where the value goes from at most the threshold to above it."""
    out = framed(df, keys, order, 1, 0, {"__before": lambda w: F.lag(y).over(w)}, **dealt)
    return out.where((F.col("__before") <= threshold) & (F.col(y) > threshold)).drop("__before", "__rank")


def peak_candidates(df: DataFrame, y: str, threshold: float, ahead: int, keys: list[str], order: str, **dealt) -> DataFrame:
    """At each crossing the largest value among the next ``ahead`` samples, itself included, and its place; the first of equals."""
    best = {"__before": lambda w: F.lag(y).over(w), "__best": lambda w: F.max(F.struct(F.col(y).alias("v"), (-F.col(order)).alias("o"))).over(w.rowsBetween(0, ahead - 1))}
    out = framed(df, keys, order, 1, ahead - 1, best, **dealt).where((F.col("__before") <= threshold) & (F.col(y) > threshold))
    return out.withColumns({"peak": F.col("__best.v"), "peak_at": -F.col("__best.o")}).drop("__best", "__before", "__rank")
