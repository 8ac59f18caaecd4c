"""Interval joins, differences, gaps, blocks and merges as sweeps and bucketed joins."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import DAY, SECOND, floor_div
from .prefix import running_sum, with_next

#: Width of the blocks of time that running sums are dealt out by.
BLOCK = 365 * DAY


#: Widths of the join's buckets, in seconds; the last is longer than any span that fits into 64 bits of nanoseconds.
WIDTHS = tuple(20**k for k in range(9))


def interval_join(content: DataFrame, queries: DataFrame, keys: list[str] | None = None, instants: bool = False) -> DataFrame:
    """Pairs of a content row [tmin_ns, tmax_ns) and a query row [qmin_ns, qmax_ns) that overlap, with equal keys.

    A row's class is the narrowest of WIDTHS that is as long as it is. Two rows meet in the buckets of
    the wider of their classes, of which each touches two at most; so a row is filed under its own class
    and under those wider ones that the other side has, never under many buckets. A pair that meets twice
    is kept in the later of the first buckets of both, so there are no repeats to remove. Instants are
    spans of one nanosecond; where all queries are instants, ``instants`` spares a run over them to learn their classes.
    """
    keys = keys or []

    def classed(df: DataFrame, lo: str, hi: str, k: str) -> DataFrame:
        length = F.greatest(F.col(hi) - F.col(lo), F.lit(1))
        of = F.lit(len(WIDTHS) - 1)
        for i in reversed(range(len(WIDTHS) - 1)):
            of = F.when(length <= WIDTHS[i] * SECOND, F.lit(i)).otherwise(of)
        return df.withColumn(k, of)

    c, q = classed(content, "tmin_ns", "tmax_ns", "__kc"), classed(queries, "qmin_ns", "qmax_ns", "__kq")
    has_c, has_q = ([0] if instants and k == "__kq" else sorted(r[0] for r in df.select(k).distinct().collect() if r[0] is not None) for df, k in ((c, "__kc"), (q, "__kq")))
    if not has_c or not has_q:
        has_c = has_q = [0]

    def filed(df: DataFrame, lo: str, hi: str, k: str, other: list[int], own: str, first: str) -> DataFrame:
        mine = F.when(F.col(k) >= min(other), F.array(F.col(k))).otherwise(F.array().cast("array<int>"))
        levels = F.array_distinct(F.concat(mine, F.filter(F.array(*map(F.lit, other)), lambda x: x > F.col(k))))
        width = F.get(F.array(*(F.lit(w * SECOND if w * SECOND < 1 << 62 else 1 << 62).cast("long") for w in WIDTHS)), F.col("__k"))
        out = df.withColumn("__k", F.explode(levels))
        start, end = floor_div(F.col(lo), width), floor_div(F.greatest(F.col(hi), F.col(lo) + 1) - 1, width)
        exact = out.withColumns({"__first": start, "__end": end})
        each = exact.withColumn("__b", F.explode(F.sequence("__first", F.greatest("__end", "__first"))))
        return each.withColumns({own: F.col("__k") == F.col(k), first: F.col("__b") == F.col("__first")}).withColumn("__b", F.col("__b") * 16 + F.col("__k")).drop("__k", k, "__first", "__end")

    met = filed(c, "tmin_ns", "tmax_ns", "__kc", has_q, "__oc", "__cf").join(filed(q, "qmin_ns", "qmax_ns", "__kq", has_c, "__oq", "__qf"), [*keys, "__b"])
    overlap = (F.col("tmin_ns") < F.greatest("qmax_ns", F.col("qmin_ns") + 1)) & (F.greatest("tmax_ns", F.col("tmin_ns") + 1) > F.col("qmin_ns"))
    # neither side is filed below its class nor before its first bucket, so the wider class and the later bucket are one side's own
    once = (F.col("__oc") | F.col("__oq")) & (F.col("__cf") | F.col("__qf"))
    return met.where(overlap & once).drop("__b", "__oc", "__oq", "__cf", "__qf")


def overlap_stats(content: DataFrame, queries: DataFrame, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(keys, qmin_ns, qmax_ns, n, first, last): how many content rows overlap each distinct query row with equal keys, the smallest
    tmin_ns and the largest tmax_ns of those; queries that nothing overlaps are left out, as are rows without a bound.

    No pairs are made. A query is overlapped by what starts before its end, less what ends by its start; the smallest
    start among what ends after its start, and the largest end among what starts before its end, are those of overlapping
    rows if there are any. All of these are running sums and maxima by blocks of time over starts, ends and queries.
    """
    keys = keys or []
    end = F.greatest("tmax_ns", F.col("tmin_ns") + 1)
    q = queries.where("qmin_ns is not null").select(*keys, "qmin_ns", "qmax_ns").distinct()
    names = ["opened", "closed", "tmax_ns", "back"]
    nothing = {"opened": F.lit(0), "closed": F.lit(0), "tmax_ns": F.lit(None), "back": F.lit(None)}

    def at(t: Column, **given: Column) -> Column:
        return F.struct(t.cast("long").alias("t_ns"), *((given.get(n, nothing[n])).cast("long").alias(n) for n in names))

    def each(df: DataFrame, a: Column) -> DataFrame:
        return df.select(*keys, a.alias("__e")).groupBy(*keys, F.col("__e.t_ns").alias("t_ns")).agg(F.sum("__e.opened").alias("opened"), F.sum("__e.closed").alias("closed"), F.max("__e.tmax_ns").alias("tmax_ns"), F.max("__e.back").alias("back"))

    def asked(side: str, t: Column) -> DataFrame:
        return q.select(*keys, t.cast("long").alias("t_ns"), F.struct(F.lit(side).alias("side"), "qmin_ns", "qmax_ns").alias("__q"))

    def met(content: DataFrame, asked: DataFrame) -> DataFrame:
        # counts and maxima stay what they are: a query's row adds nothing
        rows = content.withColumn("__q", F.lit(None).cast(asked.schema["__q"].dataType)).unionByName(asked, allowMissingColumns=True)
        return running_sum(rows, keys, "t_ns", {"opened": "__opened", "closed": "__closed"}, block, largest={"tmax_ns": "__last", "back": "__back"}).where("__q is not null")

    whole = content.where("tmin_ns is not null and tmax_ns is not null")
    ahead = each(whole, F.explode(F.array(at(F.col("tmin_ns"), opened=F.lit(1), tmax_ns=F.col("tmax_ns")), at(end, closed=F.lit(1)))))
    behind = each(whole, at(-end, back=-F.col("tmin_ns")))
    stop = F.greatest("qmax_ns", F.col("qmin_ns") + 1)
    found = met(ahead, asked("stop", stop - 1).unionByName(asked("start", F.col("qmin_ns")))).unionByName(met(behind, asked("back", -F.col("qmin_ns") - 1)))
    of = lambda side, v: F.max(F.when(F.col("__q.side") == side, F.col(v)))
    n = F.coalesce(of("stop", "__opened"), F.lit(0)) - F.coalesce(of("start", "__closed"), F.lit(0))
    per = found.groupBy(*keys, F.col("__q.qmin_ns").alias("qmin_ns"), F.col("__q.qmax_ns").alias("qmax_ns")).agg(n.alias("n"), (-of("back", "__back")).alias("first"), of("stop", "__last").alias("last"))
    return per.where("n > 0")


def sweep(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t_ns, step): +1 at each start and -1 at each end, summed per instant, zero sums left out."""
    ends = F.explode(F.array(F.struct(F.col("tmin_ns").alias("t_ns"), F.lit(1).alias("step")), F.struct(F.col("tmax_ns").alias("t_ns"), F.lit(-1).alias("step"))))
    return spans.select(*keys, ends.alias("__e")).groupBy(*keys, F.col("__e.t_ns").alias("t_ns")).agg(F.sum("__e.step").cast("long").alias("step")).where("step <> 0")


def islands(spans: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, t_ns, tmax_ns, island): the starts and ends of spans, with the number of the run of overlapping or touching
    ones they belong to, and the largest end of those that start there.

    The count of open spans and the number of a run are running sums by blocks of time, so that a key with
    very many spans is dealt out.
    """
    up = spans.select(*keys, F.col("tmin_ns").alias("t_ns"), F.lit(1).alias("step"), "tmax_ns")
    down = spans.select(*keys, F.greatest("tmax_ns", F.col("tmin_ns") + 1).alias("t_ns"), F.lit(-1).alias("step"), F.lit(None).cast("long").alias("tmax_ns"))
    steps = up.unionAll(down).groupBy(*keys, "t_ns").agg(F.sum("step").cast("long").alias("step"), F.max("tmax_ns").alias("tmax_ns"))
    counted = running_sum(steps, keys, "t_ns", {"step": "open"}, block)
    starts = counted.withColumn("starts", ((F.col("open") > 0) & (F.col("open") == F.col("step"))).cast("long"))
    return running_sum(starts, keys, "t_ns", {"starts": "island"}, block).select(*keys, "t_ns", "tmax_ns", "island", "starts")


def merge_spans(spans: DataFrame, keys: list[str], tolerance: int = 0, block: int = BLOCK) -> DataFrame:
    """Maximal spans of overlapping or adjacent ones, up to a gap of tolerance ns; an instant reaches to the next nanosecond."""
    longer = spans.withColumn("tmax_ns", F.col("tmax_ns") + tolerance)
    runs = islands(longer, keys, block).groupBy(*keys, "island").agg(F.min("t_ns").alias("tmin_ns"), (F.max("tmax_ns") - tolerance).alias("tmax_ns"))
    return runs.drop("island")


def gaps(spans: DataFrame, keys: list[str], tmin: int, tmax: int, block: int = BLOCK) -> DataFrame:
    """Parts of [tmin, tmax) that no span of a key covers."""
    own = spans.where((F.col("tmin_ns") < tmax) & (F.col("tmax_ns") > tmin)).select(*keys, F.greatest("tmin_ns", F.lit(tmin)).alias("tmin_ns"), F.least("tmax_ns", F.lit(tmax)).alias("tmax_ns"))
    edges = spans.select(*keys).distinct().select(*keys, F.explode(F.array(F.lit(tmin - 1), F.lit(tmax))).alias("tmin_ns")).withColumn("tmax_ns", F.col("tmin_ns") + 1)
    merged = merge_spans(own.unionByName(edges), keys, block=block)
    following = with_next(merged, keys, "tmin_ns", "gap_max_ns", block)
    return following.select(*keys, F.col("tmax_ns").alias("gap_min_ns"), "gap_max_ns").where("gap_max_ns > gap_min_ns")


def split(spans: DataFrame, tmin: int, tmax: int) -> DataFrame:
    """Rows with [tmin, tmax) cut out of them: what is left of each on either side."""
    left = F.struct(F.col("tmin_ns").alias("lo"), F.least("tmax_ns", F.lit(tmin)).alias("hi"))
    right = F.struct(F.greatest("tmin_ns", F.lit(tmax)).alias("lo"), F.col("tmax_ns").alias("hi"))
    return spans.withColumn("__p", F.explode(F.array(left, right))).where("__p.lo < __p.hi").withColumns({"tmin_ns": F.col("__p.lo"), "tmax_ns": F.col("__p.hi")}).drop("__p")


# Round durations in seconds up to two days.
NICE = (1, 2, 5, 10, 20, 30, 60, 120, 300, 600, 1200, 1800, 3600, 7200, 10800, 21600, 43200, 86400, 172800)


def nice_value(x: Column) -> Column:
    """The 1, 2 or 5 times a power of ten that is nearest to x > 0, from 1.5, 3.5 and 7.5 on the next one."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    lead = x / power
    return power * F.when(lead >= 7.5, 10).when(lead >= 3.5, 5).when(lead >= 1.5, 2).otherwise(1)


def block_length(deltat: Column, n_samples: int = 100_000) -> Column:
    """Seconds of a block of about n_samples, a round duration."""
    want = deltat * n_samples
    out = F.lit(float(NICE[-1]))
    for nice in reversed(NICE):
        out = F.when(want <= nice, F.lit(float(nice))).otherwise(out)
    return F.when(want < 1, nice_value(want)).when(want > 86400, nice_value(want / 86400) * 86400).otherwise(out)


def blocks(spans: DataFrame, n_samples: int = 100_000) -> DataFrame:
    """spans with one row per block they touch: block_min_ns and block_max_ns, aligned to multiples of the block's length."""
    length = F.rint(block_length(F.col("deltat"), n_samples) * SECOND).cast("long")
    # the length is worked out once for a span, not for each of its blocks; what is exploded are the blocks' starts
    cut = spans.withColumn("__length", length).withColumns({"__first": floor_div(F.col("tmin_ns"), F.col("__length")), "__last": floor_div(F.col("tmax_ns") - 1, F.col("__length"))})
    each = cut.withColumn("__b", F.explode(F.sequence("__first", F.greatest("__first", "__last"))))
    return each.withColumns({"block_min_ns": F.col("__b") * F.col("__length"), "block_max_ns": (F.col("__b") + 1) * F.col("__length")}).drop("__b", "__length", "__first", "__last")


def cut_at_boundaries(epochs: DataFrame, group: list[str], block: int = BLOCK) -> DataFrame:
    """Epochs cut at every start and end of an epoch in their group.

    Repeated epochs count once. A piece goes from a boundary of the group to the next one, so each boundary is given its next one
    once, by blocks of time; an epoch's pieces are the boundaries from its start to before its end, met by the bucketed
    interval join, and nothing is sorted or made distinct after it.
    """
    points = epochs.select(*group, F.explode(F.array("tmin_ns", "tmax_ns")).alias("qmin_ns"))
    # of equal boundaries the last one has a larger one after it
    led = with_next(points, group, "qmin_ns", "__u", block).where("__u is null or __u > qmin_ns").withColumn("qmax_ns", F.col("qmin_ns"))
    whole = epochs.distinct()
    pieces = interval_join(whole, led, group, instants=True).where("qmin_ns < tmax_ns or qmin_ns = tmin_ns")
    rest = [c for c in epochs.columns if c not in ("tmin_ns", "tmax_ns")]
    cut = pieces.select(*rest, F.col("qmin_ns").alias("tmin_ns"), F.when(F.col("tmax_ns") > F.col("tmin_ns"), F.col("__u")).otherwise(F.col("tmax_ns")).alias("tmax_ns"))
    # what has no group or no start meets no boundary and stays as it is
    uncut = whole.where(reduce(or_, (F.col(c).isNull() for c in (*group, "tmin_ns"))))
    return cut.unionByName(uncut)


def epoch_lookup(points: DataFrame, epochs: DataFrame, keys: list[str], time: str = "t_ns") -> DataFrame:
    """points with the epoch [tmin_ns, tmax_ns) of their keys that holds their time, and n_matches, how many do.

    One row per point: the epoch with the latest start if several match, nulls if none does.
    """
    asked = points.select(*keys, F.col(time).alias("qmin_ns")).where("qmin_ns is not null").distinct().withColumn("qmax_ns", F.col("qmin_ns"))
    rest = [c for c in epochs.columns if c not in keys]
    met = interval_join(epochs, asked, keys, instants=True)
    found = met.groupBy(*keys, "qmin_ns").agg(F.max(F.struct("tmin_ns", *(c for c in rest if c != "tmin_ns"))).alias("__e"), F.count("*").alias("n_matches"))
    best = found.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("qmin_ns").alias("__t"), "__e", "n_matches")
    on = [points[k] == best[f"__k{i}"] for i, k in enumerate(keys)] + [points[time] == best["__t"]]
    joined = points.join(best, on, "left")
    return joined.select(*(points[c] for c in points.columns), F.coalesce(best["n_matches"], F.lit(0)).alias("n_matches"), *(F.col(f"__e.{c}").alias(f"epoch_{c}") for c in rest))
