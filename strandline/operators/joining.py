"""Joining and cutting neighbouring traces of the same codes: degap, deoverlap, merge, event grouping.

The folds are sequential, but only among traces that overlap. Windows over times alone,
dealt out by blocks of time, find the clusters of overlapping traces; only clusters of more
than one are folded in Python, one cluster at a time. What merely follows, with or without
a gap to fill, is linked by times, and samples move once, to be put together. So a channel
with very many traces is dealt out by its clusters, whether it has gaps or not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import step_ns, tmax_ns
from ..functions.times import floor_div
from .intervals import BLOCK, interval_join, islands, merge_spans
from .prefix import running_sum, with_next
from .settle import settled

#: Samples of a joined trace beyond which it is continued in another row (32 MB).
LONGEST = 1 << 22


def _samples(traces: DataFrame, keys: list[str]) -> DataFrame:
    return traces.where(F.size("ydata") > 0).select(*keys, "deltat", F.col("tmin_ns").cast("long").alias("tmin_ns"), F.col("ydata").cast("array<double>").alias("ydata"))


def with_clusters(traces: DataFrame, keys: list[str]) -> DataFrame:
    """traces with the start ``cluster`` of the run of overlapping ones they belong to, and ``alone`` where it is the only one of it."""
    step = step_ns(F.col("deltat"))
    times = settled(traces.select(*keys, "tmin_ns", (tmax_ns(F.col("tmin_ns"), F.col("deltat"), F.col("ydata")) + F.floor(step / 2)).alias("tmax_ns")), "times")
    starts = times.groupBy(*keys, "tmin_ns").agg(F.count("*").alias("n"))
    numbers = settled(islands(times, keys).where("tmax_ns is not null").select(*keys, F.col("t_ns").alias("tmin_ns"), "island").join(starts, [*keys, "tmin_ns"]), "islands")
    of = numbers.groupBy(*keys, "island").agg(F.min("tmin_ns").alias("cluster"), (F.sum("n") == 1).alias("alone"))
    return traces.join(numbers.join(of, [*keys, "island"]).select(*keys, "tmin_ns", "cluster", "alone"), [*keys, "tmin_ns"])


def _fold(traces: DataFrame, keys: list[str], kernel) -> DataFrame:
    """(keys, tmin_ns, ydata, cluster, nth, last): kernel(list of (tmin_ns, samples), step in ns), which returns such a list,
    for every cluster of overlapping traces; nth counts what comes out of a cluster, last marks the last of it."""
    found = settled(with_clusters(traces, keys), "clusters")
    cols = [*keys, "tmin_ns", "ydata", "cluster"]
    alone = found.where("alone").select(*cols, F.lit(0).alias("nth"), F.lit(True).alias("last"))
    schema, names = alone.schema, alone.columns

    def run(t: pa.Table) -> pa.Table:
        step = round(t.column("deltat")[0].as_py() * 1e9)
        y = t.column("ydata").combine_chunks()
        rows = sorted(((a, y[i].values.to_numpy(zero_copy_only=False)) for i, a in enumerate(t.column("tmin_ns").to_pylist())), key=lambda r: (r[0], -len(r[1]), r[1].tolist()))
        out = kernel(rows, step)
        same = [pa.array([t.column(k)[0].as_py()] * len(out), t.schema.field(k).type) for k in keys]
        own = [pa.array([a for a, _ in out], pa.int64()), pa.array([y for _, y in out], pa.list_(pa.float64())), pa.array([t.column("cluster")[0].as_py()] * len(out), pa.int64()), pa.array(range(len(out)), pa.int32()), pa.array([i == len(out) - 1 for i in range(len(out))])]
        return pa.Table.from_arrays([*same, *own], names=names)

    return alone.unionByName(found.where("not alone").select(*cols).groupBy(*keys, "cluster").applyInArrow(run, schema))


def _linked(pieces: DataFrame, keys: list[str], maxgap: int, fill: str, longest: int) -> DataFrame:
    """Pieces put together with what follows them on the common sampling instants at most maxgap samples later.

    Of a cluster the last piece may be followed, and the first may follow. Chains are numbered by running sums over
    clusters; a cluster of several pieces ends one chain and begins another.
    """
    step = step_ns(F.col("deltat"))
    ends = {"end": tmax_ns(F.col("tmin_ns"), F.col("deltat"), F.col("ydata")), "before": F.element_at("ydata", -1), "after": F.get("ydata", F.lit(0))}
    pieces = settled(pieces.withColumns(ends), "pieces")
    tails = pieces.where("last").select(*keys, "cluster", "end", "before", (F.col("nth") == 0).alias("single"))
    heads = pieces.where("nth = 0").select(*keys, F.col("cluster").alias("next"), F.col("tmin_ns").alias("start"), "after")
    follows = with_next(tails.select(*keys, "cluster"), keys, "cluster", "next", BLOCK).where("next is not null")
    met = tails.join(follows, [*keys, "cluster"]).join(heads, [*keys, "next"])
    d = (F.col("start") - F.col("end")) / step
    links = settled(met.withColumn("i", F.rint(d).cast("int")).where((F.abs(d - F.col("i")) <= 0.05) & F.col("i").between(1, maxgap)), "links")
    joins = links.select(*keys, F.col("next").alias("cluster"), F.lit(0).alias("fresh"))
    marked = tails.join(joins, [*keys, "cluster"], "left").select(*keys, "cluster", "single", (F.coalesce("fresh", F.lit(1)) + F.when(F.col("single"), 0).otherwise(1)).cast("long").alias("new"))
    chains = settled(running_sum(marked, keys, "cluster", {"new": "chain"}, BLOCK).select(*keys, "cluster", "chain"), "chains")
    dealt = pieces.join(chains, [*keys, "cluster"]).withColumn("chain", F.when(F.col("last"), F.col("chain")).when(F.col("nth") == 0, F.col("chain") - 1))
    k = F.sequence(F.lit(1), F.col("i") - 1)
    between = F.transform(k, lambda j: F.lit(0.0)) if fill == "zeros" else F.transform(k, lambda j: F.col("before") + (F.col("after") - F.col("before")) * j / F.col("i"))
    filled = links.where("i > 1").join(chains, [*keys, "cluster"]).select(*keys, "chain", (F.col("end") + step).alias("tmin_ns"), between.alias("ydata"))
    inner = dealt.where("chain is null").select(*keys, "tmin_ns", "ydata")  # neither the first nor the last of its cluster
    parts = dealt.where("chain is not null").select(*keys, "chain", "tmin_ns", "ydata").unionByName(filled)
    begins = parts.groupBy(*keys, "chain").agg(F.min("tmin_ns").alias("begin"))
    cut = parts.join(begins, [*keys, "chain"]).withColumn("row", floor_div(F.col("tmin_ns") - F.col("begin"), step * longest))
    ordered = F.sort_array(F.collect_list(F.struct("tmin_ns", "ydata")))
    whole = cut.groupBy(*keys, "chain", "row").agg(F.min("tmin_ns").alias("tmin_ns"), F.flatten(F.transform(ordered, lambda x: x["ydata"])).alias("ydata"))
    return whole.select(*keys, "tmin_ns", "ydata").unionByName(inner)


def degap(traces: DataFrame, keys: list[str], maxgap: int = 5, fill: str = "interpolate", overlap: str = "use_second", maxlap: int | None = None, longest: int = LONGEST) -> DataFrame:
    """Traces joined where the next starts at most maxgap samples behind the last, or inside it up to maxlap.

    fill: interpolate or zeros for missing samples; overlap: use_second, use_first, crossfade_cos or add.
    Traces off the common sampling instants by more than a twentieth of a step are not joined; if such
    a one overlaps, the first is cut before it. A joined trace of over ``longest`` samples goes on in further rows.
    """
    lap = maxgap if maxlap is None else maxlap

    def kernel(rows, step):
        out: list[tuple[int, np.ndarray]] = []
        for t, y in rows:
            if not out:
                out.append((t, y))
                continue
            t0, y0 = out[-1]
            d = (t - (t0 + (len(y0) - 1) * step)) / step
            i = round(d)
            if abs(d - i) > 0.05 and i <= maxgap:
                if i <= 0 and 1 - i <= lap:
                    keep = len(y0) - (1 - i)
                    out.pop()
                    if keep > 0:
                        out.append((t0, y0[:keep]))
                out.append((t, y))
            elif i <= 0 and 1 - i <= lap:
                n = 1 - i
                if len(y) <= n:
                    continue  # ends no later than the first
                a, b = y0[len(y0) - n :], y[:n]
                if overlap == "use_second":
                    mid = b
                elif overlap == "use_first":
                    mid = a
                elif overlap == "add":
                    mid = a + b
                else:
                    w = 0.5 - 0.5 * np.cos(np.pi * (1 + np.arange(n)) / (1 + n))
                    mid = a * (1 - w) + b * w
                out[-1] = (t0, np.concatenate([y0[: len(y0) - n], mid, y[n:]]))
            else:
                out.append((t, y))
        return out

    group = [*keys, "deltat"]
    return _linked(_fold(_samples(traces, keys), group, kernel), group, maxgap, fill, longest).select(*group, "tmin_ns", "ydata")


def deoverlap(traces: DataFrame, keys: list[str], precedence: str = "longest") -> DataFrame:
    """Traces cut so that none overlap: longer (or earlier) ones stay whole, others keep what lies outside, on both sides."""

    def kernel(rows, step):
        order = sorted(rows, key=(lambda r: (-len(r[1]), r[0])) if precedence == "longest" else (lambda r: r[0]))
        taken: list[tuple[int, int]] = []
        out = []
        for t, y in order:
            parts = [(t, y)]
            for lo, hi in taken:
                rest = []
                for a, v in parts:
                    end = a + (len(v) - 1) * step
                    if end < lo or a > hi:
                        rest.append((a, v))
                        continue
                    before = max(0, -(-(lo - a) // step))
                    after = max(0, (hi - a) // step + 1)
                    if before > 0:
                        rest.append((a, v[:before]))
                    if after < len(v):
                        rest.append((a + after * step, v[after:]))
                parts = rest
            for a, v in parts:
                if len(v):
                    out.append((a, v))
                    taken.append((a, a + (len(v) - 1) * step))
        return sorted(out, key=lambda r: r[0])

    group = [*keys, "deltat"]
    return _fold(_samples(traces, keys), group, kernel).select(*group, "tmin_ns", "ydata")


def merge_archives(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Traces of both archives, those of a winning where they overlap, then joined where they meet."""
    cols = [*keys, "deltat", "tmin_ns", "ydata"]
    group = [*keys, "deltat"]
    step = step_ns(F.col("deltat"))
    spans = a.where(F.size("ydata") > 0).select(*group, "tmin_ns", (tmax_ns(F.col("tmin_ns"), F.col("deltat"), F.col("ydata")) + step).alias("tmax_ns"))
    asked = b.where(F.size("ydata") > 0).select(*group, F.col("tmin_ns").alias("qmin_ns"), (tmax_ns(F.col("tmin_ns"), F.col("deltat"), F.col("ydata")) + 1).alias("qmax_ns")).distinct()
    met = interval_join(merge_spans(spans, group), asked, group)
    covered = settled(met.groupBy(*group, F.col("qmin_ns").alias("tmin_ns"), F.col("qmax_ns").alias("__q")).agg(F.collect_list(F.struct(F.col("tmin_ns").alias("lo"), (F.col("tmax_ns") - step).alias("hi"))).alias("__taken")), "covered")
    timed = b.select(*cols).withColumn("__q", tmax_ns(F.col("tmin_ns"), F.col("deltat"), F.col("ydata")) + 1).join(covered, [*group, "tmin_ns", "__q"], "left").where(F.size("ydata") > 0)
    whole = timed.where("__taken is null").select(*cols)
    # the spans taken, as places in the trace in their order, leave what lies before, between and behind them
    up = lambda t: -floor_div(F.col("tmin_ns") - t, step)
    taken = F.transform(F.array_sort("__taken"), lambda s: F.struct(up(s["lo"]).alias("lo"), floor_div(s["hi"] - F.col("tmin_ns"), step).alias("hi")))
    parts = timed.where("__taken is not null").withColumn("__taken", taken)
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.get("__taken", k - 1)["hi"] + 1))
    end = lambda k: F.least(F.size("ydata"), F.coalesce(F.get("__taken", k)["lo"], F.size("ydata")))
    runs = F.transform(F.sequence(F.lit(0), F.size("__taken")), lambda k: F.struct(begin(k).cast("int").alias("s"), end(k).cast("int").alias("e")))
    left = parts.withColumn("__r", F.explode(F.filter(runs, lambda r: r["s"] < r["e"])))
    cut = left.select(*keys, "deltat", (F.col("tmin_ns") + F.col("__r.s") * step).alias("tmin_ns"), F.slice("ydata", F.col("__r.s") + 1, F.col("__r.e") - F.col("__r.s")).alias("ydata"))
    return degap(settled(a.select(*cols).unionByName(whole).unionByName(cut), "merged"), keys, maxgap=1)


def group_events(events: DataFrame, keys: list[str], gap_ns: int, block: int = BLOCK) -> DataFrame:
    """events (keys, t_ns) with ``group``: events closer than gap_ns to the one before share one.

    Groups are runs of overlapping spans, dealt out by blocks of time; events without a time have no group.
    """
    spans = events.where("t_ns is not null").select(*keys, F.col("t_ns").alias("tmin_ns"), (F.col("t_ns") + (gap_ns - 1)).alias("tmax_ns"))
    numbers = islands(spans, keys, block).where("tmax_ns is not null").select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("t_ns").alias("__t"), F.col("island").alias("group"))
    on = [events[k].eqNullSafe(numbers[f"__k{i}"]) for i, k in enumerate(keys)] + [events["t_ns"] == numbers["__t"]]
    return events.join(numbers, on, "left").select(*(events[c] for c in events.columns if c != "group"), "group")
