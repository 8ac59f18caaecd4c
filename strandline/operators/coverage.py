"""Coverage: how many spans of a key lie over each instant, as a step function in rows (keys, t_ns, count)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import BLOCK, sweep
from .prefix import running_sum, with_next


def coverage(spans: DataFrame, keys: list[str], tmin: int | None = None, tmax: int | None = None, block: int = BLOCK, until: str | None = None) -> DataFrame:
    """The changes of the count; with bounds, the count at tmin, the changes in (tmin, tmax] and the count at tmax.

    Without bounds, ``until`` names a column for the next change, found in the same pass; spans_of and total take it as tmax_ns.
    """
    if tmin is None and tmax is None:
        return running_sum(sweep(spans, keys), keys, "t_ns", {"step": "count"}, block, following=until).drop("step")
    steps = running_sum(sweep(spans, keys), keys, "t_ns", {"step": "count"}, block).select(*keys, "t_ns", "count")
    inside = steps
    if tmin is not None:
        inside = inside.where(F.col("t_ns") > tmin)
    if tmax is not None:
        inside = inside.where(F.col("t_ns") <= tmax)
    out = inside
    groups = spans.select(*keys).distinct()
    for t in (tmin, tmax):
        if t is not None:
            held = spans.where((F.col("tmin_ns") <= t) & (F.col("tmax_ns") > t)).groupBy(*keys).agg(F.count("*").alias("count"))
            at = groups.join(held, keys, "left").select(*keys, F.lit(t).cast("long").alias("t_ns"), F.coalesce("count", F.lit(0)).alias("count"))
            out = out.unionByName(at)
    return out.dropDuplicates([*keys, "t_ns"])


def spans_of(steps: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, tmin_ns, tmax_ns, count): stretches of equal positive count."""
    following = steps if "tmax_ns" in steps.columns else with_next(steps.select(*keys, "t_ns", "count"), keys, "t_ns", "tmax_ns", block)
    return following.select(*keys, F.col("t_ns").alias("tmin_ns"), "tmax_ns", "count").where("count > 0 and tmax_ns is not null")


def total(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, covered_ns): total covered time of keys with any."""
    return spans_of(steps, keys).groupBy(*keys).agg(F.sum(F.col("tmax_ns") - F.col("tmin_ns")).alias("covered_ns"))


def uncovered_by(a: DataFrame, b: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, tmin_ns, tmax_ns): where spans of a, but none of b, are."""
    def ends(spans: DataFrame, name: str, other: str) -> DataFrame:
        each = F.explode(F.array(F.struct(F.col("tmin_ns").alias("t_ns"), F.lit(1).alias("s")), F.struct(F.col("tmax_ns").alias("t_ns"), F.lit(-1).alias("s"))))
        return spans.select(*keys, each.alias("e")).select(*keys, "e.t_ns", F.col("e.s").alias(name), F.lit(0).alias(other))

    merged = ends(a, "in_a", "in_b").unionByName(ends(b, "in_b", "in_a")).groupBy(*keys, "t_ns").agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b")).where("in_a <> 0 or in_b <> 0")
    both = running_sum(merged, keys, "t_ns", {"in_a": "n_a", "in_b": "n_b"}, block)
    bare = (F.col("n_a") > 0) & (F.col("n_b") == 0)
    before = (F.col("n_a") - F.col("in_a") > 0) & (F.col("n_b") - F.col("in_b") == 0)
    turns = both.withColumn("bare", bare).where(bare != before).select(*keys, "t_ns", "bare")
    following = with_next(turns, keys, "t_ns", "tmax_ns", block)
    return following.where("bare").select(*keys, F.col("t_ns").alias("tmin_ns"), "tmax_ns")


def contiguous(steps: DataFrame, keys: list[str], tmin: int, tmax: int, block: int = BLOCK) -> DataFrame:
    """(keys, count): the count if it is the same all over [tmin, tmax), else -1."""
    held = with_next(steps.select(*keys, "t_ns", "count"), keys, "t_ns", "until", block).where((F.col("t_ns") < tmax) & (F.coalesce("until", F.lit(tmax)) > tmin))
    whole = held.groupBy(*keys).agg(F.min("count").alias("lo"), F.max("count").alias("hi"), F.min("t_ns").alias("first"))
    return whole.select(*keys, F.when(F.col("first") > tmin, F.when(F.col("hi") == 0, F.col("hi")).otherwise(-1)).when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1).alias("count"))


def joined(spans: DataFrame, keys: list[str], bleed: int = 0, block: int = BLOCK) -> DataFrame:
    """Coverage of all spans of the coarser keys together, each span longer by bleed ns at both ends."""
    return coverage(spans.withColumns({"tmin_ns": F.col("tmin_ns") - bleed, "tmax_ns": F.col("tmax_ns") + bleed}), keys, block=block)


def check(waveforms: DataFrame, channels: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, problem) found in an index of waveforms and channel epochs.

    duplicate: overlapping waveforms; overlapping_epochs: overlapping channel epochs; no_metadata and
    no_waveforms: one without the other; incomplete: waveforms outside of all epochs; rate: a waveform's
    rate is not the channel's. One sweep over the ends of both sides finds all but the last.
    """

    def ends(spans: DataFrame, a: int) -> DataFrame:
        each = F.explode(F.array(F.struct(F.col("tmin_ns").alias("t_ns"), F.lit(1).alias("s")), F.struct(F.col("tmax_ns").alias("t_ns"), F.lit(-1).alias("s"))))
        return spans.select(*keys, each.alias("e")).select(*keys, "e.t_ns", (F.col("e.s") * a).alias("in_a"), (F.col("e.s") * (1 - a)).alias("in_b"), F.lit(a).alias("is_a"))

    merged = ends(waveforms, 1).unionByName(ends(channels, 0)).groupBy(*keys, "t_ns").agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b"), F.max("is_a").alias("some_a"), F.min("is_a").alias("all_a"))
    both = running_sum(merged, keys, "t_ns", {"in_a": "n_a", "in_b": "n_b"}, block)
    bare = (F.col("n_a") > 0) & (F.col("n_b") == 0)
    per = both.groupBy(*keys).agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.bool_or(bare).alias("bare"), (F.max("some_a") == 1).alias("a"), (F.min("all_a") == 0).alias("b"))
    problems = {"duplicate": F.col("n_a") > 1, "overlapping_epochs": F.col("n_b") > 1, "no_metadata": ~F.col("b"), "no_waveforms": ~F.col("a"), "incomplete": F.col("bare") & F.col("b")}
    found = per.select(*keys, F.explode(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in problems.items())))).alias("problem"))
    rates = waveforms.select(*keys, "deltat").distinct().join(channels.select(*keys, F.col("deltat").alias("want")).distinct(), keys).groupBy(*keys, "deltat").agg(F.bool_or(F.abs(F.col("deltat") - F.col("want")) <= 1e-6 * F.col("want")).alias("ok")).where("not ok").select(*keys).distinct()
    return found.unionByName(rates.withColumn("problem", F.lit("rate")))
