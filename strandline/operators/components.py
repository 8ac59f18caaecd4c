"""Traces of several components cut to the spans that they have in common, by an n-way sweep over their ends.

Spans come from times alone: every component steps up where a piece begins and down where it ends; running sums, dealt
out by blocks of time, tell at every change which components are there. Samples are joined to the spans once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import step_ns
from ..functions.times import DAY
from .intervals import interval_join
from .prefix import running_sum, with_next
from .settle import settled


def component_spans(pieces: DataFrame, keys: list[str], component: str, components: list[str], width: int = DAY) -> DataFrame:
    """(keys, tmin_ns, tmax_ns, mask): maximal spans over which the same components are there; bit i of mask is component i.

    pieces are [tmin_ns, tmax_ns) of components; overlaps within one component count once, others' rows don't matter.
    """
    n = range(len(components))
    known = pieces.where(F.col(component).isin(components) & (F.col("tmax_ns") > F.col("tmin_ns")))
    up, down = (known.select(*keys, component, F.col(t).alias("t_ns"), F.lit(s).alias("s")) for t, s in (("tmin_ns", 1), ("tmax_ns", -1)))
    steps = up.unionByName(down).groupBy(*keys, "t_ns").agg(*(F.sum(F.when(F.col(component) == components[i], F.col("s")).otherwise(0)).alias(f"s{i}") for i in n))
    steps = settled(steps.where(" or ".join(f"s{i} <> 0" for i in n)), "steps")
    there = running_sum(steps, keys, "t_ns", {f"s{i}": f"c{i}" for i in n}, width)
    mask = sum((F.when(F.col(f"c{i}") > 0, 1 << i).otherwise(0) for i in n), F.lit(0))
    # where a component's overlaps begin or end nothing changes: such rows go, and each mask lasts up to the next change
    masks = settled(there.select(*keys, "t_ns", mask.alias("mask")), "masks")
    following = with_next(masks, keys, "t_ns", "t_next", width)
    before = following.where("t_next is not null").select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("t_next").alias("__t_next"), F.col("mask").alias("__was"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("t_ns") == F.col("__t_next")]
    changes = masks.join(before, on, "left").where("__was is null or __was <> mask").select(*keys, "t_ns", "mask")
    return with_next(settled(changes, "changes"), keys, "t_ns", "tmax_ns", width).where("mask > 0 and tmax_ns is not null").select(*keys, F.col("t_ns").alias("tmin_ns"), "tmax_ns", "mask")


def multi_component(traces: DataFrame, keys: list[str], component: str, components: list[str], mode: str = "common", longest: int = 1 << 20, width: int = DAY) -> DataFrame:
    """(keys, deltat, tmin_ns, mask, ydata array<array<double>>): samples of all components over each span, in the order of components.

    ``mode`` 'common' gives the spans that all components share, 'any' those that at least one has; absent ones are null
    there. Pieces of a component that follow each other are put together; of overlapping ones the later begins where the
    earlier ends. Starts are snapped to multiples of the interval. Spans of over ``longest`` samples go on in further rows.
    Null or empty traces, other components and traces with a null key are left out.
    """
    if mode not in ("common", "any"):
        raise ValueError(f"mode {mode} is not known")
    step = step_ns(F.col("deltat"))
    own = traces.where(F.col("ydata").isNotNull() & (F.size("ydata") > 0) & (F.col("deltat") > 0) & F.col(component).isin(components))
    own = own.select(*keys, component, "deltat", (F.rint(F.col("tmin_ns") / step).cast("long") * step).alias("tmin_ns"), "ydata")
    group = [*keys, "deltat"]
    times = settled(own.select(*group, component, "tmin_ns", (F.col("tmin_ns") + F.size("ydata") * step).alias("tmax_ns")).distinct(), "times")
    spans = component_spans(times, group, component, components, width)
    if mode == "common":
        spans = spans.where(F.col("mask") == (1 << len(components)) - 1)
    size = longest * step
    cuts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("tmax_ns") - F.col("tmin_ns") - 1) / size).cast("long"))
    spans = spans.withColumn("__k", F.explode(cuts)).select(*group, "mask", (F.col("tmin_ns") + F.col("__k") * size).alias("qmin_ns"), F.least("tmax_ns", F.col("tmin_ns") + (F.col("__k") + 1) * size).alias("qmax_ns"))
    met = interval_join(times, spans, group).select(*group, component, "tmin_ns", "tmax_ns", "qmin_ns", "qmax_ns", "mask")
    on = [own[k].eqNullSafe(met[k]) for k in [*group, component, "tmin_ns"]] + [F.size(own["ydata"]) * step_ns(own["deltat"]) + own["tmin_ns"] == met["tmax_ns"]]
    lo = F.greatest(met["tmin_ns"], met["qmin_ns"])
    first, n = ((lo - met["tmin_ns"]) / step_ns(met["deltat"])).cast("int"), ((F.least(met["tmax_ns"], met["qmax_ns"]) - lo) / step_ns(met["deltat"])).cast("int")
    cut = own.join(met, on).select(*(met[c] for c in [*group, component, "qmin_ns", "mask"]), F.struct(((lo - met["qmin_ns"]) / step_ns(met["deltat"])).cast("int").alias("at"), F.slice(own["ydata"], first + 1, n).alias("y")).alias("part"))

    def joined(i: int):
        parts = F.array_sort(F.collect_list(F.when(F.col(component) == components[i], F.col("part"))))
        whole = F.aggregate(parts, F.array().cast("array<double>"), lambda done, p: F.concat(done, F.slice(p["y"], F.greatest(F.lit(0), F.least(F.size(p["y"]), F.size(done) - p["at"])) + 1, F.size(p["y"]))))
        return F.when(F.size(parts) > 0, whole)

    return cut.groupBy(*group, "qmin_ns", "mask").agg(F.array(*map(joined, range(len(components)))).alias("ydata")).withColumnRenamed("qmin_ns", "tmin_ns")
