"""Responses as ordered chains of stages: checks along the chain, ranges of it, evaluation and simplification.

A chain is an array column of structs (stage, input, output, rate_in, rate_out, constant, zeros, poles), roots in radians
per second as structs (re, im). Everything is expressions over that column; nothing is shuffled once chains are built.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("stage", "input", "output", "rate_in", "rate_out", "constant", "zeros", "poles")
ROOTS = "array<struct<re: double, im: double>>"


def chains(stages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stages): the stages of each epoch in order. A chain has few stages, so it is one row; repeated rows count once."""
    plain = stages.select(*keys, F.struct(F.col("stage").cast("int").alias("stage"), *(F.col(f).cast("string").alias(f) for f in FIELDS[1:3]), *(F.col(f).cast("double").alias(f) for f in FIELDS[3:6]), *(F.coalesce(F.col(f).cast(ROOTS), F.array().cast(ROOTS)).alias(f) for f in FIELDS[6:])).alias("s"))
    return plain.groupBy(*keys).agg(F.array_sort(F.collect_set("s")).alias("stages"))


def faults(chain: Column) -> Column:
    """What is wrong between a stage and the one before it: array of struct(stage, fault), fault being number, units or rate."""
    def at(i: Column) -> Column:
        a, b = F.get(chain, i - 1), F.get(chain, i)
        tests = ((b["stage"] != a["stage"] + 1, "number"), (a["output"] != b["input"], "units"), (a["rate_out"] != b["rate_in"], "rate"))
        return F.filter(F.array(*(F.struct(b["stage"].alias("stage"), F.when(test, name).alias("fault")) for test, name in tests)), lambda x: x["fault"].isNotNull())

    return F.when(F.size(chain) > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.size(chain) - 1), at))).otherwise(F.array().cast("array<struct<stage: int, fault: string>>"))


def between(chain: Column, first: int | None = None, last: int | None = None) -> Column:
    """Stages numbered first to last, both included."""
    return F.filter(chain, lambda s: (F.lit(True) if first is None else s["stage"] >= first) & (F.lit(True) if last is None else s["stage"] <= last))


def stage_type(stage: Column) -> Column:
    """sensor, electronics, digitizer, decimation, combination, conversion or unknown, by units in and out."""
    ground = ["displacement", "velocity", "acceleration", "rotation", "pressure", "temperature"]
    i, o = stage["input"], stage["output"]
    return (
        F.when(i.isin(ground) & o.isin(ground), "conversion").when(i.isin(ground) & (o == "voltage"), "sensor").when((i == "voltage") & (o == "voltage"), "electronics").when((i == "voltage") & (o == "counts"), "digitizer")
        .when((F.coalesce(i, F.lit("counts")) == "counts") & (F.coalesce(o, F.lit("counts")) == "counts") & (stage["rate_in"] > stage["rate_out"]), "decimation").when(i.isin(ground) & (o == "counts"), "combination").otherwise("unknown")
    )


def _times(a: Column, re: Column, im: Column) -> Column:
    return F.struct((a["re"] * re - a["im"] * im).alias("re"), (a["re"] * im + a["im"] * re).alias("im"))


def evaluate(simple: Column, frequency: Column | float) -> Column:
    """struct(re, im) of struct(constant, zeros, poles) at a frequency in Hz; null at a pole."""
    w = 2 * math.pi * (frequency if isinstance(frequency, Column) else F.lit(float(frequency)))
    one = F.struct(simple["constant"].cast("double").alias("re"), F.lit(0.0).alias("im"))
    over = F.aggregate(simple["zeros"], one, lambda a, z: _times(a, -z["re"], w - z["im"]))

    def divided(a: Column, p: Column) -> Column:
        re, im = -p["re"], w - p["im"]
        norm = F.nullif(re * re + im * im, F.lit(0.0))
        return _times(a, re / norm, -im / norm)

    return F.aggregate(simple["poles"], over, divided)


def combined(chain: Column) -> Column:
    """struct(constant, zeros, poles) of a whole chain, roots as they are; a constant that is null counts as 1."""
    constant = F.aggregate(chain, F.lit(1.0), lambda a, s: a * F.coalesce(s["constant"], F.lit(1.0)))
    return F.struct(constant.alias("constant"), F.flatten(F.transform(chain, lambda s: s["zeros"])).alias("zeros"), F.flatten(F.transform(chain, lambda s: s["poles"])).alias("poles"))


def simplified(simple: Column) -> Column:
    """The same response without roots that are zeros and poles at once; each zero takes away one equal pole."""
    start = F.struct(simple["poles"].alias("poles"), F.array().cast(ROOTS).alias("zeros"))

    def step(a: Column, z: Column) -> Column:
        i = F.array_position(a["poles"], z).cast("int")
        without = F.concat(F.slice(a["poles"], F.lit(1), F.greatest(i - 1, F.lit(0))), F.slice(a["poles"], i + 1, F.size(a["poles"])))
        return F.struct(F.when(i > 0, without).otherwise(a["poles"]).alias("poles"), F.when(i > 0, a["zeros"]).otherwise(F.concat(a["zeros"], F.array(z))).alias("zeros"))

    left = F.aggregate(simple["zeros"], start, step)
    return F.struct(simple["constant"].alias("constant"), left["zeros"].alias("zeros"), left["poles"].alias("poles"))


def sensor_only(chain: Column, frequency: float) -> Column:
    """combined() with all stages but the first and sensors replaced by their gain at one frequency."""
    def flat(s: Column) -> Column:
        v = evaluate(F.struct(F.coalesce(s["constant"], F.lit(1.0)).alias("constant"), s["zeros"].alias("zeros"), s["poles"].alias("poles")), frequency)
        keep = (s["stage"] == F.get(chain, F.lit(0))["stage"]) | (stage_type(s) == "sensor")
        none = F.array().cast(ROOTS)
        return F.struct(F.when(keep, F.coalesce(s["constant"], F.lit(1.0))).otherwise(F.sqrt(v["re"] * v["re"] + v["im"] * v["im"])).alias("constant"), F.when(keep, s["zeros"]).otherwise(none).alias("zeros"), F.when(keep, s["poles"]).otherwise(none).alias("poles"))

    return combined(F.transform(chain, flat))


def to_quantity(simple: Column, source: str, wanted: str) -> Column:
    """The response to ``wanted`` of one that takes ``source``: differentiations are zeros at 0, integrations poles."""
    rank = {"displacement": 0, "velocity": 1, "acceleration": 2}
    if source not in rank or wanted not in rank:
        raise ValueError(f"no way from {wanted} to {source}")
    n = rank[source] - rank[wanted]
    more = F.array_repeat(F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im")), abs(n))
    return F.struct(simple["constant"].alias("constant"), (F.concat(simple["zeros"], more) if n > 0 else simple["zeros"]).alias("zeros"), (F.concat(simple["poles"], more) if n < 0 else simple["poles"]).alias("poles"))
