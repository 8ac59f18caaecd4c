"""Selections, rectangles of codes and time, merged along both axes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import BLOCK, merge_spans

#: The axes of codes, in the order in which they are merged.
AXES = ("channel", "location", "station", "network")


def merge_selections(asked: DataFrame, axes: tuple[str, ...] = AXES, pad_ns: int = 0, block: int = BLOCK) -> DataFrame:
    """(each axis an array of codes, sorted; tmin_ns, tmax_ns): rectangles that cover what is asked for, and each of it once.

    asked: (axes, tmin_ns, tmax_ns), spans padded by pad_ns on both sides first. Spans of equal codes that overlap or touch become one; then, axis by
    axis, rectangles that differ in nothing but that axis become one with the codes of both. As every combination
    of codes and time lies in one rectangle, no two of the result can still be merged: neither in time, since
    a code's spans don't touch, nor along an axis, since what agrees in all else was grouped.

    Null codes count as a code of their own, ''; spans without a bound, or that end before they start, are left out; empty ones
    (an instant) ask for a nanosecond. Arrays are as long as an axis has codes, which is a matter of the inventory and not of the data.
    """
    spans = asked.select(*(F.coalesce(F.col(a).cast("string"), F.lit("")).alias(a) for a in axes), (F.col("tmin_ns") - pad_ns).alias("tmin_ns"), (F.greatest(F.col("tmax_ns"), F.col("tmin_ns") + 1) + pad_ns).alias("tmax_ns"), (F.col("tmax_ns") >= F.col("tmin_ns")).alias("ok")).where("ok").drop("ok")
    out = merge_spans(spans.distinct(), list(axes), block=block)
    for axis in axes:
        rest = [c for c in out.columns if c != axis]
        out = out.groupBy(*rest).agg(F.sort_array(F.collect_set(axis)).alias(axis))
    return out.select(*axes, "tmin_ns", "tmax_ns")


def expand_selections(rectangles: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Rectangles back as one row per code and span."""
    for axis in axes:
        rectangles = rectangles.withColumn(axis, F.explode(axis))
    return rectangles
