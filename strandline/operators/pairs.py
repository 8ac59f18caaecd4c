"""Operators on several traces: rotation and projection of components, stacks, consistency, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A


def _aligned(parts: DataFrame, group: list[str], channel: str, names: list[str]) -> DataFrame:
    """One row per group and rate with the components cut to their common span, as columns y0, y1, ...; others are left out.

    Sampling instants may differ by a hundredth of a step at most. A group is one row per component.
    """
    keys = [*group, "deltat"]
    of = [F.max(F.when(F.col(channel) == n, F.struct("tmin_ns", "ydata"))).alias(f"c{i}") for i, n in enumerate(names)]
    wide = parts.where(F.col(channel).isin(names)).groupBy(*keys).agg(*of).where(" and ".join(f"c{i} is not null" for i in range(len(names))))
    step = A.step_ns(F.col("deltat"))
    lo = F.greatest(*(F.col(f"c{i}.tmin_ns") for i in range(len(names)))) if len(names) > 1 else F.col("c0.tmin_ns")
    ends = [A.tmax_ns(F.col(f"c{i}.tmin_ns"), F.col("deltat"), F.col(f"c{i}.ydata")) for i in range(len(names))]
    hi = F.least(*ends) if len(names) > 1 else ends[0]
    wide = wide.withColumns({"__lo": lo, "__hi": hi}).where("__hi >= __lo")
    for i in range(len(names)):
        off = F.abs((F.col(f"c{i}.tmin_ns") - F.col("__lo")) / step - F.rint((F.col(f"c{i}.tmin_ns") - F.col("__lo")) / step))
        wide = wide.where(off <= 0.01)
    cut = {f"y{i}": A.chop(F.col(f"c{i}.tmin_ns"), F.col("deltat"), F.col(f"c{i}.ydata"), F.col("__lo"), F.col("__hi"), include_last=True)["ydata"] for i in range(len(names))}
    return wide.withColumns(cut).select(*keys, F.col("__lo").alias("tmin_ns"), *cut)


def _long(wide: DataFrame, group: list[str], channel: str, outs: dict[str, Column]) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(n).alias(channel), y.alias("ydata")) for n, y in outs.items())))
    return wide.select(*group, "deltat", "tmin_ns", each.alias("__o")).select(*group, "deltat", "tmin_ns", f"__o.{channel}", "__o.ydata")


def rotate(traces: DataFrame, group: list[str], channel: str, azimuth: float, ins: tuple[str, str], outs: tuple[str, str]) -> DataFrame:
    """Two components turned by an angle in degrees, on the common span of each pair."""
    wide = _aligned(traces, group, channel, list(ins))
    a, b = A.rotate(F.col("y0"), F.col("y1"), azimuth)
    return _long(wide, group, channel, dict(zip(outs, (a, b), strict=True)))


def independent_parts(matrix: list[list[float]], ins: list[str], outs: list[str], least: float = 1e-9) -> list[tuple[list[int], list[int]]]:
    """(rows, columns) of the blocks that a matrix falls into, so that each can work without the other's components."""
    left, parts = set(range(len(outs))), []
    while left:
        rows, cols = {min(left)}, set()
        while True:
            c = {j for i in rows for j in range(len(ins)) if abs(matrix[i][j]) > least}
            r = {i for i in range(len(outs)) if any(abs(matrix[i][j]) > least for j in c)} | rows
            if (r, c) == (rows, cols):
                break
            rows, cols = r, c
        left -= rows
        if cols:
            parts.append((sorted(rows), sorted(cols)))
    return parts


def project(traces: DataFrame, group: list[str], channel: str, matrix: list[list[float]], ins: list[str], outs: list[str]) -> DataFrame:
    """matrix times the components of each group, block by block."""
    out = None
    for rows, cols in independent_parts(matrix, ins, outs):
        wide = _aligned(traces, group, channel, [ins[j] for j in cols])
        ys = A.project([F.col(f"y{k}") for k in range(len(cols))], [[matrix[i][j] for j in cols] for i in rows])
        one = _long(wide, group, channel, dict(zip((outs[i] for i in rows), ys, strict=True)))
        out = one if out is None else out.unionByName(one)
    return out


def value_range(traces: DataFrame, keys: list[str], mode: str = "minmax", outer: str = "minmax", k: float = 1.0) -> DataFrame:
    """(keys, lo, hi): range of the values, by each trace's extremes or mean and k standard deviations; outer robust: 10 and 90 %."""
    y = F.col("ydata")
    if mode == "minmax":
        lo, hi = F.array_min(y), F.array_max(y)
    else:
        mean = A.mean(y)
        std = F.sqrt(A.total(F.transform(y, lambda v: (v - mean) * (v - mean))) / F.size(y))
        lo, hi = mean - k * std, mean + k * std
    each = traces.select(*keys, lo.alias("__lo"), hi.alias("__hi"))
    if outer == "minmax":
        return each.groupBy(*keys).agg(F.min("__lo").alias("lo"), F.max("__hi").alias("hi"))
    return each.groupBy(*keys).agg(F.percentile("__lo", 0.1).alias("lo"), F.percentile("__hi", 0.9).alias("hi"))


def stack(samples: DataFrame, shifts: DataFrame, keys: list[str], method: int = 0) -> DataFrame:
    """Delay-and-sum stack: samples (keys, array_id, i, y) and shifts (ishift, array_id, shift, weight).

    Method 0: (keys, ishift, i, y) sums of all arrays at i + shift; method 1: the largest per shift.
    Each sample is multiplied by the shifts of its array, and sums are partial before they move.
    """
    moved = samples.join(shifts, "array_id").select(*keys, "ishift", (F.col("i") + F.col("shift")).alias("i"), (F.col("y") * F.col("weight")).alias("y"))
    full = moved.groupBy(*keys, "ishift", "i").agg(F.sum("y").alias("y"))
    if method == 0:
        return full
    return full.groupBy(*keys, "ishift").agg(F.max(F.struct("y", (-F.col("i")).alias("o"))).alias("m")).select(*keys, "ishift", F.col("m.y").alias("y"), (-F.col("m.o")).alias("i"))


def consistency(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, n_values, merged): per column how many values a group has, and the most frequent one, the smaller on ties."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    long = df.select(*keys, each.alias("__e")).select(*keys, "__e.column", "__e.value").groupBy(*keys, "column", "value").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "value"))
    return long.where("value is not null").groupBy(*keys, "column").agg(F.count("*").alias("n_values"), best["value"].alias("merged"))
