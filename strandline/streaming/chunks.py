"""Streams of trace chunks (codes, tmin_ns, deltat, ydata) with state carried from chunk to chunk.

State is kept per codes and holds only what the next chunk needs: filter memory, a
buffer of unfinished samples and the time the next chunk has to start at. A chunk
that does not continue the last one, or has another rate, starts anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import kernels as K

SCHEMA = "codes string, tmin_ns long, deltat double, ydata array<double>"
STATE = "next_ns long, deltat double, memory array<double>"


def stateful(chunks: DataFrame, step: Callable[[int, float, np.ndarray, np.ndarray | None], tuple[list[tuple[int, float, np.ndarray]], np.ndarray]]) -> DataFrame:
    """step(tmin_ns, deltat, samples, memory or None) returns chunks out and the memory for the next."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, rate, memory = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(frames)).sort_values("tmin_ns", kind="stable")
        out = []
        for t, dt, y in zip(rows["tmin_ns"], rows["deltat"], rows["ydata"], strict=True):
            y = np.array(y, float)
            if not len(y):
                continue
            fits = due is not None and rate == dt and abs(int(t) - due) <= 0.05 * dt * 1e9
            made, m = step(int(t), float(dt), y, np.array(memory, float) if fits else None)
            out += made
            due, rate, memory = int(t) + len(y) * round(dt * 1e9), float(dt), [float(v) for v in m]
        if due is not None:
            state.update((due, rate, memory))
        yield pd.DataFrame({"codes": [key[0]] * len(out), "tmin_ns": [o[0] for o in out], "deltat": [o[1] for o in out], "ydata": [o[2].tolist() for o in out]}, columns=["codes", "tmin_ns", "deltat", "ydata"])

    return chunks.select("codes", "tmin_ns", "deltat", "ydata").groupBy("codes").applyInPandasWithState(run, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)


def lfilter(chunks: DataFrame, b: np.ndarray, a: np.ndarray) -> DataFrame:
    """Each channel filtered as if its chunks were one trace; filters with feedback as a cascade, whose states are carried."""
    rows = K.sections_of(b, a) if len(a) > 1 else None

    def step(t, dt, y, memory):
        own, z = y[None], None if memory is None else memory[None]
        out, z = K.lfilter(b, a, own, z) if rows is None else K.sosfilt(rows, own, z)
        return [(t, dt, out[0])], z[0]

    return stateful(chunks, step)


def downsample(chunks: DataFrame, factor: int) -> DataFrame:
    """Low-pass and every factor-th sample, on the grid of multiples of the new interval; times include the filter's delay."""
    h = K.firwin(20 * factor + 1, 0.75 / factor)

    def step(t, dt, y, memory):
        out, z = K.lfilter(h, np.array([1.0]), y[None], None if memory is None else memory[None])
        ns = round(dt * 1e9)
        first = -(t // ns) % factor
        picked = out[0][first::factor]
        return ([(t + first * ns, dt * factor, picked)] if len(picked) else []), z[0]

    return stateful(chunks, step)


def recursive_sta_lta(chunks: DataFrame, tshort: float, tlong: float) -> DataFrame:
    def step(t, dt, y, memory):
        out, s = K.recursive_sta_lta(y[None], dt, tshort, tlong, None if memory is None else memory[None])
        return [(t, dt, out[0])], s[0]

    return stateful(chunks, step)


def fixate(chunks: DataFrame, length: float) -> DataFrame:
    """Chunks gathered and cut at multiples of ``length`` seconds; a piece is given out when the samples have passed its end."""
    def step(t, dt, y, memory):
        ns, size = round(dt * 1e9), round(length * 1e9)
        buffer = y if memory is None else np.concatenate([memory, y])
        start = t - (len(buffer) - len(y)) * ns
        out = []
        while True:
            n = -(-((start // size + 1) * size - start) // ns)
            if len(buffer) < n:
                return out, buffer
            out.append((start, dt, buffer[:n]))
            buffer, start = buffer[n:], start + n * ns

    return stateful(chunks, step)


def window_stats(samples: DataFrame, width: str, late: str, key: str = "codes", time: str = "ts", value: str = "y") -> DataFrame:
    """Count, mean and extremes per key and tumbling window; a window ends when the watermark has passed it."""
    w = F.window(F.col(time), width)
    stats = samples.withWatermark(time, late).groupBy(key, w).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return stats.select(key, F.col("window.start").alias("start"), "n", "mean", "lo", "hi")


def ready_until(latest: DataFrame, patience: float = 1.0, time: str = "t_ns") -> DataFrame:
    """One row: the time up to which channels count as complete, their median less twice the median deviation times patience."""
    middle = latest.agg(F.median(time).alias("m"))
    spread = latest.crossJoin(F.broadcast(middle)).agg(F.max("m").alias("m"), F.median(F.abs(F.col(time) - F.col("m"))).alias("mad"))
    return spread.select((F.col("m") - 2 * F.col("mad") * patience).cast("long").alias("ready_ns"))
