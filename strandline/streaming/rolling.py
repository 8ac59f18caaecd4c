"""A rolling archive: chunks of several channels held in state until a window of time is ready, then given out together.

A window of a group of channels is ready when all its channels have passed its end; when most have, by the spread of
their times; or when it has been held for as long as patience allows. So a channel that is late or gone holds up nothing
for longer than that. What comes after its window was given out follows as a late piece, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.times import SECOND

SCHEMA = "group string, wmin_ns long, codes string, tmin_ns long, deltat double, ydata array<double>, late boolean"
PIECE = "wmin_ns long, codes string, tmin_ns long, deltat double, ydata array<double>, held_ms long"


def ready_before(times: list[int], patience: float) -> int:
    """The time that all channels have passed, or the median of theirs less twice their median deviation times patience, if that is later."""
    t = np.sort(np.array(times, np.int64))
    first = int(t[0])
    off = (t - first).astype(float)
    middle = np.median(off)
    return first + max(0, int(middle - 2 * np.median(np.abs(off - middle)) * patience))


def cut_at_windows(tmin: int, step: int, y: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(window, start, samples) of a chunk."""
    first = 0
    while first < len(y):
        t = tmin + first * step
        window = t // size * size
        last = min(len(y), first - (t - window - size) // step)
        yield window, t, y[first:last]
        first = last


def joined(pieces: list[tuple]) -> Iterator[tuple[int, str, int, float, list[float]]]:
    """Pieces in order of window, channel and time; those that continue the one before them, to a tenth of a step, are put together."""
    run, due = None, 0.0
    for w, codes, t, dt, y in sorted((p[:5] for p in pieces), key=lambda p: p[:4]):
        if run is not None and (run[0], run[1], run[3]) == (w, codes, dt) and abs(t - due) < 0.1 * dt * SECOND:
            run[4].append(y)
        else:
            if run is not None:
                yield (*run[:4], np.concatenate(run[4]).tolist())
            run = [w, codes, t, dt, [y]]
        due = t + len(y) * round(dt * SECOND)
    if run is not None:
        yield (*run[:4], np.concatenate(run[4]).tolist())


class Rolling(StatefulProcessor):
    """State of a group: pieces not given out yet, each channel's latest time, and the end of the windows given out."""

    def __init__(self, size: int, patience: float, hold: int, keep: int, at_least: int) -> None:
        self.size, self.patience, self.hold, self.keep, self.at_least = size, patience, hold, keep, at_least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", PIECE, ttlDurationMs=self.keep)
        self.latest = handle.getMapState("latest", "codes string", "t_ns long", ttlDurationMs=self.keep)
        self.done = handle.getValueState("done", "t_ns long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        done = self.done.get()[0] if self.done.exists() else None
        latest = {k[0]: v[0] for k, v in self.latest.iterator()}
        late, fresh, seen = [], [], {}
        for frame in rows:
            for codes, t, dt, y in zip(frame["codes"], frame["tmin_ns"], frame["deltat"], frame["ydata"], strict=True):
                y = np.asarray(y, float)
                step = round(dt * SECOND)
                for w, start, part in cut_at_windows(int(t), step, y, self.size):
                    (late if done is not None and w < done else fresh).append((w, codes, start, float(dt), part.tolist(), now))
                seen[codes] = max(seen.get(codes, latest.get(codes, -(2**62))), int(t) + len(y) * step)
        for codes, t in seen.items():
            self.latest.updateValue((codes,), (t,))
        if fresh:
            self.pieces.appendList(fresh)
        latest |= seen
        if len(latest) >= self.at_least:
            until = ready_before(list(latest.values()), self.patience) // self.size * self.size
            done = until if done is None else max(done, until)
            self.done.update((done,))
        yield self._out(key, late, True)
        yield self._given(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        over = [p[0] + self.size for p in self.pieces.get() if p[5] + self.hold <= now]
        done = self.done.get()[0] if self.done.exists() else None
        if over:
            done = max(over) if done is None else max(done, *over)
            self.done.update((done,))
        yield self._given(key, done)

    def _given(self, key, done: int | None) -> pd.DataFrame:
        """What lies before ``done``; what stays is looked at again when its patience ends."""
        held = list(self.pieces.get())
        out = [p for p in held if done is not None and p[0] < done]
        stay = [p for p in held if done is None or p[0] >= done]
        if out and stay:
            self.pieces.put(stay)
        elif out:
            self.pieces.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if stay:
            self.handle.registerTimer(min(p[5] for p in stay) + self.hold)
        return self._out(key, out, False)

    def _out(self, key, pieces: list[tuple], late: bool) -> pd.DataFrame:
        rows = [(key[0], *r, late) for r in joined(pieces)]
        return pd.DataFrame(rows, columns=["group", "wmin_ns", "codes", "tmin_ns", "deltat", "ydata", "late"])


def rolling(chunks: DataFrame, group: Column, length: float, patience: float = 1.0, hold: float = 300.0, keep: float = 3600.0, at_least: int = 1) -> DataFrame:
    """(group, wmin_ns, codes, tmin_ns, deltat, ydata, late): chunks (codes, tmin_ns, deltat, ydata) of a stream by windows of
    ``length`` seconds, given out when they are ready.

    ``group`` (such as the station of the codes) is what has to be ready together; its channels share a task's memory with
    the windows held. ``patience`` scales how far channels may lag behind the others; no window is held for over ``hold``
    seconds of processing time. Channels that send nothing for ``keep`` seconds count no longer, and ``at_least`` so many
    must have sent something before a window is ready without its hold. Needs the RocksDB state store, and a trigger that
    goes on (timers keep a stream with ``availableNow`` from ending).

    Null codes, times or intervals, and null or empty samples are left out; nulls among samples become NaN. Repeated chunks
    are given out twice.
    """
    if keep <= hold:
        raise ValueError("state must be kept for longer than windows are held")
    own = chunks.where("codes is not null and tmin_ns is not null and deltat > 0 and size(ydata) > 0")
    keyed = own.select(F.coalesce(group, F.lit("")).alias("group"), "codes", F.col("tmin_ns").cast("long").alias("tmin_ns"), F.col("deltat").cast("double").alias("deltat"), F.col("ydata").cast("array<double>").alias("ydata"))
    processor = Rolling(round(length * SECOND), patience, round(hold * 1000), round(keep * 1000), at_least)
    return keyed.groupBy("group").transformWithStateInPandas(processor, SCHEMA, "append", "ProcessingTime")
