"""Recursive filters along channels whose pieces lie in many files, as a prefix scan.

Over a piece of n samples a filter's state z becomes M^n z + w, where M depends on the filter alone and w is the state
that the piece leaves when it starts from rest. Tasks work out w of every piece; the pieces' states are then composed
within blocks of time and over the blocks, from counts and states only; and every piece is filtered from the state that
it starts with. No channel meets in one task, and samples move once at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..functions.times import DAY, floor_div
from .settle import settled


def _rows(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Samples of each trace by offsets; None for null traces, and for those that hold a null."""
    flat = column.values
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(float) if len(flat) else np.zeros(0)
    bad = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))]) if flat.null_count else None
    offsets, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        lo, hi = offsets[i], offsets[i + 1]
        yield None if not valid[i] or lo == hi or bad is not None and bad[hi] > bad[lo] else values[lo:hi]


def transition(sections: np.ndarray) -> np.ndarray:
    """What the states of a cascade become over one sample of zero: a section's output goes into the ones behind it."""
    size = 2 * len(sections)
    out = np.zeros((size, size))
    for k in range(size):
        unit = np.eye(size)[k]
        out[:, k] = K.sosfilt(sections, np.zeros((1, 1)), unit[None])[1][0]
    return out


def power(step: np.ndarray, n: int) -> np.ndarray:
    return np.linalg.matrix_power(step, n)


def _compose(pieces: list[tuple], step: np.ndarray, state: np.ndarray, ends: float | None) -> tuple[list[list[float]], np.ndarray, float | None, bool]:
    """Start states of (tmin, tmax, dt, open, n, w) in order, the state after them, their end, and whether none began anew."""
    starts, through = [], True
    for k, (tmin, tmax, dt, open_, n, w) in enumerate(pieces):
        if ends is None or abs(tmin - ends) > dt / 2:  # a gap, an overlap, or the first piece
            state = np.zeros(len(step))
            through = through and k == 0
        starts.append(state.tolist())
        state = (power(step, n) @ state if open_ else 0) + np.asarray(w)
        through = through and open_
        ends = tmax
    return starts, state, ends, through


def filter_channels(traces: DataFrame, sections: np.ndarray, keys: list[str], width: int = DAY, y: str = "ydata", dt: str = "deltat") -> DataFrame:
    """traces with each channel's samples filtered as if its pieces were one trace, however they are dealt out.

    ``sections`` is a cascade of second order (kernels.butter_sections, kernels.sections_of), whose powers stay accurate.
    A piece goes on where the one before it, by tmin_ns, ends within half an interval; after gaps and overlaps the filter
    starts from rest. Pieces are composed by blocks of ``width`` nanoseconds, then block by block. Traces that are null,
    empty or hold nulls come back as null and count as gaps; of pieces with the same start the longest is followed.
    """
    step, order = transition(sections), 2 * len(sections)
    own = traces.select(*keys, "tmin_ns", dt, y)
    kinds = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keys)

    def from_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n = [], []
            for row in _rows(batch.column(y)):
                w.append(None if row is None else K.sosfilt(sections, row[None])[1][0].tolist())
                n.append(0 if row is None else len(row))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("tmin_ns").cast(pa.int64()), batch.column(dt).cast(pa.float64()), pa.array(n, pa.int64()), pa.array(w, pa.list_(pa.float64()))], names=[*keys, "tmin_ns", "dt", "n", "w"])

    pieces = own.mapInArrow(from_rest, f"{kinds}, tmin_ns long, dt double, n long, w array<double>").where("w is not null and tmin_ns is not null and dt > 0")
    last = pieces.groupBy(*keys, "tmin_ns").agg(F.max_by(F.struct("dt", "n", "w"), "n").alias("x")).select(*keys, "tmin_ns", "x.*")
    pieces = settled(last.withColumn("__block", floor_div(F.col("tmin_ns"), width)), "pieces")

    def listed(t: pa.Table) -> list[tuple]:
        t = t.sort_by("tmin_ns").to_pydict()
        return [(m, m + n * s * 1e9, s * 1e9, True, n, w) for m, s, n, w in zip(t["tmin_ns"], t["dt"], t["n"], t["w"], strict=True)]

    def of_block(t: pa.Table) -> pa.Table:
        p = listed(t)
        _, state, ends, through = _compose(p, step, np.zeros(order), None)
        return pa.table({**{k: t.column(k).slice(0, 1) for k in [*keys, "__block"]}, "tmin": pa.array([p[0][0]], pa.int64()), "tmax": [ends], "dt": [p[0][2]], "open": [through], "n": pa.array([sum(x[4] for x in p)], pa.int64()), "w": pa.array([state.tolist()], pa.list_(pa.float64()))})

    def of_channel(t: pa.Table) -> pa.Table:
        t = t.sort_by("tmin")
        p = list(zip(*(t.column(k).to_pylist() for k in ("tmin", "tmax", "dt", "open", "n", "w")), strict=True))
        starts = _compose(p, step, np.zeros(order), None)[0]
        before = [None, *t.column("tmax").to_pylist()[:-1]]
        return pa.table({**{k: t.column(k) for k in [*keys, "__block"]}, "state": pa.array(starts, pa.list_(pa.float64())), "ends": pa.array(before, pa.float64())})

    blocks = pieces.groupBy(*keys, "__block").applyInArrow(of_block, f"{kinds}, `__block` long, tmin long, tmax double, dt double, open boolean, n long, w array<double>")
    entry = blocks.groupBy(*keys).applyInArrow(of_channel, f"{kinds}, `__block` long, state array<double>, ends double")

    def of_piece(t: pa.Table, known: pa.Table) -> pa.Table:
        t = t.sort_by("tmin_ns")
        starts = _compose(listed(t), step, np.array(known.column("state")[0].as_py()), known.column("ends")[0].as_py())[0]
        return pa.table({**{k: t.column(k) for k in [*keys, "tmin_ns"]}, "__state": pa.array(starts, pa.list_(pa.float64()))})

    states = pieces.groupBy(*keys, "__block").cogroup(entry.groupBy(*keys, "__block")).applyInArrow(of_piece, f"{kinds}, tmin_ns long, `__state` array<double>")
    on = [traces[k].eqNullSafe(states[k]) for k in [*keys, "tmin_ns"]]
    met = traces.join(states, on, "left").select(*(traces[c] for c in traces.columns), states["__state"])
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == y else f for f in traces.schema.fields])

    names = traces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, state in zip(_rows(batch.column(y)), batch.column("__state").to_pylist(), strict=True):
                out.append(None if row is None or state is None else K.sosfilt(sections, row[None], np.array(state)[None])[0][0])
            done = pa.array(out, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([done if n == y else batch.column(n) for n in names], names=names)

    return met.mapInArrow(run, schema)
