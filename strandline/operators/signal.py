"""Signal operators over traces in array form, in Arrow batches.

A batch's traces are grouped by length and rate and go through a numpy kernel
together; nothing is shuffled. Traces with nulls or no samples give null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K


def _by_shape(batch: pa.RecordBatch, y: str, dt: str) -> Iterator[tuple[list[int], np.ndarray, float]]:
    """(rows of the batch, their samples, interval) of all traces of one length and interval; those with nulls are left out."""
    column = batch.column(y)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    steps = pc.fill_null(batch.column(dt).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    ok = (lengths > 0) & (steps != 0)
    flat = column.flatten()
    if flat.null_count:
        ok[pc.list_parent_indices(column).filter(pc.is_null(flat)).to_numpy()] = False
    for n, step in sorted(set(zip(lengths[ok].tolist(), steps[ok].tolist(), strict=True))):
        ids = np.flatnonzero(ok & (lengths == n) & (steps == step))
        yield ids.tolist(), column.take(pa.array(ids)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), n), step


def map_traces(traces: DataFrame, kernel: Callable[[np.ndarray, float], np.ndarray], out: str = "ydata", y: str = "ydata", dt: str = "deltat") -> DataFrame:
    """traces with a column of kernel(rows, deltat): one row out for each row in, of any length."""
    kept = traces.drop(out) if out != y else traces
    schema = T.StructType([f for f in kept.schema.fields if f.name != out] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list = [None] * batch.num_rows
            for ids, rows, step in _by_shape(batch, y, dt):
                for i, row in zip(ids, kernel(rows, step), strict=True):
                    done[i] = row
            rest = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(done, pa.list_(pa.float64()))], names=[*rest, out])

    return kept.mapInArrow(run, schema)


def lowpass(traces: DataFrame, corner: float, order: int = 4, **rest) -> DataFrame:
    return map_traces(traces, lambda y, dt: K.iir(y, dt, "lowpass", [corner], order), **rest)


def highpass(traces: DataFrame, corner: float, order: int = 4, **rest) -> DataFrame:
    return map_traces(traces, lambda y, dt: K.iir(y, dt, "highpass", [corner], order), **rest)


def bandpass(traces: DataFrame, low: float, high: float, order: int = 4, **rest) -> DataFrame:
    return map_traces(traces, lambda y, dt: K.iir(y, dt, "bandpass", [low, high], order), **rest)


def bandstop(traces: DataFrame, low: float, high: float, order: int = 4, **rest) -> DataFrame:
    return map_traces(traces, lambda y, dt: K.iir(y, dt, "bandstop", [low, high], order), **rest)


def bandpass_fft(traces: DataFrame, low: float, high: float, **rest) -> DataFrame:
    return map_traces(traces, lambda y, dt: K.bandpass_fft(y, dt, low, high), **rest)


def envelope(traces: DataFrame, **rest) -> DataFrame:
    return map_traces(traces, K.envelope, **rest)


def whiten(traces: DataFrame, order: int = 6, **rest) -> DataFrame:
    return map_traces(traces, lambda y, dt: K.whiten(y, dt, order), **rest)


def spectral_whiten(traces: DataFrame, width: float, **rest) -> DataFrame:
    return map_traces(traces, lambda y, dt: K.spectral_whiten(y, dt, width), **rest)


def autocorr(traces: DataFrame, n: int, **rest) -> DataFrame:
    return map_traces(traces, lambda y, dt: K.autocorr(y, dt, n), **rest)


def recursive_sta_lta(traces: DataFrame, tshort: float, tlong: float, **rest) -> DataFrame:
    return map_traces(traces, lambda y, dt: K.recursive_sta_lta(y, dt, tshort, tlong)[0], **rest)


def transfer(traces: DataFrame, response, limits: tuple[float, float, float, float] | None = None, invert: bool = False, tfade: float = 0.0, **rest) -> DataFrame:
    return map_traces(traces, lambda y, dt: K.transfer(y, dt, response, limits, invert, tfade), **rest)


def resample(traces: DataFrame, deltat: float, **rest) -> DataFrame:
    return map_traces(traces, lambda y, dt: K.resample(y, dt, deltat), **rest).withColumn("deltat", F.lit(float(deltat)))


def downsample(traces: DataFrame, factor: int, filter: str = "window", **rest) -> DataFrame:
    """Every factor-th sample, on the grid of multiples of the new interval, after the anti-alias filter.

    filter: window, or equiripple with its pass band up to 0.75 and its stop band from 1 of the new highest frequency on.
    """
    step = F.rint(F.col("deltat") * 1e9).cast("long")
    number = F.call_function("div", F.col("tmin_ns"), step)
    out = map_traces(traces, lambda y, dt: _smoothed(y, factor, filter), **rest)
    # a column of its own: inside of a lambda, names of columns that are replaced beside it mean the new ones
    out = out.withColumn("__first", F.pmod(-number, F.lit(factor)).cast("int"))
    out = out.withColumn("ydata", F.filter("ydata", lambda v, i: F.pmod(i - F.col("__first"), F.lit(factor)) == 0))
    return out.withColumns({"tmin_ns": F.col("tmin_ns") + F.col("__first") * step, "deltat": F.col("deltat") * factor}).drop("__first")


@lru_cache
def _smoother(factor: int, filter: str) -> np.ndarray:
    if filter == "window":
        return K.firwin(40 * factor // 2 * 2 + 1, 0.75 / factor)
    if filter == "equiripple":
        return K.equiripple(45 * factor // 2 * 2 + 1, ((0, 0.75 / factor), (1 / factor, 1)), (1.0, 0.0), (1.0, 50.0))
    raise ValueError(f"unknown filter {filter}")


def _smoothed(y: np.ndarray, factor: int, filter: str) -> np.ndarray:
    h = _smoother(factor, filter)
    taps = len(h)
    return np.stack([np.convolve(r, h, "valid") for r in np.pad(y, ((0, 0), (taps // 2, taps // 2)), "edge")])


def spectrum(traces: DataFrame, pad_to_pow2: bool = False) -> DataFrame:
    """traces with arrays freq, re and im of the real Fourier transform."""
    size = (lambda n: K.next_pow2(n)) if pad_to_pow2 else (lambda n: n)

    def both(y: np.ndarray, dt: float) -> np.ndarray:
        z = np.fft.rfft(y, size(y.shape[1]), axis=1)
        return np.concatenate([z.real, z.imag], axis=1)

    half = F.floor(F.size("__z") / 2).cast("int")
    out = map_traces(traces, both, out="__z").withColumns({"re": F.slice("__z", F.lit(1), half), "im": F.slice("__z", half + 1, half)}).drop("__z")
    n = F.size("ydata") if not pad_to_pow2 else F.pow(F.lit(2.0), F.ceil(F.log2(F.size("ydata").cast("double"))))
    return out.withColumn("freq", F.transform("re", lambda v, i: i / (n * F.col("deltat"))))


def filter_bank(traces: DataFrame, frequencies: list[float], width: float) -> DataFrame:
    """One row per centre frequency: the envelope in a Gaussian band of that relative width."""
    wide = traces.withColumn("centre", F.explode(F.array(*map(F.lit, frequencies))))

    schema = wide.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list = [None] * batch.num_rows
            centres = batch.column("centre").to_pylist()
            for ids, rows, step in _by_shape(batch, "ydata", "deltat"):
                f = np.fft.fftfreq(rows.shape[1], step)
                c = np.array([centres[i] for i in ids])[:, None]
                band = np.exp(-(((f[None, :] - c) / (width * c)) ** 2)) * (f > 0) * 2
                for i, row in zip(ids, np.abs(np.fft.ifft(np.fft.fft(rows, axis=1) * band, axis=1)), strict=True):
                    done[i] = row
            at = batch.schema.get_field_index("ydata")
            yield batch.set_column(at, "ydata", pa.array(done, pa.list_(pa.float64())))

    return wide.mapInArrow(run, schema)


def peaks(traces: DataFrame, threshold: float, tsearch: float, deadtime: float = 0.0, by_size: bool = False) -> DataFrame:
    """(all columns but ydata, peak_ns, peak): peaks of each trace, in time order or, by size, with suppressed neighbours."""
    rest = [f for f in traces.schema.fields if f.name != "ydata"]
    schema = T.StructType([*rest, T.StructField("peak_ns", T.LongType()), T.StructField("peak", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, at, value = [], [], []
            starts = batch.column("tmin_ns").to_pylist()
            for ids, rows, step in _by_shape(batch, "ydata", "deltat"):
                for i, row in zip(ids, rows, strict=True):
                    k, v = K.top_peaks(row, step, threshold, tsearch) if by_size else K.peaks(row, step, threshold, tsearch, deadtime)
                    of += [i] * len(k)
                    at += [starts[i] + round(x * step * 1e9) for x in k]
                    value += v
            picked = batch.select([f.name for f in rest]).take(pa.array(of, pa.int32()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(at, pa.int64()), pa.array(value, pa.float64())], names=schema.names)

    return traces.mapInArrow(run, schema)


def pairwise(pairs: DataFrame, kernel: Callable, out: str) -> DataFrame:
    """pairs (with ya, yb and deltat) with kernel(a, b, deltat) as an array of doubles."""
    schema = T.StructType([*(f for f in pairs.schema.fields if f.name not in ("ya", "yb", out)), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [None if a is None or b is None else kernel(np.array(a, float), np.array(b, float), dt) for a, b, dt in zip(batch.column("ya").to_pylist(), batch.column("yb").to_pylist(), batch.column("deltat").to_pylist(), strict=True)]
            rest = [n for n in schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(done, pa.list_(pa.float64()))], names=[*rest, out])

    return pairs.mapInArrow(run, schema)


def correlate(pairs: DataFrame, mode: str = "full", normal: bool = False) -> DataFrame:
    """pairs (ya, yb, ta_ns, tb_ns, deltat, ...) with their cross-correlation c and the time tmin_ns of its first lag."""
    lags = {"full": 1 - F.size("ya"), "valid": F.least(F.lit(0), F.size("yb") - F.size("ya")), "same": 1 - F.size("ya") + F.floor((F.size("ya") + F.size("yb") - 1 - F.greatest(F.size("ya"), F.size("yb"))) / 2)}
    first = pairs.withColumn("tmin_ns", F.col("tb_ns") - F.col("ta_ns") + lags[mode].cast("long") * F.rint(F.col("deltat") * 1e9).cast("long"))
    return pairwise(first, lambda a, b, dt: K.correlate(a, b, mode, normal)[0], "c")


def deconvolve(pairs: DataFrame, water: float) -> DataFrame:
    return pairwise(pairs, lambda a, b, dt: K.deconvolve(a, b, water), "c")


def antidrift(traces: DataFrame, true_start: str, true_end: str) -> DataFrame:
    """traces resampled from the times their clocks showed to true ones: the columns give the true times of the first and
    the last sample; out comes the same interval over the true span."""
    step = F.rint(F.col("deltat") * 1e9)
    drifted = (F.col(true_end) - F.col(true_start)) / ((F.size("ydata") - 1) * step)  # true length of a sample
    schema = traces.schema
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for y, r in zip(batch.column("ydata").to_pylist(), batch.column("__drift").to_pylist(), strict=True):
                if not y or len(y) < 2 or not r:
                    out.append(y)
                    continue
                n = int(np.floor((len(y) - 1) * r + 1e-9)) + 1
                out.append(K.stretch(np.array([y], float), np.arange(n) / r)[0])
            at = names.index("ydata")
            kept = [pa.array(out, pa.list_(pa.float64())) if i == at else batch.column(n) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(kept, names=names)

    moved = traces.withColumn("tmin_ns", F.col(true_start)).withColumn("__drift", drifted)
    return moved.mapInArrow(run, schema)


def delays(pairs: DataFrame, span: tuple[float, float] = (0.3, 0.45)) -> DataFrame:
    """pairs with ``delay`` as an array: seconds that yb is later than ya, the correlation and the spread."""
    return pairwise(pairs, lambda a, b, dt: np.array(K.delay(a, b, dt, span)), "delay")
