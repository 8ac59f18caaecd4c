"""SAC files as rows of traces, and back: a binary header of 632 bytes and single-precision samples."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, codes string, tmin_ns long, deltat double, stla double, stlo double, ydata array<double>"
UNDEFINED = -12345


def decode(data: bytes) -> tuple[str, int, float, float | None, float | None, np.ndarray]:
    """(codes, tmin_ns, deltat, latitude, longitude, samples) of an evenly sampled file in either byte order."""
    order = "<" if 1 <= struct.unpack("<i", data[304:308])[0] <= 20 else ">"
    reals, ints = struct.unpack(f"{order}70f", data[:280]), struct.unpack(f"{order}40i", data[280:440])
    text = data[440:632].decode("ascii", "replace")

    def name(at: int) -> str:
        v = text[at : at + 8].strip(" \0")
        return "" if v == str(UNDEFINED) else v

    year, day, hour, minute, second, milli = ints[:6]
    ref = datetime(year, 1, 1, tzinfo=timezone.utc) + timedelta(days=day - 1, hours=hour, minutes=minute, seconds=second) if UNDEFINED not in ints[:6] else datetime(1970, 1, 1, tzinfo=timezone.utc)
    n = ints[9]
    tmin = int(ref.timestamp()) * 10**9 + (milli * 10**6 if milli != UNDEFINED else 0) + round(reals[5] * 1e9)
    # the kinds of header texts: station first, component and network near the end
    codes = ".".join([name(168), name(0), name(24), name(160), ""])
    place = [None if v == UNDEFINED else float(v) for v in reals[31:33]]
    return codes, tmin, float(f"{reals[0]:.7g}"), place[0], place[1], np.frombuffer(data, f"{order}f4", n, 632)


def encode(codes: str, tmin_ns: int, deltat: float, y: np.ndarray) -> bytes:
    network, station, location, channel = (codes.split(".") + [""] * 4)[:4]
    whole = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=tmin_ns // 10**9)
    reals, ints = [float(UNDEFINED)] * 70, [UNDEFINED] * 40
    reals[0], reals[5], reals[6] = deltat, tmin_ns % 10**6 / 1e9, tmin_ns % 10**6 / 1e9 + (len(y) - 1) * deltat
    ints[:6] = [whole.year, whole.timetuple().tm_yday, whole.hour, whole.minute, whole.second, tmin_ns % 10**9 // 10**6]
    ints[6], ints[9], ints[15], ints[35] = 6, len(y), 1, 1
    texts = [f"{UNDEFINED:<8}"] * 24
    texts[0], texts[3], texts[20], texts[21] = (f"{v:<8}"[:8] for v in (station, location or UNDEFINED, channel, network))
    return struct.pack("<70f40i", *reals, *ints) + "".join(texts).encode() + np.asarray(y, "<f4").tobytes()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The traces of all files below a path."""
    return read_contents(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def read_contents(files: DataFrame) -> DataFrame:
    """The traces of (path, content) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *decode(c)) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array([v.astype(float) for v in c] if i == 6 else c, k) for i, (c, k) in enumerate(zip(cols, kinds, strict=True))], names=["path", "codes", "tmin_ns", "deltat", "stla", "stlo", "ydata"])

    return files.mapInArrow(run, SCHEMA)
