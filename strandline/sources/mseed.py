"""miniSEED records as rows of traces, and back.

Files are read as bytes by Spark's own reader and decoded in Arrow batches; each
record gives one row, which ``operators.joining.degap`` joins. Encodings: 16 and 32
bit integers, floats and doubles, and both Steim compressions.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, codes string, tmin_ns long, deltat double, quality string, ydata array<double>"
#: Number of differences and their bits by the two bits of a word and, in the second compression, its own first two.
STEIM1 = {1: (4, 8), 2: (2, 16), 3: (1, 32)}
STEIM2 = {(1, None): (4, 8), (2, 1): (1, 30), (2, 2): (2, 15), (2, 3): (3, 10), (3, 0): (5, 6), (3, 1): (6, 5), (3, 2): (7, 4)}
PLAIN = {1: "i2", 3: "i4", 4: "f4", 5: "f8"}


def steim(data: bytes, n: int, version: int, order: str = ">") -> np.ndarray:
    """Samples of compressed frames; the last one must be what the first frame says."""
    words = np.frombuffer(data[: len(data) // 64 * 64], f"{order}u4").astype(np.int64).reshape(-1, 16)
    first, last = (int(np.int32(np.uint32(words[0, k]))) for k in (1, 2))
    code = words[:, :1] >> (30 - 2 * np.arange(16)) & 3
    code[:, 0] = 0
    code[0, 1:3] = 0
    words, code = words.ravel(), code.ravel()
    kind = code if version == 1 else np.where(code > 1, code * 4 + (words >> 30), code)
    forms = {(k if version == 1 else k[0] if k[1] is None else k[0] * 4 + k[1]): v for k, v in (STEIM1 if version == 1 else STEIM2).items()}
    if set(kind[code > 0].tolist()) - set(forms):
        raise ValueError("a compressed record is damaged")
    counts = np.zeros(len(words), np.int64)
    for k, (count, _) in forms.items():
        counts[(kind == k) & (code > 0)] = count
    begin = np.cumsum(counts) - counts
    diffs = np.zeros(int(counts.sum()), np.int64)
    for k, (count, bits) in forms.items():
        own = np.flatnonzero((kind == k) & (code > 0))
        for j in range(count):
            v = words[own] >> ((count - 1 - j) * bits) & ((1 << bits) - 1)
            diffs[begin[own] + j] = np.where(v >> (bits - 1), v - (1 << bits), v)
    y = np.cumsum(np.concatenate([[first], diffs[1:n]]))
    if len(y) != n or y[-1] != last:
        raise ValueError("a compressed record is damaged")
    return y


@dataclass(frozen=True)
class Header:
    """What a record says of itself; its samples are decoded only when asked for."""

    at: int
    length: int
    codes: str
    tmin_ns: int
    deltat: float
    quality: str
    n: int
    encoding: int
    begin: int
    big: bool

    @property
    def tmax_ns(self) -> int:
        """Just behind the last sample."""
        return self.tmin_ns + round(self.n * self.deltat * 1e9)

    def samples(self, data: bytes, base: int = 0) -> np.ndarray:
        """``base``: where data begins in the file."""
        body, order = data[self.at - base + self.begin : self.at - base + self.length], ">" if self.big else "<"
        if self.encoding in (10, 11):
            return steim(body, self.n, self.encoding - 9, order)
        if self.encoding in PLAIN:
            return np.frombuffer(body, order + PLAIN[self.encoding], self.n)
        raise ValueError(f"encoding {self.encoding} is not read")


def header(data: bytes, at: int, base: int = 0) -> Header | None:
    """The header of the record that begins at place ``at`` of a file, of which data is what begins at ``base``; None if none begins there."""
    head = data[at - base : at - base + 48]
    if len(head) < 48 or not re.match(rb"[0-9 ]{6}[DRQM][ \0]", head):
        return None
    order = ">" if 1900 <= struct.unpack(">H", head[20:22])[0] <= 2100 else "<"
    station, location, channel, network = (head[a:b].decode("ascii", "replace").strip() for a, b in ((8, 13), (13, 15), (15, 18), (18, 20)))
    year, day, hour, minute, second, _, fract = struct.unpack(f"{order}HHBBBBH", head[20:30])
    if not (1 <= year <= 9999 and 1 <= day <= 366 and hour < 24 and minute < 60 and second <= 60):
        return None
    n, factor, multiplier = struct.unpack(f"{order}Hhh", head[30:36])
    correction, begin, blockette = struct.unpack(f"{order}iHH", head[40:48])
    rate = (factor if factor > 0 else -1 / factor if factor else 0) * (multiplier if multiplier > 0 else -1 / multiplier if multiplier else 1)
    start = datetime(year, 1, 1, tzinfo=timezone.utc) + timedelta(days=day - 1, hours=hour, minutes=minute, seconds=second)
    tmin = int(start.timestamp()) * 10**9 + fract * 100_000
    if correction and not head[36] & 2:
        tmin += correction * 100_000
    encoding, length, big, k = 11, 512, True, blockette
    while k and at - base + k + 8 <= len(data):
        kind, following = struct.unpack(f"{order}HH", data[at - base + k : at - base + k + 4])
        own = data[at - base + k + 4 : at - base + k + 8]
        if kind == 1000:
            encoding, big, length = own[0], bool(own[1]), 1 << own[2]
        elif kind == 1001:
            tmin += struct.unpack("b", own[1:2])[0] * 1000
        elif kind == 100:
            rate = struct.unpack(f"{order}f", own)[0]
        k = following if following > k else 0
    return Header(at, length, f"{network}.{station}.{location}.{channel}.", tmin, 1 / rate if rate else 0.0, chr(head[6]), n if rate else 0, encoding, begin, big)


def records(data: bytes) -> Iterator[tuple[str, int, float, str, np.ndarray]]:
    """(codes, tmin_ns, deltat, quality, samples) of each record; what is no record ends the file."""
    at = 0
    while (head := header(data, at)) is not None:
        if head.n:
            yield head.codes, head.tmin_ns, head.deltat, head.quality, head.samples(data)
        at += head.length


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files below a path."""
    return read_contents(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def read_contents(files: DataFrame) -> DataFrame:
    """Records of (path, content) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [(name, *r[:4], r[4].astype(float)) for r in records(content)]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols[:5]] + [pa.array(list(cols[5]), pa.list_(pa.float64()))], names=["path", "codes", "tmin_ns", "deltat", "quality", "ydata"])

    return files.mapInArrow(run, SCHEMA)


def encode(codes: str, tmin_ns: int, deltat: float, y: np.ndarray, power: int = 12, encoding: int = 5) -> bytes:
    """Records of 2**power bytes in big-endian order; encoding 1, 3, 4 or 5: short, integer, float, double."""
    network, station, location, channel = (codes.split(".") + [""] * 4)[:4]
    kind = np.dtype(">" + PLAIN[encoding])
    size = ((1 << power) - 64) // kind.itemsize
    out = []
    for i in range(0, len(y), size):
        part = np.asarray(y[i : i + size]).astype(kind)
        t = tmin_ns + i * round(deltat * 1e9)
        start = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=t // 10**9)
        micro = t % 10**9 // 1000
        head = f"{i // size + 1:06d}D ".encode() + f"{station:<5}{location:<2}{channel:<3}{network:<2}".encode()
        head += struct.pack(">HHBBBBH", start.year, start.timetuple().tm_yday, start.hour, start.minute, start.second, 0, micro // 100)
        head += struct.pack(">HhhBBBBiHH", len(part), *_rate(deltat), 0, 0, 0, 3, 0, 64, 48)
        head += struct.pack(">HHBBBB", 1000, 56, encoding, 1, power, 0) + struct.pack(">HHBbBB", 1001, 0, 0, micro % 100, 0, 0)
        out.append((head + part.tobytes()).ljust(1 << power, b"\0"))
    return b"".join(out)


def _rate(deltat: float) -> tuple[int, int]:
    """Factor and multiplier of a sampling rate."""
    if deltat >= 1 and abs(deltat - round(deltat)) < 1e-9:
        return -round(deltat), 1
    for m in (1, 10, 100, 1000):
        if abs(m / deltat - round(m / deltat)) < 1e-6 * m / deltat and m / deltat < 32768:
            return round(m / deltat), 1 if m == 1 else -m
    raise ValueError("this sampling rate can't be written")
