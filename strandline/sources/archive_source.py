"""miniSEED archives as a data source of Spark: planned byte ranges, filters on record headers, a writer of two phases.

    spark.dataSource.register(MiniSeed)
    spark.read.format("miniseed").option("path", folder).load().where("codes like 'XX.%' and tmin_ns < ...")
    traces.write.format("miniseed").option("path", folder).mode("append").save()

Large files are cut into ranges of ``splitBytes``; a record belongs to the range that it begins in, and a task looks for
its first record at multiples of 64 bytes. Conditions on codes and times are tested on headers, of 64 bytes; only the records
that meet them are decoded. Spark hands conditions over where ``spark.sql.python.filterPushdown.enabled`` is set and
the option ``pushdown`` is true; ``scan`` passes them as options and needs no setting.

Tasks write below ``_temporary``, which readers leave out; the driver moves the files into place when all tasks have
succeeded and removes the folder otherwise, so that a failed write leaves nothing behind.

Paths are what pyarrow's file systems open: local and mounted ones, and object stores.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from . import mseed

SCHEMA = "path string, codes string, tmin_ns bigint, tmax_ns bigint, deltat double, quality string, ydata array<double>"
_ARROW = pa.schema([("path", pa.string()), ("codes", pa.string()), ("tmin_ns", pa.int64()), ("tmax_ns", pa.int64()), ("deltat", pa.float64()), ("quality", pa.string()), ("ydata", pa.list_(pa.float64()))])
#: Bytes that are read from a file at once, samples of a batch.
CHUNK, BATCH = 8 << 20, 1 << 20
#: Longest record that the format knows of here.
LONGEST = 1 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """Records that begin in bytes begin to end of a file."""

    path: str
    begin: int
    end: int
    size: int


class _Bytes:
    """A window over a file that moves on."""

    def __init__(self, file: pa.NativeFile, size: int) -> None:
        self.file, self.size, self.base, self.data = file, size, 0, b""

    def have(self, at: int, n: int) -> bytes:
        """Data that holds bytes at to at + n as far as the file has them; ``base`` is where it begins."""
        if at < self.base or min(at + n, self.size) > self.base + len(self.data):
            self.base, self.data = at, self.file.read_at(min(max(CHUNK, n), self.size - at), at) if at < self.size else b""
        return self.data


def headers(source: _Bytes, begin: int, end: int) -> Iterator[mseed.Header]:
    """Headers of the records that begin in the range. At its begin, and behind something that is no record, the next one is looked for at multiples of 64 bytes."""
    at = -(-begin // 64) * 64
    while at < min(end, source.size):
        head = mseed.header(source.have(at, 512), at, source.base)
        if head is None or not 64 <= head.length <= LONGEST or not 48 <= head.begin < head.length:
            at += 64
            continue
        yield head
        at += head.length


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.split = int(options.get("splitbytes", 64 << 20))
        self.tmin = [int(options["tmin_ns"])] if "tmin_ns" in options else []  # what records must end behind
        self.tmax = [int(options["tmax_ns"])] if "tmax_ns" in options else []  # what records must begin before
        self.codes = [options["codes"]] if "codes" in options else []  # regular expressions for whole codes
        self.tests: list[Filter] = []
        self.decoded = 0

    def partitions(self) -> list[Range]:
        found = []
        for one in self.path.split(","):
            files, path = _open(one)
            info = files.get_file_info(path)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(one)
            listed = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path, recursive=True))
            for x in listed:
                if x.type == fs.FileType.File and x.size and not re.search(r"(^|/)[._]", x.path[len(path) :]):
                    found += [Range(x.path if "://" not in one else f"{one.partition('://')[0]}://{x.path}", a, min(a + self.split, x.size), x.size) for a in range(0, x.size, self.split)]
        return found or [Range("", 0, 0, 0)]

    def wanted(self, h: mseed.Header) -> bool:
        if not h.n or any(h.tmax_ns <= t for t in self.tmin) or any(h.tmin_ns >= t for t in self.tmax) or any(not re.fullmatch(c, h.codes) for c in self.codes):
            return False
        for f in self.tests:
            v = getattr(h, f.attribute[0])
            if not (v in f.value if isinstance(f, In) else v.startswith(f.value) if isinstance(f, StringStartsWith) else v == f.value if isinstance(f, EqualTo) else v > f.value if isinstance(f, GreaterThan) else v >= f.value if isinstance(f, GreaterThanOrEqual) else v < f.value if isinstance(f, LessThan) else v <= f.value):
                return False
        return True

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        files, path = _open(partition.path)
        rows: list[tuple[mseed.Header, np.ndarray]] = []
        held = 0
        with files.open_input_file(path) as file:
            source = _Bytes(file, partition.size)
            for h in headers(source, partition.begin, partition.end):
                if self.wanted(h):
                    rows.append((h, h.samples(source.have(h.at, h.length), source.base).astype(float)))
                    self.decoded += 1
                    held += h.n
                    if held >= BATCH:
                        yield self._batch(partition.path, rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(partition.path, rows)

    def _batch(self, path: str, rows: list[tuple[mseed.Header, np.ndarray]]) -> pa.RecordBatch:
        heads = [h for h, _ in rows]
        ends = np.concatenate([[0], np.cumsum([h.n for h in heads])])
        y = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([y for _, y in rows])))
        columns = [[path] * len(rows), *([getattr(h, k) for h in heads] for k in ("codes", "tmin_ns", "tmax_ns", "deltat", "quality"))]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=False)), y], schema=_ARROW)


class PushingReader(Reader):
    """For sessions that hand conditions over; Spark refuses such a reader in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of codes and times with constants are tested on headers; Spark tests all others."""
        for f in filters:
            own = isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("codes",)
            if own or isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("tmin_ns",), ("tmax_ns",)):
                self.tests.append(f)
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Writer(DataSourceArrowWriter):
    """One file per code, day and task, in folders by network and station."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.power, self.encoding = int(options.get("power", 12)), int(options.get("encoding", 5))
        self.job = uuid.uuid4().hex

    @property
    def temporary(self) -> str:
        return f"{_open(self.path)[1].rstrip('/')}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        files, _ = _open(self.path)
        context = TaskContext.get()
        task = f"{context.partitionId():05d}-{uuid.uuid4().hex[:12]}" if context else uuid.uuid4().hex
        names: dict[str, pa.NativeFile] = {}
        try:
            for batch in iterator:
                by_file = defaultdict(list)
                for codes, tmin, deltat, y in zip(*(batch.column(k).to_pylist() for k in ("codes", "tmin_ns", "deltat")), batch.column("ydata"), strict=True):
                    if codes is None or tmin is None or not deltat or not y.is_valid or not len(y.values):
                        continue
                    day = datetime.fromtimestamp(tmin // 10**9, timezone.utc)
                    network, station = (codes.split(".") + [""])[:2]
                    name = f"{network or '_'}/{station or '_'}/{codes.strip('.')}.{day:%Y.%j}.{task}.mseed".replace("/_/", "/-/").replace(":", "-")
                    by_file[name].append(mseed.encode(codes, tmin, deltat, y.values.to_numpy(zero_copy_only=False), self.power, self.encoding))
                for name, parts in by_file.items():
                    if name not in names:
                        if len(names) >= 64:  # files that stay open at once; what comes later for a closed one goes on in another
                            old, stream = next(iter(names.items()))
                            stream.close()
                            names[old] = None
                        full = f"{self.temporary}/{name}"
                        files.create_dir(full.rpartition("/")[0], recursive=True)
                        names[name] = files.open_output_stream(full)
                    if names[name] is None:
                        again = name.replace(".mseed", f"-{len(names)}.mseed")
                        names[again] = files.open_output_stream(f"{self.temporary}/{again}")
                        name = again
                    names[name].write(b"".join(parts))
        finally:
            for stream in names.values():
                if stream is not None:
                    stream.close()
        return Written(list(names))

    def commit(self, messages: list[Written | None]) -> None:
        files, path = _open(self.path)
        path = path.rstrip("/")
        if self.overwrite:
            for x in files.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
                if x.type == fs.FileType.File and not re.search(r"(^|/)[._]", x.path[len(path) :]):
                    files.delete_file(x.path)
        for m in messages:
            for name in m.names if m else []:
                files.create_dir(f"{path}/{name}".rpartition("/")[0], recursive=True)
                files.move(f"{self.temporary}/{name}", f"{path}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, _ = _open(self.path)
        for folder in (self.temporary, self.temporary.rpartition("/")[0]):
            if files.get_file_info(folder).type == fs.FileType.Directory and (folder == self.temporary or not files.get_file_info(fs.FileSelector(folder))):
                files.delete_dir(folder)


class MiniSeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "miniseed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return (PushingReader if self.options.get("pushdown", "") == "true" else Reader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def scan(spark: SparkSession, path: str, tmin_ns: int | None = None, tmax_ns: int | None = None, codes: str | None = None, split: int = 64 << 20) -> DataFrame:
    """Records of the files below a path that overlap a span of time and whose codes match a regular expression; no others are decoded.

    Empty and hidden files are left out. A path that is missing is an error, a folder without files gives no rows.
    """
    spark.dataSource.register(MiniSeed)
    options = {"path": path, "splitBytes": str(split)} | {k: str(v) for k, v in (("tmin_ns", tmin_ns), ("tmax_ns", tmax_ns), ("codes", codes)) if v is not None}
    return spark.read.format("miniseed").options(**options).load()


def save(traces: DataFrame, path: str, mode: str = "append", encoding: int = 5, power: int = 12) -> None:
    """Traces (codes, tmin_ns, deltat, ydata) as records; those without codes, time, interval or samples are left out.

    Repartition by codes and day first, so that a task opens few files and a day's file isn't cut into many.
    """
    spark = traces.sparkSession
    spark.dataSource.register(MiniSeed)
    plain = traces.select(F.col("codes").cast("string"), F.col("tmin_ns").cast("long"), F.col("deltat").cast("double"), F.col("ydata").cast("array<double>"))
    plain.write.format("miniseed").options(path=path, power=str(power), encoding=str(encoding)).mode(mode).save()
