"""Shared helpers of the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Character class of the white space that separates words, in Java and RE2 syntax.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of the tables made inside each open scratch(), the innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one if all of Spark is this machine, else an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; an open scratch() deletes it at its end."""
    path = f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, can be read many times.

    It stays until it is discarded, or until the scratch() it was made in ends. What a lazy result still reads
    can't be deleted by the operator that returns it, so callers put a scratch() around operator and write.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def delete(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once all that was computed from them is written itself."""
    for df in tables:
        delete(df.sparkSession, df.written_to)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all tables that were made inside; write results elsewhere, or by written() around it."""
    _open.append([])
    try:
        yield
    finally:
        delete(spark, *_open.pop())


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def exactly_one(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of any name can't clash."""
    return df.select(*(df[n] for n in names))
