"""Selecting files, telling their formats apart and loading what is in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mseed, sac


def select_files(spark: SparkSession, paths: str | list[str], include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(path, modificationTime, length) of the files below paths whose path holds a match of include and none of exclude.

    Contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "modificationTime", "length")
    if include is not None:
        files = files.where(F.col("path").rlike(include))
    if exclude is not None:
        files = files.where(~F.col("path").rlike(exclude))
    return files


def format_of(content: Column) -> Column:
    """mseed, sac, stationxml, quakeml or null, by the first bytes of a file."""
    text = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    sac_version = F.hex(F.substring(content, 305, 4))
    return (
        F.when(text.rlike(r"^[0-9 ]{6}[DRQM][ \x00]"), "mseed")
        .when(sac_version.isin("06000000", "00000006"), "sac")
        .when(text.contains("FDSNStationXML"), "stationxml")
        .when(F.lower(text).contains("quakeml"), "quakeml")
    )


def detect(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, format) of the files below paths; null where the format is not known."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", format_of(F.col("content")).alias("format"))


def load(spark: SparkSession, paths: str | list[str], format: str = "detect") -> DataFrame:
    """(path, codes, tmin_ns, deltat, ydata) of the traces in the files below paths; files of other formats give none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")
    kinds = files.withColumn("format", format_of(F.col("content")) if format == "detect" else F.lit(format))
    cols = ["path", "codes", "tmin_ns", "deltat", "ydata"]
    read = {"mseed": mseed.read_contents, "sac": sac.read_contents}
    parts = [f(kinds.where(F.col("format") == k).select("path", "content")).select(*cols) for k, f in read.items() if format in ("detect", k)]
    if not parts:
        raise ValueError(f"format {format} is not read")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
