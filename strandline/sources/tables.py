"""Text and XML metadata, and the archive's own layout, by Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import part
from ..functions.times import SECOND, str_to_time, ts_of
from ..operators.windows import calendar


def read_stations_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``net.sta.loc lat lon elevation depth description``; blank ones and those after # are left out."""
    lines = spark.read.text(path).where(F.trim("value").rlike("^[^#]"))
    f = F.split(F.trim("value"), r"\s+", 6)
    codes = F.get(f, F.lit(0))
    return lines.select(*(part(codes, p).alias(p) for p in ("network", "station", "location")), *(F.get(f, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("lat", "lon", "elevation", "depth"), 1)), F.coalesce(F.get(f, F.lit(5)), F.lit("")).alias("description"))


def read_events_text(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue of ``name = value`` lines, an event after each line of dashes, as (event, name, time_ns, ...) rows.

    Files are read whole, so an event never falls between two tasks; blocks are exploded.
    """
    blocks = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"(?m)^-{3,}\s*$")).alias("event", "block"))
    pairs = F.filter(F.split("block", "\n"), lambda s: s.rlike(r"^\s*\w+\s*=\s*\S"))
    fields = F.map_from_entries(F.transform(pairs, lambda s: F.struct(F.regexp_extract(s, r"^\s*(\w+)", 1), F.trim(F.regexp_extract(s, r"=\s*(.*)$", 1)))))
    of = blocks.select("event", fields.alias("f")).where(F.size("f") > 0)
    numbers = [F.try_element_at("f", F.lit(n)).try_cast("double").alias(a) for n, a in (("latitude", "lat"), ("longitude", "lon"), ("depth", "depth"), ("magnitude", "magnitude"))]
    return of.select("event", F.try_element_at("f", F.lit("name")).alias("name"), str_to_time(F.try_element_at("f", F.lit("time"))).alias("time_ns"), *numbers)


def read_pipe_table(spark: SparkSession, path: str) -> DataFrame:
    """Tables of web services: values between bars under a header line that starts with #."""
    df = spark.read.csv(path, sep="|", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.toDF(*(c.strip("# ").lower() for c in df.columns))


def read_stationxml(spark: SparkSession, path: str) -> DataFrame:
    """Channel epochs of station metadata: (network, station, location, channel, lat, lon, elevation, depth, azimuth, dip, rate, tmin_ns, tmax_ns)."""
    kind = "_code string, Station array<struct<_code: string, Channel: array<struct<_code: string, _locationCode: string, _startDate: string, _endDate: string, Latitude: double, Longitude: double, Elevation: double, Depth: double, Azimuth: double, Dip: double, SampleRate: double>>>>"
    nets = spark.read.format("xml").option("rowTag", "Network").schema(kind).load(path)
    s = nets.select(F.col("_code").alias("network"), F.explode("Station").alias("s"))
    c = s.select("network", F.col("s._code").alias("station"), F.explode("s.Channel").alias("c"))
    numbers = [F.col(f"c.{n}").alias(a) for n, a in (("Latitude", "lat"), ("Longitude", "lon"), ("Elevation", "elevation"), ("Depth", "depth"), ("Azimuth", "azimuth"), ("Dip", "dip"), ("SampleRate", "rate"))]
    return c.select("network", "station", F.coalesce("c._locationCode", F.lit("")).alias("location"), F.col("c._code").alias("channel"), *numbers, str_to_time(F.col("c._startDate")).alias("tmin_ns"), str_to_time(F.col("c._endDate")).alias("tmax_ns"))


def save_archive(traces: DataFrame, path: str, unit: str = "day") -> None:
    """Traces cut into calendar windows, as Parquet below network, year and window: time and code filters prune folders."""
    step = F.rint(F.col("deltat") * SECOND).cast("long")
    spans = traces.withColumn("tmax_ns", F.col("tmin_ns") + F.size("ydata") * step)
    cut = calendar(spans, unit)
    first = F.greatest(F.lit(0), F.ceil((F.col("wmin_ns") - F.col("tmin_ns")) / step)).cast("int")
    last = F.least(F.size("ydata"), F.ceil((F.col("wmax_ns") - F.col("tmin_ns")) / step).cast("int"))
    pieces = cut.select("codes", (F.col("tmin_ns") + first * step).alias("tmin_ns"), "deltat", F.slice("ydata", first + 1, F.greatest(last - first, F.lit(0))).alias("ydata"), ts_of(F.col("wmin_ns")).cast("date").alias("window")).where(F.size("ydata") > 0)
    named = pieces.withColumns({"network": part(F.col("codes"), "network"), "year": F.year("window")})
    named.repartition("network", "window").sortWithinPartitions("codes", "tmin_ns").write.mode("append").partitionBy("network", "year", "window").parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("codes", "tmin_ns", "deltat", "ydata", F.col("network"), F.col("year"), F.col("window"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed object trees, one to a line, by a declared schema."""
    return spark.read.schema(schema).json(path)
