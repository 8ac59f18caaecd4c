"""Metadata operations: nested station trees, instrument files, orientations, constraints, lookup tables, homogeneous sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import step_ns
from ..functions.codes import part
from .index import FAR


def contains(tmin: Column, tmax: Column, other_tmin: Column, other_tmax: Column) -> Column:
    """Whether a span, null bounds open, holds all of another."""
    return (F.coalesce(tmin, F.lit(-FAR)) <= F.coalesce(other_tmin, F.lit(-FAR))) & (F.coalesce(other_tmax, F.lit(FAR)) <= F.coalesce(tmax, F.lit(FAR)))


def hull(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tmin_ns, tmax_ns): the span that holds all of a key; null bounds are open and win."""
    lo, hi = (F.when(F.bool_or(F.col(c).isNull()), F.lit(None)).otherwise(f(c)) for c, f in (("tmin_ns", F.min), ("tmax_ns", F.max)))
    return spans.groupBy(*keys).agg(lo.alias("tmin_ns"), hi.alias("tmax_ns"))


def orientation(azimuth: Column, dip: Column) -> tuple[Column, Column, Column]:
    """East, north and up of a unit vector; angles in degrees, dip downwards."""
    a, d = F.radians(azimuth), F.radians(dip)
    return F.sin(a) * F.cos(d), F.cos(a) * F.cos(d), -F.sin(d)


def line_of_sight(phi: Column, theta: Column) -> tuple[Column, Column, Column]:
    """North, east and down factors of a look vector of elevation theta and horizontal angle phi from east, in radians."""
    return F.cos(theta) * F.sin(phi), F.cos(theta) * F.cos(phi), -F.sin(theta)


def station_tree(channels: DataFrame) -> DataFrame:
    """(network, stations): channel epochs as networks of stations of channels, sorted and without repeats."""
    c = channels.select(*(part(F.col("codes"), p).alias(p) for p in ("network", "station", "location", "channel")), "tmin_ns", "tmax_ns").distinct()
    stations = c.groupBy("network", "station").agg(F.sort_array(F.collect_list(F.struct("location", "channel", "tmin_ns", "tmax_ns"))).alias("channels"))
    return stations.groupBy("network").agg(F.sort_array(F.collect_list(F.struct("station", "channels"))).alias("stations"))


def read_pole_zero_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, zeros, poles, gain) of text files with ZEROS, POLES and CONSTANT; zeros that are not listed lie at 0."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"(?m)^\*.*$", "").alias("value"))

    def roots(name: str) -> Column:
        n = F.coalesce(F.regexp_extract("value", rf"(?i){name}\s+(\d+)", 1).try_cast("int"), F.lit(0))
        block = F.regexp_extract("value", rf"(?is){name}\s+\d+\s*\n(.*?)(?=[A-Z]{{5,}}|$)", 1)
        lines = F.filter(F.split(F.trim(block), r"\n"), lambda x: x.rlike(r"^\s*[-+.\d]\S*\s+[-+.\d]"))
        pairs = F.transform(lines, lambda x: F.transform(F.array(F.split(F.trim(x), r"\s+")), lambda w: F.struct(F.get(w, 0).cast("double").alias("re"), F.get(w, 1).cast("double").alias("im")))[0])
        rest = F.array_repeat(F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im")), F.greatest(n - F.size(pairs), F.lit(0)))
        return F.concat(pairs, rest)

    return text.select("path", roots("ZEROS").alias("zeros"), roots("POLES").alias("poles"), F.regexp_extract("value", r"(?i)CONSTANT\s+(\S+)", 1).try_cast("double").alias("gain"))


def write_stations_text(stations: DataFrame, path: str) -> None:
    line = F.format_string("%s.%s.%s %.6f %.6f %.1f %.1f %s", "network", "station", "location", "lat", "lon", "elevation", "depth", F.coalesce("description", F.lit("")))
    stations.select(F.rtrim(line).alias("value")).write.text(path)


def interpolate(points: DataFrame, table: DataFrame, axes: list[tuple[str, float, float, int]], value: str, keys: list[str]) -> DataFrame:
    """points with ``value`` read multilinearly off a table on a regular grid: (keys, i0, i1, ..., value).

    An axis is (column of points, minimum, step, size); points off the grid get null. The table is met by
    an equi join on the corners' indices, and corners are summed per point.
    """
    from .greens import vicinity

    tagged = points.withColumn("__id", F.struct(*points.columns))
    corners = vicinity([(F.col(c), lo, step, n) for c, lo, step, n in axes], 1)
    each = tagged.select("__id", *keys, F.explode(corners).alias("__c")).select("__id", *keys, F.col("__c.irecord").alias("__i"), F.col("__c.weight").alias("__w"))
    flat = F.lit(0).cast("long")
    for k, (_, _, _, n) in enumerate(axes):
        flat = flat * n + F.col(f"i{k}")
    rows = table.select(*keys, flat.alias("__i"), F.col(value).alias("__v"))
    summed = each.join(rows, [*keys, "__i"]).groupBy("__id").agg(F.sum(F.col("__w") * F.col("__v")).alias(value))
    return tagged.join(summed, "__id", "left").select(*points.columns, value)


def homogeneous(traces: DataFrame, keys: list[str], snap: bool = True) -> DataFrame:
    """traces of each key cut to the span that all of them cover, on the grid of multiples of their interval.

    Keys with several intervals, or without a common span, are left out. Spans are found from times
    alone and joined back, so samples don't move by key.
    """
    step = step_ns(F.col("deltat"))
    start = F.rint(F.col("tmin_ns") / step).cast("long") * step if snap else F.col("tmin_ns")
    own = traces.withColumn("tmin_ns", start)
    span = own.groupBy(*keys).agg(F.max("tmin_ns").alias("__lo"), F.min(F.col("tmin_ns") + (F.size("ydata") - 1) * step).alias("__hi"), F.count_distinct("deltat").alias("__n")).where("__n = 1 and __lo <= __hi")
    first = F.rint((F.col("__lo") - F.col("tmin_ns")) / step).cast("int")
    n = F.floor((F.col("__hi") - F.col("__lo")) / step).cast("int") + 1
    met = own.join(span, keys)
    return met.withColumns({"ydata": F.slice("ydata", first + 1, n), "tmin_ns": F.col("tmin_ns") + first * step}).select(*traces.columns)


def thin_out(points: DataFrame, lat: str, lon: str, badness: str, cell: float, keep: int = 1) -> DataFrame:
    """Of each cell of about ``cell`` degrees the ``keep`` points of least badness; cells narrow towards the poles in longitude."""
    from pyspark.sql import Window as W

    row = F.floor((F.col(lat) + 90) / cell)
    across = F.greatest(F.lit(1.0), F.floor(360 / cell * F.cos(F.radians((row + 0.5) * cell - 90))))
    col = F.floor((F.pmod(F.col(lon) + 180, F.lit(360.0))) / 360 * across)
    order = W.partitionBy("__r", "__c").orderBy(badness, lat, lon)
    return points.withColumns({"__r": row, "__c": col}).withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= keep).drop("__r", "__c", "__k")


def dispersion(sources: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, a, b, covariance, correlation) of each pair of columns."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    values = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.covar_samp(a, b).alias("covariance"), F.corr(a, b).alias("correlation")) for a, b in pairs]
    return sources.groupBy(*keys).agg(F.array(*values).alias("__v")).select(*keys, F.explode("__v").alias("__v")).select(*keys, "__v.*")


def full_turn(azimuth: Column) -> Column:
    return F.pmod(azimuth, F.lit(360.0))


def trz_matrix(azimuth: float) -> list[list[float]]:
    """Rows of the transverse, radial and vertical directions in east, north and up."""
    a = math.radians(azimuth)
    return [[math.cos(a), -math.sin(a), 0.0], [math.sin(a), math.cos(a), 0.0], [0.0, 0.0, 1.0]]
