"""Thinning of points by a radius: rounds of local elimination over cells of the sphere.

What stays is what a greedy walk from the best point to the worst would keep: a point stays if none that stays already
lies within the radius. The rounds find the same set in parallel. Cells are so small that two points of one cell are
always within the radius; so of each cell only its best undecided point can be next, and it is kept if no cell within
reach has a better one. Then all that lie within the radius of a kept point go. Every round is linear in the points
that are left: cells are compared, never pairs of points, and a crowd in one cell goes in one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .settle import settled


def central_angle(alat: Column, alon: Column, blat: Column, blon: Column) -> Column:
    """Degrees between two points, precise for near ones."""
    h = F.pow(F.sin(F.radians(blat - alat) / 2), 2) + F.cos(F.radians(alat)) * F.cos(F.radians(blat)) * F.pow(F.sin(F.radians(blon - alon) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def _columns_of(row: Column, side: float) -> Column:
    """How many cells of at most ``side`` degrees a row has around the globe."""
    lo = row * side - 90
    widest = F.when((lo <= 0) & (lo + side >= 0), 0.0).otherwise(F.least(F.abs(lo), F.abs(lo + side)))
    return F.greatest(F.lit(1), F.ceil(360 * F.cos(F.radians(F.least(widest, F.lit(90.0)))) / side)).cast("long")


def cell(lat: Column, lon: Column, side: float) -> Column:
    """struct(row, col) of the cell that a point lies in."""
    row = F.floor((lat + 90) / side).cast("long")
    n = _columns_of(row, side)
    return F.struct(row.alias("row"), F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n).cast("long"), n - 1).alias("col"))


def cells_within(lat: Column, lon: Column, radius: float, side: float) -> Column:
    """All cells that a circle of ``radius`` degrees around a point touches, also across the poles and the date line."""
    reach = radius + 1e-9
    polar = F.abs(lat) + reach >= 90
    dlon = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(reach))) / F.cos(F.radians(lat)))))) + 1e-9
    rows = F.sequence(F.greatest(F.lit(0), F.floor((lat - reach + 90) / side)).cast("long"), F.least(F.lit(180 / side), F.floor((lat + reach + 90) / side)).cast("long"))
    x = F.pmod(lon + 180, F.lit(360.0))

    def of_row(r: Column) -> Column:
        n = _columns_of(r, side)
        first, last = F.floor((x - dlon) / 360 * n).cast("long"), F.floor((x + dlon) / 360 * n).cast("long")
        cols = F.when(last - first >= n, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.sequence(first, F.greatest(first, last)))
        return F.transform(cols, lambda c: F.struct(r.alias("row"), F.pmod(c, n).alias("col")))

    return F.array_distinct(F.flatten(F.transform(rows, of_row)))


def thin_by_radius(points: DataFrame, radius: float, id: str = "id", lat: str = "lat", lon: str = "lon", badness: str = "badness") -> DataFrame:
    """The points that stay when, from the least badness on (ties: the smaller id), all within ``radius`` degrees of one that stays are left out.

    Points without id or coordinates are left out; a null badness is the worst; of repeated ids one stays at most, so ids
    are meant to be distinct. The number of rounds grows with the logarithm of the points unless badness follows the map.
    """
    side = radius / 1.5
    plain = points.select(F.col(id).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), F.coalesce(F.col(badness).cast("double"), F.lit(float("inf"))).alias("b")).where("id is not null and lat is not null and lon is not null")
    left = settled(plain.withColumn("cell", cell(F.col("lat"), F.col("lon"), side)), "points")
    kept = []
    while not left.isEmpty():
        best = settled(left.groupBy("cell").agg(F.min(F.struct("b", "id", "lat", "lon")).alias("p")).select("cell", "p.*"), "best")
        around = best.select("b", "id", F.explode(cells_within(F.col("lat"), F.col("lon"), radius, side)).alias("cell"))
        rivals = around.alias("a").join(best.alias("o"), "cell").groupBy("a.id").agg(F.min(F.struct("o.b", "o.id")).alias("first"))
        stay = settled(best.join(rivals.where(F.col("first.id") == F.col("id")).select("id"), "id").select("id", "lat", "lon"), "kept")
        kept.append(stay)
        reach = stay.select(F.col("lat").alias("klat"), F.col("lon").alias("klon"), F.explode(cells_within(F.col("lat"), F.col("lon"), radius, side)).alias("cell"))
        gone = left.join(reach, "cell").where(central_angle(F.col("klat"), F.col("klon"), F.col("lat"), F.col("lon")) <= radius).select("id").distinct()
        left = settled(left.join(gone, "id", "left_anti"), "points")
    if not kept:
        return points.limit(0)
    stay = reduce(DataFrame.unionAll, kept).select(F.col("id").alias("__stay"))
    return points.join(stay, points[id] == stay["__stay"], "left_semi").where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
