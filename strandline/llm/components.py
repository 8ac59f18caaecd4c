"""Connected components by alternating large-star and small-star joins.

Each round is two joins on a node's smallest neighbour; the neighbour minimum is a
partially aggregated group, written and read back, so that adaptive execution can split
the join when a node has very many neighbours. Rounds are written to the shared folder, so
lineage stays short; nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """One star operation over (u, v) with u > v: every node's chosen neighbours are moved to its smallest one.

    Also returns the written table of smallest neighbours that it reads.
    """
    both = edges.select("u", "v")
    if large:
        both = both.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # read back, so that the join's side of a node with very many neighbours can be split
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    moved = both.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct(), least


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node id reachable.

    Self-edges, repeated edges, either direction and null ends are accepted; null ends link nothing.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = written(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        check = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if check == mark or check[0] == 0:
            break
        mark = check
        large, least = _star(now, True)
        large = written(large, "edges")
        small, smallest = _star(large, False)
        before, now = now, written(small, "edges")
        discard(before, least, large, smallest)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
