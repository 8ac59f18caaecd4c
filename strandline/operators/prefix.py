"""Running sums and successors over long ordered groups that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import floor_div


def running_sum(df: DataFrame, keys: list[str], order: str, values: dict[str, str], width: int, following: str | None = None, largest: dict[str, str] | None = None) -> DataFrame:
    """df with a running sum per key for each (value column: name of its sum), in the order of a long column.

    The order is cut into blocks of ``width``. What lies before a block is a window over one row per (key, block);
    it goes into the block as a row of its own in front, and one window over (key, block) sums both, so that the long
    table is dealt out once and not joined. Rows of equal order share their sum; rows without an order are left out.
    ``largest`` are running maxima likewise, of other columns. ``following`` is the next larger order per key, null after the last, for
    orders that are distinct per key: the first order of the next block that has rows goes into a block behind its last row.
    """
    largest = largest or {}
    if values.keys() & largest.keys():
        raise ValueError("a column is either summed or its maximum taken")
    parts = df.where(F.col(order).isNotNull()).withColumns({"__block": floor_div(F.col(order), width), "__carried": F.lit(False)})
    of = {**{v: F.sum for v in values}, **{v: F.max for v in largest}}
    totals = parts.groupBy(*keys, "__block").agg(*(f(v).alias(f"__of_{v}") for v, f in of.items()), F.min(order).alias("__first"))
    by = W.partitionBy(*keys).orderBy("__block")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    edges = totals.select(*keys, "__block", *(f(f"__of_{v}").over(before).alias(v) for v, f in of.items()), F.lead("__first").over(by).alias("__then"))
    front = F.struct(F.lit(None).cast("long").alias("t"), F.lit(True).alias("sums"))
    behind = F.struct(F.col("__then").alias("t"), F.lit(False).alias("sums"))
    ends = F.array(front, behind) if following and of else F.array(behind if following else front)
    carried = edges.withColumn("__e", F.explode(ends)).where("__e.sums or __e.t is not null")
    carried = carried.select(*keys, "__block", *(F.when(F.col("__e.sums"), F.col(v)).alias(v) for v in of), F.col("__e.t").alias(order), F.lit(True).alias("__carried"))
    inside = W.partitionBy(*keys, "__block").orderBy(F.col(order).asc_nulls_first())
    so_far = inside.rangeBetween(W.unboundedPreceding, 0)
    made = {n: F.sum(v).over(so_far) for v, n in values.items()} | {n: F.max(v).over(so_far) for v, n in largest.items()}
    if following:
        made[following] = F.lead(order).over(inside)
    both = parts.unionByName(carried, allowMissingColumns=True)
    out = both.select("*", *(c.alias(f"__made_{n}") for n, c in made.items())).where(~F.col("__carried"))
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema.fields), *(F.col(f"__made_{n}").alias(n) for n in made))


def with_next(df: DataFrame, keys: list[str], order: str, name: str, width: int) -> DataFrame:
    """df with the next larger value of its order column per key, null after the last; of rows of equal order the last has it, others their own."""
    return running_sum(df, keys, order, {}, width, following=name)
