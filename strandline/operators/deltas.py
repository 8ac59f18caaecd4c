"""Tables over an index that are kept up by signed changes, without a rescan of what is unchanged.

What is kept is how many entries of a kind and codes start and end at each instant. These counts add up: an entry that
goes counts as -1, one that comes as +1, a changed file as both. An update appends the sums of its own changes as one
run, so it costs what has changed; a reader adds the runs up, and compaction does so once for all. Counts, spans and
coverage are read off the sums, since every instant that is still the start or end of an entry has its count there.

A run is named by the number of its update and replaces one of that number, so an update that is tried again counts
once; in a stream the number is that of foreachBatch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import FAR
from .intervals import BLOCK
from .prefix import running_sum

KEYS = ["kind", "codes"]
SCHEMA = "kind string, codes string, t_ns long, starts long, ends long, run long"


def changes(index: DataFrame, states: DataFrame, fresh: DataFrame) -> DataFrame:
    """(kind, codes, tmin_ns, tmax_ns, sign): what files of ``states`` (path, state; from index.sync) take from the index and bring to it.

    index: entries with the path of their file, as they are known; fresh: entries of new and modified files, of which others are ignored.
    """
    cols = [*KEYS, "tmin_ns", "tmax_ns"]
    left = index.join(states.where("state in (-1, 0)").select("path").distinct(), "path", "left_semi").select(*cols, F.lit(-1).cast("long").alias("sign"))
    come = fresh.join(states.where("state = 0").select("path").distinct(), "path", "left_semi").select(*cols, F.lit(1).cast("long").alias("sign"))
    return left.unionByName(come)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS, "t_ns").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends")).where("starts <> 0 or ends <> 0")


def append(changed: DataFrame, path: str, number: int) -> None:
    """Add the changes (kind, codes, tmin_ns, tmax_ns, sign) as run ``number`` >= 0 of the tables at path; open bounds lie at the ends of time."""
    if number < 0:
        raise ValueError("updates are numbered from 0")
    none = F.lit(0).cast("long")
    start = F.struct(F.coalesce("tmin_ns", F.lit(-FAR)).alias("t_ns"), F.col("sign").alias("starts"), none.alias("ends"))
    end = F.struct(F.coalesce("tmax_ns", F.lit(FAR)).alias("t_ns"), none.alias("starts"), F.col("sign").alias("ends"))
    _summed(changed.select(*KEYS, F.inline(F.array(start, end)))).write.mode("overwrite").parquet(f"{path}/run={number}")


def bounds(spark: SparkSession, path: str) -> DataFrame:
    """(kind, codes, t_ns, starts, ends): the sums over all runs."""
    return _summed(spark.read.schema(SCHEMA).parquet(path))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The sums of all runs at path as the first run of new tables at ``to``, where updates go on with their numbers."""
    bounds(spark, path).write.mode("overwrite").parquet(f"{to}/run=-1")


def summary(sums: DataFrame) -> DataFrame:
    """(kind, codes, n, tmin_ns, tmax_ns) of the entries there are; open spans have null bounds."""
    first, last = F.min(F.when(F.col("starts") > 0, F.col("t_ns"))), F.max(F.when(F.col("ends") > 0, F.col("t_ns")))
    out = sums.groupBy(*KEYS).agg(F.sum("starts").alias("n"), first.alias("lo"), last.alias("hi")).where("n > 0")
    return out.select(*KEYS, "n", F.when(F.col("lo") > -FAR, F.col("lo")).alias("tmin_ns"), F.when(F.col("hi") < FAR, F.col("hi")).alias("tmax_ns"))


def coverage(sums: DataFrame, block: int = BLOCK) -> DataFrame:
    """(kind, codes, t_ns, count): how many entries are open from each instant at which that changes on."""
    steps = sums.select(*KEYS, "t_ns", (F.col("starts") - F.col("ends")).alias("step")).where("step <> 0")
    return running_sum(steps, KEYS, "t_ns", {"step": "count"}, block).select(*KEYS, "t_ns", "count")
