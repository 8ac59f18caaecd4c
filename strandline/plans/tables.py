"""The star-schema test tables seen as content entries, traces, samples, epochs and places; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import DAY, ns_of


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries: an order line lasts from its shipping date on for as many days as its quantity."""
    t = ns_of(F.col("l_shipdate"))
    kind = F.when(F.col("l_linenumber") <= 5, "waveform").when(F.col("l_linenumber") == 6, "channel").otherwise("response")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").cast("long").alias("element"), kind.alias("kind"),
        F.concat_ws(".", "l_returnflag", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.lit(""), "l_linestatus", F.lit("")).alias("codes"),
        (F.col("l_linenumber") * 0.5).alias("deltat"), t.alias("tmin_ns"), (t + (F.col("l_quantity") * DAY).cast("long")).alias("tmax_ns"), F.col("l_partkey").alias("part"),
    )


def group_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spans under six codes."""
    t = ns_of(F.col("l_shipdate"))
    return read(spark, sf_dir, "lineitem").select(F.concat_ws(".", "l_returnflag", "l_linestatus").alias("codes"), F.col("l_linenumber").cast("long").alias("element"), t.alias("tmin_ns"), (t + (F.col("l_quantity") * DAY).cast("long")).alias("tmax_ns"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs of customers: from each order to the next, open at the end."""
    from pyspark.sql import Window as W

    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("customer"), "o_orderkey", F.col("o_orderpriority").alias("priority"), ns_of(F.col("o_orderdate")).alias("tmin_ns"), ns_of(F.lead("o_orderdate").over(order)).alias("tmax_ns"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in long form: users' values by event."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("codes"), F.col("event_id").alias("i"), ns_of(F.col("ts")).alias("t_ns"), F.col("value").alias("y"), F.col("event_type").alias("channel"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces in array form: one per vector, at 2 Hz, starting as many seconds after 2020 as its id."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trace_id"), F.concat(F.lit("XX.L"), F.col("label").cast("string"), F.lit("..Z.")).alias("codes"), (F.lit(1_577_836_800_000_000_000) + F.col("vec_id") * 1_000_000_000).alias("tmin_ns"), F.lit(0.5).alias("deltat"), F.col("embedding").cast("array<double>").alias("ydata"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of customers, from their keys."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("place"), (F.pmod(k * 37, F.lit(170)) - 85.0).alias("lat"), (F.pmod(k * 101, F.lit(360)) - 180.0).alias("lon"), F.col("c_acctbal").alias("w"), F.col("c_mktsegment").alias("region"))


SQL = {
    "nuts": """nuts AS (SELECT l_orderkey AS file_id, l_linenumber::BIGINT AS element,
  CASE WHEN l_linenumber <= 5 THEN 'waveform' WHEN l_linenumber = 6 THEN 'channel' ELSE 'response' END AS kind,
  l_returnflag || '.S' || l_suppkey || '..' || l_linestatus || '.' AS codes, l_linenumber * 0.5::DOUBLE AS deltat,
  epoch_us(l_shipdate) * 1000 AS tmin_ns, epoch_us(l_shipdate) * 1000 + (l_quantity * 86400000000000)::BIGINT AS tmax_ns, l_partkey AS part FROM lineitem)""",
    "group_spans": """spans AS (SELECT l_returnflag || '.' || l_linestatus AS codes, l_linenumber::BIGINT AS element, epoch_us(l_shipdate) * 1000 AS tmin_ns,
  epoch_us(l_shipdate) * 1000 + (l_quantity * 86400000000000)::BIGINT AS tmax_ns FROM lineitem)""",
    "epochs": """epochs AS (SELECT o_custkey AS customer, o_orderkey, o_orderpriority AS priority, epoch_us(o_orderdate) * 1000 AS tmin_ns,
  epoch_us(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) * 1000 AS tmax_ns FROM orders)""",
    "samples": """samples AS (SELECT user_id AS codes, event_id AS i, epoch_us(ts) * 1000 AS t_ns, value AS y, event_type AS channel FROM events)""",
    "traces": """traces AS (SELECT vec_id AS trace_id, 'XX.L' || label || '..Z.' AS codes, 1577836800000000000 + vec_id * 1000000000 AS tmin_ns, 0.5::DOUBLE AS deltat, embedding::DOUBLE[] AS ydata FROM embeddings)""",
    "places": """places AS (SELECT c_custkey AS place, ((c_custkey * 37) % 170) - 85.0::DOUBLE AS lat, ((c_custkey * 101) % 360) - 180.0::DOUBLE AS lon, c_acctbal AS w, c_mktsegment AS region FROM customer)""",
}
