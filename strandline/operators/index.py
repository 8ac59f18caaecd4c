"""Scans of the index of content entries ("nuts") and what is read off it.

An entry is a row with kind, codes, deltat, tmin_ns and tmax_ns, exclusive; equal
bounds are an instant, a null bound is open. All predicates are plain columns, so
they reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codes import match_codes

KINDS = ("undefined", "waveform", "station", "channel", "response", "event", "waveform_promise", "empty")
FAR = 9_000_000_000_000_000_000


def overlaps(tmin: int | None, tmax: int | None, lo: Column | None = None, hi: Column | None = None) -> Column:
    """Half-open overlap of an entry with [tmin, tmax); instants lie in a span that holds them, and a query instant in an entry."""
    lo, hi = F.coalesce(lo if lo is not None else F.col("tmin_ns"), F.lit(-FAR)), F.coalesce(hi if hi is not None else F.col("tmax_ns"), F.lit(FAR))
    a, b = -FAR if tmin is None else tmin, FAR if tmax is None else tmax
    if a == b:
        return ((lo <= a) & (hi > a)) | ((lo == a) & (hi == a))
    return (lo < b) & ((hi > a) | ((lo == hi) & (hi >= a)))


def kind_mask(*kinds: str) -> int:
    return sum(1 << KINDS.index(k) for k in kinds)


def in_mask(kind: Column, mask: int) -> Column:
    return kind.isin([k for i, k in enumerate(KINDS) if mask >> i & 1])


def scan(nuts: DataFrame, kinds: list[str] | None = None, tmin: int | None = None, tmax: int | None = None, codes: list[str] | None = None, codes_exclude: list[str] | None = None, rate_min: float | None = None, rate_max: float | None = None, limit: int | None = None) -> DataFrame:
    """Entries of the kinds that overlap [tmin, tmax), match codes, don't match codes_exclude and have such a rate; limit comes last."""
    out = nuts
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    if tmin is not None or tmax is not None:
        out = out.where(overlaps(tmin, tmax))
    if codes is not None:
        out = out.where(match_codes(F.col("codes"), codes))
    if codes_exclude:
        out = out.where(~match_codes(F.col("codes"), codes_exclude))
    if rate_min is not None:
        out = out.where(F.col("deltat") <= (1 + 1e-6) / rate_min)
    if rate_max is not None:
        out = out.where(F.col("deltat") >= (1 - 1e-6) / rate_max)
    return out if limit is None else out.orderBy("kind", "tmin_ns", "codes").limit(limit)


def time_span(nuts: DataFrame, tight: bool = True) -> DataFrame:
    """One row: the first and the last time; not tight: null where an entry is open."""
    lo, hi = F.min("tmin_ns"), F.max("tmax_ns")
    if not tight:
        lo, hi = F.when(~F.coalesce(F.bool_or(F.col("tmin_ns").isNull()), F.lit(False)), lo), F.when(~F.coalesce(F.bool_or(F.col("tmax_ns").isNull()), F.lit(False)), hi)
    return nuts.agg(lo.alias("tmin_ns"), hi.alias("tmax_ns"))


def counts(nuts: DataFrame) -> DataFrame:
    return nuts.groupBy("kind", "codes").agg(F.count("*").alias("n"))


def stats(nuts: DataFrame) -> DataFrame:
    """Per kind: entries, distinct codes and rates, time span, sampling interval span."""
    return nuts.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("codes").alias("n_codes"), F.count_distinct("deltat").alias("n_deltats"), F.min("tmin_ns").alias("tmin_ns"), F.max("tmax_ns").alias("tmax_ns"), F.min("deltat").alias("deltat_min"), F.max("deltat").alias("deltat_max"))


def prioritized(nuts: DataFrame, group: list[str], priority: Column) -> DataFrame:
    """Of each group the entries of its best (smallest) priority."""
    best = W.partitionBy(*group)
    return nuts.withColumn("__p", priority).where("__p is not null").withColumn("__best", F.min("__p").over(best)).where("__p = __best").drop("__p", "__best")


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): added, removed or changed rows between two states of a table; the rest is left out."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("__old"), F.lit(True).alias("__in_old"))
    b = new.select(*keys, F.struct(*rest).alias("__new"), F.lit(True).alias("__in_new"))
    both = a.join(b, keys, "full")
    change = F.when(F.col("__in_old").isNull(), "added").when(F.col("__in_new").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def sync(index: DataFrame, listing: DataFrame) -> DataFrame:
    """listing of (path, mtime, size) with its state against the index: 0 new or modified, 2 known; files that are gone have state -1."""
    known = index.select("path", F.col("mtime").alias("__mtime"), F.col("size").alias("__size")).distinct()
    both = listing.join(known, "path", "full")
    same = F.col("mtime").eqNullSafe(F.col("__mtime")) & F.col("size").eqNullSafe(F.col("__size"))
    state = F.when(F.col("mtime").isNull() & F.col("size").isNull(), -1).when(same, 2).otherwise(0)
    return both.select("path", "mtime", "size", state.alias("state"))


def prefix_tree(codes: DataFrame, depth: int) -> DataFrame:
    """(level, prefix, children): for each level the sorted next parts below each prefix of dotted codes."""
    parts = F.split("codes", r"\.")
    levels = F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.struct(i.alias("level"), F.concat_ws(".", F.slice(parts, F.lit(1), i)).alias("prefix"), F.get(parts, i).alias("child"))))
    rows = codes.select(levels.alias("x")).select("x.*").where("child is not null")
    return rows.groupBy("level", "prefix").agg(F.array_join(F.sort_array(F.collect_set("child")), ",").alias("children"))
