"""Green's function stores as tables, looked up by grid position and summed by joins.

A store is a table (irecord, itmin, data); a record number is a position on a
regular grid times the number of components. Multilinear lookups are weighted terms
(target, irecord, delay, weight); terms of the same record and delay are merged
before the join; samples are summed as arrays, by numpy and per target, and exploded last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nearest_record(axes: list[tuple[Column, float, float, int]], components: int) -> Column:
    """First record of the nearest grid point; an axis is (value, minimum, step, size); null off the grid."""
    index, ok = F.lit(0).cast("long"), F.lit(True)
    for value, low, step, n in axes:
        i = F.rint((value - low) / step).cast("long")
        index, ok = index * n + i, ok & (i >= 0) & (i < n)
    return F.when(ok, index * components)


def vicinity(axes: list[tuple[Column, float, float, int]], components: int) -> Column:
    """Array of (irecord, weight) of the corners around a position for multilinear interpolation; null off the grid."""
    corners, ok = [(F.lit(0).cast("long"), F.lit(1.0))], F.lit(True)
    for value, low, step, n in axes:
        x = (value - low) / step
        lo, hi = F.floor(x).cast("long"), F.ceil(x).cast("long")
        down, up = 1 - (x - lo), (1 - (hi - x)) * (hi - lo)
        ok = ok & (lo >= 0) & (hi < n)
        corners = [(i * n + j, w * v) for i, w in corners for j, v in ((lo, down), (hi, up))]
    all_of = F.array(*(F.struct((i * components).alias("irecord"), w.alias("weight")) for i, w in corners))
    return F.when(ok, F.filter(all_of, lambda c: c["weight"] != 0))


def merge_terms(terms: DataFrame, target: list[str]) -> DataFrame:
    """Weights of equal (target, irecord, delay) added up."""
    return terms.groupBy(*target, "irecord", "delay").agg(F.sum("weight").alias("weight"))


def _blocks(store: DataFrame, together: int) -> DataFrame:
    """(block, records): ``together`` neighbouring records as one row; those without samples are left out."""
    record = F.struct((F.col("irecord") % together).cast("int").alias("at"), F.col("itmin").cast("long").alias("itmin"), F.col("data").cast("array<double>").alias("data"))
    return store.where(F.size("data") > 0).groupBy(F.floor(F.col("irecord") / together).cast("long").alias("block")).agg(F.collect_list(record).alias("records"))


def _placed(store: DataFrame, rows: DataFrame, target: list[str], together: int, deltat: float, stf: list[tuple[float, float]]) -> DataFrame:
    """(target, part, first, y): for each part of a row, the weighted sum of its block's records as samples from ``first`` on.

    rows: (target, block, delay, parts: array of (part, weights of the block's records)). Of a batch's rows those with equally many
    records of equal length are summed together: records go to their common span, are multiplied by the weights and convolved with
    the delay's two neighbouring samples and the source time function.
    """
    # where the store is broadcast, few files of targets would else leave all sums to few tasks
    met = rows.repartition(*target).join(_blocks(store, together), "block").select(*target, "delay", "parts", "records")
    kept = [f for f in met.schema.fields if f.name in target]
    schema = T.StructType([*kept, T.StructField("part", T.StringType()), T.StructField("first", T.LongType()), T.StructField("y", T.ArrayType(T.DoubleType()))])
    times = np.array([t for t, _ in stf])
    shares = np.array([w for _, w in stf])

    def numbers(column) -> np.ndarray:
        return pc.fill_null(column, 0).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records, parts = batch.column("records"), batch.column("parts")
            n_records, n_parts = (pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(int) for c in (records, parts))
            flat, named = records.flatten(), parts.flatten()
            at, itmin, data = numbers(flat.field("at")), numbers(flat.field("itmin")), flat.field("data")
            lengths = pc.list_value_length(data).to_numpy(zero_copy_only=False).astype(int)
            samples = numbers(data.flatten()).astype(float)
            weights = numbers(named.field("weights").flatten()).reshape(-1, together)
            r0, p0, s0 = np.cumsum(n_records) - n_records, np.cumsum(n_parts) - n_parts, np.cumsum(lengths) - lengths
            shift = (batch.column("delay").to_numpy(zero_copy_only=False)[:, None] + times) / deltat
            lo = np.floor(shift).astype(int)
            longest = np.maximum.reduceat(lengths, r0) if len(r0) else n_records
            same = np.maximum.reduceat(-lengths, r0) == -longest if len(r0) else n_records
            alike = np.stack([n_records, n_parts, np.where(same, longest, -1 - np.arange(len(longest)))], axis=1)
            for kind in np.unique(alike, axis=0):
                own = np.flatnonzero((alike == kind).all(axis=1))
                k, m = kind[0], kind[1]
                which = r0[own][:, None] + np.arange(k)
                start, size = itmin[which], lengths[which]
                begin, width = start.min(axis=1), (start + size).max(axis=1) - start.min(axis=1)
                n = width.max()
                place = np.clip(np.arange(n) + (begin[:, None] - start)[:, :, None], 0, size[:, :, None] - 1)
                d = samples[s0[which][:, :, None] + place]
                w = weights[p0[own][:, None] + np.arange(m)]
                w = np.take_along_axis(w, np.broadcast_to(at[which][:, None, :], (len(own), m, k)), axis=2)
                y = w @ d
                # taps of the two neighbouring samples of every delay of the source time function
                low = lo[own].min(axis=1)
                taps = np.zeros((len(own), (lo[own] - low[:, None]).max() + 2))
                part = shift[own] - lo[own]
                for j, share in enumerate(shares):
                    tap = lo[own][:, j] - low
                    taps[np.arange(len(own)), tap] += share * (1 - part[:, j])
                    taps[np.arange(len(own)), tap + 1] += share * part[:, j]
                n_taps = taps.shape[1]
                out = np.zeros((len(own), m, n + n_taps - 1))
                for j in range(n_taps):
                    out += taps[:, j, None, None] * y[:, :, np.clip(np.arange(n + n_taps - 1) - j, 0, n - 1)]
                # a part spans its own records and taps only
                used, on = w != 0, taps != 0
                head = np.where(used, (start - begin[:, None])[:, None, :], n).min(axis=2) + on.argmax(axis=1)[:, None]
                tail = np.where(used, (start + size - begin[:, None])[:, None, :], 0).max(axis=2) + (n_taps - 1 - on[:, ::-1].argmax(axis=1))[:, None]
                there = used.any(axis=2) & on.any(axis=1)[:, None]
                i = np.arange(n + n_taps - 1)
                mask = (i >= head[:, :, None]) & (i < tail[:, :, None]) & there[:, :, None]
                row, col = np.nonzero(there)
                ends = np.concatenate([[0], np.cumsum(mask.sum(axis=2)[row, col])])
                owners = pa.array(own[row])
                names = named.field("part").take(pa.array((p0[own][:, None] + np.arange(m))[row, col]))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(owners) for f in kept), names, pa.array((begin + low)[row] + head[row, col]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out[mask]))], names=schema.names)

    return met.mapInArrow(run, schema)


def _joined(placed: DataFrame, target: list[str]) -> DataFrame:
    """(target, part, it, y): what was placed added up; each continues with its first and last sample over the span of all of its target."""
    each = placed.groupBy(*target, "part").agg(F.collect_list(F.struct("first", "y")).alias("all"), F.min("first").alias("lo"), F.max(F.col("first") + F.size("y") - 1).alias("hi"))

    def at(it: Column) -> Column:
        return F.aggregate("all", F.lit(0.0), lambda s, p: s + F.get(p["y"], F.least(F.greatest(it - p["first"], F.lit(0)), F.size(p["y"]) - 1).cast("int")))

    total = each.select(*target, "part", "lo", F.transform(F.sequence("lo", "hi"), at).alias("y"))
    return total.select(*target, "part", "lo", F.posexplode("y").alias("i", "y")).select(*target, "part", (F.col("lo") + F.col("i")).alias("it"), "y")


def delayed_sum(store: DataFrame, terms: DataFrame, target: list[str], deltat: float) -> DataFrame:
    """(target, it, y): weighted sum of delayed records.

    A delay falls on two neighbouring samples with linear weights. Every record continues with its first
    value to the left and its last one to the right, over the span of all terms of its target. Samples are summed as arrays
    and exploded when the sums are there.
    """
    merged = merge_terms(terms, target).where("weight <> 0")
    weight = F.struct(F.lit(None).cast("string").alias("part"), F.array("weight").alias("weights"))
    rows = merged.select(*target, F.col("irecord").alias("block"), F.col("delay").cast("double").alias("delay"), F.array(weight).alias("parts"))
    return _joined(_placed(store, rows, target, 1, deltat, [(0.0, 1.0)]), target).drop("part")


def _factors(weights: dict[str, list[Column]], scale: Column, components: int) -> Column:
    """Array of (part, weights): each component's factors of a corner's records."""
    padded = {c: [*ws, *[F.lit(0.0)] * (components - len(ws))] for c, ws in weights.items()}
    return F.array(*(F.struct(F.lit(c).alias("part"), F.array(*(w * scale for w in ws)).alias("weights")) for c, ws in padded.items()))


def _corners(pairs: DataFrame, target: list[str], corners: Column, weights: dict[str, list[Column]], delay: Column, components: int) -> DataFrame:
    names = {f"__w{c}{k}": w for c, ws in weights.items() for k, w in enumerate(ws)}
    own = pairs.select(*target, delay.cast("double").alias("delay"), *(w.alias(n) for n, w in names.items()), F.explode(corners).alias("__c"))
    held = {c: [F.col(f"__w{c}{k}") for k in range(len(ws))] for c, ws in weights.items()}
    return own.select(*target, F.floor(F.col("__c.irecord") / components).cast("long").alias("block"), "delay", _factors(held, F.col("__c.weight"), components).alias("parts"))


def component_sum(store: DataFrame, pairs: DataFrame, target: list[str], corners: Column, weights: dict[str, list[Column]], delay: Column, deltat: float, components: int, stf: list[tuple[float, float]] | None = None) -> DataFrame:
    """delayed_sum over component_terms (target, component, it, y), convolved with a source time function.

    A corner's records, which lie together in the store, are joined as one row and serve all components, so there is one row
    for each pair and corner where terms have one for each record and delay.
    """
    rows = _corners(pairs, target, corners, weights, delay, components)
    return _joined(_placed(store, rows, target, components, deltat, stf or [(0.0, 1.0)]), target).withColumnRenamed("part", "component")


def component_static(store: DataFrame, pairs: DataFrame, target: list[str], corners: Column, weights: dict[str, list[Column]], it: int, components: int) -> DataFrame:
    """static_sum over component_terms (target, component, y), with one row for each pair and corner in the join."""
    values = _values(store, it).groupBy(F.floor(F.col("irecord") / components).cast("long").alias("block")).agg(F.collect_list(F.struct((F.col("irecord") % components).cast("int").alias("at"), "v")).alias("values"))
    met = _corners(pairs, target, corners, weights, F.lit(0.0), components).join(values, "block")

    def of(i: int) -> Column:
        w = lambda e: F.get(F.col("parts")[i]["weights"], e["at"])
        used = F.filter("values", lambda e: w(e) != 0)
        return F.when(F.size(used) > 0, F.aggregate(used, F.lit(0.0), lambda s, e: s + F.coalesce(e["v"] * w(e), F.lit(0.0))))

    sums = met.groupBy(*target).agg(*(F.sum(of(i)).alias(f"__{c}") for i, c in enumerate(weights)))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(f"__{c}").alias("y")) for c in weights)))
    return sums.select(*target, each.alias("__e")).select(*target, "__e.component", "__e.y").where("y is not null")


def _values(store: DataFrame, it: int) -> DataFrame:
    at = F.least(F.greatest(F.lit(it) - F.col("itmin"), F.lit(0)), F.size("data") - 1).cast("int")
    return store.select("irecord", F.get("data", at).cast("double").alias("v"))


def static_sum(store: DataFrame, terms: DataFrame, target: list[str], it: int) -> DataFrame:
    """(target, y): the weighted sum at one sample; of a record only that sample is joined."""
    met = terms.select(*target, "irecord", "weight").join(_values(store, it), "irecord")
    return met.groupBy(*target).agg(F.sum(F.col("v") * F.col("weight")).alias("y"))


def elastic10_weights(m6: list[Column], azimuth: Column, backazimuth: Column) -> dict[str, list[Column]]:
    """Factors of the record components 0 to 9 for north, east and down displacement of a moment tensor (mnn mee mdd mne mnd med)."""
    a, b = F.radians(azimuth), F.radians(backazimuth) - math.pi
    ca, sa, cb, sb = F.cos(a), F.sin(a), F.cos(b), F.sin(b)
    nn, ee, dd, ne, nd, ed = m6
    along = [nn * ca * ca + ee * sa * sa + ne * F.sin(2 * a), nd * ca + ed * sa, dd]
    across = [0.5 * (ee - nn) * F.sin(2 * a) + ne * F.cos(2 * a), ed * ca - nd * sa]
    extra = nn * sa * sa + ee * ca * ca - ne * F.sin(2 * a)
    zero = F.lit(0.0)
    # components: 0 1 2 radial, 3 4 transverse, 5 6 7 down, 8 radial and 9 down of the extra term
    north = [*(cb * f for f in along), *(-sb * f for f in across), zero, zero, zero, cb * extra, zero]
    east = [*(sb * f for f in along), *(cb * f for f in across), zero, zero, zero, sb * extra, zero]
    down = [zero] * 5 + along + [zero, extra]
    return {"n": north, "e": east, "d": down}


def elastic5_weights(force: list[Column], azimuth: Column, backazimuth: Column) -> dict[str, list[Column]]:
    """Factors of the components 0 to 4 for a single force (north, east, down)."""
    a, b = F.radians(azimuth), F.radians(backazimuth) - math.pi
    fn, fe, fd = force
    along, across = fn * F.cos(a) + fe * F.sin(a), fe * F.cos(a) - fn * F.sin(a)
    zero = F.lit(0.0)
    return {"n": [F.cos(b) * fd, F.cos(b) * along, -F.sin(b) * across, zero, zero], "e": [F.sin(b) * fd, F.sin(b) * along, F.cos(b) * across, zero, zero], "d": [zero, zero, zero, fd, along]}


def component_terms(pairs: DataFrame, target: list[str], corners: Column, weights: dict[str, list[Column]], delay: Column) -> DataFrame:
    """(target, component, irecord, delay, weight) of source-receiver pairs: corners times component factors."""
    factors = F.array(*(F.struct(F.lit(c).alias("component"), F.lit(k).alias("ig"), w.alias("w")) for c, ws in weights.items() for k, w in enumerate(ws)))
    each = pairs.select(*target, delay.alias("delay"), F.explode(corners).alias("__c"), F.filter(factors, lambda f: f["w"] != 0).alias("__f")).withColumn("__f", F.explode("__f"))
    return each.select(*target, "__f.component", (F.col("__c.irecord") + F.col("__f.ig")).alias("irecord"), "delay", (F.col("__c.weight") * F.col("__f.w")).alias("weight"))


def rectangular_source(sources: DataFrame, nl: int, nw: int, velocity: float | None = None) -> DataFrame:
    """Fault planes (strike, dip, length, width, nucleation_x in -1..1) as nl x nw points.

    Adds il, iw, north, east and depth shifts from the centre in metres, and time, the rupture's arrival
    from the nucleation point along strike, 0 without a velocity.
    """
    il, iw = F.sequence(F.lit(0), F.lit(nl - 1)), F.sequence(F.lit(0), F.lit(nw - 1))
    grid = sources.withColumn("il", F.explode(il)).withColumn("iw", F.explode(iw))
    x = ((F.col("il") + 0.5) / nl - 0.5) * F.col("length")
    y = ((F.col("iw") + 0.5) / nw - 0.5) * F.col("width")
    s, d = F.radians("strike"), F.radians("dip")
    north = x * F.cos(s) - y * F.cos(d) * F.sin(s)
    east = x * F.sin(s) + y * F.cos(d) * F.cos(s)
    time = F.sqrt(F.pow(x - F.col("nucleation_x") * F.col("length") / 2, F.lit(2)) + y * y) / velocity if velocity else F.lit(0.0)
    return grid.withColumns({"north": north, "east": east, "depth": y * F.sin(d), "time": time})


def stf_weights(kind: str, duration: float, deltat: float, anchor: float = 0.0) -> list[tuple[float, float]]:
    """(delay, weight) of a source time function on the sampling grid: boxcar, triangular or half_sinusoid; weights add up to 1."""
    start = -duration * (anchor + 1) / 2
    if duration == 0:
        k = math.floor(start / deltat)
        part = start / deltat - k
        return [(k * deltat, 1 - part), ((k + 1) * deltat, part)] if part else [(k * deltat, 1.0)]

    def rise(x: float) -> float:
        x = min(max(x, 0.0), 1.0)
        if kind == "boxcar":
            return x
        if kind == "triangular":
            return 2 * x * x if x < 0.5 else 1 - 2 * (1 - x) ** 2
        return 0.5 - 0.5 * math.cos(math.pi * x)

    first, last = round(start / deltat), round((start + duration) / deltat)
    parts = [(k * deltat, rise(((k + 0.5) * deltat - start) / duration) - rise(((k - 0.5) * deltat - start) / duration)) for k in range(first, last + 1)]
    total = sum(w for _, w in parts)
    return [(t, w / total) for t, w in parts if w]


def with_stf(terms: DataFrame, stf: list[tuple[float, float]]) -> DataFrame:
    """terms convolved with a source time function: every delay and weight of it."""
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in stf)))
    return terms.withColumn("__s", each).withColumns({"delay": F.col("delay") + F.col("__s.t"), "weight": F.col("weight") * F.col("__s.w")}).drop("__s")


def check_store(store: DataFrame) -> DataFrame:
    """One row: records, empty ones, repeated numbers, non-finite samples."""
    bad = F.exists("data", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    per = store.groupBy("irecord").agg(F.count("*").alias("n"), F.max(F.size("data")).alias("size"), F.max(F.coalesce(bad, F.lit(False)).cast("int")).alias("bad"))
    return per.agg(F.count("*").alias("n_records"), F.sum((F.col("size") == 0).cast("long")).alias("n_empty"), F.sum((F.col("n") > 1).cast("long")).alias("n_repeated"), F.sum(F.col("bad").cast("long")).alias("n_bad"))
