"""What users ask of an archive: waveforms of a window, restituted records, sensors, and virtual channels.

All of it composes scans, interval joins, cuts, joins of traces and signal kernels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..functions import codes as C
from ..functions import kernels as K
from ..functions import response as R
from . import intervals, joining
from .index import overlaps
from .settle import settled


def waveforms(traces: DataFrame, tmin: int, tmax: int, codes: list[str] | None = None, exclude: list[str] | None = None, degap: bool = True, maxgap: int = 5, want_incomplete: bool = True) -> DataFrame:
    """Traces (codes, deltat, tmin_ns, ydata) cut to [tmin, tmax), joined where they meet.

    Without want_incomplete, only those whose edges are within half a step of the window stay; joined
    ones that miss up to five steps at either end are extended by their first or last sample.
    """
    step = A.step_ns(F.col("deltat"))
    end = F.col("tmin_ns") + F.size("ydata") * step
    own = traces.where(overlaps(tmin, tmax, hi=end))
    if codes is not None:
        own = own.where(C.match_codes(F.col("codes"), codes))
    if exclude:
        own = own.where(~C.match_codes(F.col("codes"), exclude))
    cut = own.withColumn("__c", A.chop(F.col("tmin_ns"), F.col("deltat"), F.col("ydata"), F.lit(tmin), F.lit(tmax))).where("__c is not null")
    cut = cut.select("codes", "deltat", "__c.tmin_ns", "__c.ydata")
    out = joining.degap(cut, ["codes"], maxgap) if degap else cut
    if want_incomplete:
        return out
    start, stop = (F.col("tmin_ns") - tmin) / step, (F.col("tmin_ns") + F.size("ydata") * step - tmax) / step
    whole = (F.abs(start) <= 0.5) & (F.abs(stop) <= 0.5)
    if not degap:
        return out.where(whole)
    near = ((start > 0) & (start <= 5) | (F.abs(start) <= 0.5)) & ((stop < 0) & (stop >= -5) | (F.abs(stop) <= 0.5))
    longer = A.extend(F.col("tmin_ns"), F.col("deltat"), F.col("ydata"), F.lit(tmin), F.lit(tmax) - step, "repeat")
    return out.where(near).withColumn("__e", F.when(whole, F.struct("tmin_ns", "ydata")).otherwise(longer)).select("codes", "deltat", "__e.tmin_ns", "__e.ydata")


def sensors(channels: DataFrame, shared: list[str]) -> DataFrame:
    """Channel epochs grouped into sensors: epochs are cut at all boundaries of the sensor, then those with equal
    sensor codes, span and shared attributes belong together; components holds the sorted channel codes."""
    keyed = channels.withColumn("sensor", C.grouping_key(F.col("codes"), "sensor"))
    cut = intervals.cut_at_boundaries(keyed.select("sensor", "codes", "tmin_ns", "tmax_ns", *shared), ["sensor"])
    return cut.groupBy("sensor", "tmin_ns", "tmax_ns", *shared).agg(F.array_join(F.sort_array(F.collect_set("codes")), ",").alias("components"))


def restitute(traces: DataFrame, responses: DataFrame, limits: tuple[float, float, float, float], source: str = "velocity", target: str = "displacement", tfade: float = 0.0) -> DataFrame:
    """traces with their instrument taken out: (codes, deltat, tmin_ns, ydata, n_matches).

    responses are epochs (codes, tmin_ns, tmax_ns, zeros, poles as arrays of struct(re, im), gain). A
    trace takes the epoch that holds its start; traces with no or several epochs get null samples.
    """
    met = intervals.epoch_lookup(traces.select("codes", "deltat", F.col("tmin_ns").alias("t_ns"), "ydata"), responses, ["codes"])
    convert = R.converter(source, target)
    schema = T.StructType.fromDDL("codes string, deltat double, tmin_ns long, ydata array<double>, n_matches long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ys = [], batch.column("ydata")
            for i, r in enumerate(batch.drop_columns(["ydata"]).to_pylist()):
                y = ys[i].values
                if y is None or not len(y) or r["n_matches"] != 1:
                    out.append(None)
                    continue
                zeros, poles = ([complex(v["re"], v["im"]) for v in r[f"epoch_{n}"] or []] for n in ("zeros", "poles"))
                instrument = R.inverse(R.pole_zero(zeros, poles, r["epoch_gain"]))
                out.append(K.transfer(y.to_numpy(zero_copy_only=False)[None].astype(float), r["deltat"], R.multiply(instrument, convert), limits, tfade=tfade)[0])
            yield pa.RecordBatch.from_arrays([batch.column("codes"), batch.column("deltat"), batch.column("t_ns"), pa.array(out, pa.list_(pa.float64())), batch.column("n_matches")], names=schema.names)

    return met.select("codes", "deltat", "t_ns", "ydata", "n_matches", "epoch_zeros", "epoch_poles", "epoch_gain").mapInArrow(run, schema)


@dataclass
class VirtualChannels:
    """Views by output codes: what matches ``patterns`` is passed through ``make`` and gets a suffix behind its codes."""

    patterns: list[str]
    make: object
    suffix: str

    def view(self, traces: DataFrame) -> DataFrame:
        own = traces.where(C.match_codes(F.col("codes"), self.patterns))
        return self.make(own).withColumn("codes", C.add_suffix(F.col("codes"), self.suffix))


@dataclass
class Registry:
    """Stored traces and virtual channels under one name: asking for codes builds only the views that can have them."""

    traces: DataFrame
    views: list[VirtualChannels] = field(default_factory=list)

    def add(self, view: VirtualChannels) -> None:
        self.views.append(view)

    def get(self, codes: list[str]) -> DataFrame:
        cols = ["codes", "deltat", "tmin_ns", "ydata"]
        out = self.traces.select(*cols)
        for v in self.views:
            if any(not C.is_exact(p) or p.endswith(v.suffix) for p in codes):
                out = out.unionByName(v.view(self.traces).select(*cols))
        return out.where(C.match_codes(F.col("codes"), codes))


def redeem(promises: DataFrame, available: DataFrame, keys: list[str]) -> DataFrame:
    """What of the promised spans is not available yet, by key; of several sources the one with the smallest rank."""
    from .coverage import uncovered_by

    # read twice: for the classes of lengths and for the join
    missing = settled(uncovered_by(promises.select(*keys, "tmin_ns", "tmax_ns"), available.select(*keys, "tmin_ns", "tmax_ns"), keys), "missing")
    asked = intervals.interval_join(promises, missing.select(*keys, F.col("tmin_ns").alias("qmin_ns"), F.col("tmax_ns").alias("qmax_ns")), keys)
    best = asked.groupBy(*keys, "qmin_ns", "qmax_ns").agg(F.min(F.struct("rank", "source")).alias("s"))
    return best.select(*keys, F.col("qmin_ns").alias("tmin_ns"), F.col("qmax_ns").alias("tmax_ns"), "s.source")


def fill_template(template: str, codes, tmin_ns):
    """A path: {network}, {station}, {location}, {channel} and {year}, {month}, {day}, {jday} of a template."""
    from ..functions.times import ts_of

    ts = ts_of(tmin_ns)
    values = {p: C.part(codes, p) for p in C.PARTS} | {"year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"), "day": F.date_format(ts, "dd"), "jday": F.lpad(F.dayofyear(ts).cast("string"), 3, "0")}
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(values[name])
    return F.concat(*parts)
