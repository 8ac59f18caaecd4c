"""Derived channels as a graph: what is asked for at the end is carried back, node by node, to the scan of the stored traces.

A node reads from another one. Asked codes go back through a node's naming and come out as patterns for what it reads
(exact codes stay exact, so that they reach the scan as a set); asked windows grow by what the node needs around them.
So a call builds one plan that reads only the rows it needs, and nothing is computed for channels that nobody asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import codes as C
from ..functions.times import SECOND
from . import archive, components, joining, pairs

COLUMNS = ("codes", "deltat", "tmin_ns", "ydata")


@dataclass
class Stored:
    """Traces (codes, deltat, tmin_ns, ydata). With ``longest``, the longest of them in ns, a window's start bounds the scan too.
    With ``maxgap`` those that follow each other are joined, as by ``joining.degap``."""

    traces: DataFrame
    longest: int | None = None
    maxgap: int | None = None

    def read(self, patterns: list[str], tmin: int, tmax: int) -> DataFrame:
        """Traces of codes that match, cut to [tmin, tmax); rows with nulls are left out."""
        own = self.traces.where(C.match_codes(F.col("codes"), patterns)).where(F.col("tmin_ns") < tmax)
        if self.longest is not None:
            own = own.where(F.col("tmin_ns") > tmin - self.longest)
        cut = _cut(own, tmin, tmax)
        return cut if self.maxgap is None else joining.degap(cut, ["codes"], self.maxgap).select(*COLUMNS)


def _cut(traces: DataFrame, tmin: int, tmax: int) -> DataFrame:
    """Samples at tmin up to before tmax."""
    step = A.step_ns(F.col("deltat"))
    first = F.greatest(F.ceil((tmin - F.col("tmin_ns")) / step).cast("long"), F.lit(0).cast("long"))
    last = F.least(F.ceil((tmax - F.col("tmin_ns")) / step).cast("long"), F.size("ydata").cast("long"))
    own = traces.where(F.col("ydata").isNotNull() & (F.col("deltat") > 0)).withColumns({"__a": first, "__b": last}).where(F.col("__a") < F.col("__b"))
    return own.select("codes", "deltat", (F.col("tmin_ns") + F.col("__a") * step).alias("tmin_ns"), F.slice("ydata", (F.col("__a") + 1).cast("int"), (F.col("__b") - F.col("__a")).cast("int")).cast("array<double>").alias("ydata"))


def _parts(pattern: str) -> list[str] | None:
    """A pattern's five parts; None where it doesn't tell them apart. As codes have four dots, stars can't stand for any of them then."""
    parts = pattern.split(".")
    return parts if len(parts) == len(C.PARTS) and "[" not in pattern else None


def _wide(pattern: str) -> list[str]:
    """What all codes that match have in common, whatever becomes of their channel and extra code: whole parts before the first wildcard."""
    if C.is_exact(pattern):
        return []
    head = pattern[: min(i for i, c in enumerate(pattern) if c in "*?[")].split(".")[:-1][:3]
    return [".".join([*head, "*"])]


def _without_suffix(patterns: list[str], suffix: str) -> list[str]:
    """Patterns for codes that match one of the given ones once they have the suffix; more may match than must."""
    out = []
    for p in patterns:
        parts = _parts(p)
        if parts is None:
            out += _wide(p)
        elif parts[4].endswith(suffix):
            out.append(p.removesuffix(suffix))
        elif not C.is_exact(parts[4]):
            out.append(".".join([*parts[:4], "*"]))
    return list(dict.fromkeys(out))


@dataclass
class Each:
    """A trace of ``of`` gives one trace, with a suffix behind its codes.

    ``make`` takes traces (codes, deltat, tmin_ns, ydata), still under the codes read, and gives the same columns. It is
    given ``before`` and ``after`` ns around the window, and ``delay`` ns tells how far it moves traces in time.
    ``only`` restricts what the node takes at all.
    """

    of: object
    make: Callable[[DataFrame], DataFrame]
    suffix: str
    before: int = 0
    after: int = 0
    delay: int = 0
    only: list[str] = field(default_factory=lambda: ["*"])

    def names(self, codes: Column) -> list[Column]:
        return [C.add_suffix(codes, self.suffix)]

    def group(self, codes: Column) -> Column:
        return codes

    def read(self, patterns: list[str], tmin: int, tmax: int) -> DataFrame | None:
        back = _without_suffix(patterns, self.suffix)
        if not back:
            return None
        got = self.of.read(back, tmin - self.delay - self.before, tmax - self.delay + self.after)
        if got is None:
            return None
        own = got.where(C.match_codes(F.col("codes"), self.only)).where(C.match_codes(self.names(F.col("codes"))[0], patterns))
        made = self.make(own).select(*COLUMNS).withColumn("codes", self.names(F.col("codes"))[0])
        return _cut(made, tmin, tmax)


def shift(of, seconds: float, suffix: str = "S") -> Each:
    """Traces some seconds later."""
    ns = round(seconds * SECOND)
    return Each(of, lambda t: t.withColumn("tmin_ns", F.col("tmin_ns") + ns), suffix, delay=ns)


def restitution(of, responses: DataFrame, fmin: float, fmax: float, quantity: str = "displacement", source: str = "velocity", widen: float = 1.5, fade: float = 2.0) -> Each:
    """Instruments taken out between fmin and fmax, with flanks down to fmin / widen and up to fmax * widen; suffix R and the quantity's
    first letter. Each side takes fade / fmin seconds more than asked for. ``responses`` as in ``archive.restitute``, by the codes read;
    traces without exactly one epoch are left out."""
    pad = fade / fmin
    limits = (fmin / widen, fmin, fmax, fmax * widen)
    make = lambda t: archive.restitute(t, responses, limits, source, quantity, pad).where("ydata is not null")
    return Each(of, make, f"R{quantity[0]}", before=round(pad * SECOND), after=round(pad * SECOND))


@dataclass
class Turned:
    """A sensor's components ``ins`` (last letters of channels) give those of ``outs`` by a matrix; the extra code gets T and the system.

    Asked components go back to those that their rows of the matrix need: an asked vertical one reads no horizontal ones.
    Components that are mixed are taken where all of them have samples, on a common grid; overlaps and gaps as in
    ``components.multi_component``. A component that gives another one alone is passed on trace by trace.
    """

    of: object
    matrix: list[list[float]]
    ins: str
    outs: str
    longest: int = 1 << 20

    @property
    def suffix(self) -> str:
        return "T" + self.outs.lower()

    def names(self, codes: Column) -> list[Column]:
        return [self._name(self.group(codes), c) for c in self.outs]

    def group(self, codes: Column) -> Column:
        return C.grouping_key(codes, "sensor")

    def _back(self, patterns: list[str], rows: list[int]) -> tuple[list[str], list[int]]:
        """What to read for those of the rows that patterns can ask for, and these rows."""
        back, asked = [], set()
        for p in _without_suffix(patterns, self.suffix):
            parts = _parts(p)
            channel = parts[3] if parts else "*"
            some = [i for i in rows if channel[-1:] in ("*", "?", self.outs[i])]
            need = [c for j, c in enumerate(self.ins) if any(self.matrix[i][j] for i in some)]
            asked |= set(some)
            if parts is None:
                back += [p] if need else []
            else:
                # a star may stand for no letter, so that the one before it is the component
                head = channel.rstrip("*")[:-1] + "*" if channel.endswith("*") else channel[:-1]
                back += [".".join([*parts[:3], head + c, parts[4]]) for c in need]
        return list(dict.fromkeys(back)), sorted(asked)

    def read(self, patterns: list[str], tmin: int, tmax: int) -> DataFrame | None:
        out = None
        # rows that share components work together; others neither read nor wait for theirs
        for rows, _ in pairs.independent_parts(self.matrix, list(self.ins), list(self.outs)):
            back, rows = self._back(patterns, rows)
            got = self.of.read(back, tmin, tmax) if back else None
            if got is None:
                continue
            cols = [j for j in range(len(self.ins)) if any(self.matrix[i][j] for i in rows)]
            keyed = got.withColumns({"__group": self.group(F.col("codes")), "__c": F.substring(C.part(F.col("codes"), "channel"), -1, 1)})
            if len(cols) == 1:  # nothing to align with: no sweep, no shuffle
                wide = keyed.where(F.col("__c") == self.ins[cols[0]]).withColumn("ydata", F.array("ydata"))
            else:
                wide = components.multi_component(keyed, ["__group"], "__c", [self.ins[j] for j in cols], longest=self.longest)
            ys = A.project([F.get("ydata", F.lit(k)) for k in range(len(cols))], [[self.matrix[i][j] for j in cols] for i in rows])
            each = F.explode(F.array(*(F.struct(self._name(F.col("__group"), self.outs[i]).alias("codes"), y.alias("y")) for i, y in zip(rows, ys, strict=True))))
            one = wide.select("deltat", "tmin_ns", each.alias("__o")).select("__o.codes", "deltat", "tmin_ns", F.col("__o.y").alias("ydata"))
            out = one if out is None else out.unionByName(one)
        return None if out is None else _cut(out.where(C.match_codes(F.col("codes"), patterns)), tmin, tmax)

    def _name(self, group: Column, letter: str) -> Column:
        """The codes of a component of a sensor."""
        parts = {p: C.part(group, p) for p in C.PARTS}
        return C.dotted(*(parts[p] for p in C.PARTS[:3]), F.concat(parts["channel"], F.lit(letter)), F.concat(parts["extra"], F.lit(self.suffix)))


def to_rtz(of, backazimuth: float, ins: str = "ENZ", **more) -> Turned:
    """Radial (away from where the wave comes from), transverse (clockwise from radial) and vertical."""
    b = np.deg2rad(backazimuth)
    return Turned(of, _clean([[-np.sin(b), -np.cos(b), 0], [-np.cos(b), np.sin(b), 0], [0, 0, 1]]), ins, "RTZ", **more)


def to_ltq(of, backazimuth: float, incidence: float, ins: str = "ENZ", **more) -> Turned:
    """Along the ray (up from an incidence in degrees off the vertical), transverse, and across the ray in its vertical plane."""
    b, i = np.deg2rad(backazimuth), np.deg2rad(incidence)
    along = [-np.sin(i) * np.sin(b), -np.sin(i) * np.cos(b), np.cos(i)]
    across = [np.cos(i) * np.sin(b), np.cos(i) * np.cos(b), np.sin(i)]
    return Turned(of, _clean([along, [-np.cos(b), np.sin(b), 0], across]), ins, "LTQ", **more)


def to_enz(of, azimuths: list[float], dips: list[float], ins: str, **more) -> Turned:
    """East, north and up from three components by their azimuths and dips (down from the horizontal) in degrees."""
    a, d = np.deg2rad(azimuths), np.deg2rad(dips)
    seen = np.stack([np.sin(a) * np.cos(d), np.cos(a) * np.cos(d), -np.sin(d)], axis=1)
    return Turned(of, _clean(np.linalg.inv(seen)), ins, "ENZ", **more)


def _clean(matrix) -> list[list[float]]:
    """Without what rounding leaves of zeros, which would ask for components that aren't needed."""
    return [[0.0 if abs(v) < 1e-12 else float(v) for v in row] for row in matrix]


@dataclass
class Graph:
    """Nodes that can be asked for together; a node that others read from is asked for only if it is one of them."""

    nodes: list

    def get(self, codes: list[str], tmin: int, tmax: int) -> DataFrame:
        """(codes, deltat, tmin_ns, ydata) of all nodes' channels that match, over [tmin, tmax)."""
        out = [r for r in (n.read(codes, tmin, tmax) for n in self.nodes) if r is not None]
        if not out:
            raise ValueError(f"no node can have channels like {codes}")
        done = out[0]
        for r in out[1:]:
            done = done.unionByName(r)
        return done


def mappings(available: DataFrame, node) -> DataFrame:
    """(group, in_codes, out_codes): what a node would read together and give, of a table with a column codes. Null codes are left out."""
    own = available.where("codes is not null").select("codes", node.group(F.col("codes")).alias("group"))
    if isinstance(node, Turned):
        own = own.where(F.substring(C.part(F.col("codes"), "channel"), -1, 1).isin(list(node.ins)))
    grouped = own.groupBy("group").agg(F.sort_array(F.collect_set("codes")).alias("in_codes"))
    return grouped.withColumn("out_codes", F.array(*node.names(F.get("in_codes", F.lit(0)))))


def update_mappings(current: DataFrame, added: DataFrame, removed: DataFrame, node) -> DataFrame:
    """current mappings after codes were added and removed; groups that no change touches are passed on as they are."""
    touched = added.select("codes").unionByName(removed.select("codes")).where("codes is not null").select(node.group(F.col("codes")).alias("group")).distinct()
    kept = current.join(touched, "group", "left_anti")
    before = current.join(touched, "group", "left_semi").select(F.explode("in_codes").alias("codes"))
    again = mappings(before.unionByName(added.select("codes")).join(removed.select("codes"), "codes", "left_anti"), node)
    return kept.unionByName(again)
