"""Small texts that users write for instants and grids, compiled into columns; texts that don't follow the grammar give an error.

    timing = [select] "{" phase ("|" phase)* "}" [offset]  |  phase [offset]  |  offset
    select = "first" | "last";  offset = number ["S" | "%"]
    phase  = "stored:" name | "vel:" number | "vel_surface:" number | "cake:" text | "iaspei:" text
    grid   = axis ("," axis)*;  axis = [start] [":" [stop] [":" [step]]] ["@" number of points]
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_NAME = r"[A-Za-z][A-Za-z0-9._]{0,64}"
_PHASE = re.compile(r"(?P<kind>stored|vel|vel_surface|cake|iaspei):(?P<what>.+)")
_BRACED = re.compile(rf"(?P<select>first|last|)\{{(?P<phases>[^{{}}]+)\}}(?P<offset>{_NUMBER})?(?P<unit>[S%]?)")
#: The short forms: names are of stored phases, and offsets are seconds.
_LISTED = re.compile(rf"(?P<select>first|last|)\((?P<phases>{_NAME}(?:\|{_NAME})*)\)(?P<offset>{_NUMBER})?(?P<unit>)")
_NAMED = re.compile(rf"(?P<select>)(?P<phases>{_NAME})(?P<offset>{_NUMBER})?(?P<unit>)")
_BARE = re.compile(rf"(?P<select>)(?P<phases>stored:{_NAME}|vel(?:_surface)?:{_NUMBER}|(?:cake|iaspei):[^|{{}}+-]+?)(?P<offset>{_NUMBER})?(?P<unit>[S%]?)")
_OFFSET = re.compile(rf"(?P<select>)(?P<phases>)(?P<offset>{_NUMBER})(?P<unit>[S%]?)")


@dataclass(frozen=True)
class Timing:
    """An instant relative to arrivals: the first that is known of ``phases``, or the earliest or latest of them, and an offset.

    ``unit`` of the offset: nothing for seconds, S for a surface slowness in s/km, % of the arrival.
    """

    phases: tuple[tuple[str, str], ...] = ()
    select: str = ""
    offset: float = 0.0
    unit: str = ""

    @classmethod
    def parse(cls, text: str) -> Timing:
        s = "".join(text.split())
        found = next((m for r in (_OFFSET, _BRACED, _LISTED, _BARE, _NAMED) if (m := r.fullmatch(s))), None)
        if found is None:
            raise ValueError(f"{text!r} is no timing")
        phases = []
        for p in found["phases"].split("|") if found["phases"] else ():
            p = f"stored:{p}" if found.re in (_LISTED, _NAMED) else p
            m = _PHASE.fullmatch(p)
            if m is None or not re.fullmatch({"stored": _NAME, "vel": _NUMBER, "vel_surface": _NUMBER}.get(m["kind"], ".+"), m["what"]):
                raise ValueError(f"{p!r} in {text!r} is no phase")
            if m["kind"].startswith("vel") and float(m["what"]) == 0:
                raise ValueError(f"{text!r} has a velocity of zero")
            phases.append((m["kind"], m["what"]))
        return cls(tuple(phases), found["select"], float(found["offset"] or 0), found["unit"])

    def __str__(self) -> str:
        named = f"{self.select}{{{'|'.join(map(':'.join, self.phases))}}}" if self.phases else ""
        return named + (f"{self.offset:+.17g}{self.unit}" if self.offset or not self.phases else "")

    def column(self, arrivals: Column | Mapping[str, Column], surface_m: Column, straight_m: Column | None = None) -> Column:
        """Seconds as a double; null where no phase is known, and where the arrival or a distance that is needed is null.

        ``arrivals`` holds arrival times by phase name: a map column, or columns by name. Those of kinds that need rays are
        looked up by their whole text, such as cake:P, so they can be worked out beforehand. A name missing in a mapping is an error.
        """
        def arrival(kind: str, what: str) -> Column:
            if kind == "vel_surface":
                return surface_m / F.lit(1000.0 * float(what))
            if kind == "vel":
                if straight_m is None:
                    raise ValueError("vel: needs distances in space")
                return straight_m / F.lit(1000.0 * float(what))
            name = what if kind == "stored" else f"{kind}:{what}"
            if isinstance(arrivals, Column):
                return F.try_element_at(arrivals, F.lit(name))
            if name not in arrivals:
                raise ValueError(f"there are no arrivals of {name}")
            return arrivals[name]

        offset = F.lit(self.offset)
        if self.unit == "S" and self.offset:
            offset = surface_m / 1000.0 * self.offset
        if not self.phases:
            return offset.cast("double")
        of = [arrival(*p).cast("double") for p in self.phases]
        pick = {"": F.coalesce, "first": F.least, "last": F.greatest}[self.select]
        t = of[0] if len(of) == 1 else pick(*of)
        return t * (1 + self.offset / 100) if self.unit == "%" else t + offset


def timing(text: str, arrivals: Column | Mapping[str, Column], surface_m: Column, straight_m: Column | None = None) -> Column:
    """``Timing.parse(text).column(...)``: for instance first{stored:P|stored:S}-10, {vel_surface:3.5}+5%, or 100."""
    return Timing.parse(text).column(arrivals, surface_m, straight_m)


def arrival_map(table: DataFrame, keys: list[str], phase: str, t: str) -> DataFrame:
    """(keys, arrivals): a map of arrival times by phase, the earliest where a phase comes several times. Null phases and times are left out."""
    first = table.where(F.col(phase).isNotNull() & F.col(t).isNotNull()).groupBy(*keys, phase).agg(F.min(t).cast("double").alias("__t"))
    return first.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(phase, "__t"))).alias("arrivals"))


@dataclass(frozen=True)
class Axis:
    """Points of a grid along an axis; what is None is taken from the range and step at hand."""

    start: float | None = None
    stop: float | None = None
    step: float | None = None
    count: int | None = None

    def column(self, lo: Column, hi: Column, inc: Column) -> Column:
        """The points as an array of doubles, on an axis from lo to hi in steps of inc (all may differ by row; null gives null).

        Without a count the last point is the stop, if a step ends within 1e-5 of it, else the last step before it.
        """
        lo, hi, inc = (c.cast("double") for c in (lo, hi, inc))
        down = self.step is not None and self.step < 0
        start = (hi if down else lo) if self.start is None else F.lit(float(self.start))
        stop = (lo if down else hi) if self.stop is None else F.lit(float(self.stop))
        known = start.isNotNull() & stop.isNotNull()
        if self.count is None:
            step = F.when(hi < lo, -inc).otherwise(inc) if self.step is None else F.lit(float(self.step))
            known &= step.isNotNull()
            turns = (stop - start) / step
            near = F.rint(turns)
            n = F.when(F.abs(start + near * step - stop) > 1e-5, F.floor(turns)).otherwise(near).cast("int") + 1
            wrong = F.raise_error(F.concat(F.lit("steps lead away from the end: "), F.to_json(F.array(start, stop, step)))).cast("int")
            n = F.when((step == 0) | ((step < 0) != (stop - start < 0)), wrong).otherwise(n)
            each = lambda i: start + i * step
        else:
            n = F.lit(self.count)
            each = lambda i: start + i * (stop - start) / max(self.count - 1, 1)
        n = F.when(start == stop, 1).otherwise(n)
        return F.when(known, F.transform(F.sequence(F.lit(0), n - 1), each))


_UNITS = {"k": 1e3, "M": 1e6}


def parse_grid(text: str) -> list[Axis]:
    """Axes of a text like ``0:30k:5k,100k:@20``; units are k and M."""
    def number(s: str) -> float | None:
        if not s:
            return None
        m = re.fullmatch(rf"({_NUMBER})([kM]?)", s)
        if m is None:
            raise ValueError(f"{text!r} is no grid: {s!r} is no number")
        return float(m[1]) * _UNITS.get(m[2], 1.0)

    out = []
    for axis in text.split(","):
        span, *count = (p.strip() for p in axis.split("@"))
        values = [number(s.strip()) for s in span.split(":")]
        if len(count) > 1 or len(values) + len(count) > 3 or count and not re.fullmatch(r"\+?0*[1-9]\d*", count[0]):
            raise ValueError(f"{text!r} is no grid: {axis!r}")
        start, stop, step = (values * 2 if len(values) == 1 else values + [None])[:2] + (values[2:3] or [None])
        if step == 0:
            raise ValueError(f"{text!r} is no grid: a step of zero")
        out.append(Axis(start, stop, step, int(count[0]) if count else None))
    return out


def grid(df: DataFrame, text: str, axes: Mapping[str, tuple[Column, Column, Column]]) -> DataFrame:
    """df with one row for each point of a grid, as columns named as the axes, of which each has (lo, hi, step). No shuffle.

    Axes that the text leaves out at its end take their whole ranges.
    """
    parsed = parse_grid(text)
    if len(parsed) > len(axes):
        raise ValueError(f"{text!r} has more than {len(axes)} axes")
    parsed += [Axis()] * (len(axes) - len(parsed))
    tables = df.withColumns({f"__{n}": a.column(*of) for (n, of), a in zip(axes.items(), parsed, strict=True)})
    return reduce(lambda d, n: d.withColumn(n, F.explode(f"__{n}")).drop(f"__{n}"), axes, tables)
