"""Operations on one trace in array form, as columns: (tmin_ns, deltat, ydata)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import SECOND


def step_ns(deltat: Column) -> Column:
    return F.rint(deltat * SECOND).cast("long")


def tmax_ns(tmin: Column, deltat: Column, y: Column) -> Column:
    """Time of the last sample."""
    return tmin + (F.size(y) - 1) * step_ns(deltat)


def _index(t: Column, tmin: Column, deltat: Column) -> Column:
    """Sample number at a time, half to even."""
    return F.rint((t - tmin) / step_ns(deltat)).cast("int")


def chop(tmin: Column, deltat: Column, y: Column, lo: Column, hi: Column, include_last: bool = False) -> Column:
    """struct(tmin_ns, ydata) cut to [lo, hi); null if nothing is left."""
    first = F.greatest(F.lit(0), _index(lo, tmin, deltat))
    last = F.least(F.size(y), _index(hi, tmin, deltat) + int(include_last))
    cut = F.struct((tmin + first * step_ns(deltat)).alias("tmin_ns"), F.slice(y, first + 1, F.greatest(last - first, F.lit(0))).alias("ydata"))
    return F.when(first < last, cut)


def sample_at(tmin: Column, deltat: Column, y: Column, t: Column) -> Column:
    """Value at a time by linear interpolation; null outside."""
    x = (t - tmin) / step_ns(deltat)
    i = F.floor(x).cast("int")
    inside = (x >= 0) & (x <= F.size(y) - 1)
    return F.when(inside, F.get(y, i) + (x - i) * (F.get(y, F.least(i + 1, F.size(y) - 1)) - F.get(y, i)))


def nearest(tmin: Column, deltat: Column, y: Column, t: Column) -> Column:
    i = _index(t, tmin, deltat)
    return F.when((i >= 0) & (i < F.size(y)), F.get(y, i))


def time_axis(tmin: Column, deltat: Column, y: Column) -> Column:
    return F.transform(y, lambda v, i: tmin + i * step_ns(deltat))


def extremes(y: Column) -> Column:
    """struct(imax, max, imin, min, iabs, absmax): first places; absmax takes the maximum on a tie."""
    hi, lo = F.array_max(y), F.array_min(y)
    imax, imin = F.array_position(y, hi).cast("int") - 1, F.array_position(y, lo).cast("int") - 1
    up = F.abs(hi) >= F.abs(lo)
    return F.struct(imax.alias("imax"), hi.alias("max"), imin.alias("imin"), lo.alias("min"), F.when(up, imax).otherwise(imin).alias("iabs"), F.greatest(F.abs(hi), F.abs(lo)).alias("absmax"))


def shift(tmin: Column, seconds: float) -> Column:
    return tmin + round(seconds * SECOND)


def snap(tmin: Column, deltat: Column) -> Column:
    """tmin at the nearest multiple of deltat."""
    return F.rint(tmin / step_ns(deltat)).cast("long") * step_ns(deltat)


def extend(tmin: Column, deltat: Column, y: Column, lo: Column, hi: Column, fill: str = "zeros") -> Column:
    """struct(tmin_ns, ydata) longer to span [lo, hi]; fill: zeros, repeat, mean or median."""
    before = F.greatest(F.lit(0), -_index(lo, tmin, deltat))
    after = F.greatest(F.lit(0), _index(hi, tmin, deltat) - (F.size(y) - 1))
    if fill == "repeat":
        left, right = F.get(y, F.lit(0)), F.get(y, F.size(y) - 1)
    elif fill == "mean":
        left = right = mean(y)
    elif fill == "median":
        s = F.sort_array(y)
        n = F.size(y)
        left = right = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    else:
        left = right = F.lit(0.0)
    return F.struct((tmin - before * step_ns(deltat)).alias("tmin_ns"), F.concat(F.array_repeat(left, before), y, F.array_repeat(right, after)).alias("ydata"))


def total(y: Column) -> Column:
    return F.aggregate(y, F.lit(0.0), lambda a, v: a + v)


def mean(y: Column) -> Column:
    return total(y) / F.size(y)


def crop_zeros(tmin: Column, deltat: Column, y: Column) -> Column:
    """struct(tmin_ns, ydata) without leading and trailing zeros; null if all are zeros."""
    nonzero = F.filter(F.transform(y, lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())
    first, last = F.array_min(nonzero), F.array_max(nonzero)
    return F.when(F.size(nonzero) > 0, F.struct((tmin + first * step_ns(deltat)).alias("tmin_ns"), F.slice(y, first + 1, last - first + 1).alias("ydata")))


def add(ya: Column, yb: Column, ib: Column, product: bool = False) -> Column:
    """ya with yb, whose first sample is at number ib of ya, added (or multiplied) where they overlap."""
    def one(v: Column, i: Column) -> Column:
        w = F.when((i >= ib) & (i - ib < F.size(yb)), F.get(yb, i - ib))
        return v * F.coalesce(w, F.lit(1.0)) if product else v + F.coalesce(w, F.lit(0.0))

    return F.transform(ya, one)


def cosine_taper(y: Column, a: float, b: float, c: float, d: float, x0: float, dx: float) -> Column:
    """y times a window: 0 up to a, rising to b, 1 until c, falling to d, 0 from there; x0 is the first sample's place."""
    def corner(x: float) -> int:
        return math.ceil((x - x0) / dx)

    ia, ib, ic, id_ = (max(0, corner(x)) for x in (a, b, c, d))

    def window(v: Column, i: Column) -> Column:
        x = x0 + i * dx
        up = 0.5 - 0.5 * F.cos((x - a) / (b - a) * math.pi) if b > a else F.lit(1.0)
        down = 0.5 + 0.5 * F.cos((x - c) / (d - c) * math.pi) if d > c else F.lit(0.0)
        return v * F.when((i < ia) | (i >= id_), 0.0).when(i < ib, up).when(i < ic, 1.0).otherwise(down)

    return F.transform(y, window)


def gauss_taper(y: Column, alpha: float, x0: float, dx: float) -> Column:
    """y times exp(-(pi x / alpha)^2) of its place x in a spectrum."""
    return F.transform(y, lambda v, i: v * F.exp(-((math.pi / alpha) ** 2) * (x0 + i * dx) * (x0 + i * dx)))


def diff(y: Column, deltat: Column, n: int = 1, order: int = 4) -> Column:
    """First or second derivative by central differences of order 2 or 4, lower near the edges."""
    size = F.size(y)

    def at(i: Column, k: int) -> Column:
        return F.get(y, i + k)

    def first(v: Column, i: Column) -> Column:
        inner = (at(i, 1) - at(i, -1)) / (2 * deltat)
        left, right = (at(i, 1) - v) / deltat, (v - at(i, -1)) / deltat
        out = F.when(i == 0, left).when(i == size - 1, right)
        if order == 4:
            wide = (-at(i, 2) + 8 * at(i, 1) - 8 * at(i, -1) + at(i, -2)) / (12 * deltat)
            return out.when((i == 1) | (i == size - 2), inner).otherwise(wide)
        return out.otherwise(inner)

    def second(v: Column, i: Column) -> Column:
        j = F.when(i == 0, 1).when(i == size - 1, size - 2).otherwise(i)
        inner = (at(j, 1) - 2 * at(j, 0) + at(j, -1)) / (deltat * deltat)
        if order == 4:
            wide = (-at(i, 2) + 16 * at(i, 1) - 30 * v + 16 * at(i, -1) - at(i, -2)) / (12 * deltat * deltat)
            return F.when((i <= 1) | (i >= size - 2), inner).otherwise(wide)
        return inner

    return F.transform(y, first if n == 1 else second)


def lx_norm(u: Column, v: Column, power: int = 2) -> tuple[Column, Column]:
    """The misfit (sum |v - u|^p)^(1/p) and the norm (sum |v|^p)^(1/p)."""
    both = F.zip_with(u, v, lambda a, b: F.pow(F.abs(b - a), F.lit(power)))
    return F.pow(total(both), F.lit(1 / power)), F.pow(total(F.transform(v, lambda b: F.pow(F.abs(b), F.lit(power)))), F.lit(1 / power))


def valid_samples(y: Column) -> Column:
    """Not empty, and all finite."""
    return (F.size(y) > 0) & F.forall(y, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def content_hash(codes: Column, tmin: Column, deltat: Column, y: Column) -> Column:
    return F.sha2(F.concat_ws("|", codes, tmin.cast("string"), deltat.cast("string"), F.array_join(y.cast("array<string>"), ",")), 256)


def almost_equal(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda ok: F.coalesce(ok, F.lit(False)))


def rotate(a: Column, b: Column, azimuth: float) -> tuple[Column, Column]:
    """Two components turned by an angle in degrees."""
    c, s = math.cos(math.radians(azimuth)), math.sin(math.radians(azimuth))
    return F.zip_with(a, b, lambda x, y: x * c + y * s), F.zip_with(a, b, lambda x, y: -x * s + y * c)


def project(parts: list[Column], matrix: list[list[float]]) -> list[Column]:
    """matrix times the components."""
    out = []
    for row in matrix:
        y = None
        for k, c in zip(row, parts, strict=True):
            y = _scaled(c, k) if y is None else F.zip_with(y, _scaled(c, k), lambda p, q: p + q)
        out.append(y)
    return out


def _scaled(y: Column, k: float) -> Column:
    return F.transform(y, lambda v: v * k)
