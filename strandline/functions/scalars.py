"""Magnitudes, scaling relations, numbers and quoted text as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment_to_magnitude(moment: Column) -> Column:
    return F.log10(moment * 1e7) / 1.5 - 10.7


def magnitude_to_moment(magnitude: Column) -> Column:
    return F.pow(F.lit(10.0), 1.5 * (magnitude + 10.7)) * 1e-7


def magnitude_to_duration(magnitude: Column) -> Column:
    """Duration of a source in seconds, by the cube root of its moment."""
    return F.pow(magnitude_to_moment(magnitude) / 1.1e16, F.lit(1 / 3))


def gutenberg_richter(u: Column, b: float, smallest: float) -> Column:
    """Magnitude of a uniform number in [0, 1): exponentially distributed above the smallest."""
    return smallest + F.log10(1 - u) / -b


def dc_to_m6(strike: Column, dip: Column, rake: Column, moment: Column) -> list[Column]:
    """mnn, mee, mdd, mne, mnd, med of a double couple; angles in degrees."""
    s, d, r = F.radians(strike), F.radians(dip), F.radians(rake)
    sd, cd, s2d, c2d = F.sin(d), F.cos(d), F.sin(2 * d), F.cos(2 * d)
    ss, cs, s2s, c2s = F.sin(s), F.cos(s), F.sin(2 * s), F.cos(2 * s)
    sr, cr = F.sin(r), F.cos(r)
    mnn = -moment * (sd * cr * s2s + s2d * sr * ss * ss)
    mee = moment * (sd * cr * s2s - s2d * sr * cs * cs)
    mdd = moment * s2d * sr
    mne = moment * (sd * cr * c2s + 0.5 * s2d * sr * s2s)
    mnd = -moment * (cd * cr * cs + c2d * sr * ss)
    med = -moment * (cd * cr * ss - c2d * sr * cs)
    return [mnn, mee, mdd, mne, mnd, med]


def scalar_moment(m6: list[Column]) -> Column:
    """Frobenius norm over the square root of two."""
    return F.sqrt((m6[0] * m6[0] + m6[1] * m6[1] + m6[2] * m6[2]) / 2 + m6[3] * m6[3] + m6[4] * m6[4] + m6[5] * m6[5])


def in_range(value: Column, lo: float | None, hi: float | None) -> Column:
    """Inclusive bounds; a bound that is absent passes all, a missing value fails any bound that is set."""
    ok = F.lit(True)
    if lo is not None:
        ok = ok & F.coalesce(value >= lo, F.lit(False))
    if hi is not None:
        ok = ok & F.coalesce(value <= hi, F.lit(False))
    return ok


def base36encode(n: Column) -> Column:
    return F.conv(n.cast("string"), 10, 36)


def base36decode(text: Column) -> Column:
    return F.conv(text, 36, 10).cast("long")


def same_rate(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return F.abs(a - b) < (a + b) * eps


def human_bytesize(n: Column) -> Column:
    """With a decimal unit; one digit where it rounds to less than 10 of the unit."""
    out = F.concat(n.cast("string"), F.lit(" Bytes"))
    for i, unit in reversed(list(enumerate(("Bytes", "kB", "MB", "GB", "TB", "PB", "EB")))):
        v = n / F.pow(F.lit(1000.0), F.lit(i))
        whole = F.concat(F.format_number(v, 0), F.lit(f" {unit}"))
        out = F.when((F.rint(v) < 10) & (n >= 1000), F.concat(F.format_number(v, 1), F.lit(f" {unit}"))).when(F.rint(v) < 1000, whole).otherwise(out)
    return F.when(n == 1, F.lit("1 Byte")).otherwise(out)


def escape(text: Column, quote: str = "'") -> Column:
    """Backslashes before backslashes and quotes."""
    return F.regexp_replace(text, "[\\\\" + quote + "]", "\\\\$0")


def quoted_join(items: Column, sep: str = " ") -> Column:
    """Array of strings in one: quoted where empty or with a quote, a space or a backslash in it."""
    return F.array_join(F.transform(items, lambda x: F.when((x == "") | x.rlike(r"[\s'\\]"), F.concat(F.lit("'"), escape(x), F.lit("'"))).otherwise(x)), sep)


def fixed_width(line: Column, fields: list[tuple[str, int, str]]) -> list[Column]:
    """Columns of a fixed-width record: (name, width, type); blanks and what doesn't parse are null. A name of '' skips."""
    out, at = [], 1
    for name, width, kind in fields:
        if name:
            out.append(F.nullif(F.trim(F.substring(line, at, width)), F.lit("")).try_cast(kind).alias(name))
        at += width
    return out


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two positive longs: Euclid's steps, of which 64-bit numbers need 92 at most."""
    pair = F.struct(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"))
    step = lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), F.pmod(p["a"], F.when(p["b"] == 0, F.lit(1).cast("long")).otherwise(p["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, step, lambda p: p["a"])


def lcm(a: Column, b: Column) -> Column:
    return F.floor(a / gcd(a, b)).cast("long") * b


def _even(start: Column, stop: Column, step: Column, error: str, epsilon: float) -> tuple[Column, Column]:
    """(number of values of even_range, whether there are any to give)."""
    x = (stop - start) / step
    n = {"floor": F.floor, "ceil": F.ceil}.get(error, F.rint)(x).cast("int") + 1
    return n, F.abs(x - (n - 1)) <= epsilon if error == "raise" else F.lit(True)


def even_range(start: Column, stop: Column, step: Column, error: str = "raise", epsilon: float = 1e-6) -> Column:
    """Array of start, start + step and so on up to stop. Where stop is off by over epsilon steps: null, or it is moved to the
    nearest, the next smaller or the next larger multiple (error: raise, round, floor, ceil)."""
    n, ok = _even(start, stop, step, error, epsilon)
    values = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: start + i * step)
    out = F.when(n < 1, F.array().cast("array<double>")).otherwise(values)
    return F.when(ok, out) if error == "raise" else out


def even_size(start: Column, stop: Column, step: Column, error: str = "raise", epsilon: float = 1e-6) -> Column:
    """How many values even_range has, without making them."""
    n, ok = _even(start, stop, step, error, epsilon)
    return F.when(ok, F.when(n < 1, 0).otherwise(n))


def below_nyquist(frequency: Column, deltat: Column) -> Column:
    return frequency < 0.5 / deltat
