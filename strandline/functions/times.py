"""Times as nanoseconds since 1970, and their parts, texts and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
DAY = 86_400 * SECOND
#: Upper edges of the length classes in seconds: 1, then times 20 until a year is reached.
KSCALE_EDGES = tuple(20**k for k in range(7) if k == 0 or 20 ** (k - 1) < 365 * 86_400)
# Days since 1970 on which UTC fell one second further behind GPS time.
LEAP_DAYS = (4199, 4564, 4929, 5660, 6574, 7305, 7670, 8217, 8582, 8947, 9496, 10043, 10592, 13149, 14245, 15522, 16617, 17167)


def floor_div(a: Column, b: Column | int) -> Column:
    """Whole part of a / b towards minus infinity, exact for longs (a double of a time in nanoseconds is not)."""
    b = F.lit(b).cast("long") if isinstance(b, int) else b
    return F.call_function("div", a - F.pmod(a, b), b)


def ns_of(ts: Column) -> Column:
    """Of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) * 1000


def ts_of(ns: Column) -> Column:
    """Timestamp without time zone, cut to microseconds."""
    return F.timestamp_add("MICROSECOND", floor_div(ns, 1000), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def kscale(length_ns: Column) -> Column:
    """Length class of a span: how many KSCALE_EDGES are at most its length."""
    out = F.lit(len(KSCALE_EDGES))
    for k in reversed(range(len(KSCALE_EDGES))):
        out = F.when(length_ns < KSCALE_EDGES[k] * SECOND, F.lit(k)).otherwise(out)
    return out


def start_of(ns: Column, unit: str) -> Column:
    """Start of the hour, day, month or year."""
    return ns_of(F.date_trunc(unit, ts_of(ns)))


def julian_day(ns: Column) -> Column:
    return F.dayofyear(ts_of(ns))


def time_to_str(ns: Column, digits: int = 3) -> Column:
    """``YYYY-MM-DD HH:MM:SS.fff`` with that many fractional digits, rounded half up."""
    step = 10 ** (9 - digits)
    rounded = floor_div(ns + step // 2, step) * step if digits < 9 else ns
    fraction = F.lpad(floor_div(F.pmod(rounded, F.lit(SECOND)), step).cast("string"), digits, "0")
    head = F.date_format(ts_of(rounded - F.pmod(rounded, F.lit(SECOND))), "yyyy-MM-dd HH:mm:ss")
    return F.concat(head, F.lit("."), fraction) if digits else head


def str_to_time(text: Column) -> Column:
    """ns of ``YYYY-MM-DD[ HH:MM[:SS[.f*]]]``; null if it has another form. ``T`` may stand between, Z behind."""
    bare = F.regexp_replace(F.trim(text), "Z$", "")
    full = F.regexp_replace(bare, "T", " ")
    ok = full.rlike(r"^\d{4}-\d\d-\d\d( \d\d:\d\d(:\d\d(\.\d{0,9})?)?)?$")
    day = F.concat(F.substring(full, 1, 10), F.lit(" "), F.when(F.length(full) >= 19, F.substring(full, 12, 8)).when(F.length(full) >= 16, F.concat(F.substring(full, 12, 5), F.lit(":00"))).otherwise("00:00:00"))
    fraction = F.rpad(F.regexp_extract(full, r"\.(\d*)$", 1), 9, "0").cast("long")
    return F.when(ok, ns_of(F.to_timestamp_ntz(day, F.lit("yyyy-MM-dd HH:mm:ss"))) + fraction)


def gps_utc_offset(ns: Column) -> Column:
    """Seconds that GPS time is ahead of UTC, from its start in 1980 on; null before."""
    days = floor_div(ns, DAY)
    return F.when(days >= 3657, sum(F.when(days >= d, 1).otherwise(0) for d in LEAP_DAYS))


def nonempty_windows(tmin: Column, tmax: Column, tinc: int) -> Column:
    """Number of steps of tinc ns that cover [tmin, tmax), one at least; a millionth of a step is rounding."""
    return F.greatest(F.lit(1), F.floor((tmax - tmin) / F.lit(tinc) - 1e-6) + 1).cast("int")
