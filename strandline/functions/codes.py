"""Dotted codes (network.station.location.channel.extra): patterns, parts, groupings and translations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("network", "station", "location", "channel", "extra")


def glob_to_regex(pattern: str, ignore_case: bool = False) -> str:
    """Anchored regular expression of a glob: ``*`` any run, ``?`` one character, ``[...]`` a set."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            negated = pattern[i + 1] == "!"
            inner = re.sub(r"([\[\]\\^&~])", r"\\\1", pattern[i + 1 + negated : end])
            out.append(f"[{'^' * negated}{inner}]")
            i = end
        else:
            out.append(re.sub(r"([\\.^$|()\[\]{}+*?])", r"\\\1", c))
        i += 1
    return ("(?i)" if ignore_case else "") + "^" + "".join(out) + "$"


def is_exact(pattern: str) -> bool:
    return not set(pattern) & set("*?[")


def match_codes(codes: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """Whether codes match any pattern: exact ones as a set, which scans can push down, the others as regular expressions."""
    exact = [p for p in patterns if is_exact(p) and not ignore_case]
    tests = [codes.isin(exact)] if exact else []
    tests += [codes.rlike(glob_to_regex(p, ignore_case)) for p in patterns if p not in exact]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def station_patterns(patterns: list[str]) -> list[str]:
    """Patterns for stations: a three-part pattern without a location also stands for any location."""
    out = []
    for p in patterns:
        out.append(p)
        parts = p.split(".")
        if len(parts) == 2:
            out.append(f"{p}.*")
        elif len(parts) == 3 and parts[2] == "":
            out.append(f"{parts[0]}.{parts[1]}.[*]")
    return list(dict.fromkeys(out))


def part(codes: Column, name: str) -> Column:
    """One of PARTS; missing parts are empty."""
    return F.coalesce(F.get(F.split(codes, r"\."), F.lit(PARTS.index(name))), F.lit(""))


def as_struct(codes: Column) -> Column:
    return F.struct(*(part(codes, p).alias(p) for p in PARTS))


def dotted(*parts: Column) -> Column:
    return F.concat_ws(".", *parts)


#: How many leading parts each predefined grouping keeps.
GROUPINGS = {"network": 1, "station": 2, "location": 3, "channel": 4}


def grouping_key(codes: Column, by: str) -> Column:
    """The group of codes by network, station, location, channel, or sensor (all but the component letter)."""
    if by in GROUPINGS:
        return F.concat_ws(".", F.slice(F.split(codes, r"\."), 1, GROUPINGS[by]))
    if by == "sensor":
        channel = part(codes, "channel")
        return dotted(part(codes, "network"), part(codes, "station"), part(codes, "location"), F.substring(channel, F.lit(1), F.greatest(F.length(channel) - 1, F.lit(0))), part(codes, "extra"))
    raise ValueError(f"unknown grouping {by!r}")


def regex_group(codes: Column, pattern: str) -> Column:
    """The groups of a regular expression joined by dots; null where it doesn't match."""
    n = re.compile(pattern).groups
    return F.when(codes.rlike(pattern), F.concat_ws(".", *(F.regexp_extract(codes, pattern, i) for i in range(1, n + 1))))


def add_suffix(codes: Column, suffix: str) -> Column:
    """codes with suffix behind the extra part."""
    return dotted(*(part(codes, p) for p in PARTS[:4]), F.concat(part(codes, "extra"), F.lit(suffix)))


def regex_translate(codes: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(codes, pattern, replacement)


def replace_component(codes: Column, component: str) -> Column:
    """codes with another last letter of the channel."""
    channel = part(codes, "channel")
    head = F.substring(channel, F.lit(1), F.greatest(F.length(channel) - 1, F.lit(0)))
    return dotted(*(part(codes, p) for p in PARTS[:3]), F.concat(head, F.lit(component)), part(codes, "extra"))


def merge_codes(a: Column, b: Column, separator: str = "-") -> Column:
    """Part by part: the common value, or both with the separator."""
    return dotted(*(F.when(part(a, p) == part(b, p), part(a, p)).otherwise(F.concat(part(a, p), F.lit(separator), part(b, p))) for p in PARTS))
