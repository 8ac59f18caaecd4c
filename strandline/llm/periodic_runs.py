"""Periodic runs of words: stretches that repeat a block of words at least four times.

A run of period p and length 4p or more holds a stretch of at least 3p words that equal
the word p places on. So for every p it is enough to look at every third multiple of p:
over all periods these grid points make a harmonic series, n log n pairs in all. The
pairs of a text are one numpy array; how far the equality reaches to both sides is found
by binary search over prefix hashes, for all pairs at once. What is found is verified by
words, and a text in which a hash deceived is searched again with another base.

A text is searched in the task that reads it; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Least number of whole repeats, and least number of words, of a run.
REPEATS, LEAST = 4, 6
PRIME = np.uint64((1 << 31) - 1)
#: Pairs of (period, grid point) that are searched at once.
PAIRS = 1 << 21


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo PRIME."""
    out = np.ones(n + 1, np.uint64)
    have, step = 1, base % int(PRIME)
    while have <= n:
        more = min(have, n + 1 - have)
        out[have : have + more] = out[:more] * np.uint64(step) % PRIME
        have, step = have + more, step * step % int(PRIME)
    return out


class _Hashes:
    """Prefix sums of word value times power of the base; hashes of equal stretches at different places compare after a shift."""

    def __init__(self, words: np.ndarray, base: int) -> None:
        self.power = _powers(base, len(words))
        values = (words.astype(np.uint64) * np.uint64(2654435761) + np.uint64(base)) % PRIME
        self.upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.power[:-1] % PRIME, dtype=np.uint64)])

    def equal(self, at: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether length words at ``at`` and at ``other``, which lies further on, look equal."""
        a, b = self.upto[at + length] - self.upto[at], self.upto[other + length] - self.upto[other]
        return a % PRIME * self.power[other - at] % PRIME == b % PRIME


def _reach(hashes: _Hashes, at: np.ndarray, period: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """The longest length up to ``most`` that is equal at ``at`` and a period on, forwards from there or backwards up to there."""
    low, high = np.zeros_like(most), most.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        half = (low[open_] + high[open_] + 1) // 2
        start = at[open_] - half if back else at[open_]
        same = hashes.equal(start, start + period[open_], half)
        low[open_[same]] = half[same]
        high[open_[~same]] = half[~same] - 1
    return low


def _grid(n: int, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, grid point) in slices: all multiples of (repeats - 1) * period that have a word a period on."""
    periods = np.arange(1, n // repeats + 1)
    points = -(-(n - periods) // ((repeats - 1) * periods))
    ends = np.cumsum(points)
    first = 0
    while first < len(periods):
        upto = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
        own, count = periods[first:upto], points[first:upto]
        period = np.repeat(own, count)
        k = np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)
        yield period, k * (repeats - 1) * period
        first = upto


def find_runs(words: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all maximal runs in an array of word numbers, by start, then period.

    A run has length max(least, repeats * period) or more, period is its smallest one, and no neighbouring word extends it.
    """
    n = len(words)
    empty = np.zeros((0, 3), np.int64)
    if n < max(least, repeats):
        return empty
    for base in range(1_000_003, 1_000_003 + 2_000 * 97, 97):
        hashes, found = None, [empty]
        for period, at in _grid(n, repeats):
            hit = words[at] == words[at + period]
            if not hit.any():
                continue
            hashes = hashes or _Hashes(words, base)
            period, at = period[hit], at[hit]
            start = at - _reach(hashes, at, period, at, back=True)
            end = at + period + _reach(hashes, at, period, n - at - period, back=False)
            long = end - start >= np.maximum(least, repeats * period)
            found.append(np.stack([start[long], end[long] - start[long], period[long]], axis=1))
        rows = np.concatenate(found)
        # periods of one stretch are multiples of the smallest; the others go before words are verified
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        rows = rows[new]
        if all(np.array_equal(words[s : s + m - p], words[s + p : s + m]) for s, m, p in rows.tolist()):
            return rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    raise AssertionError("hashes of two thousand bases failed")


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: all that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period."""
    if not len(runs):
        return None
    ratio = runs[:, 1] / runs[:, 2]
    near = runs[ratio >= ratio.max() * (1 - 1e-9)].tolist()
    return tuple(min(near, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])))


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one document in ten the query repeats words on purpose: the original place of every word, else None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: int = REPEATS, least: int = LEAST, arrange=None, with_text: bool = False) -> DataFrame:
    """(id_col, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256[, runs, collapsed]) of every row.

    start, length, period and exponent_milli are those of the strongest run. ``arrange``, where given, maps (id, number
    of words) to the places that words are taken from, or None. ``with_text`` adds all runs and the text without repeats.
    Null and empty texts, and texts of white space, have no words and no runs: four nulls and the hashes of nothing.
    Null ids are kept; repeated rows come repeated; an empty table gives no rows. Of equally strong runs (ties) the first
    counts, then the one with the smaller period. Texts may have any length: memory is a few numbers per word besides a
    slice of pairs. Further columns are left out, so their names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = (text.as_py() or b"").split()
                if arrange is not None and (place := arrange(doc_id, len(words))) is not None:
                    words = [words[i] for i in place.tolist()]
                runs = find_runs(numbered(words), repeats, least)
                if len(runs):
                    keep = kept_words(len(words), runs)
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                best = strongest(runs)
                text = b" ".join(words)
                for k, v in zip(("start", "length", "period"), best or (None,) * 3, strict=True):
                    out[k].append(v)
                out["n_runs"].append(len(runs))
                out["exponent_milli"].append(best and 1000 * best[1] // best[2])
                out["runs_sha256"].append(hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs.tolist()).encode()).hexdigest())
                out["collapsed_sha256"].append(hashlib.sha256(text).hexdigest())
                if with_text:
                    out["runs"].append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()])
                    out["collapsed"].append(text.decode())
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            if with_text:
                kinds += [pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])), pa.string()]
            columns = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *list(out)[: len(columns)]])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if with_text:
        schema += ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), arrange=planted)
