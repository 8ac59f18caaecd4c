"""Source divergence audit: how far each source's use of words lies from other sources and from its language.

Texts become bytes: a lookup table of 256 entries lowers A-Z and marks what belongs to a term, over the concatenated
UTF-8 buffers of many documents at once; where the marks change, terms begin and end. Slices are grouped by xxhash,
and every slice is compared byte by byte with the first of its group. A task's counts are a sparse matrix of sources
by terms; one row for each of its terms is shuffled, with all its sources in an array, so that a frequent term gives
one row for each task and not one for each document.

Terms of a language are then dealt into blocks by a hash. A block is a sparse matrix of sources by terms again: the
divergence of two sources is a sum over the terms that either has, by reduceat over the matrix's rows, and one
product for all terms that neither has. Blocks give partial sums and their ten best terms, so nothing about a whole
language meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import exactly_one, table, written

#: Documents of a language that must hold a term, scale of shares, count added to every term, ranks of terms that are given.
LEAST_DOCS, SCALE, ADDED, TOP = 10, 10**9, 2, 10
#: Bytes of text that are cut at once, distinct terms that a task gathers before it lets go, entries of a block.
SLICE, GATHERED, BLOCK = 8 << 20, 1 << 20, 200_000

_byte = np.arange(256)
LETTER = ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
LOWERED = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, start, end, document) of all terms in documents that lie one after the other in data."""
    low = LOWERED[data]
    inside = LETTER[data]
    if not len(data):
        return low, *(np.zeros(0, np.int64),) * 3
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets - offsets[0]] = True  # a term ends with its document
    fresh = fresh[: len(data)]
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | fresh))
    after = np.concatenate([inside[1:], [False]])
    end = np.flatnonzero(inside & (~after | np.concatenate([fresh[1:], [True]]))) + 1
    return low, start, end, np.searchsorted(offsets - offsets[0], start, "right") - 1


def group(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Number of every slice's term, and the terms: slices of one xxhash, told apart by their bytes."""
    whole, digest = low.tobytes(), xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(whole[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    terms = [whole[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    size = end - start
    bad = np.flatnonzero(size != size[first][number])
    if not len(bad):
        shift = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        other = low[np.repeat(start, size) + shift] != low[np.repeat(start[first][number], size) + shift]
        bad = np.unique(np.repeat(np.arange(len(size)), size)[other]) if other.any() else bad
    else:  # different lengths under one hash: compare what is left slice by slice
        bad = np.array([i for i in range(len(size)) if whole[start[i] : end[i]] != terms[number[i]]])
    known: dict[bytes, int] = {}
    for i in bad.tolist():
        own = whole[start[i] : end[i]]
        if own not in known:
            known[own] = len(terms)
            terms.append(own)
        number[i] = known[own]
    return number, terms


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of values for each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values)


class _Gathered:
    """A task's counts by group of (lang, source) and term."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> None:
        low, start, end, doc = cut(data, offsets)
        number, terms = group(low, start, end)
        number = np.array([self.terms.setdefault(t, len(self.terms)) for t in terms], np.int64)[number] if terms else number
        size = np.int64(len(self.terms) or 1)
        cell, count = np.unique(doc * size + number, return_counts=True)  # documents by terms
        key, count, docs = _summed((groups[cell // size] << 40) | cell % size, count, np.ones(len(cell), np.int64))
        self.parts.append((key, count, docs))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One row for each language and term."""
        if not self.parts:
            return
        key, count, docs = _summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        names = list(self.groups)
        langs = {x: i for i, x in enumerate(dict.fromkeys(lang for lang, _ in names))}
        of, term = np.array([langs[lang] for lang, _ in names], np.int64)[key >> 40], key & ((1 << 40) - 1)
        order = np.lexsort((key >> 40, term, of))
        of, term, grp, count, docs = of[order], term[order], (key >> 40)[order], count[order], docs[order]
        at = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (term[1:] != term[:-1])]))
        every, sources = pa.array(list(self.terms), pa.binary()), pa.array([s for _, s in names], pa.string())
        for k in range(0, len(at), 50_000):
            own = at[k : k + 50_000]
            lo, hi = own[0], at[k + 50_000] if k + 50_000 < len(at) else len(of)
            held = pa.StructArray.from_arrays([sources.take(pa.array(grp[lo:hi])), pa.array(count[lo:hi])], ["source", "count"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(langs), pa.string()).take(pa.array(of[own])), every.take(pa.array(term[own])).cast(pa.string()), pa.array(np.add.reduceat(docs[lo:hi], own - lo)), pa.ListArray.from_arrays(pa.array(np.append(own - lo, hi - lo), pa.int32()), held)],
                names=["lang", "term", "docs", "counts"],
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, counts array<struct<source, count>>) of (lang, source, text) without nulls: partial counts of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gathered()
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = np.array([held.groups.setdefault(g, len(held.groups)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            text = batch.column(2).cast(pa.large_binary())
            _, offsets, data = text.buffers()
            offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            at = 0
            while at < len(text):  # as many whole documents as SLICE holds, one at least
                upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
                held.add(data[offsets[at] : offsets[upto]], offsets[at : upto + 1], groups[at:upto])
                at = upto
                if len(held.terms) > GATHERED or sum(len(p[0]) for p in held.parts) > 4 * GATHERED:
                    yield from held.rows()
                    held.terms, held.parts = {}, []
        yield from held.rows()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, term string, docs long, counts array<struct<source: string, count: bigint>>")


def share(count: np.ndarray, n: np.ndarray | int, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + ADDED) / (n + ADDED * v)), three digits at a time so that nothing overflows."""
    whole = np.asarray(n, np.int64) + ADDED * v
    left, out = np.asarray(count, np.int64) + ADDED, np.zeros(np.broadcast(count, whole).shape, np.int64)
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // whole, left % whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def block(terms: list[str], counts: list[list[dict]], sources: list[str], totals: np.ndarray, whole: int, n_terms: int, top: int = TOP) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Of the terms of one block: (sums of divergences by pair of sources, [(source, term, value)] of each source's best terms).

    The matrix lies row by row: sources in order, each with the columns of the terms that it has.
    """
    n, place = len(sources), {s: i for i, s in enumerate(sources)}
    col = np.repeat(np.arange(len(terms)), [len(c) for c in counts])
    row = np.array([place[x["source"]] for c in counts for x in c], np.int64)
    count = np.array([x["count"] for c in counts for x in c], np.int64)
    order = np.lexsort((col, row))
    row, col, count = row[order], col[order], count[order]
    begin = np.searchsorted(row, np.arange(n + 1))
    some = np.flatnonzero(np.diff(begin))  # reduceat needs rows that aren't empty
    p, p0 = share(count, totals[row], n_terms), share(np.zeros(n, np.int64), totals, n_terms)

    def by_row(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if len(some):
            out[some] = np.add.reduceat(values, begin[some])
        return out

    sums = np.zeros((n, n), np.int64)
    for a in range(n):
        own = slice(begin[a], begin[a + 1])
        dense = np.full(len(terms), p0[a])
        dense[col[own]] = p[own]
        has = np.zeros(len(terms), bool)
        has[col[own]] = True
        both = has[col]
        sums[a] = by_row(divergence(p, dense[col]))  # terms that the other has
        alone = divergence(dense[col], p0[row])  # what a's terms would give if the other lacked them
        sums[a] += np.array([divergence(p[own], x).sum() for x in p0]) - by_row(np.where(both, alone, 0))
        neither = len(terms) - np.diff(begin) - (begin[a + 1] - begin[a]) + by_row(both.astype(np.int64))
        sums[a] += neither * divergence(p0[a], p0)
    in_lang = np.zeros(len(terms), np.int64)
    np.add.at(in_lang, col, count)
    q = share(in_lang, whole, n_terms)[col]
    best = []
    more = p > q
    value = divergence(p, q)
    for a in some.tolist():
        at = np.arange(begin[a], begin[a + 1])[more[begin[a] : begin[a + 1]]]
        if len(at) > top:
            least = np.partition(value[at], len(at) - top)[len(at) - top]
            at = at[value[at] >= least]  # ties at the last place stay for the UTF-8 order
        best += sorted(((a, int(col[i]), int(value[i])) for i in at), key=lambda x: (-x[2], terms[x[1]].encode()))[:top]
    return sums, best


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences of sources from each other (pair) and their most marked terms (term).

    Null texts, languages and sources count as ''. Groups without terms take part with counts of zero; where a language
    keeps no term, all its pairs have value 0. Repeated rows are documents of their own. Ties are ordered by the item's
    UTF-8 bytes. An empty table gives no rows; texts may have any length; further columns are left out. The result has a
    row for each pair of sources of a language, so sources are meant to be far fewer than documents.
    """
    plain = exactly_one(docs, lang_col, source_col, text_col).toDF("lang", "source", "text").select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    # one exchange: all that follows keeps the rows of a term where they are
    dealt = term_counts(plain).repartition("lang", "term")
    often = dealt.withColumn("n", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("n") >= least_docs)
    summed = often.select("lang", "term", F.inline("counts")).groupBy("lang", "term", "source").agg(F.sum("count").alias("count"))
    kept = written(summed.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "count")).alias("counts")), "kept-terms")

    totals = kept.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = plain.groupBy("lang", "source").agg(F.lit(0).alias("zero")).join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.size("counts")).alias("entries"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("entries") / BLOCK)).cast("long")
    of_lang = groups.groupBy("lang").agg(F.sum("n").alias("whole")).join(sizes, "lang", "left").select("lang", "whole", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce(blocks, F.lit(1)).alias("blocks"))
    of_lang = written(of_lang, "languages")
    left = kept.join(of_lang.select("lang", "blocks"), "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "term", "counts")
    right = groups.join(of_lang, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "n", "whole", "v")

    def run(key: tuple[pa.Scalar, ...], own: pa.Table, known: pa.Table) -> pa.Table:
        lang, sources = key[0].as_py(), sorted(known.column("source").to_pylist())
        n = dict(zip(known.column("source").to_pylist(), known.column("n").to_pylist(), strict=True))
        terms = own.column("term").to_pylist()
        sums, best = block(terms, own.column("counts").to_pylist(), sources, np.array([n[s] for s in sources], np.int64), known.column("whole")[0].as_py(), known.column("v")[0].as_py(), top)
        a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
        names = pa.array(sources, pa.string())
        source = pa.concat_arrays([names.take(pa.array(a)), pa.array([sources[i] for i, _, _ in best], pa.string())])
        item = pa.concat_arrays([names.take(pa.array(b)), pa.array([terms[j] for _, j, _ in best], pa.string())])
        part = ["pair"] * len(a) + ["term"] * len(best)
        value = np.concatenate([sums[a, b], np.array([x for _, _, x in best], np.int64)])
        return pa.table({"lang": pa.array([lang] * len(part), pa.string()), "source": source, "part": pa.array(part, pa.string()), "item": item, "value": pa.array(value)})

    found = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(run, "lang string, source string, part string, item string, value long")
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).where(f"part = 'pair' or rank <= {top}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (
    SELECT r, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
    FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d)),
kept AS (SELECT lang, w, count(*) AS c FROM t GROUP BY lang, w HAVING count(DISTINCT r) >= 10),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, w, count(*) AS c FROM t SEMI JOIN kept USING (lang, w) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
p AS (
    SELECT g.lang, g.source, k.w, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.c + 2)) // (v.n + 2 * v.v) AS q
    FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.w = k.w),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY ALL),
found AS (
    SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(x.value, 0) AS value
    FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
    UNION ALL SELECT lang, source, 'term', w, ((p - q) * (p - q)) // (p + q) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 10
"""
