"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learnt so that signs lose little (iterative
quantisation); every vector gets a binary code. The code is cut into substrings, one per
table, and two vectors of one label are retrieved where some substring is equal. Substrings
have about as many bits as keep IN_BUCKET vectors of the largest label in a bucket, so they grow
with the logarithm of the table; codes grow with them, by further rotations of the same axes. How
many tables there are follows from the data: pairs exactly at the threshold are made from the
sample, and as many tables are taken as retrieve ``recall`` of them; if MAX_TABLES don't, substrings
are shortened. If none do, or on request, one table holds a label as a whole and nothing is lost. The original
vectors rerank in double precision. Vectors of different lengths are never compared;
lengths that are too rare in the sample to learn from get codes by random hyperplanes.

A bucket is compared within one task, and a large one as pairs of its blocks. The first
pass over the buckets moves codes only and tells which vectors have a candidate there; only
these meet their vectors, once per bucket. A task returns link counts by vector and a
spanning forest of its links, never the pairs. A pair counts in the first table that
retrieves it. Equal vectors of a label are one class with a count, so copies make no pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .components import connected_components
from .simhash import _union

THRESHOLD, RECALL = 0.93, 0.98
#: Vectors of a label that a bucket is meant to hold, bits of a substring at least and at most, and tables at most.
IN_BUCKET, LEAST_WIDTH, MOST_WIDTH, MAX_TABLES = 64, 4, 32, 96
#: Vectors the rotation is learnt from, the ones with the smallest hashes of their ids.
SAMPLE, ROUNDS = 4096, 30
#: Vectors of a bucket that are one block, and rows of a block that are compared at once.
BLOCK, SLICE = 2048, 256
#: Rows of a task that are gone through at once.
ROWS = 1 << 14


def learn_rotation(x: np.ndarray, bits: int = 64, rounds: int = ROUNDS, seed: int = 7, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) such that signs of (x - mean) @ projection are balanced binary codes of x; the mean is zero if not centred."""
    x = units(x)
    mean = x.mean(axis=0) if centred else np.zeros(x.shape[1])
    bits = min(bits, x.shape[1])
    axes = np.linalg.svd((x - mean).T @ (x - mean))[0][:, :bits]
    v = (x - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return mean, axes @ turn


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever their size."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Coder:
    """Codes of vectors of one length, as words of up to 64 bits, one for each rotation; substrings (word, shift, width); none: one table of all."""

    mean: np.ndarray
    projections: list[np.ndarray]
    cuts: list[tuple[int, int, int]]
    max_hamming: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A row of words for each row; unused low bits are zero."""
        v, out = units(x) - self.mean, np.zeros((len(x), len(self.projections)), np.uint64)
        for k, projection in enumerate(self.projections):
            packed = np.packbits(v @ projection >= 0, axis=1)
            full = np.zeros((len(x), 8), np.uint8)
            full[:, : packed.shape[1]] = packed
            out[:, k] = full.view(">u8").ravel()
        return out

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """A column per table: its number and the substring."""
        if not self.cuts:
            return np.zeros((len(codes), 1), np.int64)
        return np.stack([(t << 32) | substring(codes, cut).astype(np.int64) for t, cut in enumerate(self.cuts)], axis=1)

    def retrieved(self, a: np.ndarray, b: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of a and b, both of one bucket of table t: those that are near and in no bucket of an earlier table."""
        apart = np.zeros((len(a), len(b)), np.uint16)
        for k in range(a.shape[1]):
            apart += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
        i, j = np.nonzero(apart <= self.max_hamming)
        for cut in self.cuts[:t]:
            fresh = substring(a, cut)[i] != substring(b, cut)[j]
            i, j = i[fresh], j[fresh]
        return i, j


def substring(codes: np.ndarray, cut: tuple[int, int, int]) -> np.ndarray:
    word, shift, width = cut
    return (codes[:, word] >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def _cuts(bits: int, width: float, tables: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of so many substrings of ``width`` bits on average, whole ones in every word, whose bits are the upper ones of 64."""
    out, word, used = [], 0, 0
    for t in range(tables):
        own = min(int((t + 1) * width + 1e-9) - int(t * width + 1e-9), bits)
        if used + own > bits:
            word, used = word + 1, 0
        used += own
        out.append((word, 64 - used, own))
    return out


def pairs_at(x: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
    """For each row another vector at exactly that cosine: half of them off in any direction, half as two other rows differ."""
    x = units(x)
    off = rng.standard_normal(x.shape)
    real = x[rng.permutation(len(x))] - x[rng.permutation(len(x))]
    half = np.arange(len(x)) % 2 == 0
    off[half & (np.abs(real).sum(axis=1) > 1e-9)] = real[half & (np.abs(real).sum(axis=1) > 1e-9)]
    off -= (off * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(off, axis=1, keepdims=True)
    off = np.where(size > 1e-9, off / np.maximum(size, 1e-9), 0)
    return threshold * x + np.sqrt(1 - threshold**2) * off


def width_for(n: int) -> float:
    """Bits that leave IN_BUCKET of n vectors in a bucket, if codes are balanced, and some more, as longer substrings take more tables."""
    return float(min(max(1.2 * np.log2(max(n, 1) / IN_BUCKET), LEAST_WIDTH), MOST_WIDTH))


def coder(x: np.ndarray, n: int, threshold: float, recall: float | None, learnt: bool = True) -> Coder:
    """The codes and tables for n vectors like x that let the fewest other pairs in while they retrieve ``recall`` of the pairs
    at the threshold, in each half of pairs_at. recall None: one table of all."""
    bits, rng = min(64, x.shape[1]), np.random.default_rng(3)
    best: tuple[float, Coder] | None = None
    near, other = pairs_at(x, threshold, rng), x[rng.permutation(len(x))]

    def projection(k: int, centred: bool) -> tuple[np.ndarray, np.ndarray]:
        return learn_rotation(x, bits, seed=7 + k, centred=centred) if learnt else (np.zeros(x.shape[1]), rng.standard_normal((x.shape[1], bits)))

    for centred in (True, False) if learnt else (False,):
        mean, first = projection(0, centred)
        one = Coder(mean, [first], [], 64)
        if recall is None:
            return one
        a, b, c = one.codes(x), one.codes(near), one.codes(other)
        for width in np.arange(min(width_for(n), bits), 0.99, -1.0):
            most = _cuts(bits, width, MAX_TABLES)
            found = [np.zeros(len(a), bool), np.zeros(len(a), bool)]
            share = 0.0
            for t, cut in enumerate(most):
                if cut[0] == len(one.projections):
                    one.projections.append(projection(cut[0], centred)[1])
                    last = Coder(mean, one.projections[-1:], [], 64)
                    a, b, c = (np.concatenate([w, last.codes(v)], axis=1) for w, v in ((a, x), (b, near), (c, other)))
                found[0] |= substring(a, cut) == substring(b, cut)
                share += float((substring(a, cut) == substring(c, cut)).mean())
                if min(found[0][0::2].mean(), found[0][1::2].mean() if len(a) > 1 else 1) >= recall:
                    break
            else:
                continue  # shorter substrings
            words = cut[0] + 1
            apart = np.bitwise_count(a[:, :words] ^ b[:, :words]).sum(axis=1)
            if best is None or share < best[0]:
                best = share, Coder(mean, one.projections[:words], most[: t + 1], int(apart.max()))
            break
    return best[1] if best else Coder(np.zeros(x.shape[1]), [np.zeros((x.shape[1], bits))], [], 64)


class Coders:
    """A coder per length; lengths without enough vectors in the sample get one that follows from the length alone."""

    def __init__(self, drawn: list[list[float]], n: int, threshold: float = THRESHOLD, recall: float | None = RECALL):
        """n: vectors of the largest label."""
        self.shape, self.known = (n, threshold, recall), {}
        for k, m in Counter(map(len, drawn)).items():
            if m >= 4 * min(64, k):
                self.known[k] = coder(np.array([v for v in drawn if len(v) == k], float), *self.shape)

    def of(self, length: int) -> Coder:
        if length not in self.known:
            self.known[length] = coder(np.random.default_rng(length).standard_normal((1024, length)), *self.shape, learnt=False)
        return self.known[length]


def _stack(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


GROUP = ["label", "length", "key", "ci", "cj"]


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int]]:
    """(table, from, to) of every group with more than one row, from batches sorted by group and side."""

    def groups(t: pa.Table) -> Iterator[tuple[pa.Table, int, int]]:
        for s, e in zip(*_edges(t), strict=True):
            if e - s > 1:
                yield t, s, e

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= ROWS:
            t = pa.Table.from_batches(held)
            cut = _edges(t)[0][-1]
            if cut:
                yield from groups(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows = t.num_rows - cut
    if rows:
        yield from groups(pa.Table.from_batches(held))


def _edges(t: pa.Table) -> tuple[list[int], list[int]]:
    """Where groups begin and end."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in GROUP:
        v = t.column(c).combine_chunks()
        new[1:] |= pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False).astype(bool)
    starts = np.flatnonzero(new).tolist()
    return starts, [*starts[1:], t.num_rows]


def _codes(t: pa.Table, s: int, e: int) -> np.ndarray:
    """Words of the codes of rows s to e, which are of one length."""
    own = t.column("code").slice(s, e - s).combine_chunks().cast(pa.large_binary())
    own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
    offsets = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
    return np.frombuffer(own.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(own), -1).copy().view("<u8")


def _compared(t: pa.Table, s: int, e: int, coders: Coders, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Retrieved pairs of a group's rows s to e, as row numbers from s on, a slice at a time."""
    one, key = coders.of(t.column("length")[s].as_py()), t.column("key")[s].as_py()
    same = t.column("ci")[s].as_py() == t.column("cj")[s].as_py()
    codes, n = _codes(t, s, e), e - s
    last, first = (n, 0) if same else (int(np.searchsorted(sides[s:e], 2)),) * 2
    for lo in range(0, last, SLICE):
        hi = min(lo + SLICE, last)
        begin = lo if same else first
        i, j = one.retrieved(codes[lo:hi], codes[begin:], key >> 32)
        i, j = i + lo, j + begin
        if same:
            later = j > i
            i, j = i[later], j[later]
        if len(i):
            yield i, j


def dealt(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rep, h, code, label, length, key, ci, cj, side): every class in every bucket of its, a large one by pairs of blocks."""
    rows = classes.select("rep", "h", "code", "label", "length", F.explode("keys").alias("key"))
    bucket = ["label", "length", "key"]
    large = written(rows.groupBy(*bucket).count().where(F.col("count") > block).select(*bucket, F.ceil(F.col("count") / block).cast("int").alias("blocks")), "buckets")
    own = F.pmod(F.xxhash64("rep", "h"), F.coalesce("blocks", F.lit(1))).cast("int")
    spread = rows.join(large, bucket, "left").withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))})
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return spread.select("rep", "h", "code", *bucket, F.least("own", "other").alias("ci"), F.greatest("own", "other").alias("cj"), side.alias("side"))


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "side")


def retrieve(rows: DataFrame, coders: Coders) -> DataFrame:
    """The rows of dealt() that have a candidate in their block pair, by their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[pa.Table, np.ndarray]] = []
        sides = None
        for t, s, e in _by_group(batches):
            if not kept or kept[-1][0] is not t:
                if kept:
                    yield from kept[-1][0].filter(pa.array(kept[-1][1])).combine_chunks().to_batches()
                kept = [(t, np.zeros(t.num_rows, bool))]
                sides = t.column("side").to_numpy()
            for i, j in _compared(t, s, e, coders, sides):
                kept[-1][1][s + i] = True
                kept[-1][1][s + j] = True
        if kept:
            yield from kept[-1][0].filter(pa.array(kept[-1][1])).combine_chunks().to_batches()

    return _together(rows).mapInArrow(run, rows.schema)


def rerank(active: DataFrame, classes: DataFrame, coders: Coders, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, n): per block pair, n rows linked to class a (b null), and links a to b that connect what it links (n null)."""
    on = ["rep", "label", "h"]
    rows = active.join(classes.select(*on, "vec", "n"), on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sides = None
        for t, s, e in _by_group(batches):
            if held is not t:
                held, sides = t, t.column("side").to_numpy()
            x, n = units(_stack(t.column("vec").slice(s, e - s))), t.column("n").to_numpy()[s:e]
            links, up = np.zeros(e - s, np.int64), np.arange(e - s)
            for i, j in _compared(t, s, e, coders, sides):
                lo, hi, begin = int(i.min()), int(i.max()) + 1, int(j.min())
                if len(i) > 0.05 * (hi - lo) * (e - s - begin):
                    near = (x[lo:hi] @ x[begin:].T)[i - lo, j - begin] >= threshold
                else:
                    near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                i, j = i[near], j[near]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                _union(up, i, j)
            counted, joined = np.flatnonzero(links), np.flatnonzero(up != np.arange(e - s))
            if len(counted):
                rep = t.column("rep").slice(s, e - s).combine_chunks()
                none = pa.nulls(len(counted), rep.type)
                yield pa.RecordBatch.from_arrays([rep.take(pa.array(counted)), none, pa.array(links[counted])], names=["a", "b", "n"])
                yield pa.RecordBatch.from_arrays([rep.take(pa.array(up[joined])), rep.take(pa.array(joined)), pa.nulls(len(joined), pa.int64())], names=["a", "b", "n"])

    kind = classes.schema["rep"].dataType.simpleString()
    return _together(rows).mapInArrow(run, f"a {kind}, b {kind}, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, recall: float | None = RECALL, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row.

    n_links counts the other rows of the same label and length whose cosine is at least threshold, of which the tables
    retrieve about ``recall`` at the threshold and more beyond it (None: all); component_id is the smallest id reachable
    by links, where rows of one id are one node; kept: id = component_id. Vectors that are null, empty, zero or hold nulls or non-finite numbers, null labels
    and null ids link with nothing; vectors may be long and large. Repeated rows are other rows; those of a tie for the
    smallest id are all kept. An empty table gives no rows; other columns are not read.
    """
    source = vectors.schema[vector_col].dataType.simpleString()
    vec = vectors[vector_col] if source == "array<float>" else vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vec.alias("vec"))
    sound = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    ok = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    drawn = [r["vec"] for r in ok.orderBy(F.xxhash64("id")).select("vec").limit(sample).collect()]
    if not drawn:
        return vectors.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    largest = vectors.groupBy(label_col).count().where(F.col(label_col).isNotNull()).agg(F.max("count")).first()[0]
    coders = Coders(drawn, largest, threshold, recall)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column, lengths = batch.column("vec"), batch.column("vec").value_lengths().to_numpy(zero_copy_only=False)
            code, keys = [None] * len(lengths), [None] * len(lengths)
            for k in np.unique(lengths).tolist():
                own, one = np.flatnonzero(lengths == k), coders.of(k)
                words = one.codes(_stack(column.take(pa.array(own))))
                for i, w, found in zip(own.tolist(), words.astype("<u8"), one.keys(words), strict=True):
                    code[i], keys[i] = w.tobytes(), found
            batch = batch.append_column("length", pa.array(lengths.astype(np.int32)))
            yield batch.append_column("code", pa.array(code, pa.binary())).append_column("keys", pa.array(keys, pa.list_(pa.int64())))

    # classes are keyed by 128 bits of hash, so that only one of equal vectors moves
    ok = ok.withColumns({"h": F.xxhash64("vec"), "g": F.xxhash64(F.lit(7), "vec", F.size("vec"))})
    same = ok.groupBy("label", "h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")).select("rep", "label", "h", "g", "vec", "n")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in same.schema)
    classes = written(same.mapInArrow(coded, f"{schema}, length int, code binary, keys array<bigint>"), "classes")
    active = written(retrieve(dealt(classes, block), coders), "active")
    links = written(rerank(active, classes, coders, threshold), "links")
    others = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    found = connected_components(links.where("b is not null"), "a", "b")
    of = classes.join(others, "rep", "left").join(found, classes["rep"] == found["node"], "left").select(
        "label", "h", "g", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = ok.join(of, ["label", "h", "g"]).select("id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(sound & F.col("id").isNotNull() & F.col("label").isNotNull(), F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionAll(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
