"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are binned by quantiles. Boosting cycles through the features:
each step fits a shallow tree to the residuals over one feature's bins and adds it
to that feature's lookup table; the pairs of features with the largest gains get
tables of their own in the same way. A score is the sum of one entry per table.

Features of all documents are computed in one pass and written; a bounded sample
of labelled rows is fitted on the driver, and tables of a few kilobytes go back to
the tasks that score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

THRESHOLD = 0.3
#: Labelled rows that are fitted at most: those with the smallest hashes of their ids.
MAX_TRAIN = 20_000
FEATURES = ("log_words", "word_length", "litter", "pipes", "shouts", "upper", "distinct", "top_word", "repeats", "digits", "stops", "line_words", "duplicate_lines", "spaces", "other")


def features_of(text: bytes | None) -> list[float]:
    """The FEATURES of a text in UTF-8; all are finite for any text."""
    text = text or b""
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)

    def of(chars: bytes) -> float:
        return float(count[list(chars)].sum())

    lines = [x for x in text.split(b"\n") if x.strip()]
    kinds = Counter(words)
    upper, lower = float(count[65:91].sum()), float(count[97:123].sum())
    return [
        float(np.log1p(len(words))), sum(map(len, words)) / n, of(b"#*$%&<>~^{}") / n, of(b"|") / n, of(b"!") / n, upper / max(upper + lower, 1.0), len(kinds) / n,
        max(kinds.values(), default=0) / n, sum(map(bytes.__eq__, words, words[1:])) / n, float(count[48:58].sum()) / size, of(b".,;:?") / n, len(words) / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1),
        of(b" \t\n\x0b\x0c\r") / size, float(count[128:].sum()) / size,
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) of every row: x holds the FEATURES of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features_of(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, x array<double>")


@dataclass
class AdditiveModel:
    """Lookup tables over binned features; edges[f] are the upper bounds of all bins of f but the last."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += values[np.searchsorted(edges, x[:, f], "left")]
        for (f, g), values in zip(self.pairs, self.pair_tables, strict=True):
            z += values[np.searchsorted(self.coarse[f], x[:, f], "left"), np.searchsorted(self.coarse[g], x[:, g], "left")]
        return 1 / (1 + np.exp(-z))


def _cut(g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float) -> np.ndarray:
    """A tree of that depth over ordered bins with gradient sums g and curvature sums h: each bin's value."""
    whole = g.sum() / (h.sum() + ridge)
    if depth == 0 or len(g) < 2:
        return np.full(len(g), whole)
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge), -1.0)
    at = int(gain.argmax())
    if gain[at] <= g.sum() ** 2 / (h.sum() + ridge):
        return np.full(len(g), whole)
    return np.concatenate([_cut(g[: at + 1], h[: at + 1], depth - 1, least, ridge), _cut(g[at + 1 :], h[at + 1 :], depth - 1, least, ridge)])


def _cut2(g: np.ndarray, h: np.ndarray, least: float, ridge: float) -> np.ndarray:
    """A tree of two levels over a grid of bins: the first feature is cut once, each half along the second."""
    best, value = -1.0, np.full(g.shape, g.sum() / (h.sum() + ridge))
    for at in range(1, len(g)):
        halves = []
        gain = 0.0
        for part in (slice(0, at), slice(at, None)):
            gs, hs = g[part].sum(axis=0), h[part].sum(axis=0)
            values = _cut(gs, hs, 1, least, ridge)
            gain += float((2 * gs * values - (hs + ridge / len(hs)) * values**2).sum())
            halves.append(np.tile(values, (len(g[part]), 1)))
        if gain > best:
            best, value = gain, np.concatenate(halves)
    return value


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.1, depth: int = 2, least: float = 1.0, ridge: float = 1.0) -> AdditiveModel:
    """Cyclic boosting of one shallow tree per feature and round, then the same for the best pairs."""
    rate0 = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    n_features = x.shape[1]
    model = AdditiveModel(base=float(np.log(rate0 / (1 - rate0))))
    if not len(y):
        return AdditiveModel(base=0.0, edges=[np.array([])] * n_features, tables=[np.zeros(1)] * n_features)
    inner = lambda k: np.linspace(0, 1, k + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, f], inner(bins))) for f in range(n_features)]
    model.coarse = [np.unique(np.quantile(x[:, f], inner(coarse))) for f in range(n_features)]
    at = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        for f in range(n_features):
            p = 1 / (1 + np.exp(-z))
            size = len(model.tables[f])
            step = rate * _cut(np.bincount(at[f], y - p, size), np.bincount(at[f], p * (1 - p), size), depth, least, ridge)
            model.tables[f] += step
            z += step[at[f]]
    low = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(model.coarse)]
    shape = [len(e) + 1 for e in model.coarse]

    def grids(f: int, g: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, size = low[f] * shape[g] + low[g], shape[f] * shape[g]
        return (np.bincount(cell, v, size).reshape(shape[f], shape[g]) for v in (y - p, p * (1 - p)))

    p = 1 / (1 + np.exp(-z))
    gains = []
    for f in range(n_features):
        for g in range(f + 1, n_features):
            a, b = grids(f, g, p)
            v = _cut2(a, b, least, ridge)
            gains.append((float((2 * a * v - b * v**2).sum()), f, g))
    model.pairs = [(f, g) for gain, f, g in sorted(gains, reverse=True)[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((shape[f], shape[g])) for f, g in model.pairs]
    for _ in range(pair_rounds):
        for k, (f, g) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-z))
            step = rate * _cut2(*grids(f, g, p), least, ridge)
            model.pair_tables[k] += step
            z += step[low[f], low[g]]
    return model


def held_out(id_col: str = "id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row of docs.

    Labelled rows whose id's crc32 mod 5 is 0 are held out and never learnt from. Null labels and ids
    are not learnt from, of several labels for an id the largest counts; null ids are scored and not held out. Without any label to
    learn from every score is 0.5. Null texts count as empty; empty texts have a score like any other. Of several texts of one
    id the one with the smallest features is learnt from, all are scored; equal bins (ties) score alike. Repeated rows come
    repeated, and an empty table gives no rows. Texts may have any length.
    """
    x = written(features(docs, id_col, text_col), "features")
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    once = known.where(~held_out()).join(x, "id").groupBy("id", "y").agg(F.min("x").alias("x"))
    rows = once.orderBy(F.xxhash64("id"), "id").limit(max_train).select("x", "y").collect()
    model = fit(np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r["y"] for r in rows], float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield batch.select(["id"]).append_column("score", pa.array(model.score(own)))

    kind = x.schema["id"].dataType.simpleString()
    scored = x.mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
