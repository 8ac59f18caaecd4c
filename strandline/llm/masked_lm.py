"""LM scoring by masked pseudo-likelihood.

A small network predicts every token from the ``window`` tokens on either side: the
embeddings of the left and of the right neighbours are summed into a hidden layer,
and the token is predicted in two steps, its class and its place in the class. A
document's score is the sum of the log-probabilities of all its tokens.

The vocabulary comes from counts over the whole corpus; the network knows rarer words
by shared hashed ids. A rare word's log-probability is its id's, plus the log of the
word's part in the count of the id. That part is counted over all other documents, so a
word that no other document has is as good as unseen, and what the model knows of words
grows with the corpus. Training is data-parallel: every partition runs over all of its
tokens and returns its parameters, which are averaged, once per round: an embedding by
how often a partition has met it, everything else by tokens. Parameters have a fixed
size (about 1 MB); nothing else is sent to the driver but the vocabulary.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: CLASSES squared ids: 0 is the edge of a document, then words, then HASHED shared ids.
CLASSES, HASHED, WIDTH, WINDOW, ROUNDS = 64, 512, 16, 2, 1
STEP, CHUNK = 0.05, 4096
#: What is added to the count of a rare word in other documents: little, as what no other document has could be any string.
UNSEEN = 0.001
#: Values of a parameter that are averaged together.
BLOCK = 8192


def vocabulary(docs: DataFrame, text_col: str = "text", classes: int = CLASSES, hashed: int = HASHED) -> tuple[dict[bytes, int], np.ndarray, DataFrame]:
    """Ids of the commonest words of the corpus, the counts of all ids, and (word, n) of all words. Ties go to the smaller word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                counts.update((t.as_py() or b"").split())
            if len(counts) > 500_000:
                yield out()
                counts.clear()
        yield out()

    counted = docs.select(docs[text_col].cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(counted, "words")
    top = counted.orderBy(F.desc("n"), "word").limit(classes * classes - 1 - hashed).collect()
    words = {bytes(r["word"]): i + 1 for i, r in enumerate(top)}
    counts = np.zeros(classes * classes)
    counts[1 : len(top) + 1] = [r["n"] for r in top]
    first = classes * classes - hashed
    for r in counted.groupBy((F.crc32("word") % hashed).alias("at")).agg(F.sum("n").alias("n")).collect():
        counts[first + r["at"]] = r["n"]
    for w, i in words.items():
        counts[first + zlib.crc32(w) % hashed] -= counts[i]
    return words, counts, counted


def token_ids(docs: DataFrame, words: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, hashed: int = HASHED) -> DataFrame:
    """(id, tokens, row, n_rare, rare, own) of every row, in the shared folder.

    tokens are little-endian 16-bit ids, row is a number of its own, n_rare how many tokens have shared ids; rare are
    the different words of these, own how often each is there.
    """
    first = classes * classes - hashed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.get
        for batch in batches:
            out, n_rare, rare, own = [], [], [], []
            for t in batch.column(1).cast(pa.binary()):
                all_words = (t.as_py() or b"").split()
                ids = list(map(known, all_words))
                counts = Counter([w for w, i in zip(all_words, ids, strict=True) if i is None])
                shared = {w: first + zlib.crc32(w) % hashed for w in counts}
                out.append(np.array([i or shared[w] for w, i in zip(all_words, ids, strict=True)], "<u2").tobytes())
                n_rare.append(counts.total())
                rare.append(list(counts))
                own.append(list(counts.values()))
            arrays = [batch.column(0), pa.array(out, pa.binary()), pa.array(n_rare, pa.int64()), pa.array(rare, pa.list_(pa.binary())), pa.array(own, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "tokens", "n_rare", "rare", "own"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    found = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, tokens binary, n_rare long, rare array<binary>, own array<int>")
    return written(found.select("id", "tokens", F.monotonically_increasing_id().alias("row"), "n_rare", "rare", "own"), "tokens")


def rare_counts(tokens: DataFrame, counted: DataFrame, unseen: float = UNSEEN) -> DataFrame:
    """(row, log_count, n_seen): the sum, over a row's words with shared ids, of the log of how often other rows have them plus
    ``unseen``, less what it is where none has, and how many of these words other rows have; rows without any may be missing."""
    more = counted.where("n > 1").groupBy(F.xxhash64("word").alias("h")).agg(F.sum("n").alias("n"))
    pairs = tokens.select("row", F.explode(F.arrays_zip("rare", "own")).alias("x")).select("row", F.xxhash64("x.rare").alias("h"), F.col("x.own").alias("own"))
    gain = F.col("own") * (F.log(F.col("n") - F.col("own") + F.lit(unseen)) - F.log(F.lit(unseen)))
    return pairs.join(more, "h").where("n > own").groupBy("row").agg(F.sum(gain).alias("log_count"), F.sum(F.col("own").cast("long")).alias("n_seen"))


class WindowNetwork:
    """The network and its Adagrad steps; parameters are float32 arrays by name."""

    def __init__(self, counts: np.ndarray, classes: int = CLASSES, width: int = WIDTH, window: int = WINDOW, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes, self.window = classes, window
        share = (counts + 0.1).reshape(classes, classes)
        self.low_bias = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)

        def small(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * 0.1).astype(np.float32)

        size = classes * classes
        self.p = {"left": small(size, width), "right": small(size, width), "bias": np.zeros(width, np.float32), "high": small(width, classes), "high_bias": np.log(share.sum(axis=1) / share.sum()).astype(np.float32), "low": small(width, classes), "of_class": small(classes, width)}

    def stream(self, docs: list[np.ndarray]) -> np.ndarray:
        """The documents one after the other, with the window's worth of edges around each."""
        gap = np.zeros(self.window, np.int64)
        return np.concatenate([gap, *(x for d in docs for x in (d.astype(np.int64), gap))])

    def _around(self, x: np.ndarray, side: str, forward: bool) -> np.ndarray:
        """Sum of the side's embeddings of the window neighbours of all positions but the outer ones."""
        e, w = self.p[side][x], self.window
        n = len(x) - 2 * w
        return sum(e[w + k : w + k + n] if forward else e[w - k : w - k + n] for k in range(1, w + 1))

    def _predict(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of every position but the outer ones: its class and place, the two layers, and the logits of both steps."""
        p, w = self.p, self.window
        high, low = np.divmod(x[w : len(x) - w], self.classes)
        h = np.tanh(self._around(x, "left", False) + self._around(x, "right", True) + p["bias"])
        g = h + p["of_class"][high]
        return high, low, h, g, h @ p["high"] + p["high_bias"], g @ p["low"] + self.low_bias[high]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of every position of a stream but the outer ones; zero at edges."""
        high, low, _, _, a, b = self._predict(x)
        out = np.zeros(len(high), np.float32)
        for z, at in ((a, high), (b, low)):
            _bounded(z)
            out += z[np.arange(len(z)), at] - np.log(np.exp(z).sum(axis=1))
        return np.where(x[self.window : len(x) - self.window] > 0, out, 0)

    def gradients(self, x: np.ndarray) -> tuple[int, dict[str, np.ndarray], np.ndarray]:
        """Number of tokens, mean gradients of the dense parameters and per id of the embeddings, ids touched."""
        p, w = self.p, self.window
        high, low, h, g, da, db = self._predict(x)
        rows, real = np.arange(len(high)), x[w : len(x) - w] > 0
        n = max(int(real.sum()), 1)
        scale = (real / n).astype(np.float32)
        for z, at in ((da, high), (db, low)):  # from logits to their gradients
            _bounded(z)
            np.exp(z, out=z)
            z *= (scale / z.sum(axis=1))[:, None]
            z[rows, at] -= scale
        dg = db @ p["low"].T
        dh = (da @ p["high"].T + dg) * (1 - h * h)
        kinds, of_class = _sum_by(high, dg)
        m = len(x)
        padded = np.zeros((m + 2 * w, h.shape[1]), np.float32)
        padded[2 * w : m] = dh
        # x[s] is a left neighbour of the positions after s, which are rows s - w + k of dh
        to_left = sum(padded[w + k : w + k + m] for k in range(1, w + 1))
        to_right = sum(padded[w - k : w - k + m] for k in range(1, w + 1))
        ids, both = _sum_by(x, np.concatenate([to_left, to_right], axis=1))
        wide = np.zeros_like(p["of_class"])
        wide[kinds] = of_class
        return n, {
            "high": h.T @ da, "high_bias": da.sum(axis=0), "low": g.T @ db, "of_class": wide, "bias": dh.sum(axis=0),
            "left": both[:, : h.shape[1]], "right": both[:, h.shape[1] :],
        }, ids

    def train(self, x: np.ndarray, seen: dict[str, np.ndarray], met: np.ndarray, step: float = STEP) -> int:
        """One Adagrad step on a stream; seen holds the sums of squares, met how many steps had each id."""
        n, grads, ids = self.gradients(x)
        for name, grad in grads.items():
            at = ids if name in ("left", "right") else slice(None)
            seen[name][at] += grad * grad
            self.p[name][at] -= step * grad / (np.sqrt(seen[name][at]) + 1e-8)
        met[ids] += 1
        return n


def _bounded(z: np.ndarray) -> None:
    """Takes the largest of a row off it, where sums of exponentials could overflow."""
    if z.size and z.max() > 60:
        z -= z.max(axis=1, keepdims=True)


def _sum_by(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of the rows of each."""
    keys = keys.astype(np.uint16)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(rows[order], at)


def _streams(net: WindowNetwork, batches: Iterator[pa.RecordBatch], column: str = "tokens", size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray]]:
    """Runs of whole documents of about ``size`` tokens, as (batch, from row, to row, stream); long ones stand alone."""
    for batch in batches:
        held, first, n = [], 0, 0
        for row, t in enumerate(batch.column(column)):
            d = np.frombuffer(t.as_py() or b"", "<u2")
            if held and n + len(d) > size:
                yield batch, first, row, net.stream(held)
                held, first, n = [], row, 0
            held.append(d)
            n += len(d)
        if held:
            yield batch, first, batch.num_rows, net.stream(held)


def fit(tokens: DataFrame, counts: np.ndarray, rounds: int = ROUNDS, **shape) -> WindowNetwork:
    """Trains on all tokens: rounds times, every partition from the average of the last round."""
    net = WindowNetwork(counts, **shape)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], start: WindowNetwork = net) -> Iterator[pa.RecordBatch]:
            own = WindowNetwork(counts, start.classes, start.p["bias"].size, start.window)
            own.p = {k: v.copy() for k, v in start.p.items()}
            seen = {k: np.full_like(v, 1e-6) for k, v in own.p.items()}
            done, met = 0, np.zeros(len(counts), np.float32)
            for _, _, _, x in _streams(own, batches):
                for at in range(0, max(len(x) - 2 * own.window, 0), CHUNK):  # long documents in several steps
                    done += own.train(x[at : at + CHUNK + 2 * own.window], seen, met)
            if done:
                part = TaskContext.get().partitionId()
                for name, v in own.p.items():
                    weights = np.repeat(met, v.shape[1]) if name in ("left", "right") else np.full(v.size, done, np.float32)
                    for at in range(0, v.size, BLOCK):
                        w = weights[at : at + BLOCK]
                        change = (v.ravel()[at : at + BLOCK] - start.p[name].ravel()[at : at + BLOCK]) * w
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at // BLOCK], pa.int32()), pa.array([part], pa.int32()), *(pa.array([x.astype(np.float32)], pa.list_(pa.float32())) for x in (change, w))], names=["name", "block", "part", "change", "weight"])

        parts = tokens.select("tokens").mapInArrow(run, "name string, block int, part int, change array<float>, weight array<float>")
        ordered = parts.repartition("name", "block").sortWithinPartitions("name", "block", "part")
        for r in ordered.mapInArrow(_mean_changes, "name string, block int, change array<float>").collect():
            flat = net.p[r["name"]].reshape(-1)
            flat[r["block"] * BLOCK : r["block"] * BLOCK + len(r["change"])] += np.array(r["change"], np.float32)
    return net


def _mean_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted mean change of every block, of rows in the order of block and partition: one block's sums are held at a time."""
    key = total = weight = None

    def out() -> pa.RecordBatch:
        mean = (total / np.maximum(weight, 1e-9)).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([mean], pa.list_(pa.float32()))], names=["name", "block", "change"])

    for batch in batches:
        for i in range(batch.num_rows):
            now = (batch.column("name")[i].as_py(), batch.column("block")[i].as_py())
            change, w = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.float64) for c in ("change", "weight"))
            if now != key:
                if key is not None:
                    yield out()
                key, total, weight = now, np.zeros(len(change)), np.zeros(len(change))
            total += change
            weight += w
    if key is not None:
        yield out()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id_col, n_tokens, score, mean_score, n_unseen, unseen_share) of every row: the summed log-probability of its tokens, and
    per token; how many tokens are words that no other row has, and what share. A text that the corpus holds twice has none of these.

    Words are told apart whatever the size of the vocabulary: all of them are counted, as docs is what is scored, and
    a row's own words are left out of the counts that it is scored by.

    Null and empty texts have no tokens, score 0 and a null mean; texts may have any length. Repeated rows are
    trained on each and score alike, as other documents to each other; null ids are kept. Words of equal counts
    (ties) enter the vocabulary by their bytes. An empty table gives no rows; other columns are not read.
    """
    words, counts, counted = vocabulary(docs, text_col)
    tokens = token_ids(docs, words, id_col, text_col)
    net = fit(tokens, counts, rounds)
    shared = np.log(np.maximum(counts, 1))
    shared[:-HASHED] = 0  # a known word is all of its id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, last, x in _streams(net, batches):
            w = net.window
            own = batch.slice(first, last - first)
            parts = [net.log_probabilities(x[at : at + CHUNK + 2 * w]) for at in range(0, len(x) - 2 * w, CHUNK)]
            lp = np.concatenate([*parts, np.zeros(1)]).astype(np.float64)
            lengths = np.array([len(t.as_py() or b"") // 2 for t in own.column("tokens")], np.int64)
            starts = np.cumsum(lengths + w) - lengths - w
            lp -= shared[x[w:]][: len(lp)]
            sums = np.array([lp[s : s + n].sum() for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([own.column("id"), own.column("row"), own.column("n_rare"), pa.array(lengths), pa.array(sums, pa.float64())], names=["id", "row", "n_rare", "n_tokens", "score"])

    kind = tokens.schema["id"].dataType.simpleString()
    scored = tokens.select("id", "tokens", "row", "n_rare").mapInArrow(run, f"id {kind}, row long, n_rare long, n_tokens long, score double")
    own = F.col("n_rare") * F.log(F.lit(UNSEEN)) + F.coalesce("log_count", F.lit(0.0))
    scored = scored.join(rare_counts(tokens, counted), "row", "left").withColumns({"score": F.col("score") + own, "n_unseen": F.col("n_rare") - F.coalesce("n_seen", F.lit(0))})
    mean, share = (F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens")) for c in ("score", "n_unseen"))
    return scored.select(F.col("id").alias(id_col), "n_tokens", "score", mean.alias("mean_score"), "n_unseen", share.alias("unseen_share"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
