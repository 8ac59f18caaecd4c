"""Toxicity: terms found through misspellings, weighed by what stands around them.

The lexicon is learnt from labelled rows: words, and beginnings of words, that documents marked toxic hold far more
often than the others. Its trie is intersected with Levenshtein automata (insertion, deletion, substitution and swap of
neighbours; short terms allow no edit, long ones two), and the product is made deterministic once, on the driver: a
table of states by letters. Tasks run the words of many documents through that table together, one letter of all
words at a time; nearly all words are in the dead state after two or three.

Around every hit a window of words is looked at: quotation marks, words of reporting and negation make it count for
less, an address for more. What remains per document - weight, weight a word, kinds of terms - goes into a logistic
regression. All documents are scored in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .quality_model import held_out

THRESHOLD = 0.5
#: Labelled rows of each class that are learnt from at most: those with the smallest hashes of their ids.
MAX_TRAIN = 5_000
#: Terms of a lexicon at most; letters of the longest beginning that is tried; words to each side of a hit that are looked at.
MAX_TERMS, MAX_STEM, WINDOW = 150, 12, 6
#: Characters of text that are run through the table at once.
SLICE = 1 << 21
#: Share of a term's own hits that misspelled ones are expected to have, before any is seen.
MISSPELLED = 0.02

# Signs that stand for letters inside of words, marks of quotation, and words that tell
# reports, denials and addresses in English, German, French and Spanish.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
OPENING, CLOSING, EITHER = "“„«‹‚", "”“»›", '"'
REPORTING = "said says called calls quote quoted quotes wrote word term insult slur sagte sagt nannte nennt schrieb wort zitat dit disait appelé traité mot citation dijo dice llamó escribió palabra insulto cita".split()
DENYING = "not never no nobody isn don nicht nie kein keine niemand pas jamais aucun personne nunca nadie ningún".split()
ADDRESSING = "you your yours yourself du dich dir dein deine ihr euch tu toi te vous votre ton eres tú te usted vosotros".split()
#: What a hit's weight is multiplied by.
QUOTED_, REPORTED_, DENIED_, ADDRESSED_ = 0.2, 0.5, 0.6, 1.5


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the letter in lower case or that a sign stands for; 1 for letters and marks on them, 2 for signs."""
    low, kind = np.arange(1 << 16, dtype=np.uint16), np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha() or 0x300 <= c < 0x370:
            kind[c] = 1
            lower = ch.lower()
            low[c] = ord(lower) if len(lower) == 1 and ord(lower) < 1 << 16 else c
    for sign, letter in SIGNS.items():
        low[ord(sign)], kind[ord(sign)] = ord(letter), 2
    return low, kind


@dataclass
class Words:
    """All words of some texts: letters in lower case, where each word begins and ends, its text, and the way back to the characters."""

    text: str
    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    place: np.ndarray

    def before(self, i: int, n: int) -> str:
        j = max(i - n, int(np.searchsorted(self.doc, self.doc[i])))
        return self.text[self._from(self.end[j - 1], j) if j else 0 : self.place[self.start[i]]] if j < i else self.text[self._from(self.end[i - 1], i) if i else 0 : self.place[self.start[i]]]

    def after(self, i: int, n: int) -> str:
        j = min(i + n, int(np.searchsorted(self.doc, self.doc[i], "right")) - 1)
        upto = self.place[self.start[j + 1]] if j + 1 < len(self.start) else len(self.text)
        return self.text[self.place[self.end[i] - 1] + 1 : upto].partition("\0")[0]

    def _from(self, end: int, j: int) -> int:
        """After the word that ends there, and after the end of a text that ends between it and word j."""
        at = self.place[end - 1] + 1
        return at + self.text[at : self.place[self.start[j]]].rfind("\0") + 1


def words_of(texts: list[str]) -> Words:
    """Words are runs of letters; a sign between letters, or two, is the letter it stands for; of three or more equal letters two stay."""
    text = "".join(t + "\0" for t in texts)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lows, kinds = _letters()
    at = np.minimum(code, (1 << 16) - 1)
    low, kind = lows[at], kinds[at]
    letter, sign = kind == 1, kind == 2
    off = lambda x, k: np.concatenate([x[k:], np.zeros(k, x.dtype)]) if k > 0 else np.concatenate([np.zeros(-k, x.dtype), x[:k]])
    to = off(letter, 1) | off(sign, 1) & off(letter, 2)
    inside = letter | sign & off(letter, -1) & to
    inside |= sign & off(inside & sign, -1) & off(letter, 1)
    drop = np.zeros(len(low), bool)
    drop[2:] = inside[2:] & inside[1:-1] & inside[:-2] & (low[2:] == low[1:-1]) & (low[2:] == low[:-2])
    place = np.flatnonzero(~drop)
    low, inside = low[place], inside[place]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    return Words(text, low, start, end, np.searchsorted(ends, place[start], "right"), place)


@dataclass
class Lexicon:
    """Terms with their kinds and, compiled from them, a deterministic automaton.

    stems[t] says whether term t may go on. step[state, class of letter] is the next state: 0 is dead, 1 the first.
    ends[state] and upto[state] are 4 * term + edits for words that end there or may go on from there, or -1.
    """

    terms: list[str]
    stems: list[bool]
    classes: dict[str, int] = field(default_factory=dict)
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 1), np.int32))
    ends: np.ndarray = field(default_factory=lambda: np.full(2, -1, np.int32))
    upto: np.ndarray = field(default_factory=lambda: np.full(2, -1, np.int32))

    def edits(self, t: int) -> int:
        n = len(self.terms[t])
        return int(n >= 6) if self.stems[t] else (n >= 5) + (n >= 9)

    def __post_init__(self) -> None:
        child, last, budget = [{}], [-1], [0]
        for t, term in enumerate(self.terms):
            node, own = 0, self.edits(t)
            budget[0] = max(budget[0], own)
            for ch in term:
                if ch not in child[node]:
                    child[node][ch] = len(child)
                    child.append({})
                    last.append(-1)
                    budget.append(0)
                node = child[node][ch]
                budget[node] = max(budget[node], own)
            last[node] = t
        self.classes = {ch: i + 1 for i, ch in enumerate(sorted({c for t in self.terms for c in t}))}

        def closed(found: Iterable[tuple[int, int, str]]) -> frozenset:
            """With deletions, and the fewest edits of every place. (node, edits, letter that a swap still waits for)."""
            best: dict[tuple[int, str], int] = {}
            todo = list(found)
            while todo:
                node, e, wait = todo.pop()
                if e > budget[node] or best.get((node, wait), 9) <= e:
                    continue
                best[node, wait] = e
                if not wait:
                    todo += [(x, e + 1, "") for x in child[node].values()]
            return frozenset((node, e, wait) for (node, wait), e in best.items())

        def moved(state: frozenset, ch: str) -> frozenset:
            out = []
            for node, e, wait in state:
                if wait:
                    if ch == wait:  # the swap's second letter; the node already lies behind both
                        out.append((node, e, ""))
                    continue
                if ch in child[node]:
                    out.append((child[node][ch], e, ""))
                out.append((node, e + 1, ""))
                for first, x in child[node].items():
                    if first != ch:
                        out.append((x, e + 1, ""))
                    if ch in child[x] and ch != first:
                        out.append((child[x][ch], e + 1, first))
            return closed(out)

        dead, first = frozenset(), closed([(0, 0, "")])
        number, todo, rows = {dead: 0, first: 1}, [first], {0: np.zeros(len(self.classes) + 1, np.int32)}
        while todo:
            state = todo.pop()
            near = {c for node, _, wait in state for c in (wait, *child[node], *(d for x in child[node].values() for d in child[x])) if c}
            row = None
            for ch in ["", *near]:
                new = moved(state, ch)
                if new not in number:
                    number[new] = len(number)
                    todo.append(new)
                if row is None:
                    row = np.full(len(self.classes) + 1, number[new], np.int32)
                else:
                    row[self.classes[ch]] = number[new]
            rows[number[state]] = row
        self.step = np.stack([rows[i] for i in range(len(number))])
        self.ends, self.upto = np.full(len(number), -1, np.int32), np.full(len(number), -1, np.int32)
        for state, i in number.items():
            hits = sorted((e, last[node]) for node, e, wait in state if not wait and last[node] >= 0 and e <= self.edits(last[node]))
            for out, own in ((self.ends, hits), (self.upto, [h for h in hits if self.stems[h[1]]])):
                if own:
                    out[i] = 4 * own[0][1] + own[0][0]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, 4 * term + edits) of every word that a term fits, with the fewest edits."""
        classes = np.zeros(1 << 16, np.uint16)
        for ch, i in self.classes.items():
            if ord(ch) < 1 << 16:
                classes[ord(ch)] = i
        cls = classes[words.low]
        n = len(words.start)
        hit = np.full(n, -1, np.int32)
        own, state = np.arange(n), np.ones(n, np.int32)
        k = 0
        while len(own):
            state = self.step[state, cls[words.start[own] + k]]
            k += 1
            for value, at in ((self.upto[state], own), (np.where(words.end[own] == words.start[own] + k, self.ends[state], -1), own)):
                some = value >= 0
                if some.any():
                    value, at = value[some], at[some]
                    better = (hit[at] < 0) | ((value & 3) < (hit[at] & 3))
                    hit[at[better]] = value[better]
            on = (state > 0) & (words.end[own] > words.start[own] + k)
            own, state = own[on], state[on]
        found = np.flatnonzero(hit >= 0)
        return found, hit[found]


_word = re.compile(r"[^\W\d_]+")
_reporting, _denying, _addressing = map(frozenset, (REPORTING, DENYING, ADDRESSING))


def context(before: str, after: str) -> float:
    """What a hit between these two texts counts for: 1 alone, less inside of quotation marks, in reports and denials, more in an address."""
    before, after = before.rpartition("\n")[2], after.partition("\n")[0]
    out = 1.0
    opened = max((before.rfind(c) for c in OPENING), default=-1)
    closed = max((before.rfind(c) for c in CLOSING if c not in OPENING), default=-1)
    if opened > closed and any(c in after for c in CLOSING) or before.count(EITHER) % 2 and EITHER in after:
        out *= QUOTED_
    near, far = set(_word.findall(before.lower())), set(_word.findall(after.lower()))
    if near & _reporting:
        out *= REPORTED_
    if near & _denying:
        out *= DENIED_
    if (near | far) & _addressing:
        out *= ADDRESSED_
    return out


def hits_of(texts: list[str], lexicon: Lexicon, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of every text; and of all hits text, 4 * term + edits, context)."""
    n, docs, codes, scores, at = [], [], [], [], 0
    while at < len(texts):
        upto, size = at + 1, len(texts[at])
        while upto < len(texts) and size + len(texts[upto]) <= SLICE:
            size += len(texts[upto])
            upto += 1
        words = words_of(texts[at:upto])
        n.append(np.bincount(words.doc, minlength=upto - at))
        found, code = lexicon.find(words)
        docs.append(words.doc[found] + at)
        codes.append(code)
        scores.append(np.array([context(words.before(i, window), words.after(i, window)) for i in found.tolist()], float))
        at = upto
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in (n, docs, codes, scores))


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def term_documents(texts: DataFrame) -> DataFrame:
    """(term, word boolean, toxic, clean): documents of (text, y) of both classes with a word, or with one that begins like that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                w = words_of([text])
                low = w.low.astype("<u2").tobytes().decode("utf-16-le", "surrogatepass")
                own = {low[s:e] for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)}
                count[y].update((x, True) for x in own if len(x) > 2)
                count[y].update((x, False) for x in {x[:k] for x in own for k in range(4, min(len(x) - 1, MAX_STEM) + 1)})
            keys = list(count[0] | count[1])
            for k in range(0, len(keys), 100_000):
                own = keys[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([t.encode("utf-8", "replace").decode() for t, _ in own]), pa.array([x for _, x in own]), pa.array([count[1][x] for x in own]), pa.array([count[0][x] for x in own])], names=["term", "word", "toxic", "clean"])

    return texts.select("text", "y").mapInArrow(run, "term string, word boolean, toxic long, clean long").groupBy("term", "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose(counted: DataFrame, n_toxic: int, n_clean: int, max_terms: int = MAX_TERMS, lift: float = 4.0, least: float = 10.83) -> tuple[list[str], list[bool]]:
    """Terms with the largest likelihood ratios, none of which begins like another, and whether they may go on.

    A term is held by three toxic documents and half a per cent of them, ``lift`` times as often as by the others, and its
    likelihood ratio exceeds ``least`` (a chance of one in a thousand). At most ``max_terms`` rows times 40 come to the driver.
    """
    p, q = (F.col("toxic") + 0.5) / (n_toxic + 1), (F.col("clean") + 0.5) / (n_clean + 1)
    m = (p * n_toxic + q * n_clean) / (n_toxic + n_clean)
    kl = lambda p: p * F.log(p / m) + (1 - p) * F.log((1 - p) / (1 - m))
    gain = 2 * (n_toxic * kl(p) + n_clean * kl(q))
    good = counted.where((F.col("toxic") >= max(3, 0.005 * n_toxic)) & (p >= lift * q)).withColumn("gain", gain).where(F.col("gain") >= least)
    rows = good.orderBy(F.desc("gain"), F.desc("word"), F.desc(F.length("term")), "term").limit(40 * max_terms).collect()
    terms: dict[str, bool] = {}
    for r in rows:
        t = r["term"]
        if len(terms) < max_terms and not any(t.startswith(x) or x.startswith(t) for x in terms):
            terms[t] = not r["word"]
    return list(terms), list(terms.values())


@dataclass
class Model:
    lexicon: Lexicon
    #: Of 4 * term + edits.
    weight: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    window: int = WINDOW

    def features(self, n: np.ndarray, doc: np.ndarray, code: np.ndarray, context: np.ndarray) -> np.ndarray:
        """By document: logs of the weight of all hits, of that a hundred words, of the kinds of terms, and the heaviest hit."""
        w = self.weight[code] * context
        total = np.bincount(doc, w, len(n))
        heavy = np.zeros(len(n))
        np.maximum.at(heavy, doc, w)
        counts = w >= 0.5
        kinds = np.unique(doc[counts] * np.int64(1 << 20) + (code[counts] >> 2))
        distinct = np.bincount(kinds >> 20, minlength=len(n))
        share = 100 * total / np.maximum(n, 1)
        return np.stack([np.log1p(total), np.log1p(share), np.log1p(distinct), heavy, np.log1p(total) * np.log1p(share)], axis=1)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n, doc, code, near = hits_of(texts, self.lexicon, self.window)
        x = (self.features(n, doc.astype(np.int64), code.astype(np.int64), near) - self.centre) / self.scale
        return 1 / (1 + np.exp(-(self.beta[0] + x @ self.beta[1:]))), np.bincount(doc.astype(np.int64), minlength=len(n))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method; the intercept isn't held back."""
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    beta, hold = np.zeros(a.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + hold, a.T @ (y - p) - hold @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, max_terms: int = MAX_TERMS, seeds: tuple[str, ...] = (), window: int = WINDOW) -> Model:
    """A model from the labelled rows that aren't held out; ``seeds`` are words that the lexicon has in any case."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y")).where(~held_out())
    total = {r["y"]: r["n"] for r in known.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    first = [known.where(c).orderBy(F.xxhash64("id"), "id").limit(max_train).select("id", F.lit(y).alias("y")) for y, c in ((1, "y > 0"), (0, "y <= 0"))]
    chosen = written(first[0].unionByName(first[1]), "chosen")
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    once = texts.join(F.broadcast(chosen), "id").groupBy(F.xxhash64("text").alias("h")).agg(F.max("y").alias("y"), F.min("text").alias("text"))  # copies of a text count once
    sample = written(once, "labelled")
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    terms, stems = choose(term_documents(sample), size[1], size[0], max_terms) if len(size) == 2 else ([], [])
    own = [s for s in seeds if s not in terms]
    lexicon = Lexicon(own + terms, [False] * len(own) + stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, doc, code, near = hits_of(_texts(batch.column(0)), lexicon, window)
            # a document's hits by term, edits and context: bounded by the lexicon
            cells: list[dict] = [{} for _ in n]
            for d, c, s in zip(doc.astype(int).tolist(), code.tolist(), near.tolist(), strict=True):
                cells[d][c, s] = cells[d].get((c, s), 0) + 1
            held = [[{"code": int(c), "near": s, "hits": k} for (c, s), k in x.items()] for x in cells]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n.astype(np.int64)), pa.array(held, pa.list_(pa.struct([("code", pa.int32()), ("near", pa.float64()), ("hits", pa.int64())])))], names=["y", "n", "found"])

    rows = sample.select("text", "y").mapInArrow(run, "y int, n long, found array<struct<code: int, near: double, hits: bigint>>").collect()
    y, n = np.array([r["y"] for r in rows], float), np.array([r["n"] for r in rows], np.int64)
    flat = [(i, f["code"], f["near"], f["hits"]) for i, r in enumerate(rows) for f in r["found"]]
    doc, code, hits = (np.repeat(np.array([f[k] for f in flat], np.int64), [f[3] for f in flat]) if flat else np.zeros(0, np.int64) for k in (0, 1, 3))
    near = np.repeat(np.array([f[2] for f in flat], float), [f[3] for f in flat]) if flat else np.zeros(0)
    weight = np.zeros(4 * max(len(lexicon.terms), 1))
    words = [max(float(n[y == k].sum()), 1.0) for k in (0, 1)]
    count = [np.bincount(code[y[doc] == k], minlength=len(weight)).astype(float) for k in (0, 1)]
    expected = np.where(np.arange(len(weight)) % 4 == 0, 0.5, MISSPELLED * np.repeat(count[1][::4], 4))
    weight = np.clip(np.log((count[1] + expected + 1e-9) / words[1] * words[0] / (count[0] + 0.5)), 0, 6)
    weight[: 4 * len(own)] = np.maximum(weight[: 4 * len(own)], np.tile([5.0, 3.0, 2.0, 0.0], len(own)))
    model = Model(lexicon, weight, np.zeros(5), np.ones(5), np.array([-3.0, 1.2, 0, 0, 0.2, 0]), window)
    if len(size) == 2:
        x = model.features(n, doc, code, near)
        model.scale = np.maximum(x.std(axis=0), 1e-3)
        model.beta = logistic(x / model.scale, y)
        model.beta[0] += np.log(total[1] / total[0]) - np.log(size[1] / size[0])  # classes as common as they are, not as they were drawn
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **of_model) -> DataFrame:
    """(id_col, held_out, score, predicted, n_hits) of every row of docs.

    Labelled rows whose id's crc32 mod 5 is 0 are held out and never learnt from. Null labels and ids are not learnt from,
    of several labels for an id the largest counts, and copies of one text are learnt from once; null ids are scored and
    not held out. Without labels of both classes only ``seeds`` are found. Null texts count as empty; texts without words
    have the score of a text without hits. Of terms that fit a word equally well (ties) one counts. Repeated rows come
    repeated, an empty table gives no rows, texts may have any length, and further columns are left out.
    """
    model = learn(docs, labels, id_col, text_col, **of_model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, hits = model.score(_texts(batch.column(1))) if batch.num_rows else (np.zeros(0), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(hits.astype(np.int64))], names=["id", "score", "n_hits"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    scored = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double, n_hits long")
    return scored.select(F.col("id").alias(id_col), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
