"""Toxicity, periodic runs and divergences: against brute force, SQL and held-out labels."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import divergence_audit, periodic_runs, toxicity

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs


def plain_runs(w, repeats=4, least=6):
    """Every period word by word; the first period that gives a stretch is its smallest."""
    found, number = {}, {}
    w = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
    for p in range(1, len(w) // repeats + 1):
        edge = np.diff(np.concatenate([[0], (w[:-p] == w[p:]).view(np.int8), [0]]))
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if e + p - s >= max(least, repeats * p):
                found.setdefault((s, e + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_row(doc_id, text, plant=True):
    w = SPACE.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, runs and 1000 * best[1] // best[2] or None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_random_words():
    rng = np.random.default_rng(5)
    for k in range(1500):
        w = rng.integers(0, 1 + rng.integers(1, 4), rng.integers(0, 70))
        if k % 3 == 0:
            w = np.concatenate([w, np.tile(rng.integers(0, 3, rng.integers(1, 7)), rng.integers(3, 14)), w[::-1]])
        assert [tuple(r) for r in periodic_runs.find_runs(w).tolist()] == plain_runs(w.tolist())


def test_runs_survive_bad_hashes(monkeypatch):
    w = np.array([0, 1] * 30 + [2, 1, 0] * 9 + list(range(40)))
    want = plain_runs(w.tolist())
    real, calls = periodic_runs._Hashes.equal, []

    def lies(self, at, other, length):  # the first base takes everything for equal
        calls.append(1)
        return np.ones(len(at), bool) if len(calls) < 9 else real(self, at, other, length)

    monkeypatch.setattr(periodic_runs._Hashes, "equal", lies)
    assert [tuple(r) for r in periodic_runs.find_runs(w).tolist()] == want


def test_long_runs():
    for w in (np.zeros(50_000, np.int64), np.arange(120_000) % 30_000, np.arange(119_999) % 30_000):
        got = periodic_runs.find_runs(w).tolist()
        assert got == ([[0, len(w), 1]] if not w.any() else [[0, len(w), 30_000]] if len(w) >= 120_000 else [])


def test_periodic_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, periodic_runs.query(spark, SF).collect()))
    assert got == sorted(plain_row(r["doc_id"], r["text"]) for r in docs.collect())
    assert sum(r[1] for r in got) > 5


def test_periodic_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 9), (4, "x y " * 7), (4, "x y " * 7), (5, "a b c d e a b c d e a b c d e"), (6, "b b b b b b a a a a a a"), (7, ("ü ö " * 40_000).strip())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "n_runs": F.lit("x"), "id": F.lit(0)})
    got = sorted(map(tuple, periodic_runs.periodic_runs(df).collect()), key=repr)
    assert got == sorted((plain_row(i, t, plant=False) for i, t in rows), key=repr)
    out = {r["doc_id"]: r for r in periodic_runs.periodic_runs(df, with_text=True).collect()}
    assert out[6]["collapsed"] == "b a" and [tuple(r) for r in out[6]["runs"]] == [(0, 6, 1), (6, 6, 1)] and out[6]["start"] == 0
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


# --- divergences

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, least=10, top=10):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]
        groups[lang, source].update(terms)
        docs[lang].update(set(terms))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in docs.items()}
    whole = defaultdict(Counter)
    for (lang, _), c in groups.items():
        whole[lang].update(c)

    def shares(lang, c):
        total, v = sum(c[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept[lang]}

    out = []
    for (lang, source), c in groups.items():
        p, q = shares(lang, c), shares(lang, whole[lang])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        others = {s: shares(lang, o) for (x, s), o in groups.items() if x == lang and s != source}
        pairs = sorted(((-sum(f(p[t], o[t]) for t in p), s.encode()) for s, o in others.items()))
        out += [(lang, source, "pair", s.decode(), -v, i + 1) for i, (v, s) in enumerate(pairs)]
        terms = sorted((-f(p[t], q[t]), t.encode()) for t in p if c[t] and p[t] > q[t])[:top]
        out += [(lang, source, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms)]
    return sorted(out)


def test_divergence_sql(same_as_sql):
    same_as_sql(divergence_audit.query, divergence_audit.ORACLE_SQL)
    same_as_sql(divergence_audit.query, divergence_audit.ORACLE_SQL, "sf0.01")


def test_divergence_plain(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = ["The", "the", "é", "日本", "x1y", "a_b", "Straße", " ", "ZÜ", "w" * 300, "ab", "ba"]
    rows = [(["en", "de", None, ""][rng.integers(4)], ["s1", "s2", None, "", "é", "z"][rng.integers(6)], " ".join(rng.choice(vocabulary, rng.integers(0, 30)))) for _ in range(300)]
    rows += [("fr", "only", "un deux"), ("it", "a", None), ("it", "b", ""), ("xx", "hot", "word " * 50_000)] + [("en", "s1", "Copy copy")] * 12
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"docs": F.lit(1), "counts": F.lit(2), "term": F.lit(None), "n": F.lit(0)}).repartition(5)
    want = plain_audit(rows)
    assert sorted(map(tuple, divergence_audit.audit(df).collect())) == want
    monkeypatch.setattr(divergence_audit, "BLOCK", 7)  # many blocks
    assert sorted(map(tuple, divergence_audit.audit(df).collect())) == want
    assert divergence_audit.audit(df.limit(0)).count() == 0


def test_slices_and_collisions(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "bb", "Bb", "ccc", "é", "cab"], rng.integers(0, 9))).encode() for _ in range(60)] + [b"", b"tail", b"joined"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for digest in (None, lambda x: len(x) % 2, lambda x: 7):  # hashes that collide, by length and in full
        if digest:
            monkeypatch.setattr(divergence_audit.xxhash, "xxh3_64_intdigest", digest)
        low, start, end, doc = divergence_audit.cut(data, offsets)
        number, terms = divergence_audit.group(low, start, end)
        assert [(d, terms[i]) for d, i in zip(doc.tolist(), number.tolist(), strict=True)] == [(d, w) for d, t in enumerate(texts) for w in t.lower().split()]


def test_flushes(monkeypatch):
    held = divergence_audit._Gathered()
    assert list(held.rows()) == []
    big = 5 * 10**12  # beyond what one 64-bit product would hold
    assert divergence_audit.share(np.array([big]), np.array([2 * big]), 10)[0] == 1 + 10**9 * (big + 2) // (2 * big + 20)


# --- toxicity


def edits_to(term, word):
    """Edits that turn the term into each beginning of the word; swaps of neighbours count one."""
    d = np.zeros((len(term) + 1, len(word) + 1), int)
    d[:, 0], d[0] = range(len(term) + 1), range(len(word) + 1)
    for i, a in enumerate(term, 1):
        for j, b in enumerate(word, 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a != b))
            if i > 1 and j > 1 and a == word[j - 2] and term[i - 2] == b:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[-1]


def test_automaton():
    lexicon = toxicity.Lexicon(["rotter", "gobshite", "oaf", "babab", "abcabcabcd", "knave"], [False, False, False, False, False, True])
    rng, words = np.random.default_rng(6), []
    for _ in range(2500):
        t = list(lexicon.terms[rng.integers(6)])
        for _ in range(rng.integers(0, 4)):
            i, c = int(rng.integers(0, len(t) + 1)), "abcdekt"[rng.integers(7)]
            t[i:i] = [c] if rng.random() < 0.3 else []
            i = int(rng.integers(0, max(len(t), 1)))
            if rng.random() < 0.3:
                t[i : i + 1] = []
            elif rng.random() < 0.5:
                t[i : i + 2] = t[i : i + 2][::-1]
        word = re.sub(r"(.)\1\1+", r"\1\1", "".join(t) + "st" * int(rng.integers(2)))
        words += [word] if word else []
    found, code = lexicon.find(toxicity.words_of([" ".join(words)]))
    got = dict(zip(found.tolist(), (code & 3).tolist(), strict=True))
    for i, word in enumerate(words):
        fits = [e for t, term in enumerate(lexicon.terms) if (e := int((min if lexicon.stems[t] else lambda d: d[-1])(edits_to(term, word)))) <= lexicon.edits(t)]
        assert got.get(i) == min(fits, default=None), word
    assert 500 < len(got) < len(words)


def test_words():
    w = toxicity.words_of(["R0tt3r! l0$er", "", "sooooo\nÉté x1", "1a 22"])
    low = w.low.astype("<u2").tobytes().decode("utf-16-le")
    assert [(d, low[s:e]) for d, s, e in zip(w.doc.tolist(), w.start.tolist(), w.end.tolist(), strict=True)] == [(0, "rotter"), (0, "loser"), (2, "soo"), (2, "été"), (2, "x"), (3, "a")]
    assert w.before(1, 6) == "R0tt3r! " and w.after(0, 6) == "! l0$er" and w.before(2, 6) == "" and w.after(1, 3) == ""


def test_context():
    assert toxicity.context("you are a ", " indeed") == toxicity.ADDRESSED_
    assert toxicity.context("the word ", " is old") == toxicity.REPORTED_
    assert toxicity.context('he shouted "', '" there') == toxicity.QUOTED_ and toxicity.context('"yes" a ', ' "no"') == 1
    assert toxicity.context("das «", "» da") == toxicity.QUOTED_ and toxicity.context("»a« ", " x") == 1
    assert toxicity.context("", "") == 1


def labelled(spark, n=400):
    rng = np.random.default_rng(8)
    clean = ["".join(rng.choice(list("aeioumnrst"), rng.integers(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words, toxic = list(rng.choice(clean, 40)), int(i % 4 == 0)
        if toxic:
            for k in rng.integers(0, 40, 4):
                words[k] = ["gobshite", "knavery", "knavish", "rotter"][rng.integers(4)]
        rows.append((i, " ".join(words), "zz"))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_learns(spark):
    rows, labels = labelled(spark)
    base = rows[1][1]
    more = {1000: base + " a gobsihte", 1001: base + " r0tter", 1002: base + " knaverous rotterr", 1003: base, 1004: None, 1005: "", 1006: base + ' he said "rotter" once', 1007: (base + " ") * 3000 + "rotter gobshite " * 2000, 1008: "n" * 100_000}
    docs = spark.createDataFrame(rows + [(k, v, "zz") for k, v in more.items()] + [(None, base + " gobshite rotter", None), (1003, base, "again")], "doc_id long, text string, score string").withColumns({"y": F.lit(1), "h": F.lit(2)})
    table = spark.createDataFrame(labels + [(5, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    got = defaultdict(list)
    for r in toxicity.classify(docs, table).collect():
        got[r["doc_id"]].append(r)
    assert len(got) == len(rows) + len(more) + 1 and len(got[1003]) == 2
    wrong = [i for i, y in labels if got[i][0]["held_out"] and got[i][0]["predicted"] != y]
    assert not wrong and all(got[i][0]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    score = {k: v[0]["score"] for k, v in got.items()}
    assert min(score[k] for k in (1000, 1001, 1002)) > 5 * score[1003] and score[1007] > 0.5 and got[None][0]["predicted"] == 1 and not got[None][0]["held_out"]
    assert score[1004] == score[1005] and max(score[k] for k in (1003, 1004, 1008)) < 0.1
    assert score[1006] < score[1001]  # quotation counts for less
    assert toxicity.classify(docs.limit(0), table).count() == 0
    seeded = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, table.limit(0), seeds=("gobshite", "rotter")).collect()}
    assert seeded[None] > 0.5 > seeded[1003]


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_toxicity_query(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = toxicity.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    held = [(r["predicted"], r["toxic"]) for r in rows if r["held_out"] and r["toxic"] is not None]
    right = sum(p == y == 1 for p, y in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert right >= 0.7 * sum(y for _, y in held) and right >= 0.8 * sum(p for p, _ in held)


def test_toxicity_rows_are_the_models(spark):
    """The query's scores against a plain walk over words, edit distances and contexts with the same model."""
    docs, table = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(docs, table)
    got = {r["doc_id"]: (r["score"], r["n_hits"]) for r in toxicity.query(spark, SF).collect()}
    terms, stems = model.lexicon.terms, model.lexicon.stems
    assert terms
    known = {}
    for r in docs.orderBy("doc_id").limit(12).collect():
        w = toxicity.words_of([r["text"] or ""])
        low = w.low.astype("<u2").tobytes().decode("utf-16-le")
        total = heavy = hits = 0.0
        kinds = set()
        for i, (s, e) in enumerate(zip(w.start.tolist(), w.end.tolist(), strict=True)):
            word = low[s:e]
            if word not in known:
                fits = [(d, t) for t, term in enumerate(terms) if abs(len(term) - len(word)) <= 2 or stems[t] if (d := int((min if stems[t] else lambda x: x[-1])(edits_to(term, word)))) <= model.lexicon.edits(t)]
                known[word] = min(fits, default=None)
            if known[word]:
                d, t = known[word]
                x = model.weight[4 * t + d] * toxicity.context(w.before(i, 6), w.after(i, 6))
                total, heavy, hits = total + x, max(heavy, x), hits + 1
                kinds |= {t} if x >= 0.5 else set()
        share = 100 * total / max(len(w.start), 1)
        x = np.array([np.log1p(total), np.log1p(share), np.log1p(len(kinds)), heavy, np.log1p(total) * np.log1p(share)]) / model.scale
        want = 1 / (1 + np.exp(-(model.beta[0] + x @ model.beta[1:])))
        assert got[r["doc_id"]] == (pytest.approx(want, abs=1e-9), hits)
