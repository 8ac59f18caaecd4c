"""The pipeline's rows against a plain version of its stages, and its stages one by one."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import quality_rules as Q
from strandline.llm import secrets as S
from strandline.llm import simhash

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\f\r"
LOWER = str.maketrans(Q.ASCII_UPPER_TO_LOWER[0], Q.ASCII_UPPER_TO_LOWER[1])


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def bad_line(s):
    n = len(words_of(s))
    separators, litter, shouts = len(re.findall(Q.SEPARATORS, s)), len(re.findall(Q.LITTER, s)), s.count("!")
    marks = len(re.findall(Q.PUNCTUATION, s))
    return (separators >= 2 and separators * 4 >= n) or (litter >= 3 and litter * 2 >= n) or (shouts >= 4 and shouts * 4 >= n) or (marks >= 6 and marks * 2 >= len(s)) or (n < 8 and bool(re.search(Q.CUT_OFF, s))) or bool(re.match(Q.BOILERPLATE, s.translate(LOWER))) or not re.search(r"[^\W_]", s)


def quality(docs):
    out = {}
    for i, (t, source, lang) in docs.items():
        w = words_of(t)
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [(x, x.strip(SPACE)) for x in t.split("\n")]
        total = sum(len(s) for _, s in lines)
        fails = [bool(s) and bad_line(s) for _, s in lines]
        lost = sum(len(s) for (_, s), f in zip(lines, fails, strict=True) if f)
        if len(w) >= 10 and 100 * len(hit) <= 20 * len(w) and lost <= 0.5 * total:
            out[i] = ("\n".join(x for (x, _), f in zip(lines, fails, strict=True) if not f), source, lang)
    return out


def lines(docs):
    holders = defaultdict(set)
    key = lambda x: x.strip(SPACE).translate(LOWER)
    for i, (t, *_) in docs.items():
        for x in t.split("\n"):
            holders[key(x)].add(i)
    return {i: ("\n".join(x for x in t.split("\n") if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and i != max(holders[key(x)]))), *rest) for i, (t, *rest) in docs.items()}


def second_word(h):
    """The splitmix generator's step from a hash."""
    m = (1 << 64) - 1
    h = (h + 0x9E3779B97F4A7C15) & m
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m
    h = (h ^ h >> 27) * 0x94D049BB133111EB & m
    return h ^ h >> 31


def near(docs):
    def fp(t):
        w = t.encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 5]), 42) for k in range(max(1, len(w) - 4))]
        h = [x << 64 | second_word(x) for x in h]
        return sum(1 << b for b in range(128) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {i: fp(t) for i, (t, *_) in docs.items()}
    up = {i: i for i in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 23:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: v for i, v in docs.items() if root(i) == i}


def secret(docs):
    found, owners, repos = {}, defaultdict(set), defaultdict(set)
    for i, (t, source, lang) in docs.items():
        spans = [(m.start(), m.end(), m[2]) for m in re.finditer(S.ASSIGN, t) if len(m[2]) >= 12]
        spans += [(m.start(), m.end(), m[0]) for m in re.finditer(S.ACCESS, t) if len(m[0]) >= 18]
        spans += [(m.start(), m.end(), m[0]) for m in re.finditer(S.HEX, t)]
        more = [(m.start(), m.end(), m[0]) for m in re.finditer(S.OPAQUE, t) if all(re.search(p, m[0]) for p in ("[A-Z]", "[a-z]", "[0-9]"))]
        spans += [o for o in more if not any(b[0] < o[1] and o[0] < b[1] for b in spans)]
        found[i] = spans
        for s in spans:
            owners[s[2]].add(source)
            repos[s[2]].add((source, lang))
    out = {}
    for i, (t, *rest) in docs.items():
        at, parts = 0, []
        for a, b in sorted((s[0], s[1]) for s in found[i] if len(owners[s[2]]) <= S.MAX_OWNERS and len(repos[s[2]]) <= S.MAX_REPOS):
            if a >= at:
                parts += [t[at:a], S.MASK]
            at = max(at, b)
        out[i] = ("".join(parts) + t[at:], *rest)
    return out


def test_pipeline_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: (r["text"] or "", r["source"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for stage in (quality, lines, near, secret):
        docs = stage(docs)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, (t, *_) in docs.items():
        ids, at, k = [*tok.encode(t, add_special_tokens=False).ids, 0], 0, 0
        while at < len(ids):
            upto = at + 2048 if k else (len(ids) - 1) % 2048 + 1
            want.add((i, k, at, upto - at, zlib.crc32(np.array(ids[at:upto], "<u4").tobytes())))
            at, k = upto, k + 1
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want) > 50
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 2048
    assert len(places) <= -(-sum(w[3] for w in want) // 2048) + 2


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stage_edges(spark, stage):
    line = "A passage that is long enough to be counted as shared by all."
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "x " * 30_000, "en", "s", 60_000)] + [(10 + i, f"{line}\nDocument {i} says something of its own about the matter {i * i} {'abc' * i} here.", "en", f"s{i}", 9) for i in range(6)] + [(12, "Same id, another text with quite a few more words in it than that.", "en", "s", 5), (None, "No id but enough words to be kept by all of the rules here.", "en", "s", 5)]
    rows += rows[4:6]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"quality": F.lit(1), "lines": F.lit(2), "live": F.lit(3), "fp": F.lit(4), "length": F.lit(5)})
    out = stage(spark, docs, SF)
    last = stage is corpus_pipeline.STAGES[-1][1]
    assert last or out.columns == docs.columns
    got = out.collect()
    assert got
    if not last:
        changed = [r for r in got if r["text"] is not None and r["n_chars"] is not None and r["n_chars"] != len(r["text"])]
        assert stage is corpus_pipeline.near_copies or not changed
        assert {r["quality"] for r in got} == {1}
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_copies_by_shingles(spark):
    """Of pairs with a Jaccard similarity of 0.8 or more few stay in different groups; unlike documents stay all."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    group = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, **simhash.SIMILAR).collect()}
    words = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :])
    alike = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in common.items()}
    near = [p for p, j in alike.items() if j >= 0.8]
    assert len(near) > 30 and sum(group[a] == group[b] for a, b in near) >= 0.95 * len(near)
    best = defaultdict(float)
    for (a, b), j in alike.items():
        best[a], best[b] = max(best[a], j), max(best[b], j)
    alone = [i for i in group if best[i] < 0.5]
    assert len(alone) > 500 and all(group[i] == i for i in alone)


def test_clean_documents_stay(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, SF).select("doc_id").collect()}
    failed = {r["doc_id"] for r in Q.judged(docs.select("doc_id", "text")).where("quality.base_failed").select("doc_id").collect()}
    clean = {i for i, q in labels.items() if q == 1} - failed
    assert len(clean & kept) >= 0.99 * len(clean)
    assert len({i for i, q in labels.items() if q == 0} & kept) <= 0.1 * len(labels)
