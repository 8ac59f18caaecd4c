"""Embeddings, LM scores, pieces, quality model, packing and SimHash: against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import embedding_dedup, masked_lm, packing, piece_transducer, quality_model, simhash
from strandline.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def find(links, ids):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(3, 3), (None, 5)]
    df = spark.createDataFrame(edges, "x long, y long")
    got = {r["node"]: r["component"] for r in connected_components(df, "x", "y").collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = find(real, {i for e in real for i in e})
    assert got == want
    assert connected_components(df.limit(0), "x", "y").count() == 0


def brute_embeddings(rows):
    ok = {}
    for i, v, label in rows:
        x = np.array([np.nan if c is None else c for c in v], float) if v is not None else np.zeros(0)
        if label is not None and x.size and np.isfinite(x).all() and x.any():
            ok[i] = (x / np.linalg.norm(x), label)
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= 0.93 - 1e-12]
    return links, find(links, [r[0] for r in rows])


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for c in range(40):
        base = rng.standard_normal(32)
        for _ in range(rng.integers(1, 6)):
            rows.append((n, [float(v) for v in base + 0.12 * rng.standard_normal(32)], c % 3))
            n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(4)] + [(n + 4, rows[0][1], 1), (n + 5, rows[0][1], None), (n + 6, None, 0), (n + 7, [0.0] * 32, 0), (n + 8, [None] + [1.0] * 31, 0), (n + 9, [float("inf")] * 32, 0), (n + 10, [], 0), (n + 11, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"code": F.lit(1), "rep": F.lit(2)})
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    links, component = brute_embeddings(rows)
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert set(got) == set(count)
    assert all(got[i]["n_links"] <= count[i] for i in count)  # nothing below the threshold
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * sum(count.values()) > 0
    assert sum(got[i]["component_id"] == component[i] for i in count) >= 0.95 * len(count)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_several_lengths(spark):
    """A longer vector takes no links from the others, and every length has its own links."""
    rng = np.random.default_rng(5)
    rows = []
    for size, groups in ((32, 60), (48, 40), (16, 20), (100, 1)):
        for c in range(groups):
            base = rng.standard_normal(size)
            rows += [(len(rows) + k, [float(v) for v in base + 0.1 * rng.standard_normal(size)], c % 3) for k in range(3 if groups > 1 else 1)]
    rows.append((len(rows), [*rows[0][1], 0.0], 0))  # like row 0, but longer
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    links, _ = brute_embeddings(rows)
    for size in (32, 48, 16):
        own = [r[0] for r in rows if len(r[1]) == size]
        want = 2 * sum(a in own for a, _ in links)
        assert 0.9 * want <= sum(got[i] for i in own) <= want and want >= len(own)
    assert got[len(rows) - 1] == got[len(rows) - 2] == 0


def clustered(rng, groups, size, dims, spread, mean=0.0):
    """Groups around directions of their own, with a part that all share."""
    shared = rng.standard_normal(dims)
    shared *= mean / np.linalg.norm(shared)
    rows = []
    for c in range(groups):
        base = rng.standard_normal(dims)
        base *= np.sqrt(1 - mean**2) / np.linalg.norm(base)
        for _ in range(size):
            off = rng.standard_normal(dims)
            rows.append((len(rows), [float(v) for v in shared + base + spread * off / np.linalg.norm(off)], c % 3))
    return rows


@pytest.mark.parametrize("mean", [0.0, 0.7, 0.9])
def test_embeddings_near_the_threshold(spark, mean):
    """Pairs at cosines of 0.93 to 0.96, also where vectors have a strong common direction: recall by tables, all of them without, in blocks."""
    rows = clustered(np.random.default_rng(7), 200, 3, 48, 0.24, mean)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    links, component = brute_embeddings([(i, np.array(v, np.float32).astype(float), label) for i, v, label in rows])
    count = Counter(x for p in links for x in p)
    assert len(links) > 300
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df).collect()}
    assert all(got[i] <= count[i] for i in got) and sum(got.values()) >= 0.95 * 2 * len(links)
    whole = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, recall=None, block=50).collect()}
    assert whole == {i: (count[i], component[i]) for i in component}


def test_embedding_comparisons_grow_slowly():
    """Vectors compared with each: four times the table makes less than 1.3 times as many, and all its buckets' pairs are counted."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((64_000, 64))
    per_vector = []
    for n in (4_000, 16_000, 64_000):
        one = embedding_dedup.coder(x[:4096], n, 0.93, 0.98)
        keys = one.keys(one.codes(x[:n]))
        counts = [np.unique(keys[:, t], return_counts=True)[1] for t in range(keys.shape[1])]
        per_vector.append(sum(float((c * (c - 1) / 2).sum()) for c in counts) / n)
        assert len(one.cuts) == keys.shape[1] > 1
    assert all(b < 1.3 * a for a, b in zip(per_vector, per_vector[1:]))


def test_embedding_blocks_and_sizes(spark):
    """A bucket that is cut into blocks gives the same rows; very large and very small components keep their direction."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal(24)
    rows = [(i, [float(v) for v in base + 0.1 * rng.standard_normal(24)], 0) for i in range(120)]
    rows += [(200 + i, [v * scale for v in rows[i][1]], 0) for i, scale in enumerate((1e200, 1e-200, 1e300))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = {i: (len(rows) - 1, 0) for i, *_ in rows}
    for block in (16, 2048):
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, block=block).collect()} == want
    twice = df.unionByName(df.where("vec_id < 5")).unionByName(df.where("vec_id = 3").withColumn("label", F.lit(1)))
    got = embedding_dedup.near_duplicates(twice.withColumns({"rep": F.lit(1), "n": F.lit(2), "key": F.lit("k")})).collect()
    assert len(got) == len(rows) + 6 and {r["component_id"] for r in got} == {0} and max(r["n_links"] for r in got) == len(rows) + 4


def test_embedding_query_recall(spark, tmp_path):
    """The table's vectors, which have no links, with near copies of every third among them."""
    rng = np.random.default_rng(9)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    for i, v, label in rows[::3]:
        for k in (1, 2):
            off = rng.standard_normal(len(v))
            rows.append((10_000 * k + i, [float(x) for x in np.array(v) + 0.27 * np.linalg.norm(v) * off / np.linalg.norm(off)], label))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.query(spark, str(tmp_path)).collect()}
    links, component = brute_embeddings([(i, np.array(v, np.float32).astype(float), label) for i, v, label in rows])
    count = Counter(x for p in links for x in p)
    assert len(got) == len(rows) and len(links) > 300
    assert all(n <= count[i] for i, (n, _) in got.items()) and sum(n for n, _ in got.values()) >= 0.97 * 2 * len(links)
    assert sum(got[i][1] == component[i] for i in component) >= 0.97 * len(rows)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in (None, "", " \n", "a", "A b c", "a b c d", "a b c d e a b c d", "É é x y z", "w " * 5000):
        assert simhash.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)


@pytest.mark.parametrize("seed", range(4))
def test_trie_links(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    keys = [int(b) for b in base]
    for b in base:
        for _ in range(rng.integers(0, 40)):
            x = int(b)
            for bit in rng.choice(51, rng.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            keys.append(x)
    keys = np.unique(np.array(keys, np.uint64))
    for front, budget in ((13, 4), (0, 3)):
        links = [(i, j) for i in range(len(keys)) for j in range(i) if int(keys[i] ^ keys[j]).bit_count() <= budget and (front == 0 or keys[i] >> np.uint64(64 - front) == keys[j] >> np.uint64(64 - front))]
        assert list(simhash.trie_links(keys, front, budget)) == list(find(links, range(len(keys))).values())


def test_simhash(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    texts = []
    for _ in range(25):
        words = [word() for _ in range(400)]
        texts.append(" ".join(words))
        for _ in range(3):
            w = list(words)
            w[rng.randrange(400)] = "changed"
            texts.append(" ".join(w))
    texts += [texts[0].upper(), None, "", "  ", "one two", "one two", "x " * 20_000]
    ids = [*range(len(texts) - 1), None]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumns({"fp": F.lit(1), "component_id": F.lit(2), "rep": F.lit(3)})
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fps = {i: plain_fingerprint(t) for i, t in zip(ids, texts, strict=True)}
    assert {i: g[0] for i, g in got.items()} == fps
    real = [i for i in ids if i is not None]
    want = find([(a, b) for a in real for b in real if a < b and (fps[a] ^ fps[b]).bit_count() <= 4], real)
    assert {i: got[i][1] for i in real} == want and len(set(want.values())) < len(real)
    assert got[None][1] is None
    same_id = spark.createDataFrame([(0, "Another text under an id that is there already, and a copy of nothing.")], "doc_id long, text string")
    twice = simhash.keep_one(df.select("doc_id", "text").unionByName(same_id))
    assert twice.where("doc_id = 0").count() == 2 and twice.count() == len(set(want.values())) + 2
    kept = simhash.keep_one(df.unionByName(df.where("doc_id < 3"))).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(want.values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("bits", "budget", "errors"), [(64, 4, 0), (64, 4, 1), (128, 23, 3)])
def test_crowded_nodes(spark, bits, budget, errors):
    """All rotations together find every link, and nodes that are split into node pairs give the same components."""
    rng = np.random.default_rng(11)
    keys = []
    for _ in range(12):
        x = int.from_bytes(rng.bytes(bits // 8), "big")
        for _ in range(40):
            y = x
            for bit in rng.choice(bits, rng.integers(0, budget + 1), replace=False):
                y ^= 1 << int(bit)
            keys.append(y)
            x = y if rng.random() < 0.3 else x
    keys = sorted(set(keys))
    rows = [(i, *(signed(k >> at & (1 << 64) - 1) for at in range(bits - 64, -1, -64))) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "rep long, fp long" + ", fp2 long" * (bits // 64 - 1))
    want = find([(i, j) for i in range(len(keys)) for j in range(i) if (keys[i] ^ keys[j]).bit_count() <= budget], range(len(keys)))
    assert len(set(want.values())) > 10
    for crowd in (1 << 20, 20):
        got = {r["node"]: r["component"] for r in connected_components(simhash.fingerprint_links(df, budget=budget, errors=errors, crowd=crowd), "a", "b").collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_rotations():
    """Whatever bits differ, some rotation has its front equal and few enough of them in its block."""
    rng = np.random.default_rng(4)
    for bits, budget, errors in ((64, 4, 0), (64, 9, 2), (128, 23, 3)):
        plan = simhash.rotations(bits, budget, errors)
        assert all(part > 3 for _, _, _, part, _ in plan)
        for _ in range(300):
            off = rng.choice(bits, budget, replace=False)
            word, at = off // 64, off % 64
            assert any(((word == w) & (at >= lo) & (at < lo + size)).sum() <= errors and not ((word == w) & (at >= first) & (at < first + part)).any() for w, lo, first, part, size in plan)


def test_trie_of_one_value():
    """Keys that are all equal and told apart by the second word only."""
    rng = np.random.default_rng(1)
    keys, rest = np.zeros(3000, np.uint64), rng.integers(0, 1 << 20, 3000, dtype=np.uint64)
    up = simhash.trie_links(keys, 5, 3, 1, 20, rest)
    near = np.bitwise_count(rest[:, None] ^ rest[None, :]) <= 3
    assert list(up) == list(find(list(zip(*np.nonzero(near), strict=True)), range(3000)).values())


def test_simhash_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    want = find([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4], fps)
    assert {r["doc_id"]: r["component_id"] for r in simhash.query(spark, SF).collect()} == want


def test_packing_places(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    texts |= {9001: None, 9002: "", 9003: "漢字 <|endoftext|> ​😀", 9004: "long word " * 5000, 9005: texts[0], 9006: "a b\x1cc\x85d"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"length": F.lit("x"), "offset": F.lit(1)})
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    rows = packing.pack_documents(df).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        own = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, ids in want.items():
        p = sorted(by_doc[i])
        assert [x[0] for x in p] == list(range(-(-len(ids) // 2048))) and sum(x[2] for x in p) == len(ids)
        assert all(x[2] == 2048 for x in p[1:])
    for places in by_seq.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    least = -(-sum(map(len, want.values())) // 2048)
    assert len(by_seq) <= least + 2
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_plain_texts_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    fast = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    plain = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)]]
    for _ in range(3000):
        t = "".join(rng.choice(plain if rng.random() < 0.5 else "ab 's\n\t 12.") for _ in range(rng.randrange(40)))
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids, repr(t)


def test_minimum_bin_slack_is_best_fit():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 400):
        lengths = rng.integers(1, 101, n)
        bins, offsets = packing.minimum_bin_slack(lengths, 100)
        used = np.bincount(bins, lengths, bins.max() + 1) if n else np.array([])
        assert (used <= 100).all() and len(used) <= -(-lengths.sum() // 100) + max(2, 0.1 * n)
    for _ in range(200):
        sizes = sorted({int(x) for x in rng.integers(1, 30, 5)}, reverse=True)
        counts = {s: int(rng.integers(0, 3)) for s in sizes}
        room = int(rng.integers(0, 60))
        sums = {0}
        for s in sizes:
            for _ in range(counts[s]):
                sums |= {x + s for x in sums if x + s <= room}
        chosen = packing.fullest(sizes, counts, room)
        assert sum(chosen) == max(sums) and all(chosen.count(s) <= counts[s] for s in sizes)


def test_pack_keeps_strange_lengths(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (3, 0, None), (4, 3000, "d"), (5, 2043, "e"), (5, 2043, "e")], "k long, length long, sequence_id string")
    got = [(r["k"], r["sequence_id"] is None) for r in packing.pack(df).collect()]
    assert sorted(got) == [(1, False), (2, True), (3, True), (4, True), (5, False), (5, False)]


@pytest.fixture(scope="module")
def model():
    return piece_transducer.load()


def test_pieces_are_those_of_the_library(model):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    letters = " ▁abcdeethinou\nÀé€😀\t\x00<0x0A><s>漢字.,12 "
    pieces = [p.replace("▁", " ") for p in model.pieces[300:]]
    texts = ["", " ", *(" " * n + "x" for n in range(40)), *(" " * n for n in range(40)), "word " * 3000, "a" * 2000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))) for _ in range(3000)]
    for t in texts:
        ids = model.encode(t)
        assert ids == sp.encode(t), repr(t)
        assert model.decode(ids) == t.replace("▁", " ")


def test_long_words_take_linear_time(model):
    """Words of up to a million characters without a break, against the library; four times the length takes about four times as long."""
    import time

    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(8)
    for make in (lambda n: "ab" * (n // 2), lambda n: "".join(rng.choices("abcdefghij", k=n))):
        seconds = []
        for n in (250_000, 1_000_000):
            t = make(n)
            start = time.perf_counter()
            ids = model.encode(t)
            seconds.append(time.perf_counter() - start)
            assert ids == sp.encode(t)
        assert seconds[1] < 8 * seconds[0] + 1


def test_normaliser():
    import itertools
    import re

    for prefix, squeeze, escape in itertools.product([False, True], repeat=3):
        normalise = piece_transducer.Normaliser(prefix, squeeze, escape)
        for t in ("", " ", "   ", "a", " a", "a  b ", "  a b   c  ", "é\t \n  x"):
            want = re.sub(" +", " ", t).strip(" ") if squeeze else t
            want = " " + want if prefix and want else want
            assert normalise(t) == (want.replace(" ", "▁") if escape else want)


def test_remembered_bytes_are_bounded(model):
    import pickle

    fresh = piece_transducer.PieceTransducer(model.model)
    fresh.room = 5000
    words = [f"word{i}" for i in range(500)]
    assert fresh.encode(" ".join(words)) == model.encode(" ".join(words)) and len(fresh.latest) + len(fresh.chunks) < 30
    assert pickle.loads(pickle.dumps(model)) is model


def test_unigram_shortest_path(model):
    """A small unigram model: the shortest path against all segmentations."""
    import itertools
    import struct

    def field(n, kind, data):
        return bytes([n << 3 | kind]) + (bytes([len(data)]) if kind == 2 else b"") + data

    scores = {"<unk>": 0.0, "▁": -2.0, "a": -1.5, "b": -1.7, "ab": -2.1, "▁a": -2.2, "ba": -3.0, "aba": -3.3}
    proto = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([2 if p == "<unk>" else 1]))) for p, s in scores.items())
    m = piece_transducer.PieceTransducer(proto + field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00")))
    assert m.kind == piece_transducer.UNIGRAM
    for t in ("", "a", "abab", "aba ab", "bbaab"):
        text = m.normalise(t)
        best = None
        for cuts in itertools.product([0, 1], repeat=max(len(text) - 1, 0)):
            parts, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(text[at:i])
                    at = i
            parts.append(text[at:])
            if text and all(p in scores for p in parts):
                cost = -sum(struct.unpack("<f", struct.pack("<f", scores[p]))[0] for p in parts)
                best = cost if best is None else min(best, cost)
        got = -sum(m.scores[i] for i in m.encode(t))
        assert got == pytest.approx(best or 0)
        assert m.decode(m.encode(t)) == t
    assert m.encode("c") == [1, 0]


def test_pieces_round_trip(spark):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in piece_transducer.query(spark, SF).collect()}
    for i, t in texts.items():
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and got[i]["n_ids"] == len(got[i]["ids"])
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x y")], "doc_id long, text string").withColumns({"ids": F.lit(1), "decoded": F.lit("q")})
    rows = {r["doc_id"]: r for r in piece_transducer.decode(piece_transducer.encode(odd)).collect()}
    assert rows[1]["ids"] == rows[2]["ids"] == [] and rows[1]["decoded"] == "" and rows[None]["decoded"] == "x y"
    assert piece_transducer.encode(odd.limit(0)).count() == 0
    none = spark.createDataFrame([(None,), ([1],)], "ids array<int>")
    assert [r["decoded"] for r in piece_transducer.decode(none).collect()] == [None, ""]


def test_packing_deals_repeated_rows(spark):
    """Copies of one row without an id don't fall into one pool."""
    df = spark.createDataFrame([(None, "one text of some words")] * 600, "doc_id long, text string").repartition(3)
    rows = packing.pack_documents(df, pool=100).collect()
    assert len(rows) == 600 and "__salt" not in rows[0]
    pools = Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(pools) == 6 and max(pools.values()) < 200


def test_quality_model_is_additive_with_pairs():
    rng = np.random.default_rng(9)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # an interaction that no single feature shows
    model = quality_model.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    again = np.full(5, model.base)
    for f in range(4):
        again += [model.tables[f][np.searchsorted(model.edges[f], v, "left")] for v in x[:5, f]]
    for (f, g), t in zip(model.pairs, model.pair_tables, strict=True):
        again += [t[np.searchsorted(model.coarse[f], r[f], "left"), np.searchsorted(model.coarse[g], r[g], "left")] for r in x[:5]]
    assert np.allclose(model.score(x[:5]), 1 / (1 + np.exp(-again)))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality_model.query(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 1000
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [i for i in labels if i in got and got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labels[i] for i in held) >= 0.9 * len(held)


def _plain_features(text):
    """FEATURES from the characters of a text, counted one by one."""
    raw = (text or "").encode()
    words, word = [], b""
    for c in raw + b" ":
        if c in b" \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = b""
        else:
            word += bytes([c])
    n, size = max(len(words), 1), max(len(raw), 1)
    have = lambda chars: sum(raw.count(c) for c in chars)
    lines = [x for x in raw.split(b"\n") if any(c not in b" \t\n\x0b\x0c\r" for c in x)]
    upper, lower = (sum(a <= c <= b for c in raw) for a, b in (b"AZ", b"az"))
    repeats = sum(1 for k in range(1, len(words)) if words[k] == words[k - 1])
    most = max((words.count(w) for w in set(words)), default=0)
    return [
        np.log1p(len(words)), sum(len(w) for w in words) / n, have(b"#*$%&<>~^{}") / n, have(b"|") / n, have(b"!") / n, upper / max(upper + lower, 1), len(set(words)) / n, most / n, repeats / n,
        sum(48 <= c <= 57 for c in raw) / size, have(b".,;:?") / n, len(words) / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), have(b" \t\n\x0b\x0c\r") / size, sum(c > 127 for c in raw) / size,
    ]


def _plain_tree(g, h, depth):
    """Values of bins under the best tree, by trying every split."""
    whole = sum(g) / (sum(h) + 1.0)
    best, at = sum(g) ** 2 / (sum(h) + 1.0), None
    for k in range(1, len(g)) if depth else ():
        gl, hl = sum(g[:k]), sum(h[:k])
        gr, hr = sum(g) - gl, sum(h) - hl
        gain = gl * gl / (hl + 1.0) + gr * gr / (hr + 1.0)
        if hl >= 1.0 and hr >= 1.0 and gain > best:
            best, at = gain, k
    return [whole] * len(g) if at is None else _plain_tree(g[:at], h[:at], depth - 1) + _plain_tree(g[at:], h[at:], depth - 1)


def _plain_grid(g, h):
    best, value = -1.0, None
    for k in range(1, len(g)):
        gain, rows = 0.0, []
        for part in (range(k), range(k, len(g))):
            gs, hs = ([sum(m[r][c] for r in part) for c in range(len(g[0]))] for m in (g, h))
            values = _plain_tree(gs, hs, 1)
            gain += sum(2 * a * v - (b + 1.0 / len(hs)) * v * v for a, b, v in zip(gs, hs, values))
            rows += [values] * len(part)
        if gain > best:
            best, value = gain, rows
    flat_g, flat_h = (sum(map(sum, m)) for m in (g, h))
    return value or [[flat_g / (flat_h + 1.0)] * len(g[0]) for _ in g]


def _plain_scores(x, learnt, y):
    """Scores of all rows of x by boosting on the learnt rows, bins and tables as plain lists."""

    def bins(k):
        edges = [sorted(set(np.quantile([x[i][f] for i in learnt], np.linspace(0, 1, k + 1)[1:-1]).tolist())) for f in range(15)]
        return [[sum(e < row[f] for e in edges[f]) for f in range(15)] for row in x], [len(e) + 1 for e in edges]

    (at, sizes), (low, few) = bins(32), bins(8)
    rate = min(max(sum(y) / len(y), 1e-3), 1 - 1e-3)
    z = [float(np.log(rate / (1 - rate)))] * len(x)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for _ in range(150):
        for f in range(15):
            g, h = [0.0] * sizes[f], [0.0] * sizes[f]
            for i, label in zip(learnt, y):
                p = sigmoid(z[i])
                g[at[i][f]] += label - p
                h[at[i][f]] += p * (1 - p)
            values = _plain_tree(g, h, 2)
            z = [v + 0.1 * values[at[i][f]] for i, v in enumerate(z)]

    def grid(f, k):
        g, h = ([[0.0] * few[k] for _ in range(few[f])] for _ in "gh")
        for i, label in zip(learnt, y):
            p = sigmoid(z[i])
            g[low[i][f]][low[i][k]] += label - p
            h[low[i][f]][low[i][k]] += p * (1 - p)
        return g, h, _plain_grid(g, h)

    gains = []
    for f in range(15):
        for k in range(f + 1, 15):
            g, h, v = grid(f, k)
            gains.append((sum(2 * a * w - b * w * w for rg, rh, rv in zip(g, h, v) for a, b, w in zip(rg, rh, rv)), f, k))
    pairs = [(f, k) for gain, f, k in sorted(gains, reverse=True)[:8] if gain > 0]
    for _ in range(40):
        for f, k in pairs:
            v = grid(f, k)[2]
            z = [w + 0.1 * v[low[i][f]][low[i][k]] for i, w in enumerate(z)]
    return [sigmoid(v) for v in z]


def test_quality_query_against_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] is not None}
    ids = sorted(docs)
    x = [_plain_features(docs[i]) for i in ids]
    learnt = [k for k, i in enumerate(ids) if i in labels and zlib.crc32(str(i).encode()) % 5]
    order = {r["id"]: k for k, r in enumerate(spark.createDataFrame([(ids[k],) for k in learnt], "id long").orderBy(F.xxhash64("id"), "id").collect())}
    learnt.sort(key=lambda k: order[ids[k]])
    want = dict(zip(ids, _plain_scores(x, learnt, [labels[ids[k]] for k in learnt])))
    got = {r["doc_id"]: r for r in quality_model.query(spark, sf).collect()}
    assert set(got) == set(want)
    for i in ids:
        assert abs(got[i]["score"] - want[i]) < 1e-6, i
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == int(want[i] >= 0.3)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "good text here. " * 9), (3, "good text here. " * 9), (None, "x"), (4, "z" * 200_000)], "doc_id long, text string").withColumns({"x": F.lit(1), "score": F.lit(2)})
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (3, 1), (3, 0)], "doc_id long, quality int")
    assert quality_model.classify(docs, labels).count() == 6
    none = quality_model.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_model.classify(docs.limit(0), labels).count() == 0


def test_lm_gradients():
    rng = np.random.default_rng(3)
    net = masked_lm.WindowNetwork(rng.random(64) * 10, classes=8, width=6)
    x = net.stream([rng.integers(1, 64, 30).astype(np.uint16), rng.integers(1, 64, 9).astype(np.uint16)])
    n, grads, ids = net.gradients(x)
    assert n == 39
    for name, grad in grads.items():
        at = (ids[3], 2) if name in ("left", "right") else tuple(k // 2 for k in net.p[name].shape)
        mine = grad[3, 2] if name in ("left", "right") else grad[at]
        old, e = net.p[name][at], np.float32(1e-2)
        loss = []
        for v in (old + e, old - e):
            net.p[name][at] = v
            loss.append(-net.log_probabilities(x).sum() / n)
        net.p[name][at] = old
        assert mine == pytest.approx((loss[0] - loss[1]) / (2 * e), abs=2e-3)


def test_lm_probabilities_sum_to_one():
    net = masked_lm.WindowNetwork(np.ones(16), classes=4, width=3)
    total = sum(np.exp(net.log_probabilities(np.array([0, 0, 5, 7, k, 3, 2, 0, 0]))[2]) for k in range(1, 16))
    zero = net._predict(np.array([0, 0, 5, 7, 0, 3, 2, 0, 0]))
    a, b = (z[2] - np.log(np.exp(z[2]).sum()) for z in zero[4:])
    assert total + np.exp(a[0] + b[0]) == pytest.approx(1, abs=1e-5)


def test_lm_prefers_order(spark):
    rng = random.Random(2)
    cycle = [f"w{i}" for i in range(12)]
    docs = []
    for i in range(300):
        s = rng.randrange(12)
        docs.append((i, " ".join(cycle[(s + k) % 12] for k in range(60))))
    shuffled = docs[0][1].split()
    rng.shuffle(shuffled)
    docs += [(1000, " ".join(shuffled)), (1001, None), (1002, ""), (None, "w1 w2"), (5, docs[5][1]), (1003, "w1 " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"tokens": F.lit(1), "score": F.lit(2)})
    got = {}
    for r in masked_lm.score(df, rounds=2).collect():
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["score"], r["mean_score"]))
    assert got[0][0][2] > got[1000][0][2] + 0.5
    assert got[1001] == got[1002] == [(0, 0.0, None)] and got[None][0][0] == 2 and len(got[5]) == 2
    assert got[5][0][1] == pytest.approx(got[5][1][1], rel=1e-4) and got[1003][0][0] == 20_000
    assert masked_lm.score(df.limit(0)).count() == 0


def test_lm_gibberish_is_less_likely(spark):
    """Rare words that share an id are told apart by their counts, and their probabilities are a distribution."""
    rng = random.Random(4)
    weights = [1 / (k + 10) for k in range(12_000)]
    texts = [" ".join(f"w{k}" for k in rng.choices(range(12_000), weights, k=120)) for _ in range(500)]
    texts += [" ".join(f"w{rng.randrange(3_900, 4_300)}" for _ in range(120)) for _ in range(20)]
    texts += [" ".join("".join(rng.choice("qxzjkv") for _ in range(9)) for _ in range(120)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["mean_score"] for r in masked_lm.score(df).collect()}
    assert max(got[i] for i in range(520, 540)) < min(got[i] for i in range(520))
    words, counts, counted = masked_lm.vocabulary(df)
    n = {bytes(r["word"]): r["n"] for r in counted.collect()}
    first = masked_lm.CLASSES**2 - masked_lm.HASHED
    shared = Counter()
    for w, k in n.items():
        if w not in words:
            shared[first + zlib.crc32(w) % masked_lm.HASHED] += k
    assert len(n) > len(words) and {i: counts[i] for i in range(first, len(counts)) if counts[i]} == shared
    tokens = masked_lm.token_ids(df, words)
    rare = {r["row"]: (r["log_count"], r["n_seen"]) for r in masked_lm.rare_counts(tokens, counted).collect()}
    for r in tokens.collect():
        own = Counter(w for w in texts[r["id"]].encode().split() if w not in words)
        assert r["n_rare"] == own.total()
        want = sum(k * (math.log(n[w] - k + masked_lm.UNSEEN) - math.log(masked_lm.UNSEEN)) for w, k in own.items() if n[w] > k)
        assert rare.get(r["row"], (0, 0)) == (pytest.approx(want), sum(k for w, k in own.items() if n[w] > k))


def plain_scores(texts, net, words, counts):
    """Every document's score, token by token, from the parameters of a fitted network."""
    p, w, size = net.p, net.window, net.classes
    n = Counter(x for t in texts.values() for x in (t or "").encode().split())
    first = size * size - masked_lm.HASHED
    share = (counts + 0.1).reshape(size, size)
    out = {}
    for i, t in texts.items():
        said = (t or "").encode().split()
        own = Counter(said)
        ids = [0] * w + [words.get(x) or first + zlib.crc32(x) % masked_lm.HASHED for x in said] + [0] * w
        total = 0.0
        for at in range(w, len(ids) - w):
            left, right = (p["left"][ids[at - k]] for k in range(1, w + 1)), (p["right"][ids[at + k]] for k in range(1, w + 1))
            h = np.tanh(sum(left) + sum(right) + p["bias"].astype(float))
            high, low = divmod(ids[at], size)
            a = h @ p["high"] + p["high_bias"]
            b = (h + p["of_class"][high]) @ p["low"] + np.log(share[high] / share[high].sum())
            total += a[high] - np.log(np.exp(a).sum()) + b[low] - np.log(np.exp(b).sum())
            x = said[at - w]
            if ids[at] >= first:
                total += math.log(n[x] - own[x] + masked_lm.UNSEEN) - math.log(max(counts[ids[at]], 1))
        out[i] = (len(said), total)
    return out


def test_lm_scores_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words, counts, _ = masked_lm.vocabulary(docs)
    net = masked_lm.fit(masked_lm.token_ids(docs, words), counts)
    fresh = masked_lm.WindowNetwork(counts)
    assert np.abs(net.p["left"] - fresh.p["left"]).max() > 0.05
    want = plain_scores({i: t for i, t in texts.items()}, net, words, counts)
    got = {r["doc_id"]: (r["n_tokens"], r["score"]) for r in masked_lm.query(spark, SF).collect()}
    assert set(got) == set(want)
    for i, (n, score) in want.items():
        assert got[i][0] == n and got[i][1] == pytest.approx(score, rel=2e-3, abs=0.05)


def test_lm_tells_documents_that_occur_twice(spark):
    """A model of the whole corpus: documents that are there twice score above others, by their own words."""
    rng = random.Random(12)
    weights = [1 / (k + 10) for k in range(60_000)]
    make = lambda: " ".join(f"w{k}" for k in rng.choices(range(60_000), weights, k=rng.randrange(80, 400)))
    texts = [make() for _ in range(900)]
    texts += texts[:60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in masked_lm.score(df).collect()}
    twice, once = {*range(60), *range(900, 960)}, range(60, 900)
    assert all(rows[i]["n_unseen"] == 0 for i in twice) and sum(rows[i]["n_unseen"] > 0 for i in once) >= 0.95 * len(once)
    bound = sorted(rows[i]["mean_score"] for i in once)[int(len(once) * 0.9)]
    assert sum(rows[i]["mean_score"] > bound for i in twice) >= 0.9 * len(twice)


def test_lm_average_is_by_touches(spark):
    """An embedding that one partition alone has met keeps all that it learnt there."""
    docs = [(i, "alpha beta gamma delta " * 60) for i in range(20)] + [(20 + i, "one two three four " * 60) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    words, counts, _ = masked_lm.vocabulary(df)
    tokens = masked_lm.token_ids(df, words)
    halves = tokens.repartitionByRange(2, "id")
    net, fresh = masked_lm.fit(halves, counts), masked_lm.WindowNetwork(counts)
    alone = masked_lm.fit(tokens.where("id < 20").coalesce(1), counts)
    at = words[b"alpha"]
    assert np.abs(net.p["left"][at] - fresh.p["left"][at]).max() > 0.9 * np.abs(alone.p["left"][at] - fresh.p["left"][at]).max() > 0
