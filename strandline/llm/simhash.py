"""SimHash near-duplicates: fingerprints linked by a binary trie self-join.

A fingerprint is 64 or 128 bits. It is cut into blocks so that two fingerprints within
``budget`` differing bits differ in at most ``errors`` bits of some block, and agree on
one of errors + 1 parts of that block. The trie is kept in as many rotations as there are
parts, each with its part in front and the rest of its block behind; a rotation's
self-join starts at the node pairs whose front is equal. From there node pairs are
traversed together: a pair of nodes (two ranges of the sorted fingerprints) is split bit
by bit into the pairs of its children, differing bits are added up, and a pair is dropped
as soon as it has more than ``errors`` in the block or more than ``budget`` in all. A pair
whose two nodes lie wholly in one component already is dropped too, since it can add no
link to the components; large groups of near copies cost their trie and not their pairs.

Spark deals the fronts out by a shuffle of distinct fingerprints; copies of a fingerprint
take part once. A front with too many fingerprints for a task is split into the node pairs
some bits further down, again and again until all fit. Each task returns a spanning forest
of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written
from .components import connected_components

#: Node pairs of a step of the traversal, the rest wait on a stack; and pairs of fingerprints that are compared at once.
CHUNK, COMPARED = 1 << 15, 1 << 18
#: Rows of a task that are traversed at once, and fingerprints of one front beyond which its node pairs are dealt out.
ROWS, CROWD = 1 << 16, 1 << 17
#: Node pairs with so few fingerprint pairs below are compared directly.
SMALL = 32
#: Bits by which a crowded node is split.
STEP = 4
#: Settings for texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Such fingerprints differ
#: in 19.4 of 128 bits on average; the budget leaves room for chance, so that few pairs are lost, and unlike texts (64 bits)
#: stay far off. Two errors in a block of 16 bits: 24 rotations with fronts of about five bits.
SIMILAR = {"width": 5, "bits": 128, "budget": 23, "errors": 2}


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Further hashes of hashes: multiplications and shifts of 64-bit words."""
    with np.errstate(over="ignore"):
        x = h + np.uint64((0x9E3779B97F4A7C15 * k) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint_words(text: bytes | None, width: int = 4, seed: int = 42, n_words: int = 1) -> list[int]:
    """SimHash of a text's word shingles, 64 bits a word; the first word is of XXH64 itself. No words: zero."""
    words = (text or b"").lower().split()  # of bytes: A-Z alone, and the six white space characters
    if not words:
        return [0] * n_words
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        joined, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[: 1 - width].tolist() if width > 1 else starts.tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(words) - width + 1)
    ones = np.zeros((n_words, 64), np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        for k in range(n_words):
            bits = np.unpackbits((_mixed(part, k) if k else part).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[k] += bits.sum(axis=0, dtype=np.int32)
    return [int.from_bytes(np.packbits(2 * one > len(hashes)).tobytes(), "big") for one in ones]


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    return fingerprint_words(text, width, seed)[0]


def _fp_columns(bits: int) -> list[str]:
    if bits not in (64, 128):
        raise ValueError("fingerprints have 64 or 128 bits")
    return ["fp", "fp2"][: bits // 64]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, bits: int = 64) -> DataFrame:
    """(id_col, text_hash, fp) of every row, with fp2 for 128 bits; fp is the fingerprint as a signed long. Null texts count as empty."""
    names = _fp_columns(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fps = np.array([fingerprint_words(t.as_py(), width, seed, len(names)) for t in texts], np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(fps[:, k].copy()) for k in range(len(names)))], names=["id", "text_hash", *names])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, f"id {kind}, text_hash long, " + ", ".join(f"{n} long" for n in names)).withColumnRenamed("id", id_col)


def _root(up: np.ndarray, x: np.ndarray) -> np.ndarray:
    y = up[x]
    while (up[y] != y).any():
        y = up[y]
    return y


def _union(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; up holds a smaller or equal member for each, and roots after it."""
    while len(a):
        a, b = _root(up, a), _root(up, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
    while (up[up] != up).any():
        up[:] = up[up]


def own_pairs(keys: np.ndarray, front: int) -> np.ndarray:
    """The node pairs a self-join starts at: every range of sorted keys with equal ``front`` leading bits, with itself."""
    heads = np.flatnonzero(np.concatenate(([True], np.diff(keys >> np.uint64(64 - front)) != 0))) if front else np.array([0])
    tails = np.append(heads[1:], len(keys))
    many = tails - heads > 1
    return np.stack([heads[many], tails[many], heads[many], tails[many], np.zeros(many.sum(), np.int64)]).astype(np.int32)


def trie_links(keys: np.ndarray, front: int, budget: int, errors: int = 0, block: int = 0, rest: np.ndarray | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """For sorted 64-bit keys, with the other words of the fingerprints in rest: the smallest index of each one's
    component under links of at most ``budget`` differing bits in all, between keys with equal ``front`` leading bits
    and at most ``errors`` differing bits among the leading ``block`` ones.

    start has other node pairs to begin at, as columns (range of one, range of the other, bits that differ before ``front``).
    """
    n = len(keys)
    up = np.arange(n, dtype=np.int32)
    if n < 2:
        return up
    zeros: dict[int, np.ndarray] = {}  # bit: how many keys before an index have it unset

    def zeros_of(bit: int) -> np.ndarray:
        if bit not in zeros:
            if len(zeros) > 16:
                zeros.clear()
            zeros[bit] = np.concatenate(([0], np.cumsum((keys >> np.uint64(63 - bit)) & np.uint64(1) == 0))).astype(np.int32)
        return zeros[bit]

    def compare(al: np.ndarray, bl: np.ndarray, nb: np.ndarray, sizes: np.ndarray) -> None:
        """All pairs below node pairs, as many node pairs at once as have COMPARED pairs below."""
        ends = np.cumsum(sizes, dtype=np.int64)
        lo = 0
        while lo < len(sizes):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + COMPARED, "right")))
            which = np.repeat(np.arange(lo, hi, dtype=np.int32), sizes[lo:hi])
            k = np.arange(len(which), dtype=np.int32) - np.repeat((ends[lo:hi] - sizes[lo:hi] - done).astype(np.int32), sizes[lo:hi])
            a, b = al[which] + k // nb[which], bl[which] + k % nb[which]
            differ = np.bitwise_count(keys[a] ^ keys[b])
            if rest is not None:
                differ = differ + np.bitwise_count(rest[a] ^ rest[b])
            near = (a < b) & (differ <= budget)
            if near.any():
                _union(up, a[near], b[near])
            lo = hi

    def push(bit: int, pairs: np.ndarray) -> None:
        stack.extend((bit, pairs[:, i : i + CHUNK].copy()) for i in range(0, pairs.shape[1], CHUNK))

    stack: list[tuple[int, np.ndarray]] = []
    push(front, own_pairs(keys, front) if start is None else start)
    while stack:
        bit, (al, ah, bl, bh, d) = stack.pop()
        change = np.concatenate(([0], np.cumsum(up[1:] != up[:-1], dtype=np.int32)))
        joined = (change[al] == change[ah - 1]) & (change[bl] == change[bh - 1]) & (up[al] == up[bl])
        na, nb = ah - al, bh - bl
        sizes = na.astype(np.int64) * nb
        few = ~joined & ((sizes <= SMALL) | (bit == 64))
        if bit == 64:  # keys of one value: they can be many only where rest tells them apart
            tall = few & (sizes > COMPARED)
            for i in np.flatnonzero(tall):
                for row in range(al[i], ah[i]):
                    compare(np.array([row], np.int32), bl[i : i + 1], nb[i : i + 1], nb[i : i + 1].astype(np.int64))
            few &= ~tall
        if few.any():
            compare(al[few], bl[few], nb[few], sizes[few])
        on = ~joined & (sizes > SMALL) if bit < 64 else np.zeros(len(al), bool)
        if not on.any():
            continue
        al, ah, bl, bh, d = al[on], ah[on], bl[on], bh[on], d[on]
        z = zeros_of(bit)
        am, bm = al + z[ah] - z[al], bl + z[bh] - z[bl]
        same = al == bl
        down = np.concatenate([
            np.stack([al, am, bl, bm, d]), np.stack([am, ah, bm, bh, d]),
            np.stack([al, am, bm, bh, d + 1]), np.stack([am, ah, bl, bm, d + 1])[:, ~same],
        ], axis=1)
        lone = (down[0] == down[2]) & (down[1] - down[0] < 2)
        most = min(errors, budget) if bit < block else budget
        down = down[:, (down[1] > down[0]) & (down[3] > down[2]) & (down[4] <= most) & ~lone]
        push(bit + 1, down[:, np.argsort(-down[4], kind="stable")])  # the nearest are on top of the stack
    return up


def _cuts(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    """(begin, length) of n parts of bits lo to hi."""
    edges = np.linspace(lo, hi, n + 1).round().astype(int).tolist()
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def rotations(bits: int, budget: int, errors: int) -> list[tuple[int, int, int, int, int]]:
    """(word, begin of block, begin of part, length of part, length of block) of every rotation."""
    n_blocks = -(-(budget + 1) // (errors + 1))
    per_word = -(-n_blocks // (bits // 64))
    out = []
    for word in range(bits // 64):
        for lo, size in _cuts(0, 64, per_word):
            out += [(word, lo, at, part, size) for at, part in _cuts(lo, lo + size, errors + 1)]
    return out


def _turned(x: Column, by: int) -> Column:
    by %= 64
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def _behind_part(x: Column, lo: int, at: int, part: int, size: int) -> Column:
    """The word with one part of a block in front, the block's other bits behind it, and the word's other bits behind these."""
    block = _turned(x, lo)  # the block is in front
    before = at - lo
    if not before:
        return block
    kept = F.shiftrightunsigned(F.shiftleft(block, size), size) if size < 64 else F.lit(0).cast("long")
    head = F.shiftleft(F.shiftrightunsigned(F.shiftleft(block, before), 64 - part), 64 - part)
    first = F.shiftleft(F.shiftrightunsigned(block, 64 - before), 64 - part - before)
    behind = size - before - part
    last = F.shiftleft(F.shiftrightunsigned(F.shiftleft(block, before + part), 64 - behind), 64 - size) if behind else F.lit(0).cast("long")
    return head.bitwiseOR(first).bitwiseOR(last).bitwiseOR(kept)


def dealt_keys(fps: DataFrame, rep: str, names: list[str], budget: int, errors: int) -> DataFrame:
    """(rep, node, key, rest): every fingerprint in every rotation; node is the rotation and the front, rest the other word."""
    turns = []
    for r, (word, lo, at, part, size) in enumerate(rotations(64 * len(names), budget, errors)):
        key = _behind_part(F.col(names[word]), lo, at, part, size)
        rest = F.col(names[1 - word]) if len(names) == 2 else F.lit(None).cast("long")
        turns.append(F.struct(F.shiftrightunsigned(key, 64 - part).bitwiseOR(F.lit(r).cast("long") * (1 << 40)).alias("node"), key.alias("key"), rest.alias("rest")))
    return fps.select(F.col(rep).alias("rep"), F.explode(F.array(*turns)).alias("t")).select("rep", "t.*")


def split_nodes(dealt: DataFrame, budget: int, errors: int, plan: list[tuple[int, int, int, int, int]], crowd: int, tables: list[DataFrame]) -> DataFrame:
    """dealt with path, side and err: nodes of over ``crowd`` fingerprints become the node pairs below them, until all fit.

    A path lists, for every STEP bits further down, which two children were taken; side says which of the two nodes
    a fingerprint is under (1 or 2; 0: the pair is a node with itself); err is how many bits the two differ in so far.
    Pairs with too many differing bits are left out. Written tables are added to ``tables``.
    """
    of_rotation = F.shiftright("node", 40).cast("int")
    part, block = (F.get(F.array(*(F.lit(p[k]) for p in plan)), of_rotation) for k in (3, 4))
    rows = dealt.withColumns({"path": F.lit(""), "side": F.lit(0), "err": F.lit(0)})
    fits = []
    for depth in range(64 // STEP):
        at = part + STEP * depth
        sizes = rows.groupBy("node", "path").agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi"))
        crowds = written(sizes.where((F.col("n") > crowd) & ((F.col("lo") == 0) | (F.col("lo") < F.col("hi"))) & (at + STEP <= 64)).select("node", "path", F.lit(True).alias("crowded")), "crowds")
        tables.append(crowds)
        if crowds.isEmpty():
            break
        marked = rows.join(crowds, ["node", "path"], "left").withColumn("at", at)
        fits.append(marked.where("crowded is null").select(*rows.columns))
        v, w = F.expr(f"cast(shiftrightunsigned(shiftleft(key, at), {64 - STEP}) as int)"), F.col("w")
        down = marked.where("crowded").withColumns({"v": v, "w": F.explode(F.sequence(F.lit(0), F.lit((1 << STEP) - 1)))})
        most = F.when(F.col("at") + STEP <= block, min(errors, budget)).otherwise(budget)
        down = down.withColumn("err", F.col("err") + F.bit_count(F.col("v").bitwiseXOR(w)).cast("int")).where(F.col("err") <= most)
        down = down.withColumn("side", F.when(F.col("side") > 0, F.col("side")).when(F.col("v") == w, 0).when(F.col("v") < w, 1).otherwise(2))
        pair = F.when(F.col("side") == 2, F.format_string("%x%x", w, "v")).otherwise(F.format_string("%x%x", "v", w))
        rows = written(down.withColumn("path", F.concat("path", pair)).select(*rows.columns), "nodes")
        tables.append(rows)
    for fit in fits:
        rows = rows.unionByName(fit)
    return rows


def fingerprint_links(fps: DataFrame, rep: str = "rep", budget: int = 4, errors: int = 0, crowd: int = CROWD, tables: list[DataFrame] | None = None) -> DataFrame:
    """(a, b): links between the rows of distinct fingerprints (fp and, for 128 bits, fp2), a spanning forest of those of each task.

    Tables that it writes on the way are added to ``tables``, for the caller to discard.
    """
    names = [n for n in ("fp", "fp2") if n in fps.columns]
    plan = rotations(64 * len(names), budget, errors)
    dealt = split_nodes(dealt_keys(fps, rep, names, budget, errors), budget, errors, plan, crowd, [] if tables is None else tables)
    dealt = dealt.select("node", "path", "side", "err", "rep", "key", "rest").repartition("node", "path").sortWithinPartitions("node", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
            node, side, err, key = (t.column(c).to_numpy() for c in ("node", "side", "err", "key"))
            other = t.column("rest").to_numpy().view(np.uint64) if len(names) == 2 else None
            path = np.array(t.column("path").to_pylist())
            kinds: list[tuple[int, str, np.ndarray]] = [(r, "", np.flatnonzero((node >> 40 == r) & (path == ""))) for r in np.unique(node[path == ""] >> 40).tolist()]
            kinds += [(n >> 40, p, np.flatnonzero((node == n) & (path == p))) for n, p in {(n, p) for n, p in zip(node[path != ""].tolist(), path[path != ""].tolist(), strict=True)}]
            for r, p, own in kinds:
                own = own[np.lexsort((key[own].view(np.uint64), side[own]))]
                keys, rest = key[own].view(np.uint64), None if other is None else other[own]
                front = plan[r][3] + STEP * (len(p) // 2)
                start = None
                if p and side[own[-1]]:
                    second = int(np.searchsorted(side[own], 2))
                    if second in (0, len(own)):
                        continue  # nothing under the other node
                    start = np.array([[0], [second], [second], [len(own)], [err[own[0]]]], np.int32)
                up = trie_links(keys, front, budget, errors, plan[r][4], rest, start)
                linked = np.flatnonzero(up != np.arange(len(up)))
                if len(linked):
                    yield pa.RecordBatch.from_arrays([t.column("rep").take(pa.array(own[i])).combine_chunks() for i in (up[linked], linked)], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < ROWS:
                continue
            t = pa.Table.from_batches(held)
            last = (t.column("node").to_numpy() == t.column("node")[-1].as_py()) & pc.equal(t.column("path"), t.column("path")[-1]).to_numpy()
            cut = int(np.flatnonzero(~last)[-1] + 1) if not last.all() else 0
            if cut:
                yield from links(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows = t.num_rows - cut
        if rows:
            yield from links(pa.Table.from_batches(held))

    kind = fps.schema[rep].dataType.simpleString()
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, budget: int = 4, errors: int = 0, bits: int = 64) -> DataFrame:
    """(id_col, fingerprint, component_id, text_hash) of every row.

    component_id is the smallest id whose fingerprint is reachable by links of at most ``budget``
    bits. Null and empty texts have fingerprint zero, linked like any other; equal texts and
    repeated rows share theirs, so ties go to the smallest id. Texts may have any length. Rows with
    a null id are returned with the component of their fingerprint (null if nothing with an id is
    reachable). An empty table gives no rows; other columns are not read. ``errors`` changes how the
    trie is cut up, not the links.
    """
    names, tables = _fp_columns(bits), []
    fps = written(fingerprints(docs, id_col, text_col, width, seed, bits), "fingerprints")
    reps = fps.groupBy(*names).agg(F.min(id_col).alias("rep"))
    found = connected_components(fingerprint_links(reps.where("rep is not null"), budget=budget, errors=errors, tables=tables), "a", "b")
    discard(*tables)
    of = reps.join(found, reps["rep"] == found["node"], "left").select(*names, F.coalesce("component", "rep").alias("component_id"))
    shown = F.concat(*(F.lower(F.lpad(F.hex(n), 16, "0")) for n in names))
    return fps.join(of, names).select(id_col, shown.alias("fingerprint"), "component_id", "text_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rest) -> DataFrame:
    """docs with one document of each group of near duplicates: the one whose id is the group's component_id.

    Rows of one id are one document: of equal ones one stays, and if the document stays, all its different texts do.
    Rows with a null id stay where nothing with an id is in their group.
    """
    found = written(near_duplicates(docs, id_col, text_col, **rest).select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"), "component_id"), "groups")
    kept = found.where(F.col("__id").eqNullSafe(F.col("component_id"))).select("__id", "__hash").distinct()
    keyed = docs.withColumn("__text", F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    out = keyed.join(kept, keyed[id_col].eqNullSafe(kept["__id"]) & (keyed["__text"] == kept["__hash"]), "left_semi")
    repeated = found.where("__id is not null").groupBy("__id", "__hash").count().where("count > 1")
    if not repeated.isEmpty():
        out = out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, "__text"]).unionByName(out.where(F.col(id_col).isNull()))
    return out.drop("__text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
