"""SentencePiece encoding and decoding with a weighted finite-state transducer.

A model file is compiled into three parts that are composed with each input:

* the normaliser: states and arcs for the dummy prefix, repeated spaces that go, and
  spaces that become the mark that pieces use;
* the pieces: a tree over their characters, with one output arc per piece;
* byte fallback: an arc per character that no piece covers, writing its bytes.

Encoding is the shortest path in the tropical semiring over the positions of the
normalised text, one search for all models. A unigram model weights an arc by its
negative log probability. In a byte-pair model a state is a position and the piece that
ends there, and the weight of an arc is zero if merging by rank would leave the two pieces
side by side, and infinite otherwise. Exactly one path to every position is finite then,
the one that merging gives, so one predecessor per position is enough and the ids are
those of the reference encoder. Pieces are walked by index, so that the time is linear in
the text, whatever its words are like.

No piece reaches over the start of a run of spaces, nor, in many models, from a word
into punctuation, so texts are cut there and the chunks, mostly words, are looked
up among those a Python worker has met before, up to a bounded number of bytes.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What a worker remembers, which only saves work: bytes of words and other chunks, none of them longer than so many characters, and pairs of pieces.
REMEMBERED, LONGEST, PAIRS = 64 << 20, 64, 300_000
#: Classes of characters that the normaliser tells apart, and its states: before the text, after other characters, after a space.
SPACE, OTHER = 0, 1
BEFORE, INSIDE, AFTER = 0, 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in protocol buffer wire format."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[i : i + n]
            i += n


class Normaliser:
    """A transducer over two classes of characters: ``arcs`` has, per state and class, what is written and the next state.

    Written is, per arc, a text before the character and what the character becomes (None: itself). Spaces are written
    late where repeated ones go, with the next other character, so that none is left at the end.
    """

    def __init__(self, prefix: bool, squeeze: bool, escape: bool):
        space = MARK if escape else " "
        head = space if prefix else ""
        if squeeze:
            self.arcs = {
                (BEFORE, SPACE): ("", "", BEFORE), (BEFORE, OTHER): (head, None, INSIDE), (INSIDE, OTHER): ("", None, INSIDE),
                (INSIDE, SPACE): ("", "", AFTER), (AFTER, SPACE): ("", "", AFTER), (AFTER, OTHER): (space, None, INSIDE),
            }
        else:
            self.arcs = {(BEFORE, SPACE): (head, space, INSIDE), (BEFORE, OTHER): (head, None, INSIDE), (INSIDE, SPACE): ("", space, INSIDE), (INSIDE, OTHER): ("", None, INSIDE)}

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if AFTER not in {to for *_, to in self.arcs.values()}:  # behind the first arc there is one state, which writes a text for every character
            first, inside = self.arcs[BEFORE, SPACE if text[0] == " " else OTHER], self.arcs[INSIDE, SPACE]
            return first[0] + text.replace(" ", inside[1])
        state, out = BEFORE, []
        for run in re.findall(" +|[^ ]+", text):
            kind = SPACE if run[0] == " " else OTHER
            before, becomes, state = self.arcs[state, kind]
            out.append(before)
            if becomes is None:
                out.append(run)  # the state that it leads to has a loop that writes other characters as they are
        return "".join(out)


class PieceTransducer:
    """A compiled model: ``encode`` and ``decode`` single texts."""

    def __init__(self, model: bytes):
        self.model = model
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.unk = UNIGRAM, 0
        self.prefix, squeeze, escape = True, True, True
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("only models with the identity normaliser are compiled")
                self.prefix, squeeze, escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are compiled")
        self.normalise = Normaliser(self.prefix, squeeze, escape)
        text_ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.unk = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        shown = ("" if k == CONTROL else " ⁇ " if k == UNKNOWN else p.replace(MARK, " ") if escape else p for p, k in zip(self.pieces, self.kinds, strict=True))
        #: what each piece stands for when it is decoded
        self.written = [bytes([int(p[3:5], 16)]) if k == BYTE else t.encode("utf-8", "replace") for p, k, t in zip(self.pieces, self.kinds, shown, strict=True)]
        #: prefix of a piece -> the piece's id, or -1 where only longer pieces begin so
        self.arcs: dict[str, int] = {}
        #: the same as a tree: character -> (id or -1, the next characters)
        self.tree: dict[str, tuple[int, dict]] = {}
        for p, i in text_ids.items():
            for n in range(1, len(p)):
                self.arcs.setdefault(p[:n], -1)
            self.arcs[p] = i
        self.weights = [-s for s in self.scores] if self.kind == UNIGRAM else [0.0] * len(self.pieces)
        self.fallback = 10 - min(self.scores, default=0.0)
        if self.kind == BPE:
            inner = [p for p in text_ids if MARK in p[1:] and p.strip(MARK)]
            self.runs = {len(p): i for p, i in text_ids.items() if not p.strip(MARK)}
            low = min((self.scores[i] for p, i in text_ids.items() if len(p) > 1 and p.strip(MARK)), default=0.0)
            if inner or any(self.scores[i] > low for n, i in self.runs.items() if n > 1) or 1 not in self.runs:
                raise ValueError("byte-pair models need space runs as their last merges")
            #: merge order of each piece (single characters come first), and the pair it is merged from
            self.rank = [-s if len(p) > 1 else -1.0 for p, s in zip(self.pieces, self.scores, strict=True)]
            self.parts: dict[int, tuple[int, int] | None] = {}
            for p, i in text_ids.items():
                if len(p) > 1 and p.strip(MARK) and not self._parts_of(i):
                    self.arcs[p] = -1  # merging never makes it
        kids: dict[str, dict] = {"": self.tree}
        for p in sorted(self.arcs):
            kids[p] = {}
            kids[p[:-1]][p[-1]] = (self.arcs[p], kids[p])
        self.follows: dict[int, bool] = {}
        self.latest: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.room = REMEMBERED
        used = {chr(c) for c in range(128)}.union(*text_ids) - {MARK}
        signs = "".join(sorted(c for c in used if unicodedata.category(c)[0] in "PSZC" or unicodedata.category(c) == "No"))
        apart = not any((a in signs) != (b in signs) for p in text_ids for a, b in zip(p, p[1:]) if a != MARK)
        signs = re.escape(signs)
        #: chunks that no piece reaches across: runs of spaces with a word or, if pieces never mix them, with signs
        self.cut = re.compile(f"{MARK}*[^{MARK}{signs}]+|{MARK}*[{signs}]+|{MARK}+" if apart else f"{MARK}*[^{MARK}]+|{MARK}+")

    def __reduce__(self) -> tuple:
        return compiled, (self.model,)

    def _parts_of(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes piece; None for a character and for what merging never makes."""
        if piece not in self.parts:
            symbols = list(self.pieces[piece])
            made = None
            while len(symbols) > 1:
                best = None
                for i in range(len(symbols) - 1):
                    t = self.arcs.get(symbols[i] + symbols[i + 1], -1)
                    if t >= 0 and (best is None or self.rank[t] < best[0]):
                        best = (self.rank[t], i)
                if best is None:
                    made = None
                    break
                i = best[1]
                made = (symbols[i], symbols[i + 1])
                symbols[i : i + 2] = ["".join(made)]
            ids = [self.arcs.get(s, -1) for s in made or ()]
            self.parts[piece] = (ids[0], ids[1]) if made and min(ids) >= 0 else None
        return self.parts[piece]

    def may_follow(self, a: int, b: int) -> bool:
        """The two-piece constraint: whether merging the text of a and b leaves exactly a and b.

        Goes back in time from both pieces: while two parts lie side by side, their own merge must not
        have come before the merge that used one of them up.
        """
        key = a << 32 | b
        known = self.follows.get(key)
        if known is not None:
            return known
        until, ok = float("inf"), True
        while True:
            t = self.arcs.get(self.pieces[a] + self.pieces[b], -1)
            if t >= 0 and self.rank[t] < until:
                ok = False
                break
            pa_, pb = self._parts_of(a), self._parts_of(b)
            if pa_ and (self.rank[a] > self.rank[b] or not pb):
                until, a = self.rank[a], pa_[1]
            elif pb:  # at an equal rank the merge to the left comes first
                until, b = np.nextafter(self.rank[b], np.inf), pb[0]
            else:
                break
        if len(self.follows) < PAIRS:
            self.follows[key] = ok
        return ok

    def shortest(self, text: str) -> tuple[int, ...]:
        """Ids along the shortest path through a normalised text."""
        n, tree, weights, pairs = len(text), self.tree, self.weights, self.kind == BPE
        follows, never = self.follows, float("inf")
        cost, came, by = [0.0] + [never] * n, [0] * (n + 1), [-1] * (n + 1)
        for at in range(n):
            here, last, kids, to = cost[at], by[at], tree, at
            covered = False
            while to < n:
                node = kids.get(text[to])
                if node is None:
                    break
                piece, kids = node
                to += 1
                if piece < 0:
                    continue
                covered = covered or to == at + 1
                if here + weights[piece] < cost[to]:
                    if pairs and last >= 0:
                        ok = follows.get(last << 32 | piece)
                        if not (self.may_follow(last, piece) if ok is None else ok):
                            continue  # an infinite weight
                    cost[to], came[to], by[to] = here + weights[piece], at, piece
            if not covered and here + self.fallback < cost[at + 1]:
                cost[at + 1], came[at + 1], by[at + 1] = here + self.fallback, at, -1
        return self._back(text, came, by)

    def _back(self, text: str, came: list[int], by: list[int]) -> tuple[int, ...]:
        out: list[int] = []
        at = len(text)
        while at:
            if by[at] >= 0:
                out.append(by[at])
            elif self.bytes:
                out += [self.bytes[x] for x in reversed(text[came[at] : at].encode("utf-8", "replace"))]
            else:
                out.append(self.unk)
            at = came[at]
        return tuple(out[::-1])

    def _run(self, n: int) -> tuple[int, ...]:
        """Ids of n space marks: equal ranks, so the leftmost pair merges first."""
        held: list[int] = []
        for _ in range(n):
            held.append(1)
            while len(held) > 1 and held[-2] + held[-1] in self.runs:
                held[-2:] = [held[-2] + held[-1]]
        return tuple(self.runs[k] for k in held)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        bare = chunk.lstrip(MARK)
        n = len(chunk) - len(bare)
        if n < 2 and bare:
            return self.shortest(chunk)
        if not bare:
            return self._run(n)
        rest = self.shortest(MARK + bare)  # runs merge last: the mark before the word goes with it if it can
        return self._run(n) + rest[1:] if rest[0] == self.runs[1] else self._run(n - 1) + rest

    def encode(self, text: str) -> list[int]:
        return self.encode_array(text).tolist()

    def encode_array(self, text: str) -> np.ndarray:
        """Ids of a text, 32 bits each."""
        text = self.normalise(text)
        if self.kind != BPE:
            return np.array(self.shortest(text), "<i4")
        first, *words = text.split(MARK)
        if "" in words:
            return np.frombuffer(b"".join([self._cut_up(first), *self._with_runs(words)]), "<i4")
        found = list(map(self.latest.get, words))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            found[i] = self._word(words[i])
        return np.frombuffer(b"".join([self._cut_up(first), *found]), "<i4")

    def _with_runs(self, words: list[str]) -> Iterator[bytes]:
        run = 0
        for word in words:
            if not word:
                run += 1
            elif run:
                yield self._cut_up(MARK * (run + 1) + word)
                run = 0
            else:
                yield self._word(word)
        if run:
            yield _packed(self._run(run))

    def _word(self, word: str) -> bytes:
        """The packed ids of a mark and a word; the first ones met, common words among them, are remembered."""
        ids = self.latest.get(word)
        if ids is None:
            ids = self._cut_up(MARK + word)
            self._remember(self.latest, word, ids)
        return ids

    def _remember(self, held: dict[str, bytes], key: str, ids: bytes) -> None:
        if self.room > 0 and len(key) <= LONGEST:
            held[key] = ids
            self.room -= 200 + len(key) + len(ids)  # with what two objects and their places in the table take

    def _cut_up(self, text: str) -> bytes:
        """Packed ids of a run of marks and a word, chunk by chunk; a chunk that is a word is remembered as one."""
        found = self.cut.findall(text)
        if len(found) == 1:
            return _packed(self._chunk(text))
        out = []
        for chunk in found:
            held, key = (self.latest, chunk[1:]) if chunk[0] == MARK and chunk[1:2] != MARK else (self.chunks, chunk)
            ids = held.get(key)
            if ids is None:
                ids = _packed(self._chunk(chunk))
                self._remember(held, key, ids)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        return shown(b"".join(map(self.written.__getitem__, ids)), self.prefix)


def shown(written: bytes, prefix: bool) -> str:
    """The text of what pieces have written: without the dummy prefix."""
    text = written.decode("utf-8", "replace")
    return text[1:] if prefix and text.startswith(" ") else text


def _packed(ids: tuple[int, ...]) -> bytes:
    return array("i", ids).tobytes()


@lru_cache(maxsize=2)
def compiled(model: bytes) -> PieceTransducer:
    """The transducer of a model; a Python worker compiles it once, and its tasks share what it remembers."""
    return PieceTransducer(model)


def load(path: str | None = None) -> PieceTransducer:
    """Compiles a model file, by default the public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return compiled(f.read())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: PieceTransducer | None = None) -> DataFrame:
    """(id_col, ids) of every row.

    Null and empty texts have no ids; nulls in id_col are kept. Repeated rows come repeated; equal weights (ties) go to the
    longer last piece in a unigram model, and byte-pair models have none. Texts and words may have any length. An empty
    table gives no rows; other columns are not read.
    """
    transducer = model or load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [transducer.encode_array(t.as_py() or "") for t in part.column(1)]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate(ids) if ids else np.array([], np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "ids"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, ids_col: str = "ids", model: PieceTransducer | None = None) -> DataFrame:
    """rows with a column ``decoded``; null ids decode to null. A column of that name is replaced, an empty table gives no rows."""
    transducer = model or load()
    pieces, prefix = transducer.written, transducer.prefix  # all that tasks need
    rows = rows.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = pa.array(pieces, pa.large_binary())
        for batch in batches:
            column = batch.column(ids_col)
            ends = column.offsets.to_numpy()
            first = int(ends[0])
            taken = written.take(column.values.slice(first, int(ends[-1]) - first))  # all texts of the batch, one after the other
            places = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :]
            data = taken.buffers()[2]
            data = memoryview(data) if data is not None else memoryview(b"")
            cuts = places[ends - first].tolist() if len(taken) else [0] * len(ends)
            texts = [None if gone else shown(bytes(data[s:e]), prefix) for s, e, gone in zip(cuts, cuts[1:], column.is_null().to_pylist(), strict=False)]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the hash of the text they decode to."""
    model = load()
    rows = decode(encode(table(spark, sf_dir, "documents"), model=model), model=model)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
