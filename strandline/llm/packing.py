"""Best-fit packing by minimum bin slack.

Documents become token sequences of at most ``capacity`` ids. A bin starts with the
longest piece left; subset-sum dynamic programming over the lengths left, with a
bitset of reachable sums, finds the fullest feasible rest, and the combination is
removed. A combination is removed as often as its lengths allow at once, so a pool
of any size needs at most one dynamic programme per distinct length.

Pieces are dealt into pools by a hash, about ``pool`` documents each, and a pool is
packed in one task: no task grows with the corpus, and a pool wastes about one
sequence more than packing all at once would.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

CAPACITY = 2048
#: Texts of these characters alone are encoded by the faster library, which holds the same vocabulary;
#: both agree on them. All other texts, and those with a special token in them, go to ``tokenizers``.
PLAIN = r"[\t\n\r\x20-\x7e¡-ɏ]*"


def encoder(path: str, ranks_path: str | None):
    """A function from text to its ids as a uint32 array, as ``tokenizers`` gives them."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    fast, plain = None, re.compile(PLAIN)
    if ranks_path:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if fast and plain.fullmatch(text) and not any(s in text for s in special):
            return fast.encode_to_numpy(text)
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, tokenizer: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]): every row's ids and ``end_id``, cut into pieces.

    Sequences longer than ``capacity`` are cut, the first piece taking the remainder; null texts count
    as empty and give one piece of one id. ``tokenizer`` and ``ranks`` are paths of the vocabulary on
    the executors; by default those of the installed package of public tokenizers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = encoder(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), ranks or (None if tokenizer else public_tokenizers.path("byte_bpe_50k.tiktoken")))
        for batch in batches:
            of, piece, start, length, crc, all_ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)
                at, k = 0, 0
                while at < len(ids):
                    upto = at + capacity if k else (len(ids) - 1) % capacity + 1
                    own = ids[at:upto]
                    of.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(len(own))
                    crc.append(zlib.crc32(own.tobytes()))
                    if with_ids:
                        all_ids.append(own.astype(np.int32))
                    at, k = upto, k + 1
            cols = [batch.column(0).take(pa.array(of, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths, at most as many of each as counted, whose sum is the largest that fits into room."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for n in lengths:
        if n > room:
            continue
        for _ in range(min(counts[n], room // n)):
            more = (reach | (reach << n)) & mask
            if more == reach:
                break
            steps.append((n, reach))
            reach = more
        if reach >> room & 1:
            break
    left, chosen = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        if not before >> left & 1:
            chosen.append(n)
            left -= n
    return chosen


def minimum_bin_slack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """For lengths of 1 to capacity: the bin of each, numbered from 0, and its offset there."""
    order = np.argsort(-lengths, kind="stable")
    distinct, first, count = np.unique(-lengths[order], return_index=True, return_counts=True)
    sizes = (-distinct).tolist()
    counts, at = dict(zip(sizes, count.tolist(), strict=True)), dict(zip(sizes, first.tolist(), strict=True))
    bins, offsets, n_bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    while sizes:
        longest = sizes[0]
        counts[longest] -= 1
        combination = [longest, *fullest(sizes, counts, capacity - longest)]
        counts[longest] += 1
        need = {n: combination.count(n) for n in combination}
        times = min(counts[n] // k for n, k in need.items())
        offset = 0
        for n in combination:
            own = order[at[n] : at[n] + times]
            bins[own], offsets[own] = n_bins + np.arange(times), offset
            at[n] += times
            counts[n] -= times
            offset += n
        n_bins += times
        sizes = [n for n in sizes if counts[n]]
    return bins, offsets


def pack(items: DataFrame, length_col: str = "length", capacity: int = CAPACITY, pools: int = 1) -> DataFrame:
    """items with sequence_id and offset: every row's place in a sequence of at most ``capacity``.

    Rows are dealt into ``pools`` by a hash of all their columns that can be hashed. Rows whose length is
    null, below 1 or above the capacity get nulls. sequence_id and offset of items are replaced.
    """
    items = items.drop("sequence_id", "offset")
    keys = [c for c, kind in items.dtypes if "map" not in kind and "array" not in kind and "variant" not in kind]
    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    dealt = items.withColumn("__pool", F.pmod(F.xxhash64(*keys), F.lit(pools)))

    def run(t: pa.Table) -> pa.Table:
        pool = t.column("__pool")[0].as_py()
        lengths = t.column(length_col).fill_null(0).to_numpy().astype(np.int64)
        ok = (lengths >= 1) & (lengths <= capacity)
        bins, offsets = np.zeros(len(ok), np.int64), np.zeros(len(ok), np.int64)
        bins[ok], offsets[ok] = minimum_bin_slack(lengths[ok], capacity)
        return t.drop_columns("__pool").append_column("sequence_id", pa.array(bins + (pool << 32), mask=~ok)).append_column("offset", pa.array(offsets, mask=~ok))

    return dealt.groupBy("__pool").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, pool: int = 16384, **of_pieces) -> DataFrame:
    """Every piece of every document with its sequence_id and offset.

    ``pool``: about how many pieces are packed together; pieces that fill a sequence need no packing and get negative
    numbers. An empty table gives no rows; repeated rows are packed each for itself, dealt into pools by a number of
    their own; null ids are kept; pieces of one
    length (ties) may take each other's places. Texts may have any length.
    """
    salted = pieces(docs, id_col, text_col, capacity, **of_pieces).withColumn("__salt", F.monotonically_increasing_id())
    cut = written(salted, "pieces")  # the numbers are read back, never made again
    whole = cut.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = cut.where(F.col("length") < capacity)
    return pack(rest, "length", capacity, max(1, -(-rest.count() // pool))).unionByName(whole).drop("__salt")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
