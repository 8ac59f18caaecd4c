"""Line deduplication over levelled sorted runs of line hashes.

A run holds line keys (128 bits of hash), each with the number of documents that had it
and the largest document id among them, when it was first seen. Runs are bucketed and
sorted by key, all alike, so that a merge join with a run shuffles nothing. Each batch of
documents is brought into the same form once; what no run knows, a chain of merge
anti-joins, becomes the batch's own run at level 0; the counts of keys that a run knows
are kept beside the runs. So a key is in one run only. When a level has ``fanout`` runs
they are merged into one of the next level, and a key is rewritten a logarithmic number
of times.

Only hashes, counts and positions are shuffled by line; texts move once, to meet
the positions they lose. Built-in functions only.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, delete, discard, new_path, table, written

MIN_DOCS, MIN_CHARS, BATCHES, FANOUT = 5, 40, 4, 3
KEY = ["h1", "h2"]


class LineRuns:
    """Levels of sorted runs in the shared folder; only their names are held here.

    A run is a table of the session's catalog, as only such tables have buckets; its files are in the shared folder.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.counts: list[DataFrame] = []
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame, name: str) -> str:
        """rows, which are dealt out by key, as a bucketed and sorted table: a bucket is in one task."""
        name = f"strandline_{name}_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, name)
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, self.paths.pop(name))

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.table(name).hint("merge")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows whose key no run has: a merge anti-join with every run."""
        return reduce(lambda rows, name: rows.join(self._read(name), KEY, "left_anti"), (n for level in self.levels for n in level), keys)

    def add(self, occurrences: DataFrame) -> None:
        """Adds a batch: occurrences has h1, h2, doc_id and ``first``, true once per document and key."""
        own = self._write(occurrences.where("first").groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")), "batch")
        if not self.levels:
            return self._file(own, 0)
        fresh = self._write(self.unseen(self._read(own)), "run")
        self.counts.append(written(self._read(own).join(self._read(fresh), KEY, "left_anti"), "known"))
        self._drop(own)
        self._file(fresh, 0)

    def _file(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(full), "run")
            self._drop(*full)
            self._file(merged, level + 1)

    def _merged(self, names: list[str]) -> DataFrame:
        """The rows of runs, which share no key, dealt out by key."""
        return reduce(DataFrame.unionByName, map(self.spark.read.table, names)).repartition(self.buckets, *KEY)

    def known(self, min_docs: int = 1) -> DataFrame | None:
        """(h1, h2, n_docs, last_doc) of every key in at least min_docs documents so far; None before the first batch."""
        later = None
        if self.counts:
            parts = reduce(DataFrame.unionByName, self.counts)
            later = self._write(parts.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc")), "known")

        def total(name: str) -> DataFrame:
            run = self._read(name)
            if later:
                more = self.spark.read.table(later).withColumnsRenamed({"n_docs": "__n", "last_doc": "__last"}).hint("merge")
                run = run.join(more, KEY, "left").select(*KEY, (F.col("n_docs") + F.coalesce("__n", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "__last").alias("last_doc"))
            return run.where(F.col("n_docs") >= min_docs)

        runs = [total(n) for level in self.levels for n in level]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def close(self) -> None:
        """Deletes all runs."""
        self._drop(*list(self.paths))
        discard(*self.counts)
        self.levels, self.counts = [], []


def line_key(line: Column) -> Column:
    """A line stripped of white space at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2, first) of every line whose key has at least min_chars code points."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.split(ascii_lower(text), "\n").alias("lines"))
    hashed = F.transform("lines", lambda x, i: F.transform(F.array(F.btrim(x, F.lit(SPACE_CHARS))), lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"), i.alias("pos"))))[0])
    ordered = rows.select("doc_id", "text_hash", F.sort_array(F.filter(hashed, lambda x: x.isNotNull())).alias("lines"))
    marked = F.transform(F.array("lines"), lambda s: F.transform(s, lambda x, k: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"), F.coalesce((F.get(s, k - 1)["h1"] != x["h1"]) | (F.get(s, k - 1)["h2"] != x["h2"]), F.lit(True)).alias("first"))))[0]
    return ordered.select("doc_id", "text_hash", F.explode(marked).alias("x")).select("doc_id", "text_hash", "x.pos", "x.h1", "x.h2", "x.first")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with its text replaced and a struct ``lines`` (n_lines, n_dropped).

    A key of at least min_chars code points that is in at least min_docs documents loses all its lines
    except in the document with the largest id that holds it. Every row is a document: repeated rows
    count each, and rows that tie for the largest id all keep it. Null texts are one empty line and become
    empty; a row with a null id loses its repeated lines unless no holder has an id. Texts may have any
    length. An empty table gives no rows. Ids may have any type with an order; a column of docs that is
    called lines is replaced.
    """
    spark = docs.sparkSession
    found = occurrences(docs, id_col, text_col, min_chars).withColumn("batch", F.pmod("text_hash", F.lit(batches)).cast("int"))
    path = new_path(spark, "lines")
    found.write.partitionBy("batch").parquet(path)
    seen = spark.read.schema(found.schema).parquet(path)
    runs = LineRuns(spark, fanout)
    try:
        for b in range(batches):
            runs.add(seen.where(F.col("batch") == b).drop("batch"))
        doomed = written(runs.known(min_docs), "doomed")
    finally:
        runs.close()
    lost = seen.join(doomed, KEY).where(~F.col("doc_id").eqNullSafe(F.col("last_doc"))).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("__lost"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keyed = docs.withColumns({"__id": docs[id_col], "__hash": F.xxhash64(text)})
    joined = keyed.join(lost, keyed["__id"].eqNullSafe(lost["doc_id"]) & (keyed["__hash"] == lost["text_hash"]), "left").select(*(keyed[c] for c in docs.columns if c != "lines"), "__lost")
    text = F.coalesce(joined[text_col].cast("string"), F.lit(""))

    def without(lines: Column) -> Column:
        keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__lost"))
        return F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")

    kept = F.when(F.col("__lost").isNull(), text).otherwise(F.transform(F.array(F.split(text, "\n")), without)[0])
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return joined.withColumns({text_col: kept, "lines": F.struct(n_lines.alias("n_lines"), F.coalesce(F.size("__lost"), F.lit(0)).cast("long").alias("n_dropped"))}).drop("__lost")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("lines.n_lines").alias("n_lines"), F.col("lines.n_dropped").alias("n_dropped"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), bad AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCS}
), m AS (
  SELECT r, line, i, bad.key IS NOT NULL AND k.doc_id IS DISTINCT FROM bad.last AS lost FROM k LEFT JOIN bad USING (key)
), t AS (
  SELECT r, count(*) AS n_lines, sum(lost::INT)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256 FROM m GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM d JOIN t USING (r)
"""
