"""Secret scans with corpus-wide ownership frequency.

Patterns give candidate spans in every text. The candidates' values are hashed and
the hashes counted over the whole corpus by distinct repositories and owners: a
value that many owners hold is a widely copied example, one that few hold looks
live. Base kinds (assign, access, hex) are always reported; opaque tokens are
reported as well where they are owner-specific.

Built-in functions only. Texts are read once and never shuffled by the scan; rows
that move hold hashes, owners and positions of candidates, counted before they
move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

# Kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
MIN_ASSIGN, MIN_ACCESS, MASK = 12, 18, "[REDACTED]"
#: Owners and repositories that a value may be in before it counts as a widely copied example.
MAX_OWNERS, MAX_REPOS = 2, 4


#: Elements of a block of a running sum.
BLOCK = 256


def _running(lengths: Column) -> Column:
    """Running sums of an array of longs, by blocks, so that what is appended one by one stays short."""
    empty = F.array().cast("array<bigint>")

    def appended(values: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
        return F.aggregate(values, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    inside = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: appended(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))

    def whole(blocks: Column) -> Column:
        before = appended(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return F.flatten(F.zip_with(blocks, F.concat(F.array(F.lit(0).cast("long")), F.slice(before, 1, F.size(before) - 1)), lambda b, o: F.transform(b, lambda v: v + o)))

    return F.transform(F.array(inside), whole)[0]


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value), in code points; value is the group's."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"), F.split(text, pattern, -1).alias("gaps"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def placed(f: Column) -> Column:
        lengths = F.zip_with(F.slice(f["gaps"], F.lit(1), F.size(f["whole"])), f["whole"], lambda gap, whole: (F.length(gap) + F.length(whole)).cast("long"))
        zipped = F.arrays_zip(_running(lengths).alias("end"), f["whole"].alias("whole"), f["value"].alias("value"))
        return F.transform(zipped, lambda x: F.struct((x["end"] - F.length(x["whole"])).alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    return F.when(text.rlike(pattern), F.transform(F.array(found), placed)[0]).otherwise(empty)


def candidates(text: Column) -> Column:
    """Array of (start, kind, end, value) of all kinds, by start and then kind (its place in KINDS).

    Opaque tokens need an upper-case and a lower-case letter and a digit and may not overlap a base span.
    """

    def of(kind: int, found: Column, keep) -> Column:
        return F.transform(F.filter(found, keep), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))

    base = F.concat(
        of(0, _matches(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= MIN_ASSIGN),
        of(1, _matches(text, ACCESS), lambda x: F.length(x["value"]) >= MIN_ACCESS),
        of(2, _matches(text, HEX), lambda x: F.length(x["value"]) >= 16),
    )
    opaque = of(3, _matches(text, OPAQUE), lambda x: x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]") & x["value"].rlike("[0-9]"))

    def both(p: Column) -> Column:
        more = F.filter(p["opaque"], lambda o: ~F.exists(p["base"], lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
        return F.sort_array(F.concat(p["base"], more))

    return F.transform(F.array(F.struct(base.alias("base"), opaque.alias("opaque"))), both)[0]


def found_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(doc_id, text_hash, owner, repo, spans) of every row, written to the shared folder; values are hashed."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    repo = F.xxhash64(*(docs[c] for c in repo_cols)) if repo_cols else F.lit(0).cast("long")
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("text_hash"), docs[owner_col].cast("string").alias("owner"), repo.alias("repo"), candidates(text).alias("spans"))
    hashed = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("hash")))
    return written(rows.withColumn("spans", hashed), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_docs, n_repos, n_owners) of every candidate value; rows without an owner count as one owner."""
    each = found.select("owner", "repo", F.explode(F.array_distinct(F.col("spans.hash"))).alias("hash")).groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = each.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_docs"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, **columns) -> DataFrame:
    """(doc_id, text_hash, spans) of every row: spans is an array of (start, kind, end, hash, n_docs, n_repos,
    n_owners, live), base spans always and opaque ones if live; live: held by at most max_owners owners
    in at most max_repos repositories.

    Null texts count as empty; texts may have any length and any number of spans. An empty table gives no rows. Rows with the same id and text have the same spans. Repeated rows count
    each in n_docs. Other columns are not read, nulls in them are values like any other.
    """
    found = found_in(docs, **columns)
    each = found.where(F.size("spans") > 0).select("doc_id", "text_hash", F.explode("spans").alias("x")).select("doc_id", "text_hash", "x.*")
    owned = written(ownership(found), "owned")  # read back, so that a hot value's side of the join can be split
    judged = each.join(owned, "hash").withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).where((F.col("kind") < 3) | F.col("live"))
    of = judged.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end", "hash", "n_docs", "n_repos", "n_owners", "live"))).alias("judged"))
    rows = found.select("doc_id", "text_hash")
    return rows.join(of, rows["doc_id"].eqNullSafe(of["doc_id"]) & (rows["text_hash"] == of["text_hash"]), "left").select(
        rows["doc_id"], rows["text_hash"], F.coalesce("judged", F.array().cast(of.schema["judged"].dataType)).alias("spans")
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = MASK, **rest) -> DataFrame:
    """docs with every live span replaced by mask; spans of widely copied examples stay."""
    spans = scan(docs, id_col=id_col, text_col=text_col, **rest)
    live = spans.select("doc_id", "text_hash", F.filter("spans", lambda x: x["live"]).alias("live")).where(F.size("live") > 0).dropDuplicates(["doc_id", "text_hash"])
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keyed = docs.withColumn("__hash", F.xxhash64(text))
    joined = keyed.join(live, keyed[id_col].eqNullSafe(live["doc_id"]) & (keyed["__hash"] == live["text_hash"]), "left").select(*(keyed[c] for c in docs.columns), live["live"].alias("__live"))
    whole = F.col(text_col).cast("string")

    def step(acc: Column, x: Column) -> Column:  # overlapping spans are masked once
        gap = F.when(x["start"] >= acc["at"], F.concat(F.substr(whole, acc["at"].cast("int") + 1, (x["start"] - acc["at"]).cast("int")), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    masked = F.aggregate("__live", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(whole, acc["at"].cast("int") + 1)))
    return joined.withColumn(text_col, F.when(F.col("__live").isNull(), F.col(text_col)).otherwise(masked)).drop("__live")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    kinds = F.array(*map(F.lit, KINDS))
    base = F.filter("spans", lambda x: x["kind"] < 3)

    def count(keep) -> Column:
        return F.size(F.filter("spans", keep)).cast("long")

    def of_kind(k: int):
        return lambda x: x["kind"] == k

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")

    return scanned.select(
        "doc_id", *(count(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"), count(lambda x: ~x["live"]).alias("n_example"),
    )


def _sql_kind(k: int, pattern: str, group: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT r, {k} AS kind, place AS start, place + length(whole) AS "end", value FROM (
    SELECT r, whole, value, i, (sum(length(gap)) OVER o + sum(length(whole)) OVER o - length(whole))::BIGINT AS place FROM (
      SELECT r, unnest(whole) AS whole, unnest(value) AS value, unnest(gaps[1:len(whole)]) AS gap, unnest(range(len(whole))) AS i FROM (
        SELECT r, regexp_extract_all(text, '{p}') AS whole, regexp_extract_all(text, '{p}', {group}) AS value, regexp_split_to_array(text, '{p}') AS gaps FROM d WHERE regexp_matches(text, '{p}'))
    ) WINDOW o AS (PARTITION BY r ORDER BY i)
  ) WHERE {keep}"""


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source, lang FROM documents),
base AS ({" UNION ALL ".join([_sql_kind(0, ASSIGN, 2, f"length(value) >= {MIN_ASSIGN}"), _sql_kind(1, ACCESS, 0, f"length(value) >= {MIN_ACCESS}"), _sql_kind(2, HEX, 0, "true")])}),
opaque AS ({_sql_kind(3, OPAQUE, 0, "regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]')")}),
each AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM opaque o WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = o.r AND b.start < o."end" AND o.start < b."end")
), owners AS (
  SELECT value, count(DISTINCT coalesce('+' || source, '-')) <= {MAX_OWNERS} AND count(DISTINCT coalesce('+' || source, '-') || '/' || coalesce('+' || lang, '-')) <= {MAX_REPOS} AS live FROM each JOIN d USING (r) GROUP BY value
), judged AS (
  SELECT r, kind, start, live, ['{"', '".join(KINDS)}'][kind + 1] || ':' || start || ':' || "end" AS shown
  FROM each JOIN owners USING (value) WHERE kind < 3 OR live
)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(shown, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(shown, ',' ORDER BY start, kind), '') AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
FROM d LEFT JOIN judged USING (r) GROUP BY r, doc_id
"""
