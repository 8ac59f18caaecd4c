"""Quality rules: line-first cleaning with built-in functions only.

Every line is judged by itself (navigation, symbol litter, shouting, punctuation,
boilerplate, cut-off teasers, lines without a letter or digit); failing lines go, and a document that loses more
than half of its text with them goes too. Base rules on the whole text are a
minimum word count and a maximum share of words in repeated five-word windows.

All of it is one projection over each document: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, table

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST = 10, 20, 0.5
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
# What the line rules count or look for.
SEPARATORS = r"[|»›•·]"
LITTER = r"[#*$%&<>~^{}\\]"
PUNCTUATION = r"[.,;:!?()_=+/-]"
CUT_OFF = r"(\.\.\.|…)$"
BOILERPLATE = r"^(accept (all )?cookies|we use cookies|all rights reserved|skip to (main )?content|click here|read more|subscribe (now|to our newsletter)|share (this|on)|privacy policy|terms of (use|service)|sign in|log in|please enable javascript)\b.{0,60}$"
ASCII_UPPER_TO_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than the six white space characters."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of ``width`` words that occur twice or more, the first one included."""
    n = F.size(words)
    hashes = F.when(n >= width, F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(width))))).otherwise(F.array().cast("array<bigint>"))

    def covered(hashed: Column) -> Column:
        marked = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(marked, lambda m: F.filter(m, lambda x, k: (x["h"] == F.get(m, k - 1)["h"]) | F.coalesce(x["h"] == F.get(m, k + 1)["h"], F.lit(False))))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return _let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))), F.lit(0).cast("long"), lambda a, x: a + x))

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def line_fails(line: Column) -> Column:
    """A line, stripped and not empty, that is navigation, symbol litter, shouting, boilerplate, mostly punctuation or a teaser
    cut off after a few words, or has no letter or digit."""
    n = F.size(F.split(line, r"[\x20\x09-\x0D]+"))
    separators, litter, shouts, marks = (F.regexp_count(line, F.lit(p)) for p in (SEPARATORS, LITTER, "!", PUNCTUATION))
    return (
        ((separators >= 2) & (separators * 4 >= n))
        | ((litter >= 3) & (litter * 2 >= n))
        | ((shouts >= 4) & (shouts * 4 >= n))
        | ((marks >= 6) & (marks * 2 >= F.length(line)))
        | (line.rlike(CUT_OFF) & (n < 8))
        | F.translate(line, *ASCII_UPPER_TO_LOWER).rlike(BOILERPLATE)
        | ~line.rlike(r"[\p{L}\p{N}]")
    )


def judged(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, max_lost: float = MAX_LOST, name: str = "quality") -> DataFrame:
    """docs with one struct column, ``name``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_failed_lines, lost (share of the text's line characters), cleaned (text without failing
    lines), kept.

    Null texts count as empty; texts without words fail; texts may have any length. Repeated rows are judged each for
    itself, and an empty table gives no rows.
    A column of docs of that name is replaced.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))

    def of_lines(lines: Column) -> Column:
        judged = F.transform(lines, lambda x: _let(F.btrim(x, F.lit(SPACE_CHARS)), lambda s: F.struct(x.alias("line"), F.length(s).alias("n"), F.when(s == "", F.lit(False)).otherwise(line_fails(s)).alias("bad"))))

        def summed(j: Column) -> Column:
            total = F.aggregate(j, F.lit(0).cast("long"), lambda a, x: a + x["n"])
            bad = F.filter(j, lambda x: x["bad"])
            lost = F.aggregate(bad, F.lit(0).cast("long"), lambda a, x: a + x["n"])
            return F.struct(F.size(bad).cast("long").alias("n_failed_lines"), F.when(total > 0, lost / total).otherwise(F.lit(0.0)).alias("lost"), F.when(F.size(bad) == 0, F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(F.filter(j, lambda x: ~x["bad"]), lambda x: x["line"]), "\n")).alias("cleaned"))

        return _let(judged, summed)

    def with_words(lines: Column) -> Column:
        spoken = F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
        return F.struct(_let(spoken, lambda s: (F.size(s) - F.size(F.array_distinct(s))).cast("long")).alias("n_dup_lines"), of_lines(lines).alias("of"))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), repeated_words(words).alias("n_repeat_words"))

    parts = docs.withColumns({"__w": _let(words_of(text), of_words), "__l": _let(F.split(text, "\n"), with_words), "__s": F.regexp_count(text, F.lit(SYMBOLS)).cast("long")})
    base_failed = (F.col("__w.n_words") < min_words) | (100 * F.col("__w.n_repeat_words") > max_repeat_percent * F.col("__w.n_words"))
    fields = [F.col("__w.n_words"), F.col("__w.word_chars"), F.col("__s").alias("n_symbols"), F.col("__l.n_dup_lines"), F.col("__w.n_repeat_words"), base_failed.alias("base_failed"), F.col("__l.of.n_failed_lines"), F.col("__l.of.lost"), F.col("__l.of.cleaned"), (~base_failed & (F.col("__l.of.lost") <= max_lost)).alias("kept")]
    return parts.withColumn(name, F.struct(*fields)).drop("__w", "__l", "__s")


def clean(docs: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """The documents that pass, with all their columns; their texts lose the failing lines."""
    passed = judged(docs, text_col, name="__quality", **rules).where("__quality.kept")
    return passed.withColumn(text_col, F.col("__quality.cleaned")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = F.col("quality")
    return judged(docs).select("doc_id", *(q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")), q["n_failed_lines"].alias("n_failed_lines"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, unnest(list) AS word, unnest(range(len(list))) AS i
  FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS list FROM d)
), five AS (
  SELECT r, i, word, lead(word, 4) OVER o AS last,
         md5(concat_ws(chr(1), word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o)) AS h
  FROM w WINDOW o AS (PARTITION BY r ORDER BY i)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM five WHERE last IS NOT NULL) WHERE c >= 2
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range({WINDOW})) AS k) GROUP BY r
), counted AS (
  SELECT r, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY r
), l AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), s AS (
  SELECT r, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM l
), spoken AS (
  SELECT r, line, length(t) AS n,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words,
    len(regexp_extract_all(t, '{SEPARATORS}')) AS separators,
    len(regexp_extract_all(t, '{LITTER}')) AS litter,
    len(regexp_extract_all(t, '!')) AS shouts, len(regexp_extract_all(t, '{PUNCTUATION}')) AS marks, regexp_matches(t, '{CUT_OFF}') AS cut_off,
    regexp_matches(translate(t, '{ASCII_UPPER_TO_LOWER[0]}', '{ASCII_UPPER_TO_LOWER[1]}'), '{BOILERPLATE}') AS boilerplate,
    NOT regexp_matches(t, '[\p{{L}}\p{{N}}]') AS bare
  FROM s WHERE t <> ''
), rules AS (
  SELECT *, (separators >= 2 AND separators * 4 >= words) OR (litter >= 3 AND litter * 2 >= words) OR (shouts >= 4 AND shouts * 4 >= words) OR (marks >= 6 AND marks * 2 >= n) OR (cut_off AND words < 8) OR boilerplate OR bare AS bad FROM spoken
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS dup, sum(n) AS total, sum(CASE WHEN bad THEN n ELSE 0 END) AS lost, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS failed FROM rules GROUP BY r
), f AS (
  SELECT doc_id, coalesce(counted.n, 0) AS n_words, coalesce(chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    coalesce(lost, 0) AS lost, coalesce(total, 0) AS total, coalesce(failed, 0)::BIGINT AS n_failed_lines
  FROM d LEFT JOIN counted USING (r) LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  (n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words AND lost <= {MAX_LOST} * total) AS kept, n_failed_lines
FROM f
"""
