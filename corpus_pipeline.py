"""From raw documents to packed token sequences, stage by stage.

Every stage reads what the one before it wrote. Stages but the last return the
columns of documents; where a stage changes a text it also sets n_chars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import line_dedup, packing, quality_rules, secrets, simhash
from strandline.llm.common import discard, new_path, scratch, table


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars as the text has it now."""
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that the rules reject go."""
    return _counted(quality_rules.clean(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in the last of them only."""
    return _counted(line_dedup.drop_repeated_lines(docs).select(*docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity 0.8 or more."""
    return simhash.keep_one(docs, **simhash.SIMILAR)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked in the texts."""
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near copies", near_copies),
    ("secret scan", secret_scan),
    ("packing", pack),
]
#: Tokenising has no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, path = docs, new_path(spark, name.replace(" ", "-"))
        with scratch(spark):  # a stage's own tables go when it is written
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        docs.written_to = path
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
