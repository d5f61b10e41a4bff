"""A corpus pipeline of the training-data operators.

Toxic documents go, one document of each group of near copies stays, passages
that occurred before are cut out, documents with benchmark passages go, and what
is left is encoded. Every stage is written as Parquet and read again.

Rows with null or empty texts are clean: they stay, and end with no ids. Extra
columns stay until the last stage, whatever their names: the operators only see the
id and the text beside columns with names of their own. SQL cannot express the stages; tests compare
the whole run with a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.llm import bpe, decontaminate, jaccard, suffixes, toxicity
from calltide.llm.common import table
from calltide.session import materialise

ORACLE_SQL = None

TOXIC = 0.7
NEAR_WORDS, NEAR_LEAST = 5, (80, 100)


def _bare(docs: DataFrame) -> DataFrame:
    """``docs`` with its other columns under names that no operator uses."""
    return docs.select(
        "doc_id", "text", *[F.col(f"`{c}`").alias(f"_kept_{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    )


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` of :func:`_bare` with the columns and names of ``docs``."""
    return rows.select(
        *[F.col(c if c in ("doc_id", "text") else f"_kept_{i}").alias(c) for i, c in enumerate(docs.columns)]
    )


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples do not call toxic."""
    bare = _bare(docs)
    model = toxicity.train(bare, table(spark, sf_dir, "labels"))
    scored = toxicity.score(bare, model, keep_text=True)
    return _named(scored.where(F.col("score") < TOXIC), docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by nearly equal shingle sets, the one with the smallest id."""
    rows = suffixes.numbered(_bare(docs))
    classes = jaccard.join(rows.select(F.col("_row").alias("doc_id"), "text"), NEAR_WORDS, NEAR_LEAST)
    others = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("_row"))
    return _named(rows.join(others, "_row", "left_anti"), docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without strings of 100 bytes that start earlier."""
    left = _named(suffixes.remove(_bare(docs), as_text=True), docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.matches(_bare(docs), table(spark, sf_dir, "benchmark"))
    return _named(found.where(F.size("hits") == 0), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    vocabulary = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.encode(docs.select("doc_id", "text"), *vocabulary, keep_text=True, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("decodes"),
    )


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("near_copies", one_of_near_copies),
    ("repeats", without_repeats),
    ("benchmark", without_benchmark),
    ("encode", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
