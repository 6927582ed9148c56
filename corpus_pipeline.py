"""A corpus pipeline of five operators: each stage reads what the one before it wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``, with ``n_chars`` kept up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, linededup, neardup, packing, pii
from tidemark.llm._scratch import cut, fresh

#: A document goes if it has no letters, or if no language reaches this probability.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled two thirds of the documents; drop those of no known language. Without
    any labelled row no language is known, and only documents without a letter go."""
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"), 3, 1)))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh(docs, "_lang", "_score")
    found = langid.identify(docs, model, out=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_length(linededup.line_dedup(docs))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.near_dedup(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_length(pii.pii(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Language probabilities, weighted samples, Feistel networks and tokens have no SQL form.
ORACLE_SQL = None


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
