"""A training-data pipeline over documents: each stage's result is written and read by the next.

toxicity drops documents with a score of 0.3 or more, language drops those without a language or
with a doubtful one, near_duplicates keeps one document of each group (five-word shingles,
likeness of 0.8 or more), mixing repeats or leaves out documents to meet the sources' targets,
and packing returns the pieces of the sequences.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm import language, mixing, packing, signature_join, toxicity
from vigilframe.llm.queries import TOKENIZER, TOXIC_FROM, table
from vigilframe.session import fresh_path

LANGUAGE_FROM = 0.5  # least confidence


def kept(docs: DataFrame, column, keep) -> DataFrame:
    """The rows of docs for which keep(column) holds, with their columns as they are."""
    name = "__judged"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    return docs.withColumn(name, column).where(keep(F.col(name))).drop(name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~language.in_fold(F.col("doc_id"), 4, 2))
    model = toxicity.learnt(docs, labels)
    return kept(docs, toxicity.score_of(F.col("text"), model, spark), lambda score: score < TOXIC_FROM)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.learnt(docs.where(F.col("doc_id").isNotNull() & ~language.in_fold(F.col("doc_id"), 5, 0)))
    guess = language.predicted(F.col("text"), model, spark)
    return kept(docs, guess, lambda p: (p["lang_pred"] != language.UNKNOWN) & (p["score"] >= LANGUAGE_FROM))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return signature_join.one_of_each(docs, width=5, num=8, den=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, weights=(1, 2, 3), most=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER, capacity=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# The stages learn models and hash shingles: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again.

    Texts that are null or have no letter have no language, so their rows go. Rows without an id stay if
    they are the only ones of their group, rows with a null source are a source of their own. An
    empty table gives no rows. Other columns, whatever their names, are carried along.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        gc.collect()  # lets the driver's JVM free the plans of frames that are out of reach
    return docs
