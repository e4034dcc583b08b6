"""Cleaning a corpus for training: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns a DataFrame,
which is written as Parquet and read again as the next one's ``docs``. All but the last return the columns of
``docs``; extra columns pass through. Null and empty texts are kept until packing, where each is one token.
Repeated rows of one document stay or go together. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import decontam, neardup, packing, pii, toxicity
from kgspark.llm._shared import materialize

#: SQL cannot express the learned stage nor the tokenizer; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def by_id(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id, null included, is among ``found`` or not; no column's name can clash."""
    name = "id" + max(map(len, docs.columns)) * "_"
    ids = found.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(name)), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(5))
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return by_id(docs, neardup.near_duplicates(docs).where("kept"), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return by_id(docs, found.where("n_hit > 0"), "left_anti")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced; n_chars follows the text."""
    out = pii.sanitise(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece of a document, with its ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two of them the documents are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
