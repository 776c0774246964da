"""A corpus pipeline over ``documents``: toxicity, near duplicates, benchmark passages, secrets, SentencePiece ids.

In all stages null texts count as empty, very long texts are worked on whole,
rows that are repeated are judged alike, columns beside doc_id and text pass
through as they are, whatever their names, and an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import decontaminate, jaccard, piecefst, secrets, toxicity
from chronoloom.llm.common import documents, position, written
from chronoloom.llm.queries import PIECES, table, toxicity_model


def beside(docs: DataFrame, judged: Callable[[DataFrame, str], DataFrame], keep: str) -> DataFrame:
    """Rows of ``docs`` for which ``keep`` holds after ``judged`` added its columns; the columns of ``docs`` stay, even those with names like these."""
    plain = docs.toDF(*[f"given_{i}" for i in range(len(docs.columns))])
    kept = judged(plain, f"given_{position(docs.columns, 'text')}").filter(keep)
    return kept.select(*plain.columns).toDF(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects (score of 0.7 or more) go.  Rows without an id are scored, but teach nothing; of labels that disagree the model's sample decides."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return beside(docs, lambda d, text: toxicity.with_scores(d, model, threshold=0.7, text_col=text), "predicted = 0")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id; rows without words or id all stay, and of rows that share id and words one does."""
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; an empty benchmark lets all stay."""
    return beside(docs, lambda d, text: decontaminate.flag(d, table(spark, sf_dir, "benchmark"), width=10, text_col=text), "not contaminated")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, overlapping ones under one mark; n_chars follows; null texts become empty."""
    masked = secrets.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of what is left, with the round trip's digest: one row a document, repeated ids included."""
    return piecefst.with_round_trip(docs.select("doc_id", "text"), PIECES, ids_into="ids").drop("text")


STAGES = [
    ("toxicity", toxicity_stage),
    ("jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("sentencepiece", piece_stage),
]

#: Trained models, hash-chosen paths and transducers are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
