"""The corpus pipeline: five stages over `documents`, each one operator of pulsegrid.llm over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import compression, mixing, pieces, simhash, surrogates
from pulsegrid.llm.common import materialise, read


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    scores = compression.score_column(docs, compression.fit_quality(spark, sf_dir))
    return scores.where("score >= 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of texts that are linked by a Jaccard similarity of 0.8 or more of their five-word shingles."""
    return simhash.keep_first(docs, size=5, distance=6, similarity=0.8)


def hide_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data and secrets; n_chars follows the text."""
    out = surrogates.pseudonymise(docs, surrogates.DEMO_KEY).drop("n_entities")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: expected tokens by domain meet the target weights, of a total that takes clean text whole."""
    return mixing.take(docs, mixing.label_model(spark, sf_dir), mixing.TARGETS, whole="clean")


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (array<int>) of every document."""
    return pieces.encode_docs(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("pii surrogates", hide_pii),
    ("mixing to target weights", mix_domains),
    ("sentencepiece", to_pieces),
]

#: No stage's result is within SQL's reach; tests/llm/test_pipeline.py holds each stage's decisions against plain code over the
#: model's numbers, and those of near-dedup against all pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
