"""The corpus pipeline: documents through the stages below, in order.

Each stage takes all that its predecessor kept. Quality rules and near-duplicates drop documents; repeated
passages and personal data change texts (``n_chars`` follows); packing returns the pieces and their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import neardup, packing, passages, pii, quality
from panelwright.session import materialize


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_quality(spark, docs, sf_dir):
    """Documents that the quality rules keep."""
    return quality.filter_quality(docs)


def keep_one_of_copies(spark, docs, sf_dir):
    """One document of each group of near-duplicates."""
    return neardup.drop_near_copies(docs)


def cut_repeats(spark, docs, sf_dir):
    """Texts without passages that an earlier document, or their own text, has."""
    return _measured(passages.strip(docs))


def redact_personal(spark, docs, sf_dir):
    """Texts with personal data replaced by its kind."""
    return _measured(pii.redact(docs, pii.fit(docs.select("doc_id", "text"))))


def pack_sequences(spark, docs, sf_dir):
    """Pieces of all texts and their places in sequences."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality", keep_quality),
    ("near_copies", keep_one_of_copies),
    ("repeats", cut_repeats),
    ("personal", redact_personal),
    ("packing", pack_sequences),
]


def run(spark, sf_dir):
    """Rows of the last stage over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# Tokens, trees and fertility are beyond SQL: tests compare the stages with brute force.
ORACLE_SQL = None
