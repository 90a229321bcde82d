"""A training-data pipeline of five stages over `documents`.

toxicity -> near duplicates -> benchmark decontamination -> secrets -> SentencePiece ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next one's `docs`.  The first three drop rows, the fourth replaces secret
spans by <SECRET> (n_chars follows), and the last gives each document's ids.

Defined cases, for every stage: an empty `docs` gives an empty table; null texts and empty texts pass as they are (no evidence of
toxicity, no shingles, no item, no secret, no ids); rows with a null id are never dropped for an id; columns
beyond those of `documents` are carried by the first four.  Each stage states its own cases below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from narrata.llm.op1_near import one_of_each
from narrata.llm.op4_pieces import pieces_of
from narrata.llm.op7_toxicity import without_toxic
from narrata.llm.op9_decontaminate import decontaminated
from narrata.llm.op10_secrets import masked
from narrata.llm.store import keep, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic; learns from `labels` and the documents of this stage.

    With empty `labels`, or labels of one class only, nothing is dropped; repeated rows go or stay together; ties (a score of 0.5) go.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate class (similarity 0.8 or more).

    Of rows that are equal in id and text one stays; rows with a null id, or without words, are compared with nothing and stay.
    """
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a `benchmark` item, within its edit budget.

    With an empty `benchmark`, or items without text, nothing is dropped; repeated rows go or stay together.
    """
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; overlapping spans are replaced as one, rows stay as many as they were."""
    return masked(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, decoded_sha256, lossless, a row for each row of `docs`; null and empty texts have no ids."""
    return pieces_of(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("sentencepiece", sentencepiece),
]

#: Learned models have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
