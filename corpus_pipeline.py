"""A corpus pipeline of five of the operators; each stage's result is written as Parquet and read again by the next.

All stages take the columns of documents and any others beside them (whatever their names, as long as doc_id, text and
source are there), keep repeated rows apart, handle whole texts of any length, and give no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, jaccard, mixing, quality, secrets
from gridloom.llm.common import materialize, table


def _resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn(
        "n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])
    ) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good. Null and empty texts are scored as one empty line; without labels
    of both kinds every score is 0.5, and all documents stay."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(docs, model).where("predicted = 1").select("row.*")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; rows that repeat its doc_id stay with it.
    Documents without words, or without a doc_id, are copies of nothing and stay."""
    return jaccard.drop_near_copies(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by the kind's name; null texts stay null. n_chars follows the text."""
    return _resized(secrets.redact(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each pass, in the order of training. Documents without words (null or
    empty texts) have nothing to take and go; the last of a demand is cut to the words taken. Null sources are one."""
    return _resized(mixing.apply_mix(docs))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents of the mix; null texts count as empty."""
    return bpe.encode_documents(docs, bpe.word_model())


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]
#: No SQL: the classifier is trained, and tokens are merged by rank. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
