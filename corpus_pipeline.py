"""A corpus pipeline of five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as
Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changewatch.llm import mixing, near_dedup, packing, pii, quality_classifier
from changewatch.llm.common import shared_dir, spread
from changewatch.llm.queries import RANKS, quality_model, table, vocabulary

#: Documents whose score is below go.
QUALITY_AT_LEAST = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, fitted to the labels that may be learnt from; what it rejects goes."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.likely(docs, model, threshold=QUALITY_AT_LEAST)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dedup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked."""
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: documents go, stay or are repeated."""
    return mixing.resample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in training sequences."""
    return packing.pack_documents(docs, vocabulary(), ranks=vocabulary(RANKS))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packed)]

#: Models, samples and tokens are beyond SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    import uuid

    docs = table(spark, sf_dir, "documents")
    home = f"{shared_dir(spark)}/changewatch-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = f"{home}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spread(spark.read.parquet(out))
    return docs
