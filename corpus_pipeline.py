"""The corpus pipeline: documents through stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.llm.common import discard, kept_by, read, without, written
from braidlog.llm.dedup import drop_exact_duplicates
from braidlog.llm.jaccard import jaccard_components
from braidlog.llm.queries import op3_packing_of, quality_network, toxicity_network

#: A document goes if its toxicity is this or more, or its quality less than this.
TOXIC_FROM, GOOD_FROM = 0.7, 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go."""
    sent = spark.sparkContext.broadcast(toxicity_network(spark, docs, sf_dir))
    return kept_by(docs, "text", lambda texts: sent.value.scores(texts) < TOXIC_FROM)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network rejects go."""
    sent = spark.sparkContext.broadcast(quality_network(spark, docs, sf_dir))
    return kept_by(docs, "text", lambda texts: sent.value.scores(texts) >= GOOD_FROM)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the smallest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the smallest id stays."""
    found = jaccard_components(docs)
    return without(docs, "doc_id", found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in token windows."""
    return op3_packing_of(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("packing", packing),
]

#: The classifiers are trained and tokens are counted, so SQL can't express the rows; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and read again, and goes when the next one is written.

    A document with a null id has no label and no component and stays if its score lets it; a null text is empty.
    Repeated rows are exact copies, of which one stays. Other columns go along to the last stage but one, whatever their names.
    An empty table gives no rows.
    """
    docs, before = read(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline{k}")
        discard(*before)
        before = [docs]
    return docs
