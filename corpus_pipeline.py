"""A corpus pipeline: five stages, each one of the operators of ``logwarden.llm``.

Every stage is written as Parquet and read again by the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm import decontaminate, ngram_join, quality, secrets, sentencepieces
from logwarden.llm.common import shared_folder, table
from logwarden.llm.queries import PIECES


def select_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.select_quality(docs, quality.ratings(table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays."""
    return ngram_join.drop_similar(docs)


def decontaminate_docs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    return recounted(decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark")), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced."""
    return recounted(secrets.redact_secrets(docs), docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids: the texts as piece ids, and whether they decode to the same text."""
    encoded = sentencepieces.encode(docs.select("doc_id", "lang", "source", "text"), PIECES)
    ids = F.col("encoded.ids")
    return encoded.select(
        "doc_id", "lang", "source", F.size(ids).cast("bigint").alias("n_pieces"), ids.alias("ids"), F.col("encoded.exact").alias("exact"))


def recounted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars follows the text where it did before."""
    if "n_chars" not in docs.columns:
        return changed
    n = F.when(F.col("n_chars").isNotNull(), F.length(F.coalesce("text", F.lit(""))))
    return changed.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


STAGES = [
    ("quality classifier", select_by_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_docs),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding", encode_pieces),
]

#: The classifier and the piece ids cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{i}")
    return docs
