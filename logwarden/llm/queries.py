"""One query for each operator over its whole table, and the SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontaminate, exact_dedup, hard_negatives, language_model, line_rules, ngram_join, quality, secrets, sentencepieces, suffixes, toxicity
from .common import id_bucket, table
from .queries_sql import SQL


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), modulus=5)
    scored = toxicity.score(docs, model, out="score")
    return scored.select(
        "doc_id", (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: A public vocabulary file; nothing of it is kept in this repository.
PIECES = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    ids = F.col("encoded.ids")
    return encoded.select("doc_id", F.size(ids).cast("bigint").alias("n_pieces"), ids.alias("ids"), F.col("encoded.exact").alias("exact"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat.conversation_digest(chat.format_examples(turns.unionByName(own)))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"), modulus=10)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    joined = F.array_join(F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined, 256).alias("base_sha256"),
        F.array_join(line, ",").alias("spans"), count("random"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = line_rules.quality_report(table(spark, sf_dir, "documents"))
    return report.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), out="hits")
    hit = decontaminate.n_hit(F.col("hits"))
    return found.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), hit.alias("n_hit"), F.size("hits.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = quality.rate(docs, quality.train(docs, quality.ratings(table(spark, sf_dir, "labels"))))
    tails = F.col("rating.tails")
    return rated.select(
        "doc_id", (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("rating.expected_grade").alias("expected_grade"),
        tails[0].alias("p_good"), tails[1].alias("p_clean"), (tails[0] >= quality.ACCEPT).alias("selected"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", noisy.alias("label"))
    return hard_negatives.mine_hard_negatives(rows, lambda i: i % 50 == 0)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_toxicity": op1_toxicity, "op2_sentencepiece": op2_sentencepiece, "op3_chat": op3_chat, "op4_suffix_dedup": op4_suffix_dedup, "op5_language_model": op5_language_model, "op6_secrets": op6_secrets, "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination, "op9_quality": op9_quality, "op10_ngram_join": op10_ngram_join,
    "op11_centroids": op11_centroids, "op12_hard_negatives": op12_hard_negatives, "op13_exact_dedup": op13_exact_dedup,
}
ORACLES = SQL
