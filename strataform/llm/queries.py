"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm import decontaminate, html_text, language_id, mixing, near_dedup, nearest, pii, secrets, substring_dedup, token_packing
from strataform.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of 2,048 token ids."""
    return token_packing.pack(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def rating_weight(labels: DataFrame) -> DataFrame:
    """Columns doc_id, weight: 2 if labelled good, 0.5 if labelled bad; documents without a label are absent."""
    rated = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("rating"))
    return rated.select("doc_id", F.when(F.col("rating") == 1, 2.0).when(F.col("rating") == 0, 0.5).alias("weight"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed at source weights 5, 2, 1, repeating; quality weights from the labels."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    rated = sizes.join(rating_weight(table(spark, sf_dir, "labels")), "doc_id", "left")
    found = mixing.mix(rated, size_col="size", weight_col="weight")
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 20-word windows that start earlier."""
    found = substring_dedup.without_repeats(table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10-word benchmark windows in all documents."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest embeddings of every hundredth."""
    return nearest.search(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn(docs.filter(~language_id.held_out("doc_id")))
    found = language_id.predict(docs, profiles)
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents on 4-word shingles at similarity 0.8."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, similarity=(80, 100))


QUERIES = {
    "op1_token_packing": op1_token_packing,
    "op2_html_extraction": op2_html_extraction,
    "op3_source_mixing": op3_source_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_personal_data": op6_personal_data,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_language_id": op8_language_id,
    "op9_secrets": op9_secrets,
    "op10_minhash": op10_minhash,
}
