"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, langid, licenses, passages, pieces, quality, secrets, simhash, toxicity
from .common import held_out, materialize, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = read(spark, sf_dir, "documents")
    prints = materialize(simhash.with_fingerprints(docs, keep=["doc_id"]), "prints")
    return simhash.near_duplicates(prints).select(
        "doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that may be learned from."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of repeated paragraphs and passages in all documents."""
    return passages.find_repeats(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that may be learned from."""
    docs = read(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items."""
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document, own or inherited, the documents being laid out as files in folders."""
    docs = read(spark, sf_dir, "documents")
    return licenses.scan(docs, "doc_id", licenses.layout(F.col("doc_id"), F.col("source"), F.col("text")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and selection of every document."""
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "expected_grade",
        "tail_probability",
        (F.col("tail_probability") >= quality.REJECT_BELOW).alias("kept"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding gives the text back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, keep=["doc_id"], check=True)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate component of every vector."""
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts, digest of the base spans, all spans."""
    docs = read(spark, sf_dir, "documents")
    return secrets.scan(docs.select("doc_id", "text"), secrets.fit(docs), keep=["doc_id"])


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": op1_simhash,
        "op2_toxicity": op2_toxicity,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_language_id": op4_language_id,
        "op5_decontamination": op5_decontamination,
        "op6_license_scan": op6_license_scan,
        "op7_quality": op7_quality,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_embedding_near_dedup": op9_embedding_near_dedup,
        "op10_secret_scan": op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_simhash": simhash.oracle_sql(),
        "op5_decontamination": decontaminate.oracle_sql(),
        "op9_embedding_near_dedup": embeddings.oracle_sql(),
    }
