"""From documents to token ids, a stage at a time.

Each stage gets what its predecessor kept, as written Parquet, and works on all of
it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellframe.llm import decontaminate, pieces, quality, secrets, simhash
from cellframe.llm.common import materialize, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that are probably of the lowest grade go."""
    return quality.select_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies by SimHash and MinHash bands, of 5-word Jaccard 0.8 or more: of each group the smallest id stays."""
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; ``n_chars`` follows."""
    return secrets.redact(docs, secrets.fit(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, beside the columns that describe the document."""
    keep = [c for c in docs.columns if c != "text"]
    return pieces.encode(docs, keep=keep)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("sentencepiece encoding", encoding_stage),
]

#: XXH64 fingerprints, trained models and tokenization have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
