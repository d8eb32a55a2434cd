"""From raw documents to token ids: each stage works on what the one before it kept, written as Parquet and read again.

Quality rules drop documents, near-duplicates leave one document of each group, documents with benchmark passages go,
secrets in the texts are masked, and the texts become byte-level BPE ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import bpe, decontaminate, near_copies, quality, secrets
from postlens.session import materialise

#: SimHash, whole-word BPE and character models have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.quality_cascade(docs).where("failed_rule IS NULL").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: Jaccard similarity of 0.8 or more, by shingles of five words.

    Candidates come from SimHash balls and, since those find few pairs near 0.8, from MinHash bands.
    """
    return near_copies.drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words, or a whole shorter item, of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.remove_documents(docs, benchmark).select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked; ``n_chars`` follows the new text."""
    found = secrets.find_secrets(docs, secrets.train(secrets.labelled_sample(docs, separators=True)), parts=True)
    masked = secrets.redact(found)
    n_chars = F.when(F.size("secret_spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", n_chars).select(*docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, packed as little-endian 32-bit integers, and whether they decode to it."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    source = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
    decoded = bpe.encode(source, ranks, pattern, bytes_col="decoded")
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    same = F.sha2("decoded", 256) == F.col("text_sha256")
    return decoded.select("doc_id", "lang", "source", "ids", n_tokens.alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup with MinHash bands", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("byte-level BPE", byte_level_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
