"""A training-corpus pipeline: language, quality, near-duplicates, personal data, packing.

Each stage reads what its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from glosswork.llm import langid, packing, pii, quality, shingles
from glosswork.llm.queries import ACCEPTED_SCORE
from glosswork.llm.storage import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language the model names with enough confidence; ``lang`` stays as given.

    Texts that are null or without a letter are rejected. The model learns from the documents' own ``lang`` values.
    """
    model = langid.train(docs, F.lit(True))
    return langid.predict(docs, model).where("lang_accepted").select(COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier, learned from their labels, accepts. Ids are not needed."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where(F.col("quality_score") >= ACCEPTED_SCORE).select(COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near-duplicates: 0.8 or more of their five-word shingles in common.

    Candidates meet in balls around their SimHash fingerprints, and in MinHash bands where these are further apart.
    Repeated rows of one id are one document and stay together; rows without an id cannot be named and stay.
    """
    groups = shingles.near_duplicate_groups(docs)
    kept = groups.where("id = component_id").select(F.col("id").alias("doc_id")).distinct()
    unnamed = docs.where("doc_id is null").select(COLUMNS)
    return docs.join(kept, "doc_id", "left_semi").select(COLUMNS).union(unnamed)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts and count their characters again; a null text stays null."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences; one row per piece."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("personal_data", without_personal_data),
    ("packing", packed),
]
ORACLE_SQL = None  # learned models and tokenizers; tests compare each stage with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
