"""From raw documents to packed token sequences: five stages over everything the one before kept."""

from __future__ import annotations

from typing import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieweave.llm import language, mixing, packing, secrets, simhash
from tieweave.llm.common import pmod_of_id
from tieweave.session import materialize

#: Text that a packing task encodes at once and parts it remembers: the executors still hold what the stages
#: before took.
SLICE, KEPT_PARTS = 2 << 20, 100_000

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: without a letter, or in none of the known languages.

    The others keep their rows, with the predicted language in ``lang``.
    """
    docs = docs.select(*COLUMNS)
    judged = language.judge(docs, language.fit(docs, learned=pmod_of_id(4) != 2))
    return judged.where("NOT rejected").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: five-word shingles, similarity 0.8 or more."""
    return simhash.near_copies_removed(docs.select(*COLUMNS), words=5, similarity=0.8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it are replaced."""
    return secrets.redacted(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of at most 1024 tokens, and their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, slice_bytes=SLICE, kept_parts=KEPT_PARTS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL has no XXH64, language model, forest or token ids; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
