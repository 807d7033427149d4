"""The registered queries of this package; each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from typing import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tieweave.llm import (
    conversations,
    fingerprints,
    language,
    minhash,
    mixing,
    packing,
    quality,
    secrets,
    simhash,
    spelling,
    tokens,
    topk,
    urls,
)
from tieweave.llm.common import table
from tieweave.llm.sql import ORACLE  # noqa: F401 - taken from here by the entry
from tieweave.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {"pipeline": corpus_pipeline.run}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_top_k(spark, sf_dir):
    # Converted once; each pass of the search reads whole numbers.
    vectors = materialize(topk.integer_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@query
def op2_language_id(spark, sf_dir):
    return language.predict(table(spark, sf_dir, "documents"))


@query
def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, capacity=1024, with_ids=False)


@query
def op4_token_files(spark, sf_dir):
    return tokens.token_digest(spark, tokens.token_files(table(spark, sf_dir, "documents"), VOCABULARY))


@query
def op5_simhash_near_dedup(spark, sf_dir):
    return simhash.near_classes(table(spark, sf_dir, "documents"), words=3, radius=2)


@query
def op6_url_association_rules(spark, sf_dir):
    # The pages' documents have labels: toxic or poor ones teach what to block.
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("block")
    )
    return urls.judge(table(spark, sf_dir, "pages"), labels)


@query
def op7_quality_rules(spark, sf_dir):
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_secret_scan(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "start", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"),
        "probability", "secret",
    )


@query
def op9_multiset_fingerprints(spark, sf_dir):
    return fingerprints.edited_documents(table(spark, sf_dir, "documents"))


@query
def op10_curriculum_mix(spark, sf_dir):
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("first_position", F.get("positions", F.lit(0))["position"])
    ordered = mixing.in_training_order(rows, "first_position", "order_key")
    return ordered.select("doc_id", "size", "source_size", "target", "taken")


@query
def op11_conversation_repair(spark, sf_dir):
    given = table(spark, sf_dir, "conversations")
    return conversations.audited(conversations.damaged(given), given)


@query
def op12_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query
def op13_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
