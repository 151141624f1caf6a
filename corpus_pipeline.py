"""A corpus pipeline from five of the operators: quality, exact dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.llm import bpe, edited_copies, exact_dedup, mixing, quality, simhash_dedup
from schedlake.llm.common import free_name, numbered, row_name, settle


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as label 1 stay; rows of one id are judged each by its own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    key = free_name(docs, "row_key")
    rows = docs.withColumn(key, row_name("doc_id", "text"))
    return rows.join(quality.scored(rows, labels, keep=(key,)).filter("predicted = 1").select(key), key, "left_semi").drop(key)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest doc_id stays; of rows that repeat it, one."""
    rows, key = numbered(docs)
    named = rows.select(F.struct("doc_id", F.col(key).alias("row")).alias("doc_id"), "text")
    kept = exact_dedup.exact_groups(named).filter("kept").select(F.col("doc_id.row").alias(key))
    return rows.join(kept, key, "left_semi").drop(key)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 0.8 of their 5-word shingles, the row with the smallest doc_id stays; of rows that
    repeat it, one. Operator 8 finds groups by 5-word fingerprints, which are compared on the shingles and completed."""
    rows, key = numbered(docs)
    keyed = rows.select(F.col(key).alias("key"), "doc_id", "text")
    groups = simhash_dedup.near_groups(keyed.select(F.col("key").alias("doc_id"), "text"), width=edited_copies.WIDTH)
    linked = settle(edited_copies.near_copies(keyed, groups.select(F.col("doc_id").alias("key"), F.col("component_id").alias("grp"))).withColumnRenamed("id", "key"))
    ranked = keyed.select("key", "doc_id").join(linked, "key").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    gone = linked.join(ranked, "component").filter("key <> first.key").select(F.col("key").alias(key))
    return rows.join(gone, key, "left_anti").drop(key)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, once or twice each, so that the sources' words come near weights 3, 1, 2, .. of 150% of all words."""
    return mixing.mixed_documents(docs, weights=[3, 1, 2], share=1.5, most=2)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each whole text's token ids and of the bytes they decode to."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("mixing", mixed),
    ("byte_bpe", tokens),
]

#: SQL cannot express the trained classifier, near copies and BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = settle(docs)
    return docs
