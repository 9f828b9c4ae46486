"""Corpus tables derived from the shared input tables (see FIXTURES.md section 2).

Every derivation is a plain projection, so it scales with its input and needs no
shuffle. ``checks/base.py`` states the same derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.hashing import chunk_id, text_hash
from shelfmark.functions.text import tokenize
from shelfmark.operators.chunking import split_large
from shelfmark.sources.tables import read_table

CHUNK_SIZE = 128
CHUNK_OVERLAP = 16
REVIEW_CYCLE = ["published", "published", "reviewed", "draft", "deprecated"]
STATUS_CYCLE = ["completed", "completed", "completed", "pending", "processing", "failed"]


#: Rows of a dealt table that one task may read.
DEALT_ROWS = 5_000


def dealt(df: DataFrame) -> DataFrame:
    """Test tables are one row group each; deal such a scan out to all cores, and larger ones to more tasks.

    Decided by the number of scan tasks that hold rows (a file has splits without a row
    group of their own), so a table of many row groups is never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    filled = df.select(F.spark_partition_id().alias("task")).distinct().limit(cores).count()
    if filled >= cores:
        return df
    return df.repartition(max(cores, -(-df.count() // DEALT_ROWS)))


def pick(values: list[str], position):
    return F.get(F.array(*[F.lit(v) for v in values]), position.cast("int"))


def knowledge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four KBs, one archived; ids come from the remainders of the document ids."""
    ids = read_table(spark, sf_dir, "documents").select((F.col("doc_id") % 4).alias("kb_id")).distinct()
    return ids.select(
        "kb_id",
        F.concat(F.lit("kb-"), F.col("kb_id")).alias("name"),
        F.lit("BAAI/bge-m3").alias("embedding_model"),
        F.lit(1024).alias("embedding_dim"),
        F.lit(CHUNK_SIZE).alias("chunk_size"),
        F.lit(CHUNK_OVERLAP).alias("chunk_overlap"),
        F.when(F.col("kb_id") == 3, "archived").otherwise("active").alias("status"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("kb_id") * 86400).alias("created_at"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("document_id"),
        (i % 4).alias("kb_id"),
        F.concat(F.lit("doc-"), F.when(i % 20 == 9, i - 4).otherwise(i)).alias("name"),
        F.lit("txt").alias("file_type"),
        F.octet_length("text").cast("bigint").alias("file_size"),
        F.lit(None).cast("string").alias("minio_path"),
        text_hash(F.col("text")).alias("file_hash"),
        F.lit("text").alias("source_type"),
        F.lit(None).cast("string").alias("source_url"),
        F.col("source").alias("governance_source_type"),
        (1 + i % 5).cast("int").alias("authority_level"),
        pick(REVIEW_CYCLE, F.floor(i / 5) % 5).alias("review_status"),
        F.lit(1).alias("current_version"),
        pick(STATUS_CYCLE, i % 6).alias("status"),
        F.when(i % 6 == 5, F.concat(F.lit("parse error "), i)).alias("error_message"),
        F.array("lang", "source").alias("tags"),
        F.lit(0).alias("chunk_count"),
        F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("created_at"),
        F.col("text").alias("content"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over every document, without a shuffle."""
    d = dealt(documents(spark, sf_dir).select("document_id", "kb_id", "tags", "content")).select(
        "document_id", "kb_id", "tags", tokenize(F.col("content")).alias("tokens")
    )
    windows = split_large(d, "tokens", CHUNK_SIZE, CHUNK_OVERLAP)
    return windows.select(
        chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"),
        "document_id",
        "kb_id",
        "chunk_index",
        "content",
        text_hash(F.col("content")).alias("content_hash"),
        F.lit("text").alias("chunk_type"),
        "tags",
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as multi-block documents."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("document_id"),
        F.col("turn").cast("int").alias("block_index"),
        F.col("text").alias("content"),
        F.when(F.col("turn") % 5 == 4, "code").otherwise("text").alias("chunk_type"),
        (F.col("turn") + 1).cast("int").alias("page_num"),
        F.lit(None).cast("string").alias("bbox"),
        F.when(F.col("role") == "system", 1).otherwise(0).alias("heading_level"),
        F.col("role").alias("block_type"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as search requests over all active KBs."""
    b = read_table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("request_id"),
        F.col("text").alias("query"),
        F.lit(None).cast("array<bigint>").alias("kb_ids"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    r = requests(spark, sf_dir)
    return r.join(e, r.request_id == e.vec_id).select("request_id", "kb_ids", "embedding")


def dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector per embedded document, attached to its first chunk."""
    e = read_table(spark, sf_dir, "embeddings")
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return e.join(d, e.vec_id == d.doc_id).select(
        chunk_id(F.col("doc_id"), F.lit(0)).alias("chunk_id"),
        F.col("doc_id").alias("document_id"),
        (F.col("doc_id") % 4).alias("kb_id"),
        F.lit("text").alias("chunk_type"),
        F.array("lang", "source").alias("tags"),
        "embedding",
    )


def visual_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings").where("label = 0")
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return e.join(d, e.vec_id == d.doc_id).select(
        F.col("vec_id").alias("asset_id"),
        chunk_id(F.col("doc_id"), F.lit(0)).alias("chunk_id"),
        F.col("doc_id").alias("document_id"),
        (F.col("doc_id") % 4).alias("kb_id"),
        F.lit("image").alias("chunk_type"),
        F.array("lang", "source").alias("tags"),
        "embedding",
    )
