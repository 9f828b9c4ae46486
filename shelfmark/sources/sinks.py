"""Tables written by ingest, kept as batches so a rewrite never touches the rest.

A replaced document's new rows go into a new batch folder and readers take, per
document, the rows of its latest batch. Writing a batch twice gives the same
files, which makes a retried micro-batch harmless. ``compact`` folds the batches
into one when there are many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.hashing import text_hash
from shelfmark.operators.governance import upsert

BATCH = "batch_id"


def write_batch(df: DataFrame, path: str, batch_id: int, partitions: tuple[str, ...] = ()) -> None:
    """Write one batch folder, replacing an earlier attempt of the same batch."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/{BATCH}={batch_id}")


def read_current(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Rows of every document's latest batch.

    ``manifest`` lists (document_id, batch_id), also for documents whose new
    version has no rows at all.
    """
    latest = manifest.groupBy("document_id").agg(F.max(BATCH).alias(BATCH))
    return spark.read.parquet(path).join(latest, ["document_id", BATCH], "left_semi").drop(BATCH)


def compact(spark: SparkSession, path: str, manifest: DataFrame, target: str, partitions: tuple[str, ...] = ()) -> DataFrame:
    """Write the current rows as one batch below ``target`` and return the manifest that goes with it.

    The table stands in ``target/rows`` and its manifest in ``target/manifest``; the old
    table and manifest are left as they are.
    """
    write_batch(read_current(spark, path, manifest), f"{target}/rows", 0, partitions)
    newest = manifest.groupBy("document_id").agg(F.max(BATCH).alias(BATCH))
    held = manifest.join(newest, ["document_id", BATCH], "left_semi").dropDuplicates(["document_id"])
    write_batch(held.drop(BATCH), f"{target}/manifest", 0)
    return spark.read.parquet(f"{target}/manifest")


def replace_rows(old: DataFrame, new: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Full replace of documents' child rows (chunks or assets).

    ``documents`` names the replaced documents; by default those with new rows.
    """
    replaced = (documents if documents is not None else new).select("document_id").distinct()
    return old.join(replaced, "document_id", "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_points(old: DataFrame, new: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """Points by id, last write wins, also within the new batch when ``order`` is given."""
    if order is not None:
        others = [c for c in new.columns if c != key]
        new = (
            new.groupBy(key)
            .agg(F.max_by(F.struct(*others), order).alias("__row"))
            .select(key, "__row.*")
        )
    return upsert(old, new, key)


def content_snapshot(docs: DataFrame, content_type) -> DataFrame:
    """Full parsed text per document with type, size and hash."""
    return docs.select(
        "document_id",
        "kb_id",
        F.concat(
            F.lit("knowledge_bases/"), "kb_id", F.lit("/documents/"), "document_id", F.lit("/parsed/content")
        ).alias("path"),
        content_type.alias("content_type"),
        F.octet_length("content").cast("bigint").alias("file_size"),
        text_hash(F.col("content")).alias("file_hash"),
        "content",
    )


def append_rows(df: DataFrame, path: str) -> None:
    """Append-only tables: versions, audit events, retrieval logs."""
    df.write.mode("append").parquet(path)
