"""Scans: typed tables, uploaded files, inline text, fetched pages, layout JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.hashing import text_hash
from shelfmark.schemas import INPUT_SCHEMAS


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table read with its declared schema."""
    reader = spark.read
    if name in INPUT_SCHEMAS:
        reader = reader.schema(INPUT_SCHEMAS[name])
    return reader.parquet(f"{root}/{name}.parquet")


def source_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Uploaded files with name, type, size and hash.

    Spark's file scan leaves out files of zero bytes, so an empty upload is never
    registered; rows of size zero from other sources get their reason in
    ``register_documents``. The type is the text after the last dot of the lower-cased name, so a name
    without a dot is its own type.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.url_decode(F.regexp_replace(F.substring_index("path", "/", -1), r"\+", "%2B"))
    return files.select(
        name.alias("name"),
        F.substring_index(F.lower(name), ".", -1).alias("file_type"),
        F.col("length").alias("file_size"),
        F.sha2("content", 256).alias("file_hash"),
        F.lit("upload").alias("source_type"),
        F.when(F.col("length") == 0, "empty_file").alias("reason"),
        "content",
    )


def source_text(df: DataFrame) -> DataFrame:
    """Inline text rows (name, content, file_type) with type, size and hash filled."""
    kind = F.coalesce("file_type", F.lit("txt"))
    return df.withColumns(
        {
            "file_type": F.when(kind == "markdown", "md").otherwise(kind),
            "file_size": F.octet_length("content").cast("bigint"),
            "file_hash": text_hash(F.col("content")),
            "source_type": F.lit("text"),
        }
    )


def source_pages(df: DataFrame) -> DataFrame:
    """Fetched pages (url, html, optional name) as URL documents."""
    name = F.col("name") if "name" in df.columns else F.lit(None).cast("string")
    return df.select(
        *[c for c in df.columns if c not in ("name", "html")],
        F.coalesce(F.nullif(name, F.lit("")), F.col("url")).alias("name"),
        F.lit("html").alias("file_type"),
        F.lit("url").alias("source_type"),
        F.col("url").alias("source_url"),
        F.lit(None).cast("string").alias("file_hash"),
        F.col("html").alias("content"),
    )


def source_content_list(spark: SparkSession, path: str) -> DataFrame:
    """Layout-parser outputs in a folder tree: one JSON text per document.

    Per document the newer list format wins, and within a format the larger file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = F.substring_index("path", "/", -1)
    stem = F.regexp_extract(base, r"\A(.+)_content_list(_v2)?\.json\z", 1)
    ranked = files.where(base.rlike(r"_content_list(_v2)?\.json\z")).select(
        stem.alias("document_name"),
        F.struct(
            base.endswith("_content_list_v2.json").alias("newer"),
            F.col("length"),
            F.col("path"),
        ).alias("preference"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("layout_json"),
    )
    return ranked.groupBy("document_name").agg(
        F.max_by("layout_json", "preference").alias("layout_json")
    )
