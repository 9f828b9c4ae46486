"""Counts and profiles of the corpus. Plain aggregations with partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kb_counts(kbs: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents and chunks per KB, recounted from rows."""
    n_docs = docs.groupBy("kb_id").agg(F.count(F.lit(1)).alias("document_count"))
    n_chunks = chunks.groupBy("kb_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return (
        kbs.drop("document_count", "chunk_count")
        .join(n_docs, "kb_id", "left")
        .join(n_chunks, "kb_id", "left")
        .na.fill(0, ["document_count", "chunk_count"])
    )


def document_facets(docs: DataFrame) -> DataFrame:
    """One row with the size of every facet."""
    status, review = F.lower("status"), F.col("review_status")
    active = status.isin("pending", "processing")
    return docs.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("bigint").alias("chunks"),
        F.count_if(active).alias("active"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(review == "draft").alias("draft"),
        F.count_if(review == "reviewed").alias("reviewed"),
        F.count_if(review == "published").alias("published"),
        F.count_if(review == "deprecated").alias("deprecated"),
        F.count_if(review.isin("draft", "reviewed")).alias("draft_like"),
    )


def source_labels(docs: DataFrame) -> DataFrame:
    """Sorted distinct non-empty governance sources."""
    named = docs.where("governance_source_type <> ''")
    return named.select("governance_source_type").distinct().orderBy("governance_source_type")


def corpus_overview(kbs_with_counts: DataFrame) -> DataFrame:
    return kbs_with_counts.agg(
        F.count(F.lit(1)).alias("knowledge_bases"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.coalesce(F.sum("document_count"), F.lit(0)).cast("bigint").alias("documents"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("bigint").alias("chunks"),
    )


def block_profile(blocks: DataFrame) -> DataFrame:
    """Per document: blocks, blocks per type and distinct pages.

    Counts are first reduced to (document, type) and (document, page), so a long
    document spreads over tasks.
    """
    per_type = blocks.groupBy("document_id", "block_type").agg(F.count(F.lit(1)).alias("n"))
    pages = blocks.where("page_num is not null").select("document_id", "page_num").distinct()
    per_page = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"))
    types = per_type.groupBy("document_id").agg(
        F.sum("n").cast("bigint").alias("block_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("block_type", "n")))).alias("block_types"),
    )
    return types.join(per_page, "document_id", "left").na.fill(0, ["page_count"])


def sheet_profile(rows: DataFrame, workbook: list[str], sheet: str) -> DataFrame:
    """Sheets, kept rows and cells per workbook, from rendered worksheet rows."""
    per_sheet = rows.groupBy(*workbook, sheet).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.size("cells")).alias("cells")
    )
    return per_sheet.groupBy(*workbook).agg(
        F.count(F.lit(1)).alias("sheet_count"),
        F.sum("rows").cast("bigint").alias("row_count"),
        F.sum("cells").cast("bigint").alias("cell_count"),
    )
