"""Ranks, fusion, score cuts and the final order of search results.

Every window here is partitioned by query and sees at most a few candidate
lists, whose lengths are bounded by the candidate limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
SCORE_DIGITS = 12
GOVERNANCE_KEYS = ("review_status", "governance_source_type", "authority_level", "max_authority_level")


def candidate_limit(top_k: int, filters: dict | None = None) -> int:
    """Rows to fetch per list: wide when a later governance filter may drop some."""
    filters = filters or {}
    open_search = filters.get("include_unpublished") is True
    explicit = any(key in filters for key in GOVERNANCE_KEYS)
    return top_k * (5 if open_search and not explicit else 20)


def candidate_limit_column(top_k: Column, include_unpublished: Column, explicit: Column) -> Column:
    """The same rule over columns of a request table."""
    return top_k * F.when(include_unpublished & ~explicit, 5).otherwise(20)


def rank_candidates(hits: DataFrame, kb_merge: str = "score", item: str = "chunk_id") -> DataFrame:
    """1-based position of each hit in its query's list.

    ``score`` ranks all KBs together. ``concat`` puts each KB's whole list after
    the lists of the KBs before it, in ascending KB id.
    """
    first = [F.asc("kb_id")] if kb_merge == "concat" else []
    order = Window.partitionBy("qid").orderBy(*first, F.desc("score"), F.asc(item))
    return hits.withColumn("rank", F.row_number().over(order))


def union_rankings(rankings: dict[str, DataFrame]) -> DataFrame:
    """Stack ranked lists under their names."""
    tagged = [
        df.select(F.lit(name).alias("ranking"), "qid", "chunk_id", "document_id", "kb_id", "rank")
        for name, df in rankings.items()
    ]
    return reduce(DataFrame.unionByName, tagged)


def rrf_fuse(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over rankings; a repeated chunk counts at its first rank.

    The score is rounded so that the order of additions cannot change a rank.
    """
    first = ranked.groupBy("qid", "ranking", "chunk_id").agg(
        F.min("rank").alias("rank"),
        F.min("document_id").alias("document_id"),
        F.min("kb_id").alias("kb_id"),
    )
    return first.groupBy("qid", "chunk_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), SCORE_DIGITS).alias("score"),
        F.min("document_id").alias("document_id"),
        F.min("kb_id").alias("kb_id"),
    )


def score_threshold(df: DataFrame, threshold: float | None) -> DataFrame:
    return df if threshold is None else df.where(F.col("score") >= threshold)


def top_per_query(df: DataFrame, k: int | Column, key: str | list[str] = "qid", rank: str = "rank") -> DataFrame:
    """First k rows per query by fused score."""
    keys = [key] if isinstance(key, str) else key
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("chunk_id"))
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def rerank_order(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Position by rerank score (missing as 0), or by fused score when disabled."""
    key = F.coalesce("rerank_score", F.lit(0.0)) if enabled else F.col("score")
    order = Window.partitionBy("qid").orderBy(F.desc(key), F.asc("fused_rank"))
    return df.withColumn("rerank_rank", F.row_number().over(order))


def authority_rank(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Lower authority level first, then score; ties keep the order before."""
    score = F.coalesce("rerank_score", F.lit(0.0)) if enabled else F.col("score")
    order = Window.partitionBy("qid").orderBy(
        F.asc("authority_level"), F.desc(score), F.asc("rerank_rank")
    )
    return df.withColumn("rank", F.row_number().over(order))


def merge_responses(results: DataFrame, k: int, position: str = "query_pos") -> DataFrame:
    """Best-scored row per (request, chunk) over sub-queries, then the top k."""
    best = Window.partitionBy("request_id", "chunk_id").orderBy(F.desc("score"), F.asc(position))
    kept = results.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "rank")
    return top_per_query(kept, k, "request_id")
