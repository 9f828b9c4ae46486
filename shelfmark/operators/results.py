"""Joins that turn candidates into results, and logs of what was returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.assets import asset_keys, asset_url
from shelfmark.operators.segments import running

# Width of a time segment in half microseconds: ten seconds.
CLOCK_SEGMENT = 20_000_000

DOCUMENT_COLUMNS = {
    "name": "document_name",
    "governance_source_type": "governance_source_type",
    "authority_level": "authority_level",
    "review_status": "review_status",
    "current_version": "document_version",
}


def hydrate(candidates: DataFrame, chunks: DataFrame, docs: DataFrame, visible: Column | None = None) -> DataFrame:
    """Candidates with their chunk and document columns; vanished chunks drop out.

    Documents come first: what ``visible``, a test of document columns, refuses never
    meets the chunk table and its texts. ``candidates`` may carry a broadcast hint from the
    caller, who knows its bound.
    """
    document = docs.select(
        F.col("document_id"), *[F.col(c).alias(n) for c, n in DOCUMENT_COLUMNS.items()]
    )
    if "document_id" not in candidates.columns:
        found = candidates.join(chunks, "chunk_id").join(document, "document_id")
        return found if visible is None else found.where(visible)
    known = candidates.join(document, "document_id")
    shown = known if visible is None else known.where(visible)
    return shown.join(chunks.drop("document_id", "kb_id"), "chunk_id")


def parent_context(results: DataFrame, chunks: DataFrame, enabled: bool = True) -> DataFrame:
    """Add the parent chunk's id and text; null when there is none."""
    if not enabled:
        return results.withColumn("parent_chunk", F.lit(None).cast("struct<id:string,content:string>"))
    parent = chunks.select(
        F.col("chunk_id").alias("parent_chunk_id"),
        F.struct(F.col("chunk_id").alias("id"), "content").alias("parent_chunk"),
    )
    return results.join(parent, "parent_chunk_id", "left")


def merge_asset_keys(referenced: Column, visual: Column) -> Column:
    """Ordered union: keys used in the text first, then keys of visual hits."""
    return F.array_distinct(F.concat(referenced, visual))


def attach_assets(results: DataFrame, assets: DataFrame, visual_keys: DataFrame | None = None) -> DataFrame:
    """Add ``assets``: the referenced and visually hit assets of each result, in order."""
    key_type = "array<struct<document_id:string,asset_id:string>>"
    if visual_keys is None:
        keyed = results.withColumn("__visual", F.array().cast(key_type))
    else:
        wanted = visual_keys.select("qid", "chunk_id", F.col("asset_keys").cast(key_type).alias("__visual"))
        keyed = results.join(wanted, ["qid", "chunk_id"], "left").withColumn(
            "__visual", F.coalesce("__visual", F.array().cast(key_type))
        )
    used = keyed.select(
        "qid",
        "chunk_id",
        F.posexplode(merge_asset_keys(asset_keys(F.col("content")), F.col("__visual"))).alias("pos", "key"),
    )
    stored = assets.select(
        F.col("document_id").cast("string").alias("document_id"),
        F.col("asset_id").cast("string").alias("asset_id"),
        "asset_type",
        "source_path",
        "content_type",
        "file_size",
    )
    found = used.select("qid", "chunk_id", "pos", "key.*").join(stored, ["document_id", "asset_id"])
    one = F.struct(
        "pos",
        F.struct(
            F.col("asset_id").alias("id"),
            "document_id",
            "asset_type",
            "source_path",
            asset_url(F.col("document_id"), F.col("asset_id")).alias("url"),
            "content_type",
            "file_size",
        ).alias("asset"),
    )
    grouped = found.groupBy("qid", "chunk_id").agg(
        F.transform(F.array_sort(F.collect_list(one)), lambda a: a["asset"]).alias("assets")
    )
    joined = results.join(grouped, ["qid", "chunk_id"], "left")
    empty = F.array().cast(grouped.schema["assets"].dataType)
    return joined.withColumn("assets", F.coalesce("assets", empty))


def link_assets(assets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk of each asset: the first one whose text holds its URL, else the document's first.

    URLs are extracted from the text and joined on equality, so no text is
    compared with every asset.
    """
    used = chunks.select(
        "chunk_id", "chunk_index", F.explode(asset_keys(F.col("content"))).alias("key")
    ).select("chunk_id", "chunk_index", "key.*")
    first_use = used.groupBy("document_id", "asset_id").agg(
        F.min_by("chunk_id", "chunk_index").alias("__used")
    )
    opening = chunks.where("chunk_index = 0").select(
        F.col("document_id"), F.col("chunk_id").alias("__opening")
    )
    return (
        assets.join(first_use, ["document_id", "asset_id"], "left")
        .join(opening, "document_id", "left")
        .select(*assets.columns, F.coalesce("__used", "__opening").alias("chunk_id"))
    )


# --- logs ------------------------------------------------------------------------


def retrieval_log(results: DataFrame, requests: DataFrame, latencies: DataFrame | None = None) -> DataFrame:
    """One row per request: ids and rerank scores in result order (at most top_k each)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "rerank_score")))
    lists = results.groupBy("request_id").agg(ordered.alias("__r"))
    log = requests.join(lists, "request_id", "left").select(
        *requests.columns,
        F.coalesce(F.transform("__r", lambda r: r["chunk_id"]), F.array().cast("array<string>")).alias(
            "retrieved_chunk_ids"
        ),
        F.coalesce(F.transform("__r", lambda r: r["rerank_score"]), F.array().cast("array<double>")).alias(
            "rerank_scores"
        ),
    )
    if latencies is not None:
        log = log.join(latencies.select("request_id", "stage_latencies", "total_latency_ms"), "request_id", "left")
    return log


def cache_hit_log(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Log rows of requests that were answered from earlier results: nothing was spent, and the log says why.

    ``results`` are the reused rows; a missing rerank score is logged as 0.
    """
    scored = results.withColumn("rerank_score", F.coalesce(F.col("rerank_score").cast("double"), F.lit(0.0)))
    return retrieval_log(scored, requests).withColumns(
        {
            "stage_latencies": F.create_map(F.lit("cache_hit"), F.lit(1).cast("bigint")),
            "total_latency_ms": F.lit(0).cast("bigint"),
        }
    )


def stage_latency_sum(logs: DataFrame, key: str = "request_id") -> DataFrame:
    """Latency per stage summed over the responses of a request."""
    staged = logs.select(key, F.explode("stage_latencies").alias("stage", "ms"))
    return staged.groupBy(key, "stage").agg(F.sum("ms").cast("bigint").alias("total_ms"))


def retrieval_stats(candidates: DataFrame, fused: DataFrame, results: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Row counts per query after each stage.

    With ``requests`` every query has a row, zeros where nothing was found; without,
    queries without any hit have none.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("qid").agg(F.count(F.lit(1)).alias(name))

    first = counted(candidates, "total_candidates")
    if requests is not None:
        first = requests.select("qid").distinct().join(first, "qid", "left")
    return (
        first.join(counted(fused, "after_fusion"), "qid", "left")
        .join(counted(results, "after_rerank"), "qid", "left")
        .na.fill(0)
    )


def apply_feedback(logs: DataFrame, feedback: DataFrame, order: str = "given_at") -> DataFrame:
    """Logs with feedback set; several log rows of one request all take it.

    Of several feedback rows for a request the latest by ``order`` counts, if there is
    such a column; what still ties is settled by the values.
    """
    by = ([order] if order in feedback.columns else []) + ["feedback", "feedback_detail"]
    latest = feedback.groupBy("request_id").agg(F.max(F.struct(*by)).alias("__given"))
    joined = logs.join(latest, "request_id", "left")
    hit = F.col("__given.feedback").isNotNull()
    return joined.withColumns(
        {
            "feedback": F.when(hit, F.col("__given.feedback")).otherwise(F.col("feedback")),
            "feedback_detail": F.when(hit, F.col("__given.feedback_detail")).otherwise(F.col("feedback_detail")),
        }
    ).drop("__given")


def unmatched_feedback(logs: DataFrame, feedback: DataFrame) -> DataFrame:
    return feedback.join(logs.select("request_id"), "request_id", "left_anti")


def reuse_results(requests: DataFrame, cache: DataFrame, ttl_seconds: int = 300, voided_at: DataFrame | None = None) -> DataFrame:
    """Which requests reuse a stored response.

    ``requests`` has cache_key and requested_at, ``cache`` has cache_key,
    stored_at and response_id. A stored response is usable for ``ttl_seconds``,
    unless a document changed after it was stored (``voided_at``, one row with
    ``changed_at``). Requests not served are computed once per key: the earliest
    one is flagged ``computed`` and the others reuse it.
    """
    usable = cache
    if voided_at is not None:
        last_change = voided_at.agg(F.max("changed_at").alias("t")).scalar()
        usable = usable.where(last_change.isNull() | (F.col("stored_at") > last_change))
    # As-of lookup: both sides in one time line, the last stored response so far.
    # A response stored at the moment of a request counts, hence the doubled clock.
    stored = usable.groupBy("cache_key", "stored_at").agg(F.max("response_id").alias("response_id"))
    line = stored.select(
        "cache_key",
        (F.unix_micros("stored_at") * 2).alias("__at"),
        F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"),
        F.struct(F.unix_micros("stored_at").alias("us"), "response_id").alias("__stored"),
    ).unionByName(
        requests.select("cache_key", (F.unix_micros("requested_at") * 2 + 1).alias("__at"), "request_id"),
        allowMissingColumns=True,
    )
    known = running(line, ["cache_key"], "__at", {"__hit": ("last", F.col("__stored"))}, CLOCK_SEGMENT)
    age = F.floor(F.col("__at") / 2) - F.col("__hit.us")
    best = known.where("request_id is not null").select(
        "request_id", F.when(age < ttl_seconds * 1_000_000, F.col("__hit.response_id")).alias("response_id")
    )
    served = requests.join(best, "request_id", "left")
    fresh = served.where("response_id is null").groupBy("cache_key").agg(
        F.min(F.struct("requested_at", "request_id")).alias("first")
    )
    return served.join(fresh, "cache_key", "left").select(
        *requests.columns,
        F.coalesce("response_id", F.col("first.request_id").cast("string")).alias("response_id"),
        F.col("response_id").isNotNull().alias("cache_hit"),
        (F.col("response_id").isNull() & (F.col("first.request_id") == F.col("request_id"))).alias("computed"),
    )
