"""Predicates: governance, payload, scope, facets and input validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.assets import is_visual_type
from shelfmark.functions.text import strip
from shelfmark.schemas import KB_STATUSES, REVIEW_STATUSES

DEFAULT_REVIEW_STATUS = "published"


def governance_predicate(filters: dict | None = None) -> Column:
    """Visible documents; only published ones unless the filters say otherwise.

    Values of the wrong type are ignored, except that an empty or non-text
    review status means published.
    """
    filters = filters or {}
    test = F.lit(True)
    if filters.get("include_unpublished") is not True:
        wanted = filters.get("review_status")
        usable = isinstance(wanted, str) and wanted != ""
        test = test & (F.col("review_status") == (wanted if usable else DEFAULT_REVIEW_STATUS))
    source = filters.get("governance_source_type")
    if isinstance(source, str):
        test = test & (F.col("governance_source_type") == source)
    level, at_most = filters.get("authority_level"), filters.get("max_authority_level")
    if isinstance(level, int):
        test = test & (F.col("authority_level") == int(level))
    if isinstance(at_most, int):
        test = test & (F.col("authority_level") <= int(at_most))
    return test


def governance_filter(df: DataFrame, filters: dict | None = None) -> DataFrame:
    return df.where(governance_predicate(filters))


def payload_filter(df: DataFrame, filters: dict | None = None) -> DataFrame:
    """Chunk type equality and every requested tag, pushed below the vector scan."""
    filters = filters or {}
    if isinstance(filters.get("chunk_type"), str):
        df = df.where(F.col("chunk_type") == filters["chunk_type"])
    tags = filters.get("tags")
    for tag in tags if isinstance(tags, list) else []:
        if isinstance(tag, str):
            df = df.where(F.array_contains("tags", tag))
    return df


def kb_scope(requests: DataFrame, kbs: DataFrame) -> DataFrame:
    """Resolve each request's KBs: adds ``kb_ids`` (active ones) and ``missing``.

    An absent or empty list means every active KB. ``missing`` counts requested
    ids that do not exist or are not active; ``scope_error`` names the problem.
    """
    active = kbs.where("status = 'active'").agg(
        F.sort_array(F.collect_set("kb_id")).alias("ids")
    ).scalar()
    asked = F.coalesce("kb_ids", F.array().cast(requests.schema["kb_ids"].dataType))
    everything = F.size(asked) == 0
    usable = F.when(everything, active).otherwise(F.array_intersect(asked, active))
    missing = F.when(everything, 0).otherwise(F.size(F.array_except(asked, active)))
    return requests.withColumns({"kb_ids": usable, "missing": missing}).withColumn(
        "scope_error",
        F.when(F.col("missing") > 0, "knowledge_base_not_found").when(
            F.size("kb_ids") == 0, "no_active_knowledge_base"
        ),
    )


#: Rows of a KB table that may be broadcast.
MAX_BROADCAST_KBS = 200_000


def beside(kbs: DataFrame) -> DataFrame:
    """A narrow table of KBs as one side of a join with documents or chunks: broadcast, if it has few rows.

    They are counted first. Left to itself Spark may deal both sides by KB, and all rows of
    a KB land in one task. A larger table has many KBs and is left to Spark.
    """
    few = kbs.limit(MAX_BROADCAST_KBS + 1).count() <= MAX_BROADCAST_KBS
    return F.broadcast(kbs) if few else kbs


def active_kbs(kbs: DataFrame) -> DataFrame:
    return kbs.where("status = 'active'").select("kb_id")


def open_scope(requests: DataFrame, kbs: DataFrame, key: str = "qid") -> DataFrame:
    """As ``kb_scope``, but a request for every active KB keeps ``kb_ids`` null instead of a list of them all.

    Listed ids are looked up one by one, so no request and no task holds the ids of the
    KBs that it did not name.
    """
    asked = requests.withColumn("__all", F.coalesce(F.size("kb_ids") <= 0, F.lit(True)))
    named = asked.where(~F.col("__all")).select(F.col(key).alias("__key"), F.posexplode(F.array_distinct("kb_ids")).alias("__at", "kb_id"))
    known = active_kbs(kbs).dropDuplicates().withColumn("__known", F.lit(True))
    usable = named.join(known, "kb_id", "left").groupBy("__key").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("__known"), F.struct("__at", "kb_id")))), lambda x: x["kb_id"]).alias("__ids"),
        F.count_if(F.col("__known").isNull()).cast("int").alias("__missing"),
    )
    none = active_kbs(kbs).agg(F.count(F.lit(1)) == 0).scalar()
    found = asked.join(usable, asked[key].eqNullSafe(F.col("__key")), "left")
    scoped = found.withColumns({"kb_ids": F.when(~F.col("__all"), F.col("__ids")), "missing": F.coalesce("__missing", F.lit(0))})
    error = F.when(F.col("missing") > 0, "knowledge_base_not_found").when(F.col("__all") & none, "no_active_knowledge_base")
    return scoped.withColumn("scope_error", error).drop("__all", "__key", "__ids", "__missing")


def facet_predicate(facet: str) -> Column:
    status = F.lower("status")
    if facet == "all":
        return F.lit(True)
    if facet == "active":
        return status.isin("pending", "processing")
    if facet == "failed":
        return status == "failed"
    return F.col("review_status") == facet


def facet_search(
    docs: DataFrame, facet: str = "all", source: str = "all", text: str = "", labels: dict | None = None
) -> DataFrame:
    """Documents of a facet and source whose visible fields contain a text."""
    found = docs.where(facet_predicate(facet))
    if source != "all":
        found = found.where(F.col("governance_source_type") == source)
    needle = text.strip().lower()
    if needle:
        label = F.col("governance_source_type")
        for value, shown in (labels or {}).items():
            label = F.when(F.col("governance_source_type") == value, shown).otherwise(label)
        shown = [
            F.col("name"),
            F.col("source_type"),
            F.coalesce("file_type", F.lit("")),
            F.col("status"),
            F.col("review_status"),
            label,
            F.coalesce("error_message", F.lit("")),
        ]
        found = found.where(F.contains(F.lower(F.concat_ws(" ", *shown)), F.lit(needle)))
    return found


def image_assets(assets: DataFrame) -> DataFrame:
    """Assets an image encoder can take."""
    return assets.where((F.col("asset_type") == "image") & is_visual_type(F.col("content_type")))


def include_metadata(df: DataFrame, flag: bool, columns: tuple[str, ...] = ("metadata",)) -> DataFrame:
    if flag:
        return df
    return df.withColumns({c: F.map_from_arrays(F.array(), F.array()).cast(df.schema[c].dataType) for c in columns})


def export_assets(assets: DataFrame, max_bytes: int = 2_000_000) -> DataFrame:
    """Base64 of each small enough asset; a larger one gets a reason instead."""
    limit = max(1, min(max_bytes, 10_000_000))
    fits = F.col("file_size") <= limit
    encoded = F.when(fits, F.base64("content"))
    # base64() wraps lines; the export is one line.
    flat = F.regexp_replace(encoded, r"[\r\n]", "")
    return assets.select(
        "document_id",
        "asset_id",
        "content_type",
        F.lit("base64").alias("encoding"),
        flat.alias("data"),
        F.when(
            F.col("content_type").startswith("image/"),
            F.concat(F.lit("data:"), "content_type", F.lit(";base64,"), flat),
        ).alias("data_uri"),
        F.when(~fits, F.concat(F.lit("asset is "), "file_size", F.lit(f" bytes, larger than max_bytes={limit}"))).alias(
            "reason"
        ),
    )


# --- validation ----------------------------------------------------------------


def _reason(*rules: tuple[Column, str]) -> Column:
    """Name of the first rule that fails; a null counts as failing."""
    test = None
    for ok, name in rules:
        bad = ~F.coalesce(ok, F.lit(False))
        test = F.when(bad, name) if test is None else test.when(bad, name)
    return test


def validate_documents(df: DataFrame) -> DataFrame:
    """Trim the governance source and add ``reason``, null for accepted rows."""
    source = strip(F.col("governance_source_type"))
    kind = F.coalesce("file_type", F.lit("txt"))
    return df.withColumn("governance_source_type", source).withColumn(
        "reason",
        _reason(
            (F.length("name").between(1, 500), "invalid_name"),
            (F.length("content") >= 1, "empty_content"),
            (kind.isin("txt", "md", "markdown"), "invalid_file_type"),
            (F.length("governance_source_type").between(1, 100), "invalid_governance_source_type"),
            (F.col("authority_level") >= 1, "invalid_authority_level"),
            (F.col("review_status").isin(REVIEW_STATUSES), "invalid_review_status"),
        ),
    )


def validate_kbs(df: DataFrame) -> DataFrame:
    """Add ``reason``: a null setting takes its default, a repeated name is refused."""
    shared = df.groupBy("name").agg(F.count(F.lit(1)).alias("__uses"))
    checked = df.join(shared, "name", "left")
    return checked.withColumn(
        "reason",
        _reason(
            (F.length("name").between(1, 255), "invalid_name"),
            (F.coalesce("embedding_dim", F.lit(1024)) >= 1, "invalid_embedding_dim"),
            (F.coalesce("chunk_size", F.lit(512)) >= 128, "invalid_chunk_size"),
            (F.coalesce("chunk_overlap", F.lit(50)) >= 0, "invalid_chunk_overlap"),
            (F.coalesce("status", F.lit("active")).isin(KB_STATUSES), "invalid_status"),
            (F.coalesce("__uses", F.lit(1)) == 1, "duplicate_name"),
        ),
    ).drop("__uses")


def validate_requests(df: DataFrame) -> DataFrame:
    """Add ``reason`` to search requests; a null option takes its default."""
    rules = [
        (F.length("query") >= 1, "empty_query"),
        (F.coalesce("top_k", F.lit(5)).between(1, 50), "invalid_top_k"),
        (F.coalesce("score_threshold", F.lit(0.0)) >= 0, "invalid_score_threshold"),
        (F.coalesce("max_sub_queries", F.lit(3)).between(1, 8), "invalid_max_sub_queries"),
    ]
    if "queries" in df.columns:
        rules.append((F.size("queries").between(1, 20), "invalid_query_count"))
    return df.withColumn("reason", _reason(*rules))


def accepted(df: DataFrame) -> DataFrame:
    return df.where("reason is null").drop("reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.where("reason is not null")


# --- listings ------------------------------------------------------------------


def bounded_limit(value: int, default: int = 50, maximum: int = 200) -> int:
    return default if value <= 0 else min(value, maximum)


def list_documents(docs: DataFrame, kb_id=None, status: str | None = "completed", limit: int = 50) -> DataFrame:
    """Newest documents first."""
    if kb_id is not None:
        docs = docs.where(F.col("kb_id") == kb_id)
    if status:
        docs = docs.where(F.col("status") == status)
    return docs.orderBy(F.desc("created_at"), F.asc("document_id")).limit(bounded_limit(limit))


def list_kbs(kbs: DataFrame, include_inactive: bool = False) -> DataFrame:
    shown = kbs if include_inactive else kbs.where("status = 'active'")
    return shown.orderBy(F.desc("created_at"), F.asc("kb_id"))


def list_assets(assets: DataFrame, document_id) -> DataFrame:
    return assets.where(F.col("document_id") == document_id).orderBy("asset_index")


def page_chunks(chunks: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of every document's ordered chunks, with the document's total.

    Chunk indices are dense from 0, so the page is a range filter that reaches
    the scan; the total is a separate count.
    """
    start = max(0, offset)
    page = chunks.where(
        (F.col("chunk_index") >= start) & (F.col("chunk_index") < start + bounded_limit(limit))
    )
    totals = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("total"))
    return page.join(totals, "document_id")


def _by_document(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows of a document together and in order; documents come in any order."""
    return rows.repartition("document_id").sortWithinPartitions("document_id", *order)


def version_history(versions: DataFrame) -> DataFrame:
    """Versions of each document, the newest first."""
    return _by_document(versions, F.desc("version_number"))


def audit_history(audit: DataFrame) -> DataFrame:
    """Audit events of each document, the newest first."""
    return _by_document(audit, F.desc("created_at"), F.desc("audit_id"))
