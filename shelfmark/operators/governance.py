"""Registration, versions, audit and lifecycle jobs over the document ledger.

State goes in and out as DataFrames. Updates are equi joins on document_id and
deletions are anti joins, so a document with very many rows is handled by
adaptive skew splitting and nothing is gathered per key.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.hashing import text_hash
from shelfmark.functions.progress import progress_struct
from shelfmark.operators.filters import beside
from shelfmark.operators.segments import running
from shelfmark.schemas import SNAPSHOT_FIELDS, VERSION_FIELDS
from shelfmark.session import cut_lineage

SKIP_DETAIL = {
    # Messages of skipped uploads.
    "duplicate_name": "Skipped because a document with the same name already exists.",
    "duplicate_file_hash": "Skipped because a document with the same file hash already exists.",
    "empty_file": "Skipped because the uploaded file is empty.",
}
# Default summaries.
GOVERNANCE_SUMMARY = "Governance metadata updated"
CONTENT_SUMMARY = "Source content updated"
REPROCESS_SUMMARY = "Document queued for reprocessing"
DELETE_SUMMARY = "Document deleted"
MIGRATED_SUMMARY = "Initial migrated version"
ERROR_CHARS = 2000


# --- duplicates --------------------------------------------------------------------


def find_duplicates(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``duplicate_of`` and ``reason`` from documents already in the same KB.

    A name match wins over a hash match; a null hash never matches. Existing rows
    are cut down to the incoming keys before they are aggregated, so a small batch
    does not shuffle the whole corpus.
    """

    def matches(key: str, alias: str) -> DataFrame:
        wanted = incoming.select("kb_id", key).where(F.col(key).isNotNull()).distinct()
        held = existing.select("kb_id", key, "document_id").join(wanted, ["kb_id", key], "left_semi")
        return held.groupBy("kb_id", key).agg(F.min("document_id").alias(alias))

    by_name, by_hash = matches("name", "__named"), matches("file_hash", "__hashed")
    joined = incoming.join(by_name, ["kb_id", "name"], "left").join(by_hash, ["kb_id", "file_hash"], "left")
    return joined.select(
        *incoming.columns,
        F.coalesce("__named", "__hashed").alias("duplicate_of"),
        F.when(F.col("__named").isNotNull(), "duplicate_name")
        .when(F.col("__hashed").isNotNull(), "duplicate_file_hash")
        .alias("reason"),
    )


#: Rounds that settle short chains, and rows of a group that one task goes through in order.
DEDUP_ROUNDS = 2
DEDUP_SEGMENT = 200_000


def _first_come(rows: pa.Table) -> pa.Table:
    """Rows of one group that are accepted when taken in order of position."""
    rows = rows.sort_by("__p")
    names, hashes, kept = set(), set(), []
    keys = zip(*(rows.column(c).to_pylist() for c in ("kb_id", "name", "file_hash")))
    for i, (kb, name, digest) in enumerate(keys):
        if (name is not None and (kb, name) in names) or (digest is not None and (kb, digest) in hashes):
            continue
        names.add((kb, name))
        hashes.add((kb, digest))
        kept.append(i)
    return rows.take(kept)


def dependent_groups(rows: DataFrame) -> DataFrame:
    """Add ``__group``: the least position among rows that hang together by names or hashes of their KB.

    Every round takes the least label of each name and of each hash and then the label of
    that row's own label, so paths shrink by doubling.
    """
    labelled = cut_lineage(rows.withColumn("__group", F.col("__p")).withColumn("__moved", F.lit(True)))
    while not labelled.where("__moved").isEmpty():
        least = lambda key: labelled.where(F.col(key).isNotNull()).groupBy("kb_id", key).agg(F.min("__group").alias(f"__{key}"))
        hooked = labelled.join(least("name"), ["kb_id", "name"], "left").join(least("file_hash"), ["kb_id", "file_hash"], "left")
        hooked = hooked.withColumn("__hook", F.least("__group", "__name", "__file_hash"))
        leaders = labelled.select(F.col("__p").alias("__hook"), F.col("__group").alias("__next"))
        jumped = hooked.join(leaders, "__hook")
        labelled = cut_lineage(jumped.select(*rows.columns, F.col("__next").alias("__group"), (F.col("__next") != F.col("__group")).alias("__moved")))
    return labelled.drop("__moved")


def batch_dedup(incoming: DataFrame, position: str = "position", segment: int = DEDUP_SEGMENT) -> DataFrame:
    """First-come acceptance inside one batch: adds ``reason`` (null when accepted).

    A row is refused when an earlier accepted row of its KB has its name or its hash;
    refused rows block nobody, and a missing name or hash matches nothing. ``position`` is
    a unique number. Two rounds settle, for every name
    and every hash, the earliest open row. What is open then hangs in longer chains. The
    first rows of a chain do not depend on later ones, so the earliest ``segment`` rows of
    each KB, or of each group of dependent rows where a KB has more open, are gone through
    in order by one task per group; what they block goes, and the next segment follows.
    """
    def by_name(df: DataFrame, alias: str) -> DataFrame:
        return df.groupBy("kb_id", "name").agg(F.min("__p").alias(alias))

    def by_hash(df: DataFrame, alias: str) -> DataFrame:
        hashed = df.where("file_hash is not null")
        return hashed.groupBy("kb_id", "file_hash").agg(F.min("__p").alias(alias))

    def looked_up(df: DataFrame, source: DataFrame) -> DataFrame:
        named = df.join(by_name(source, "__named"), ["kb_id", "name"], "left")
        return named.join(by_hash(source, "__hashed"), ["kb_id", "file_hash"], "left")

    def unblocked(df: DataFrame, winners: DataFrame) -> DataFrame:
        return cut_lineage(looked_up(df, winners).where("__named is null and __hashed is null").select(*columns))

    p, columns = F.col("__p"), ["kb_id", "name", "file_hash", "__p"]
    open_rows = cut_lineage(incoming.select("kb_id", "name", "file_hash", F.col(position).alias("__p")))
    accepted = open_rows.limit(0)
    for _ in range(DEDUP_ROUNDS):
        leads = F.coalesce(F.col("__named") == p, F.lit(True)) & F.coalesce(F.col("__hashed") == p, F.lit(True))
        winners = cut_lineage(looked_up(open_rows, open_rows).where(leads).select(*columns))
        accepted = accepted.unionByName(winners)
        open_rows = unblocked(open_rows, winners)
    schema = open_rows.schema
    while most := open_rows.groupBy("kb_id").count().agg(F.max("count")).first()[0]:
        grouped = open_rows.withColumn("__group", F.col("kb_id")) if most <= segment else dependent_groups(open_rows)
        if most <= segment:
            first, later = grouped, None
        else:
            # The position below which about ``segment`` rows of a group lie, from 200 quantiles taken while it is counted.
            marks = F.percentile_approx("__p", [n / 200 for n in range(1, 201)], 2000)
            cuts = grouped.groupBy("__group").agg(F.min("__p").alias("__low"), F.count("*").alias("__n"), marks.alias("__marks"))
            rank = F.least(F.lit(200.0), F.lit(200.0 * segment) / F.col("__n"))
            inside = F.floor(F.col("__low") + (F.element_at("__marks", 1) - F.col("__low")) * rank)
            bound = F.when(rank >= 1, F.element_at("__marks", F.floor(rank).cast("int"))).otherwise(inside)
            cuts = cuts.select("__group", bound.alias("__bound"))
            placed = grouped.join(cuts, "__group")
            first, later = placed.where(p <= F.col("__bound")).drop("__bound"), placed.where(p > F.col("__bound")).select(*columns)
        winners = cut_lineage(first.groupBy("__group").applyInArrow(lambda rows: _first_come(rows.select(columns)), schema))
        accepted = accepted.unionByName(winners)
        if later is None:
            break
        open_rows = unblocked(later, winners)
    # The reason is read off at the end: a name match counts even if a hash match came first.
    judged = looked_up(incoming.withColumn("__p", F.col(position)), accepted)
    return judged.select(
        *incoming.columns,
        F.when(F.col("__named") < p, "duplicate_name")
        .when(F.col("__hashed") < p, "duplicate_file_hash")
        .alias("reason"),
    )


# --- snapshots, versions, audit -------------------------------------------------------


def snapshot(prefix: str = "") -> Column:
    """Governance snapshot of a document as a struct."""
    return F.struct(*[F.col(f"{prefix}{f}").alias(f) for f in SNAPSHOT_FIELDS])


def audit_events(
    changed: DataFrame, action: str, summary: Column | str, before: Column | None, after: Column | None
) -> DataFrame:
    """Append-only audit rows for a set of changed documents."""
    empty = F.lit(None).cast(changed.select(snapshot().alias("s")).schema["s"].dataType)
    text = F.lit(summary) if isinstance(summary, str) else summary
    return changed.select(
        "document_id",
        "kb_id",
        F.lit(action).alias("action"),
        text.alias("summary"),
        (empty if before is None else before).alias("before"),
        (empty if after is None else after).alias("after"),
    )


def version_rows(docs: DataFrame, number: Column, summary: Column | str) -> DataFrame:
    text = F.lit(summary) if isinstance(summary, str) else summary
    return docs.select(
        *VERSION_FIELDS, number.cast("int").alias("version_number"), text.alias("change_summary")
    )


def latest_versions(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """Highest version number of the changed documents only."""
    touched = versions.select("document_id", "version_number").join(
        changes.select("document_id").distinct(), "document_id", "left_semi"
    )
    return touched.groupBy("document_id").agg(F.max("version_number").alias("__latest"))


def next_version(changes: DataFrame, versions: DataFrame, order: str = "change_seq") -> DataFrame:
    """Add ``version_number``: consecutive numbers after each document's latest version.

    ``order`` is an integer. Positions come from a two-level running count, so one
    document may own most of the batch.
    """
    latest = latest_versions(versions, changes)
    counted = running(changes, ["document_id"], order, {"__nth": ("sum", F.lit(1))})
    return counted.join(latest, "document_id", "left").select(
        *changes.columns,
        (F.coalesce("__latest", F.lit(0)) + F.col("__nth")).cast("int").alias("version_number"),
    )


def backfill_versions(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """A first version row for every document that has none."""
    bare = docs.join(versions.select("document_id"), "document_id", "left_anti")
    return version_rows(bare, F.lit(1), MIGRATED_SUMMARY)


# --- jobs -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Registration:
    documents: DataFrame
    versions: DataFrame
    audit: DataFrame
    outcome: DataFrame


def register_documents(incoming: DataFrame, existing: DataFrame, summary: str = "uploaded") -> Registration:
    """Register a batch: refuse empty files and duplicates, create the rest.

    ``incoming`` rows carry document_id, kb_id, position, name, type, size, hash
    and governance fields. Existing documents are checked first, then the batch
    against itself.
    """
    sized = incoming.withColumn("__empty", F.coalesce(F.col("file_size") == 0, F.lit(False)))
    known = find_duplicates(sized, existing)
    fresh = known.where("reason is null and not __empty").drop("reason", "duplicate_of", "__empty")
    accepted = batch_dedup(fresh)
    created = accepted.where("reason is null").select(
        *incoming.columns,
        F.lit("pending").alias("status"),
        F.lit(1).alias("current_version"),
        F.lit(0).alias("chunk_count"),
        progress_struct("queued", 10, "pending", "Queued for worker").alias("ingestion_progress"),
    )
    refused = known.where("reason is not null or __empty").select(
        "document_id",
        "kb_id",
        "name",
        F.when(F.col("__empty"), "empty_file").otherwise(F.col("reason")).alias("reason"),
    )
    verdicts = refused.unionByName(accepted.select("document_id", "kb_id", "name", "reason"))
    detail = F.lit(None).cast("string")
    for reason, text in SKIP_DETAIL.items():
        detail = F.when(F.col("reason") == reason, text).otherwise(detail)
    outcome = verdicts.withColumns(
        {"status": F.when(F.col("reason").isNull(), "created").otherwise("skipped"), "detail": detail}
    )
    return Registration(
        created,
        version_rows(created, F.lit(1), f"Initial {summary} document"),
        audit_events(created, "document.created", f"{summary.capitalize()} document created", None, snapshot()),
        outcome,
    )


@dataclass(frozen=True)
class Ledger:
    """Documents after a change, with the version and audit rows to append and the refused changes."""

    documents: DataFrame
    versions: DataFrame
    audit: DataFrame
    rejected: DataFrame


_GOVERNED = ("governance_source_type", "authority_level", "review_status")


def _refused(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes for documents that are not in the ledger, with ``reason``."""
    return changes.join(docs.select("document_id"), "document_id", "left_anti").withColumn("reason", F.lit("document_not_found"))


def _numbered(docs: DataFrame, changes: DataFrame, versions: DataFrame) -> DataFrame:
    """Changes of known documents with consecutive version numbers.

    Several changes of one document follow ``change_seq``; without that column, or where
    it repeats, the values decide.
    """
    known = changes.join(docs.select("document_id"), "document_id", "left_semi")
    if "change_seq" not in changes.columns:
        known = known.withColumn("change_seq", F.xxhash64(*changes.columns))
    return next_version(known, versions)


def _last(changed: DataFrame) -> DataFrame:
    """The rows with each document's highest version number."""
    newest = changed.groupBy("document_id").agg(F.max("version_number").alias("version_number"))
    return changed.join(newest, ["document_id", "version_number"], "left_semi")


def update_governance(docs: DataFrame, changes: DataFrame, versions: DataFrame) -> Ledger:
    """Apply partial governance changes in the order of ``change_seq``.

    Only supplied (non-null) fields change. A row that supplies none is a no-op: no
    version and no audit row. Every other row gets a version and an audit row of its own,
    whose snapshots hold the state before and after that one change.
    """
    supplied = F.lit(False)
    for field in _GOVERNED:
        supplied = supplied | F.col(field).isNotNull()
    order = ["change_seq"] if "change_seq" in changes.columns else []
    wanted = changes.where(supplied).select("document_id", *order, *[F.col(f).alias(f"__new_{f}") for f in _GOVERNED], "change_summary")
    numbered = _numbered(docs, wanted, versions)
    states = running(numbered, ["document_id"], "version_number", {f"__set_{f}": ("last", F.col(f"__new_{f}")) for f in _GOVERNED})
    states = cut_lineage(states.select("document_id", "version_number", "change_summary", *[f"__set_{f}" for f in _GOVERNED]))
    earlier = states.select("document_id", (F.col("version_number") + 1).alias("version_number"), F.lit(True).alias("__chained"), *[F.col(f"__set_{f}").alias(f"__was_{f}") for f in _GOVERNED])
    paired = states.join(earlier, ["document_id", "version_number"], "left").withColumn(
        "__summary", F.coalesce(F.nullif("change_summary", F.lit("")), F.lit(GOVERNANCE_SUMMARY))
    ).drop("change_summary")
    old = docs.join(paired, "document_id")
    fields = [*_GOVERNED, "current_version"]
    held = old.withColumns({f"__old_{f}": F.col(f) for f in fields})
    was = {f: F.coalesce(f"__was_{f}", f) for f in _GOVERNED}
    was["current_version"] = F.when(F.col("__chained"), F.col("version_number") - 1).otherwise(F.col("current_version"))
    before = held.withColumns(was).withColumn("__before", snapshot()).withColumns({f: F.col(f"__old_{f}") for f in fields})
    changed = before.withColumns({f: F.coalesce(f"__set_{f}", f) for f in _GOVERNED} | {"current_version": F.col("version_number")})
    untouched = docs.join(states.select("document_id"), "document_id", "left_anti")
    return Ledger(
        untouched.unionByName(_last(changed).select(*docs.columns)),
        version_rows(changed, F.col("version_number"), F.col("__summary")),
        audit_events(changed, "document.governance_updated", F.col("__summary"), F.col("__before"), snapshot()),
        _refused(docs, changes),
    )


@dataclass(frozen=True)
class ContentChange:
    documents: DataFrame
    versions: DataFrame
    audit: DataFrame
    chunks: DataFrame
    assets: DataFrame
    rejected: DataFrame | None = None
    snapshots: DataFrame | None = None


def update_content(
    docs: DataFrame, changes: DataFrame, versions: DataFrame, chunks: DataFrame, assets: DataFrame
) -> ContentChange:
    """Replace source text: the document becomes pending inline text without chunks.

    Several changes of one document follow ``change_seq``: each gets a version and an
    audit row, the last one's text stays.
    """
    kind = F.coalesce("file_type", F.lit("md"))
    order = ["change_seq"] if "change_seq" in changes.columns else []
    wanted = changes.select(
        "document_id",
        *order,
        F.col("content").alias("__text"),
        F.when(kind == "markdown", "md").otherwise(kind).alias("__type"),
        F.coalesce(F.nullif("change_summary", F.lit("")), F.lit(CONTENT_SUMMARY)).alias("__summary"),
    )
    base = docs.withColumn("__before", snapshot())
    old = base.join(_numbered(docs, wanted, versions).drop("change_seq"), "document_id")
    new_values = {
        "source_type": F.lit("text"),
        "source_url": F.lit(None).cast("string"),
        "minio_path": F.lit(None).cast("string"),
        "file_type": F.col("__type"),
        "file_size": F.octet_length("__text").cast("bigint"),
        "file_hash": text_hash(F.col("__text")),
        "content": F.col("__text"),
        "status": F.lit("pending"),
        "error_message": F.lit(None).cast("string"),
        "chunk_count": F.lit(0),
        "current_version": F.col("version_number"),
    }
    changed = old.withColumns({k: v for k, v in new_values.items() if k in docs.columns})
    ids = wanted.select("document_id")
    untouched = docs.join(ids, "document_id", "left_anti")
    return ContentChange(
        untouched.unionByName(_last(changed).select(*docs.columns)),
        version_rows(changed, F.col("version_number"), F.col("__summary")),
        audit_events(changed, "document.content_updated", F.col("__summary"), F.col("__before"), snapshot()),
        delete_rows(chunks, ids),
        delete_rows(assets, ids),
        _refused(docs, changes),
    )


def reprocess(docs: DataFrame, ids: DataFrame, chunks: DataFrame, assets: DataFrame, snapshots: DataFrame | None = None) -> ContentChange:
    """Queue documents again: chunks, assets and the snapshots of parsed texts go, no version is written."""
    wanted = ids.select("document_id").distinct()
    reset = docs.join(wanted, "document_id", "left_semi").withColumns(
        {
            "status": F.lit("pending"),
            "error_message": F.lit(None).cast("string"),
            "chunk_count": F.lit(0),
        }
    )
    untouched = docs.join(wanted, "document_id", "left_anti")
    return ContentChange(
        untouched.unionByName(reset.select(*docs.columns)),
        version_rows(reset.limit(0), F.lit(0), ""),
        audit_events(reset, "document.reprocessed", REPROCESS_SUMMARY, None, snapshot()),
        delete_rows(chunks, wanted),
        delete_rows(assets, wanted),
        snapshots=None if snapshots is None else delete_rows(snapshots, wanted),
    )


def delete_rows(table: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """New rows replace old rows of the same key."""
    keys = [key] if isinstance(key, str) else key
    kept = old.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def delete_documents(
    tables: dict[str, DataFrame], ids: DataFrame, audited: bool = True
) -> dict[str, DataFrame]:
    """Delete documents with their versions, assets, chunks and points.

    Audit rows stay but lose their document id. Deleting documents adds a
    ``document.deleted`` audit row each.
    """
    wanted = ids.select("document_id").distinct()
    out = {n: delete_rows(t, wanted) for n, t in tables.items() if n != "audit"}
    if "audit" in tables:
        audit = tables["audit"]
        if audited:
            gone = tables["documents"].join(wanted, "document_id", "left_semi")
            events = audit_events(gone, "document.deleted", DELETE_SUMMARY, snapshot(), None)
            audit = audit.unionByName(events, allowMissingColumns=True)
        marked = audit.join(wanted.withColumn("__gone", F.lit(True)), "document_id", "left")
        out["audit"] = marked.withColumn(
            "document_id", F.when(F.col("__gone").isNull(), F.col("document_id"))
        ).drop("__gone")
    return out


def delete_kbs(tables: dict[str, DataFrame], kbs: DataFrame, kb_ids: DataFrame) -> dict[str, DataFrame]:
    """Delete KBs and everything in them; no audit row is written."""
    gone = tables["documents"].join(beside(kb_ids.select("kb_id").distinct()), "kb_id", "left_semi").select("document_id")
    out = delete_documents(tables, gone, audited=False)
    out["knowledge_bases"] = delete_rows(kbs, kb_ids, "kb_id")
    return out


KB_FIELDS = ("name", "chunk_size", "chunk_overlap", "status")


def update_kbs(kbs: DataFrame, changes: DataFrame) -> DataFrame:
    """Partial update of the mutable KB settings."""
    fields = [f for f in KB_FIELDS if f in changes.columns]
    new = changes.select("kb_id", *[F.col(f).alias(f"__new_{f}") for f in fields])
    joined = kbs.join(new, "kb_id", "left")
    return joined.withColumns({f: F.coalesce(f"__new_{f}", f) for f in fields}).select(*kbs.columns)


def mark_outcomes(docs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Write ingestion outcomes (document_id, error, chunk_count) onto documents.

    An error makes the document failed with the message cut to 2000 characters;
    success clears the error and sets the chunk count. Both end at progress 100.
    """
    seen = outcomes.select(
        "document_id",
        F.lit(True).alias("__seen"),
        F.col("error").alias("__error"),
        F.col("chunk_count").alias("__chunks"),
    )
    joined = docs.join(seen, "document_id", "left")
    failed = F.col("__error").isNotNull()
    reported = F.col("__seen").isNotNull()
    return joined.withColumns(
        {
            "status": F.when(failed, "failed").when(reported, "completed").otherwise(F.col("status")),
            "error_message": F.when(failed, F.substring("__error", 1, ERROR_CHARS))
            .when(reported, F.lit(None).cast("string"))
            .otherwise(F.col("error_message")),
            "chunk_count": F.when(reported & ~failed, F.col("__chunks")).otherwise(F.col("chunk_count")),
            "progress": F.when(reported, F.lit(100)),
        }
    ).drop("__seen", "__error", "__chunks")


def point_payload(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Filter fields of each search point, always read from the current documents."""
    governed = docs.select(
        "document_id",
        "created_at",
        "governance_source_type",
        "authority_level",
        "review_status",
        F.col("current_version").alias("document_version"),
    )
    return chunks.select("chunk_id", "document_id", "kb_id", "chunk_type", "tags").join(governed, "document_id")
