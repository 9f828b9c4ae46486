"""Checks of registration, versions, audit, lifecycle jobs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfmark import fixtures as X
from shelfmark.checks.base import check
from shelfmark.functions.text import parsed_content_type
from shelfmark.operators import filters as B
from shelfmark.operators import governance as G
from shelfmark.session import private_folder
from shelfmark.sources import sinks as S
from shelfmark.sources.tables import read_table
from shelfmark.streaming import ingest as N
from shelfmark.streaming.ratelimit import admission_sink, rate_limit

big = "bigint"


def split_documents(spark, sf):
    d = X.documents(spark, sf).withColumn("position", F.col("document_id"))
    return d.where("document_id % 10 <> 9"), d.where("document_id % 10 = 9")


DUPLICATES_SQL = """SELECT i.document_id, coalesce(n.d, h.d) AS duplicate_of,
  CASE WHEN n.d IS NOT NULL THEN 'duplicate_name' WHEN h.d IS NOT NULL THEN 'duplicate_file_hash' END AS reason
FROM (SELECT * FROM docs WHERE document_id % 10 = 9) i
LEFT JOIN (SELECT kb_id, name, min(document_id) AS d FROM docs WHERE document_id % 10 <> 9 GROUP BY ALL) n ON n.kb_id = i.kb_id AND n.name = i.name
LEFT JOIN (SELECT kb_id, file_hash, min(document_id) AS d FROM docs WHERE document_id % 10 <> 9 GROUP BY ALL) h ON h.kb_id = i.kb_id AND h.file_hash = i.file_hash"""


@check(
    "find_duplicates",
    f"SELECT document_id, coalesce(duplicate_of, -1) AS duplicate_of, reason FROM ({DUPLICATES_SQL})",
    ("docs",),
)
def _(spark, sf):
    existing, incoming = split_documents(spark, sf)
    return G.find_duplicates(incoming, existing).select(
        "document_id", F.coalesce("duplicate_of", F.lit(-1).cast(big)).alias("duplicate_of"), "reason"
    )


@check("batch_dedup", "SELECT document_id, reason FROM dedup_steps", ("dedup_steps",))
def _(spark, sf):
    d = X.documents(spark, sf)
    batch = d.select("document_id", (F.col("document_id") % 2).alias("kb_id"), "name", "file_hash", F.col("document_id").alias("position"))
    return G.batch_dedup(batch).select("document_id", "reason")


@check(
    "register_documents",
    f"""SELECT document_id, CASE WHEN reason IS NULL THEN 'created' ELSE 'skipped' END AS status, reason FROM (
  SELECT document_id, CASE WHEN reason IS NOT NULL THEN reason
    WHEN row_number() OVER (PARTITION BY reason IS NULL, kb_id, file_hash ORDER BY document_id) > 1 THEN 'duplicate_file_hash' END AS reason
  FROM ({DUPLICATES_SQL}) JOIN docs USING (document_id))""",
    ("docs",),
)
def _(spark, sf):
    existing, incoming = split_documents(spark, sf)
    keep = [c for c in incoming.columns if c not in ("status", "current_version", "chunk_count", "error_message")]
    done = G.register_documents(incoming.select(*keep), existing)
    return done.outcome.select("document_id", "status", "reason")


# --- versions -----------------------------------------------------------------------------------------


def versions(spark, sf):
    """One version per document, a second one for every third."""
    d = X.documents(spark, sf)
    first = G.version_rows(d, F.lit(1), "Initial text document")
    return first.unionByName(G.version_rows(d.where("document_id % 3 = 0"), F.lit(2), "Second"))


VERSIONS = "(SELECT doc_id AS document_id, 1 AS v FROM documents UNION ALL SELECT doc_id, 2 FROM documents WHERE doc_id % 3 = 0)"


@check(
    "next_version",
    """SELECT o_orderkey AS change_seq, o_custkey AS document_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) +
  CASE WHEN o_custkey IN (SELECT doc_id FROM documents) THEN CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE 1 END ELSE 0 END)::bigint AS version_number FROM orders""",
)
def _(spark, sf):
    changes = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("change_seq"))
    out = G.next_version(changes, versions(spark, sf))
    return out.select("change_seq", "document_id", F.col("version_number").cast(big).alias("version_number"))


@check(
    "version_history",
    f"SELECT document_id, v::bigint AS version_number, CASE v WHEN 1 THEN 'Initial text document' ELSE 'Second' END AS change_summary FROM {VERSIONS}",
)
def _(spark, sf):
    h = B.version_history(versions(spark, sf))
    return h.select("document_id", F.col("version_number").cast(big).alias("version_number"), "change_summary")


@check(
    "backfill_versions",
    "SELECT document_id, 1::bigint AS version_number, name, file_hash, 'Initial migrated version' AS change_summary FROM docs WHERE document_id % 3 <> 0",
    ("docs",),
)
def _(spark, sf):
    held = versions(spark, sf).where("document_id % 3 = 0")
    out = G.backfill_versions(X.documents(spark, sf), held)
    return out.select("document_id", F.col("version_number").cast(big).alias("version_number"), "name", "file_hash", "change_summary")


def governance_changes(spark, sf):
    i = F.col("document_id")
    return X.documents(spark, sf).where((i % 7 == 0) | (i % 11 == 0) | (i % 13 == 0)).select(
        "document_id",
        F.lit(None).cast("string").alias("governance_source_type"),
        F.when(i % 11 == 0, 1).alias("authority_level"),
        F.when(i % 7 == 0, "published").alias("review_status"),
        F.when(i % 2 == 0, "Reviewed again").alias("change_summary"),
    )


@check(
    "update_governance",
    """SELECT document_id, CASE WHEN document_id % 7 = 0 THEN 'published' ELSE review_status END AS review_status,
  CASE WHEN document_id % 11 = 0 THEN 1 ELSE authority_level END::bigint AS authority_level,
  CASE WHEN document_id % 7 = 0 OR document_id % 11 = 0 THEN CASE WHEN document_id % 3 = 0 THEN 3 ELSE 2 END ELSE 1 END::bigint AS current_version FROM docs""",
    ("docs",),
)
def _(spark, sf):
    ledger = G.update_governance(X.documents(spark, sf), governance_changes(spark, sf), versions(spark, sf))
    return ledger.documents.select(
        "document_id", "review_status", F.col("authority_level").cast(big).alias("authority_level"), F.col("current_version").cast(big).alias("current_version")
    )


@check(
    "audit_events",
    """SELECT document_id, 'document.governance_updated' AS action, CASE WHEN document_id % 2 = 0 THEN 'Reviewed again' ELSE 'Governance metadata updated' END AS summary,
  review_status AS before_status, CASE WHEN document_id % 7 = 0 THEN 'published' ELSE review_status END AS after_status,
  1::bigint AS before_version, CASE WHEN document_id % 3 = 0 THEN 3 ELSE 2 END::bigint AS after_version
FROM docs WHERE document_id % 7 = 0 OR document_id % 11 = 0""",
    ("docs",),
)
def _(spark, sf):
    audit = G.update_governance(X.documents(spark, sf), governance_changes(spark, sf), versions(spark, sf)).audit
    return audit.select(
        "document_id",
        "action",
        "summary",
        F.col("before.review_status").alias("before_status"),
        F.col("after.review_status").alias("after_status"),
        F.col("before.current_version").cast(big).alias("before_version"),
        F.col("after.current_version").cast(big).alias("after_version"),
    )


@check(
    "audit_history",
    "SELECT user_id AS document_id, event_id AS audit_id, event_type AS action FROM events",
)
def _(spark, sf):
    e = read_table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("audit_id"), F.col("event_type").alias("action"), F.col("ts").alias("created_at"))
    return B.audit_history(rows).select("document_id", "audit_id", "action")


@check(
    "governance_chain",
    """SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 2 ELSE 1 END + row_number() OVER (PARTITION BY document_id ORDER BY seq) AS version,
  b AS before_status, a AS after_status, NULL::varchar AS reason FROM (
  SELECT document_id, 1 AS seq, review_status AS b, 'published' AS a FROM docs WHERE document_id % 7 = 0
  UNION ALL SELECT document_id, 2, CASE WHEN document_id % 7 = 0 THEN 'published' ELSE review_status END, CASE WHEN document_id % 7 = 0 THEN 'published' ELSE review_status END FROM docs WHERE document_id % 5 = 0
  UNION ALL SELECT document_id, 3, 'published', 'reviewed' FROM docs WHERE document_id % 35 = 0)
UNION ALL SELECT document_id + 1000000000, 0, NULL, NULL, 'document_not_found' FROM docs WHERE document_id % 5 = 0""",
    ("docs",),
)
def _(spark, sf):
    """Up to three changes for a document, each with its own version, and changes for unknown documents."""
    d = X.documents(spark, sf)
    i = F.col("document_id")
    none = F.lit(None).cast("string")

    def change(which, seq, level, status, shift=0):
        return d.where(which).select(
            (i + shift).alias("document_id"), F.lit(seq).alias("change_seq"), none.alias("governance_source_type"),
            F.lit(level).cast("int").alias("authority_level"), F.lit(status).cast("string").alias("review_status"), none.alias("change_summary"),
        )

    changes = change(i % 7 == 0, 1, None, "published").union(change(i % 5 == 0, 2, 2, None)).union(change(i % 35 == 0, 3, None, "reviewed"))
    ledger = G.update_governance(d, changes.union(change(i % 5 == 0, 1, 3, None, 1_000_000_000)), versions(spark, sf))
    made = ledger.audit.select(
        "document_id", F.col("after.current_version").cast(big).alias("version"), F.col("before.review_status").alias("before_status"), F.col("after.review_status").alias("after_status"), none.alias("reason")
    )
    refused = ledger.rejected.select("document_id", F.lit(0).cast(big).alias("version"), none.alias("before_status"), none.alias("after_status"), "reason")
    return made.union(refused)


# --- content, reprocess, deletion ---------------------------------------------------------------------------


def children(spark, sf):
    chunks = X.chunks(spark, sf).select("document_id", "kb_id", "chunk_id")
    assets = X.visual_index(spark, sf).select("document_id", "asset_id")
    return chunks, assets


@check(
    "update_content",
    """SELECT document_id, 'text' AS source_type, CASE WHEN document_id % 10 = 0 THEN CASE WHEN document_id % 20 = 0 THEN 'md' ELSE 'txt' END ELSE 'txt' END AS file_type,
  CASE WHEN document_id % 10 = 0 THEN strlen('new ' || content) ELSE file_size END AS file_size,
  CASE WHEN document_id % 10 = 0 THEN sha256('new ' || content) ELSE file_hash END AS file_hash,
  CASE WHEN document_id % 10 = 0 THEN 'pending' ELSE status END AS status,
  coalesce(n, 0) AS chunks_left FROM docs LEFT JOIN (SELECT document_id AS d, count(*) AS n FROM chunks WHERE document_id % 10 <> 0 GROUP BY 1) ON d = document_id""",
    ("docs", "chunks"),
)
def _(spark, sf):
    d = X.documents(spark, sf)
    i = F.col("document_id")
    changes = d.where(i % 10 == 0).select(
        "document_id",
        F.concat(F.lit("new "), "content").alias("content"),
        F.when(i % 20 == 0, "markdown").otherwise("txt").alias("file_type"),
        F.lit(None).cast("string").alias("change_summary"),
    )
    out = G.update_content(d, changes, versions(spark, sf), *children(spark, sf))
    left = out.chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return out.documents.join(left, "document_id", "left").select(
        "document_id", "source_type", "file_type", "file_size", "file_hash", "status", F.coalesce("n", F.lit(0)).cast(big).alias("chunks_left")
    )


@check(
    "reprocess",
    """SELECT document_id, CASE WHEN document_id % 6 = 5 THEN 'pending' ELSE status END AS status,
  CASE WHEN document_id % 6 = 5 THEN NULL ELSE error_message END AS error_message,
  CASE WHEN document_id % 6 = 5 THEN 'document.reprocessed' END AS action FROM docs""",
    ("docs",),
)
def _(spark, sf):
    d = X.documents(spark, sf)
    out = G.reprocess(d, d.where("status = 'failed'").select("document_id"), *children(spark, sf))
    return out.documents.join(out.audit.select("document_id", "action"), "document_id", "left").select(
        "document_id", "status", "error_message", "action"
    )


@check(
    "cascade_delete",
    """SELECT 'documents' AS tbl, count(*) AS n FROM docs WHERE document_id % 5 <> 2
UNION ALL SELECT 'versions', count(*) FROM docs WHERE document_id % 5 <> 2
UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE document_id % 5 <> 2
UNION ALL SELECT 'audit', count(*) FROM docs WHERE document_id % 5 = 2 OR document_id % 2 = 0
UNION ALL SELECT 'audit_detached', count(*) FILTER (WHERE document_id % 5 = 2) + count(*) FILTER (WHERE document_id % 5 = 2 AND document_id % 2 = 0)
  FROM docs
UNION ALL SELECT 'kb_documents', count(*) FROM docs WHERE kb_id <> 1
UNION ALL SELECT 'kb_chunks', count(*) FROM chunks WHERE kb_id <> 1
UNION ALL SELECT 'knowledge_bases', count(*) FROM kbs WHERE kb_id <> 1""".replace(
        "SELECT 'audit', count(*) FROM docs WHERE document_id % 5 = 2 OR document_id % 2 = 0",
        "SELECT 'audit', count(*) FILTER (WHERE document_id % 5 = 2) + count(*) FILTER (WHERE document_id % 2 = 0) FROM docs",
    ),
    ("docs", "chunks", "kbs"),
)
def _(spark, sf):
    d = X.documents(spark, sf)
    chunks, _assets = children(spark, sf)
    audit = G.audit_events(d.where("document_id % 2 = 0"), "document.created", "x", None, G.snapshot())
    tables = {
        "documents": d,
        "versions": G.version_rows(d, F.lit(1), "x"),
        "chunks": chunks,
        "audit": audit,
    }
    out = G.delete_documents(tables, d.where("document_id % 5 = 2"))
    kbs = X.knowledge_bases(spark, sf)
    kb_out = G.delete_kbs({"documents": d, "chunks": chunks}, kbs, kbs.where("kb_id = 1"))
    counted = {
        **out,
        "audit_detached": out["audit"].where("document_id is null"),
        "kb_documents": kb_out["documents"],
        "kb_chunks": kb_out["chunks"],
        "knowledge_bases": kb_out["knowledge_bases"],
    }
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tbl"), "n") for n, df in counted.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@check(
    "update_kbs",
    "SELECT kb_id, CASE WHEN kb_id = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN kb_id = 0 THEN 256 ELSE chunk_size END::bigint AS chunk_size, CASE WHEN kb_id = 2 THEN 'disabled' ELSE status END AS status FROM kbs",
    ("kbs",),
)
def _(spark, sf):
    k = X.knowledge_bases(spark, sf)
    i = F.col("kb_id")
    changes = k.where("kb_id in (0, 2)").select(
        "kb_id", F.when(i == 0, "renamed").alias("name"), F.when(i == 0, 256).alias("chunk_size"), F.when(i == 2, "disabled").alias("status")
    )
    out = G.update_kbs(k, changes)
    return out.select("kb_id", "name", F.col("chunk_size").cast(big).alias("chunk_size"), "status")


@check(
    "mark_failures",
    """SELECT document_id, CASE WHEN document_id % 3 = 1 THEN 'failed' WHEN document_id % 3 = 2 THEN 'completed' ELSE status END AS status,
  CASE WHEN document_id % 3 = 1 THEN substr(content, 1, 2000) WHEN document_id % 3 = 2 THEN NULL ELSE error_message END AS error_message,
  CASE WHEN document_id % 3 = 2 THEN document_id % 8 ELSE 0 END::bigint AS chunk_count,
  CASE WHEN document_id % 3 <> 0 THEN 100 ELSE -1 END::bigint AS progress FROM docs""",
    ("docs",),
)
def _(spark, sf):
    d = X.documents(spark, sf)
    i = F.col("document_id")
    outcomes = d.where(i % 3 != 0).select("document_id", F.when(i % 3 == 1, F.col("content")).alias("error"), (i % 8).alias("chunk_count"))
    out = G.mark_outcomes(d, outcomes)
    return out.select("document_id", "status", "error_message", F.col("chunk_count").cast(big).alias("chunk_count"), F.coalesce("progress", F.lit(-1)).cast(big).alias("progress"))


# --- sinks ------------------------------------------------------------------------------------------------


@check(
    "replace_chunks",
    """SELECT chunk_id, document_id FROM chunks WHERE document_id % 4 <> 1
UNION ALL SELECT chunk_id, document_id FROM chunks WHERE document_id % 8 = 1 AND chunk_index = 0""",
    ("chunks",),
)
def _(spark, sf):
    c = X.chunks(spark, sf).select("chunk_id", "document_id", "chunk_index")
    new = c.where("document_id % 8 = 1 and chunk_index = 0")
    replaced = X.documents(spark, sf).where("document_id % 4 = 1")
    return S.replace_rows(c, new, replaced).select("chunk_id", "document_id")


@check(
    "upsert_points",
    """SELECT chunk_id, CASE WHEN chunk_index % 2 = 0 THEN chunk_index + 1000 ELSE chunk_index END::bigint AS val FROM chunks""",
    ("chunks",),
)
def _(spark, sf):
    c = X.chunks(spark, sf).select("chunk_id", "chunk_index")
    old = c.select("chunk_id", F.col("chunk_index").cast(big).alias("val"))
    even = c.where("chunk_index % 2 = 0")
    new = even.select("chunk_id", (F.col("chunk_index") + 500).cast(big).alias("val"), F.lit(1).alias("seq")).unionByName(
        even.select("chunk_id", (F.col("chunk_index") + 1000).cast(big).alias("val"), F.lit(2).alias("seq"))
    )
    return S.upsert_points(old, new, "chunk_id", "seq").select("chunk_id", "val")


@check(
    "content_snapshot",
    "SELECT document_id, 'knowledge_bases/' || kb_id || '/documents/' || document_id || '/parsed/content' AS path, file_size, file_hash FROM docs",
    ("docs",),
)
def _(spark, sf):
    snap = S.content_snapshot(X.documents(spark, sf), parsed_content_type(F.col("file_type"), F.col("content")))
    return snap.select("document_id", "path", "file_size", "file_hash")


@check(
    "point_payload",
    """SELECT c.chunk_id, c.lang || ',' || c.source AS tags, d.governance_source_type, d.authority_level::bigint AS authority_level, d.review_status, 1::bigint AS document_version
FROM chunks c JOIN docs d USING (document_id)""",
    ("chunks", "docs"),
)
def _(spark, sf):
    p = G.point_payload(X.chunks(spark, sf), X.documents(spark, sf))
    return p.select(
        "chunk_id",
        F.array_join("tags", ",").alias("tags"),
        "governance_source_type",
        F.col("authority_level").cast(big).alias("authority_level"),
        "review_status",
        F.col("document_version").cast(big).alias("document_version"),
    )


# --- streams ------------------------------------------------------------------------------------------------


@check("rate_limit", "SELECT key, event_id, ts_ms, allowed, retry_after::bigint AS retry_after FROM limit_steps", ("limit_steps",))
def _(spark, sf):
    e = read_table(spark, sf, "events").select(
        F.col("user_id").alias("key"), "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ts_ms")
    )
    return rate_limit(e, 3, 3600).withColumn("retry_after", F.col("retry_after").cast(big))


@check(
    "latest_progress",
    """SELECT user_id AS document_id, max_by(stage, k) AS stage, max_by(p, k)::bigint AS progress FROM (
  SELECT user_id, ['queued', 'parsing', 'chunking', 'completed'][(event_id % 4)::int + 1] AS stage, [10, 24, 40, 100][(event_id % 4)::int + 1] AS p, epoch_us(ts) AS k FROM events) GROUP BY user_id""",
)
def _(spark, sf):
    return N.latest_progress(event_stages(read_table(spark, sf, "events"))).select("document_id", "stage", F.col("progress").cast(big).alias("progress"))


def event_stages(events):
    """Events as milestones of as many documents as there are users."""
    e = events.withColumnRenamed("user_id", "document_id")
    stages = ["queued", "parsing", "chunking", "completed"]
    rows = None
    for n, stage in enumerate(stages):
        part = N.stage_rows(e.where(F.col("event_id") % 4 == n), stage, F.col("ts"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def work_folder(spark, name):
    """A fresh folder next to the checkpoints of the cluster, or a private one on a single machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or private_folder(spark.sparkContext.master)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def in_turns(df, order, folder, parts=3):
    """Write ``df`` as a folder of files that arrive one after another, and open it as a stream of one file at a time."""
    bounds = df.select(F.percentile_approx(order, [n / parts for n in range(1, parts)], 10_000).alias("b")).first()["b"] or []
    for lo, hi in zip([None, *bounds], [*bounds, None]):
        above, below = F.lit(True) if lo is None else F.col(order) > lo, F.lit(True) if hi is None else F.col(order) <= hi
        df.where(above & below).coalesce(1).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@check("rate_limit_stream", "SELECT key, event_id, ts_ms, allowed, retry_after::bigint AS retry_after FROM limit_steps", ("limit_steps",))
def _(spark, sf):
    """The batch decisions, made by a stream of files in time order with text keys."""
    root = work_folder(spark, "admission")
    e = read_table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("key"), "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ts_ms")
    )
    admission_sink(in_turns(e, "ts_ms", f"{root}/arriving"), 3, 3600, f"{root}/out", f"{root}/cp").awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.withColumns({"key": F.substring("key", 2, 20).cast(big), "retry_after": F.col("retry_after").cast(big)})


@check(
    "progress_stream",
    """SELECT user_id AS document_id, max_by(stage, k) AS stage, max_by(p, k)::bigint AS progress FROM (
  SELECT user_id, ['queued', 'parsing', 'chunking', 'completed'][(event_id % 4)::int + 1] AS stage, [10, 24, 40, 100][(event_id % 4)::int + 1] AS p, epoch_us(ts) AS k FROM events) GROUP BY user_id""",
)
def _(spark, sf):
    """The latest milestone of each document, kept by a stream whose files arrive out of order."""
    root = work_folder(spark, "progress")
    rows = event_stages(read_table(spark, sf, "events")).withColumn("turn", F.pmod(F.xxhash64("document_id", "at"), F.lit(1000)))
    N.progress_sink(in_turns(rows, "turn", f"{root}/arriving"), f"{root}/out", f"{root}/cp").awaitTermination()
    return N.current_progress(spark, f"{root}/out").select("document_id", "stage", F.col("progress").cast(big).alias("progress"))


@check(
    "ingest_stream",
    "SELECT chunk_id, document_id, chunk_index::bigint AS chunk_index, sha256(content) AS content_hash FROM chunks",
    ("chunks",),
)
def _(spark, sf):
    root = work_folder(spark, "ingest")
    docs = X.dealt(X.documents(spark, sf).select("document_id", "kb_id", "name", "file_type", "tags", "content"))
    docs.write.parquet(f"{root}/arriving")
    query = N.ingest_stream(spark, f"{root}/arriving", X.knowledge_bases(spark, sf), f"{root}/out", f"{root}/cp", 4)
    query.awaitTermination()
    out = N.current_chunks(spark, f"{root}/out")
    return out.select("chunk_id", "document_id", F.col("chunk_index").cast(big).alias("chunk_index"), "content_hash")


@check(
    "dedup_stream",
    "SELECT document_id, s.kb AS kb_id, r.name FROM dedup_steps s JOIN dedup_rows r USING (document_id) WHERE reason IS NULL",
    ("dedup_steps",),
)
def _(spark, sf):
    """First come, first registered, by a stream whose files arrive in order of position."""
    root = work_folder(spark, "dedup")
    d = X.documents(spark, sf).select("document_id", (F.col("document_id") % 2).alias("kb_id"), "name", "file_hash", F.col("document_id").alias("position"))
    N.dedup_stream(in_turns(d, "position", f"{root}/arriving"), f"{root}/out", f"{root}/cp").awaitTermination()
    return spark.read.parquet(f"{root}/out/registered").select("document_id", "kb_id", "name")
