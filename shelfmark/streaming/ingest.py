"""Continuous ingest: arriving documents become chunk tables.

Delivery is at least once. Every micro-batch writes its own batch folders and a
manifest of the documents it replaced, so a retry overwrites its own output only.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shelfmark.functions.progress import STAGE_PROGRESS
from shelfmark.operators.governance import batch_dedup, find_duplicates
from shelfmark.plans.ingest import parse_documents, split
from shelfmark.sources.sinks import BATCH, read_current, write_batch

DOCUMENT_STREAM = (
    "document_id BIGINT, kb_id BIGINT, name STRING, file_type STRING, tags ARRAY<STRING>, content STRING"
)


#: When and where a row arrived, from the file source: later rows of a document replace earlier ones.
ARRIVAL = "arrival"
_ARRIVED = "struct(_metadata.file_modification_time AS at, _metadata.file_path AS path, _metadata.row_index AS row) AS arrival"


def _newest(batch: DataFrame) -> DataFrame:
    """One row per document of a micro-batch, the one that arrived last."""
    others = [c for c in batch.columns if c not in ("document_id", ARRIVAL)]
    order = [ARRIVAL] if ARRIVAL in batch.columns else []
    newest = F.max(F.struct(*order, F.struct(*others).alias("r"))).alias("m")
    return batch.groupBy("document_id").agg(newest).select("document_id", "m.r.*")


def ingest_batch(batch: DataFrame, batch_id: int, kbs: DataFrame, root: str) -> None:
    """Process one micro-batch; bad rows are set aside instead of failing it.

    Every row ends in ``rejected`` (no id, KB or content) or its document in ``manifest``,
    as completed or failed. Documents are parsed once: the parsed rows are written and
    the other tables are made from what was written. ``stages`` gets every milestone that a
    document has reached, with the time of the step.
    """
    bad = (
        F.when(F.col("document_id").isNull(), "missing_document_id")
        .when(F.col("kb_id").isNull(), "missing_kb_id")
        .when(F.col("content").isNull(), "missing_content")
    )
    spark = batch.sparkSession
    times = {"begun": datetime.now(timezone.utc)}
    # The batch feeds several writes; it is bounded by the source's rate options.
    checked = batch.withColumn("reason", bad).persist()
    try:
        refused = checked.where("reason is not null")
        write_batch(refused.drop(ARRIVAL), f"{root}/rejected", batch_id)
        if ARRIVAL in batch.columns:
            write_batch(checked.groupBy(F.col("arrival.path").alias("path")).agg(F.count("*").alias("rows")), f"{root}/files", batch_id)
        good = _newest(checked.where("reason is null").drop("reason"))
        write_batch(parse_documents(good, kbs), f"{root}/parsed", batch_id)
        times["parsed"] = datetime.now(timezone.utc)
    finally:
        checked.unpersist()
    done = split(spark.read.parquet(f"{root}/parsed/{BATCH}={batch_id}"))
    write_batch(done.chunks, f"{root}/chunks", batch_id, ("kb_id",))
    write_batch(done.assets, f"{root}/assets", batch_id)
    times["stored"] = datetime.now(timezone.utc)
    manifest = done.outcomes.select(
        "document_id",
        "status",
        F.substring("error", 1, 2000).alias("error_message"),
        F.lit(STAGE_PROGRESS["completed"]).alias("progress"),
        "chunk_count",
    )
    write_batch(manifest, f"{root}/manifest", batch_id)
    times["ended"] = datetime.now(timezone.utc)
    write_batch(milestones(manifest, times), f"{root}/stages", batch_id)


#: Milestones of ingest by the step after which they are reached. Dense vectors come from outside.
REACHED = {
    "begun": ("queued", "reading_source"),
    "parsed": ("parsing", "chunking", "chunks_ready"),
    "stored": ("storing_assets", "embedding", "storing_chunks"),
    "ended": ("indexing",),
}


def milestones(manifest: DataFrame, times: Mapping[str, datetime]) -> DataFrame:
    """Every milestone of every document of a batch; a failed document stops after parsing."""

    def rows(names, step: str) -> list:
        at = F.lit(times[step]).cast("timestamp")
        return [F.struct(F.lit(n).alias("stage"), F.lit(STAGE_PROGRESS[n]).alias("progress"), at.alias("at")) for n in names]

    done = F.array(*[r for step, names in REACHED.items() for r in rows(names, step)], *rows(["completed"], "ended"))
    failed = F.array(*rows(REACHED["begun"], "begun"), *rows(["parsing"], "parsed"), *rows(["failed"], "ended"))
    return manifest.select("document_id", F.inline(F.when(F.col("status") == "completed", done).otherwise(failed)))


def unread_files(spark: SparkSession, source: str, root: str) -> DataFrame:
    """Files of ``source`` that gave no row or fewer than their footer counts, with a reason: streaming passes over what is damaged."""
    plain = lambda c: F.regexp_replace(c, r"\Afile:/+", "/")
    # A retried batch overwrites its folder, and a file is read in one batch.
    seen = spark.read.parquet(f"{root}/files").groupBy(plain("path").alias("__p")).agg(F.sum("rows").alias("rows"))
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(source).select("path", "length", plain("path").alias("__p"))
    # A count without columns takes the footers' row counts and reads no data.
    footers = spark.read.schema(DOCUMENT_STREAM).option("ignoreCorruptFiles", "true").option("pathGlobFilter", "*.parquet").parquet(source)
    expected = footers.groupBy(plain("_metadata.file_path").alias("__p")).agg(F.count("*").alias("expected"))
    judged = listed.join(seen, "__p", "left").join(expected, "__p", "left").withColumn(
        "reason",
        F.when(F.col("rows").isNull(), "unreadable_or_empty_file").when(F.col("expected").isNull() | (F.col("rows") < F.col("expected")), "partly_read_file"),
    )
    return judged.where("reason is not null").select("path", "length", "reason")


def ingest_stream(
    spark: SparkSession, source: str, kbs: DataFrame, root: str, checkpoint: str, max_files: int = 100
) -> StreamingQuery:
    """Start ingest of Parquet document files arriving in ``source``; runs until caught up.

    A damaged file does not stop the stream; ``unread_files`` lists it, also if some of its rows were read.
    """
    arriving = (
        spark.readStream.schema(DOCUMENT_STREAM)
        .option("maxFilesPerTrigger", max_files)
        .option("ignoreCorruptFiles", "true")
        .parquet(source)
        .selectExpr("*", _ARRIVED)
    )
    return (
        arriving.writeStream.foreachBatch(lambda df, n: ingest_batch(df, n, kbs, root))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_chunks(spark: SparkSession, root: str) -> DataFrame:
    return read_current(spark, f"{root}/chunks", spark.read.parquet(f"{root}/manifest"))


def dedup_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """Registration of arriving documents: by name or by hash within a KB.

    Two keys are ORed, so this cannot be ``dropDuplicates``; each micro-batch is
    checked against the registered table and against itself. Refused rows are kept with
    their reason in ``refused``.
    """
    spark = batch.sparkSession
    registered = f"{root}/registered"
    earlier = None
    try:
        earlier = spark.read.parquet(registered).where(F.col(BATCH) < batch_id)
    except Exception as missing:  # the first batch has no table yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    held = batch.persist()
    try:
        known, refused = held, None
        if earlier is not None:
            judged = find_duplicates(held, earlier)
            known = judged.where("reason is null").drop("reason", "duplicate_of")
            refused = judged.where("reason is not null").drop("duplicate_of")
        settled = batch_dedup(known, "position")
        write_batch(settled.where("reason is null").drop("reason"), registered, batch_id)
        later = settled.where("reason is not null")
        write_batch(later if refused is None else later.unionByName(refused), f"{root}/refused", batch_id)
    finally:
        held.unpersist()


def dedup_stream(arriving: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    return (
        arriving.writeStream.foreachBatch(lambda df, n: dedup_batch(df, n, root))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# --- progress ------------------------------------------------------------------------


def stage_rows(docs: DataFrame, stage: str, at) -> DataFrame:
    """One milestone row per document."""
    return docs.select(
        "document_id", F.lit(stage).alias("stage"), F.lit(STAGE_PROGRESS[stage]).alias("progress"), at.alias("at")
    )


def latest_progress(stages: DataFrame) -> DataFrame:
    """Latest milestone per document; a partial maximum runs before the shuffle."""
    newest = F.max(F.struct("at", "progress", "stage"))
    return stages.groupBy("document_id").agg(newest.alias("m")).select("document_id", "m.stage", "m.progress", "m.at")


def progress_stream(stages: DataFrame, checkpoint: str, table: str) -> StreamingQuery:
    """Keep the latest milestone per document of arriving stage rows in the memory table ``table``."""
    return (
        latest_progress(stages)
        .writeStream.format("memory")
        .queryName(table)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class LatestStage(StatefulProcessor):
    """The latest milestone of a document, as value state; a row goes out when it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "at timestamp, progress int, stage string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.latest.get()) if self.latest.exists() else None
        best = old
        for frame in rows:
            row = frame.sort_values(["at", "progress", "stage"]).iloc[-1]
            found = (row["at"].to_pydatetime(), int(row["progress"]), str(row["stage"]))
            best = found if best is None or found > best else best
        if best != old:
            self.latest.update(best)
            yield pd.DataFrame({"document_id": [key[0]], "stage": [best[2]], "progress": [best[1]], "at": [best[0]]})

    def close(self) -> None:
        pass


def progress_sink(stages: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest milestone per document of arriving stage rows (document_id, stage, progress, at) below ``root``.

    Each micro-batch writes the documents that moved on as one batch folder, so a retry
    overwrites its own; ``current_progress`` reads the newest row of each document. Ids
    may be of any type; ``at`` is a timestamp.
    """
    narrow = stages.select("document_id", "stage", F.col("progress").cast("int").alias("progress"), F.col("at").cast("timestamp").alias("at"))
    schema = f"document_id {narrow.schema['document_id'].dataType.simpleString()}, stage string, progress int, at timestamp"
    moved = narrow.groupBy("document_id").transformWithStateInPandas(LatestStage(), schema, "update", "None")
    return (
        moved.writeStream.foreachBatch(lambda df, n: write_batch(df, f"{root}/progress", n))
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_progress(spark: SparkSession, root: str) -> DataFrame:
    """The newest milestone of each document that ``progress_sink`` has written."""
    return latest_progress(spark.read.parquet(f"{root}/progress").drop(BATCH))
