"""Ingestion progress as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Overall progress reached at each stage.
STAGE_PROGRESS = {
    "queued": 10,
    "reading_source": 18,
    "parsing": 24,
    "storing_assets": 34,
    "chunking": 40,
    "chunks_ready": 46,
    "embedding": 84,
    "storing_chunks": 86,
    "visual_embedding": 91,
    "indexing": 99,
    "completed": 100,
    "failed": 100,
}
# Lowest progress shown for a waiting and for a running document.
PENDING_FLOOR = 18
PROCESSING_FLOOR = 24


def _ratio(completed: Column, total: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), completed / total))


def progress_between(start: Column, end: Column, completed: Column, total: Column) -> Column:
    """Clamped linear interpolation, truncated; the end when there is nothing to do."""
    return F.when(total <= 0, end).otherwise(
        start + ((end - start) * _ratio(completed, F.greatest(total, F.lit(1)))).cast("int")
    )


def stage_percent(completed: Column, total: Column) -> Column:
    return F.when(total <= 0, 100).otherwise(
        (_ratio(completed, F.greatest(total, F.lit(1))) * 100).cast("int")
    )


def clamp_percent(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), value))


def progress_struct(
    stage: str | Column,
    progress: int | Column,
    status: str | Column,
    detail: str | Column,
    started_at: Column | None = None,
    now: Column | None = None,
    completed: Column | None = None,
    total: Column | None = None,
    unit: Column | None = None,
    stage_progress: Column | None = None,
) -> Column:
    """A progress record; the start time is kept when one is given."""
    def column(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    moment = F.current_timestamp() if now is None else now
    begun = moment if started_at is None else F.coalesce(started_at, moment)

    def count(value: Column | None) -> Column:
        return F.lit(None).cast("int") if value is None else F.greatest(F.lit(0), value)

    return F.struct(
        column(stage).alias("stage"),
        clamp_percent(column(progress)).alias("progress"),
        column(status).alias("status"),
        column(detail).alias("detail"),
        begun.alias("started_at"),
        moment.alias("updated_at"),
        count(completed).alias("completed"),
        count(total).alias("total"),
        (F.lit(None).cast("string") if unit is None else F.nullif(unit, F.lit(""))).alias("unit"),
        (F.lit(None).cast("int") if stage_progress is None else clamp_percent(stage_progress)).alias("stage_progress"),
    )


def document_progress(status: Column, stored: Column) -> Column:
    """Progress to show: 100 when ended, else the stored value, else a floor."""
    state = F.lower(status)
    return (
        F.when(state.isin("completed", "failed"), 100)
        .when(stored.isNotNull(), stored)
        .when(state == "pending", PENDING_FLOOR)
        .when(state == "processing", PROCESSING_FLOOR)
        .otherwise(0)
    )
