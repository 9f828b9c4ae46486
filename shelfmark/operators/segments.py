"""Ordered work inside a group that may be very large.

A key (one document, one sheet) may own a large share of all rows, so its rows
are cut into bounded segments by their order number and worked on in parallel:

``running``
    prefix sums, minima and last values in two levels: inside each segment, then
    over one small row per segment.

``fold_segments``
    a fold whose state is small. Each segment is summarised as a function of its
    entry state, the summaries (one row per segment) are chained per key, and the
    segments are then folded for real from their true entry states. The result
    equals one pass over the whole group.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfmark.session import cut_lineage

SEGMENT_ROWS = 4096
OUTPUT_ROWS = 2048
SEGMENT = "__segment"
STATE = "__state"

Rows = Iterable[dict]


def schema_of(df: DataFrame, columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, df.schema[c].dataType) for c in columns])


def fold_sorted(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fold: Callable[[Rows], Iterator[dict]],
    schema: T.StructType,
) -> DataFrame:
    """Stream each key's rows in order through ``fold``; only one batch is held at a time."""
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        pending: list[dict] = []
        for _, group in groupby(rows, key=lambda row: tuple(row[k] for k in keys)):
            for out in fold(group):
                pending.append(out)
                if len(pending) >= OUTPUT_ROWS:
                    yield pa.RecordBatch.from_pylist(pending, schema=arrow_schema)
                    pending = []
        if pending:
            yield pa.RecordBatch.from_pylist(pending, schema=arrow_schema)

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInArrow(run, schema)


def fold_segments(
    df: DataFrame,
    keys: list[str],
    order: str,
    fold: Callable[[Rows, dict | None, bool], Iterator[dict]],
    summarize: Callable[[Rows], dict],
    advance: Callable[[dict | None, dict], dict],
    schema: T.StructType,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Fold every key's rows in order, splitting keys with many rows.

    ``order`` counts a key's rows from 0. ``fold(rows, entry_state, is_last)``
    yields output rows; ``summarize(rows)`` describes a segment for any entry
    state; ``advance(state, summary)`` gives the state after it.
    """
    position = F.col(order)
    large = df.where(position >= segment_rows).select(*keys).distinct()
    if large.isEmpty():
        return fold_sorted(df, keys, [order], lambda rows: fold(rows, None, True), schema)

    cut = df.withColumn(SEGMENT, F.floor(position / segment_rows))
    segment_keys = [*keys, SEGMENT]
    key_schema = schema_of(cut, segment_keys)
    state_schema = T.StructType([*key_schema.fields, T.StructField(STATE, T.StringType())])

    def summaries(rows: Rows) -> Iterator[dict]:
        rows = iter(rows)
        first = next(rows)

        def replay() -> Iterator[dict]:
            yield first
            yield from rows

        yield {**{k: first[k] for k in segment_keys}, STATE: json.dumps(summarize(replay()))}

    def chain(rows: Rows) -> Iterator[dict]:
        state, held = None, None
        for row in rows:
            if held is not None:
                yield {**held, STATE: json.dumps({"entry": state, "last": False})}
                state = advance(state, json.loads(held[STATE]))
            held = row
        yield {**held, STATE: json.dumps({"entry": state, "last": True})}

    hot = cut.join(large, keys, "left_semi")
    described = fold_sorted(hot, segment_keys, [order], summaries, state_schema)
    entries = fold_sorted(described, keys, [SEGMENT], chain, state_schema)

    def fold_with_entry(rows: Rows) -> Iterator[dict]:
        rows = iter(rows)
        first = next(rows)
        if first[STATE] is not None:
            given = json.loads(first[STATE])
            yield from fold(rows, given["entry"], given["last"])
            return

        def replay() -> Iterator[dict]:
            yield first
            yield from rows

        yield from fold(replay(), None, True)

    marked = cut.withColumn(STATE, F.lit(None).cast("string"))
    markers = entries.withColumn(order, F.lit(-1).cast(df.schema[order].dataType))
    together = marked.unionByName(markers, allowMissingColumns=True)
    return fold_sorted(together, segment_keys, [order], fold_with_entry, schema)


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    measures: dict[str, tuple[str, Column]],
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add inclusive running ``sum``, ``min``, ``max`` or ``last`` (non-null) columns.

    ``order`` is an integer column; rows whose order numbers share
    ``order div segment_rows`` form a segment. The only window over a whole key
    runs over one row per segment.
    """
    combine = {
        "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
        "min": F.least,
        "max": F.greatest,
        "last": lambda before, here: F.coalesce(here, before),
    }
    reduce = {
        "sum": F.sum,
        "min": F.min,
        "max": F.max,
        "last": lambda c: F.last(c, ignorenulls=True),
    }
    cut = df.withColumn(SEGMENT, F.floor(F.col(order) / segment_rows))
    for name, (_, expr) in measures.items():
        cut = cut.withColumn(f"__in_{name}", expr)

    inside = Window.partitionBy(*keys, SEGMENT).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select(
        "*",
        *[reduce[kind](F.col(f"__in_{n}")).over(inside).alias(f"__local_{n}") for n, (kind, _) in measures.items()],
    )

    def total(kind: str, name: str) -> Column:
        value = F.col(f"__in_{name}")
        if kind == "last":
            return F.max_by(value, F.when(value.isNotNull(), F.col(order)))
        return reduce[kind](value)

    totals = cut.groupBy(*keys, SEGMENT).agg(*[total(k, n).alias(f"__total_{n}") for n, (k, _) in measures.items()])
    before = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        SEGMENT,
        *[reduce[kind](F.col(f"__total_{n}")).over(before).alias(f"__carry_{n}") for n, (kind, _) in measures.items()],
    )
    joined = local.join(carried, [*keys, SEGMENT])
    return joined.select(
        *[F.col(c) for c in df.columns if c not in measures],
        *[
            combine[kind](F.col(f"__carry_{n}"), F.col(f"__local_{n}")).alias(n)
            for n, (kind, _) in measures.items()
        ],
    )
