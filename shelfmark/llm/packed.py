"""Blocks of encoded texts, and what a block asks of the whole corpus.

A block holds the words (or chunks, or phrases) of some whole texts as numbers into a
table of its own distinct 64-bit keys. It is one row of packed arrays, bounded by
``BLOCK_WORDS`` words or one longer text, and is written before anything is asked, so
that every later step sees the same blocks.

``totals`` sums counts that blocks report by key. Keys are dealt into ranges, as many as
it takes for a range to hold about ``RANGE_KEYS`` reports; a key has at most one report
per block, so even the most frequent one cannot crowd a range. ``answered`` brings the
totals back to the blocks that asked, by block number: nothing is broadcast, and a block
receives one number for each of its keys at most. Reports and answers travel as packed
arrays of sorted keys, so that a key costs a few bytes instead of a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Words to a block, and reports to a range of keys.
BLOCK_WORDS = 1_500_000
RANGE_KEYS = 4_000_000

REPORT = "block long, range long, keys binary, n binary"
_ANSWER = "block long, range long, keys binary, totals binary, own binary, n_own long, sum_own long"


def pack(values: np.ndarray) -> bytes:
    """Compressed numbers, their first bytes together, then their second bytes and so on: high bytes are mostly equal."""
    flat = np.ascontiguousarray(values)
    return zstandard.compress(flat.view(np.uint8).reshape(len(flat), -1).T.tobytes(), 1) if len(flat) else b""


def unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.empty(0, dtype=kind)
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Rising numbers as steps."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def block_number(n: int) -> int:
    """Number of the ``n``-th block that this task makes."""
    return (TaskContext.get().partitionId() << 32) + n


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, place of each, how often each occurs, number of each entry); frequent keys come first, as small numbers pack well."""
    unique, place, ids, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return unique[order], place[order], counts[order], rank[ids]


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow form of a DDL schema; made on the driver, as tasks have no session."""
    return to_arrow_schema(_parse_datatype_string(schema))


def ranges_for(entries: int) -> int:
    """Ranges of keys for so many reports."""
    return max(1, -(-entries // RANGE_KEYS))


def reports(block: int, keys: np.ndarray, counts: np.ndarray, ranges: int) -> Iterable[dict]:
    """Rows of REPORT: ``keys`` (sorted, distinct) and their counts, range by range."""
    bounds = np.array([(r << 64) // ranges for r in range(ranges)], dtype=np.uint64)
    edges = [*np.searchsorted(keys, bounds).tolist(), len(keys)]
    for r in range(ranges):
        lo, hi = edges[r], edges[r + 1]
        if lo < hi:
            yield {"block": block, "range": r, "keys": pack_sorted(keys[lo:hi]), "n": pack(counts[lo:hi].astype(np.int64))}


def report_batch(rows: Iterable[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(list(rows), schema=schema)


def totals(counts: DataFrame, least: int = 1) -> DataFrame:
    """What to answer each block: its keys that occur ``least`` times in all, their totals, and which of them it owns.

    Each key has one owner. ``n_own`` and ``sum_own`` are the number and the sum of the totals that a row owns.
    """
    arrow = arrow_schema(_ANSWER)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        each = [unpack_sorted(r["keys"], np.uint64) for r in rows]
        keys, owner = np.concatenate(each), np.repeat(np.arange(len(rows)), [len(k) for k in each])
        n = np.concatenate([unpack(r["n"], np.int64) for r in rows])
        order = np.argsort(keys, kind="stable")
        keys, owner, n = keys[order], owner[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sums = np.add.reduceat(n, first)
        sizes = np.diff(np.append(first, len(keys)))
        total = np.repeat(sums, sizes)
        own = np.zeros(len(keys), dtype=bool)
        own[first] = True
        kept = total >= least
        keys, owner, total, own = keys[kept], owner[kept], total[kept], own[kept]
        by_row = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[by_row], np.arange(len(rows) + 1))
        made = []
        for k, row in enumerate(rows):
            mine = by_row[bounds[k] : bounds[k + 1]]
            if len(mine):
                owned = total[mine][own[mine]]
                made.append({"block": row["block"], "range": row["range"], "keys": pack_sorted(keys[mine]), "totals": pack(total[mine]), "own": pack(own[mine]), "n_own": len(owned), "sum_own": int(owned.sum())})
        return pa.Table.from_pylist(made, schema=arrow)

    return counts.groupBy("range").applyInArrow(run, _ANSWER)


def answered(blocks: DataFrame, totals: DataFrame, columns: list[str], answer: Callable[[dict, np.ndarray, np.ndarray, np.ndarray], Iterable[dict]], schema: str) -> DataFrame:
    """Rows that ``answer`` makes of each block.

    It gets the block's ``columns`` and (keys, totals, own) of what came back, sorted by key.
    """
    arrow = arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.sort_by("range").to_pylist()
        parts = [(unpack_sorted(r["keys"], np.uint64), unpack(r["totals"], np.int64), unpack(r["own"], np.bool_)) for r in rows]
        none = (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool))
        keys, total, own = (np.concatenate(x) for x in zip(none, *parts))
        made: list[dict] = []
        for row in left.to_pylist():
            made += answer(row, keys, total, own)
        return pa.Table.from_pylist(made, schema=arrow)

    asked = blocks.select("block", *columns)
    replies = totals.select("block", "range", "keys", "totals", "own")
    return asked.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def owned(totals: DataFrame) -> tuple[int, int]:
    """(number of keys, sum of their totals) over the corpus."""
    row = totals.agg(F.coalesce(F.sum("n_own"), F.lit(0)).alias("n"), F.coalesce(F.sum("sum_own"), F.lit(0)).alias("s")).first()
    return row["n"], row["s"]


def entries(blocks: DataFrame) -> int:
    """Sum of the ``size`` of all blocks."""
    return blocks.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]


def look_up(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Place in ``found`` (sorted) of each of ``keys``, or -1."""
    if not len(found):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(found, keys), len(found) - 1)
    return np.where(found[at] == keys, at, -1)
