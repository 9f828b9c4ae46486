"""Vectors per chunk, and top-k search over them.

Search never materialises query-chunk pairs. A scan carries a group of query vectors of
bounded size, whatever their number and lengths, to every task; the task streams its part
of the index against blocks of these queries with NumPy and keeps only the best k rows per
query and KB. One small window then merges the local lists. More queries than one group
holds take one more scan per group. The index is never shuffled or copied, and all sizes
go the same way.

Search is exact unless ``cells`` are given: then only the cells nearest to a query are
looked at (``CellIndex``), and what is found there is scored exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfmark.functions.hashing import sparse_vector
from shelfmark.functions.memory import handing_back
from shelfmark.functions.text import bound_input
from shelfmark.session import cut_lineage

#: Queries that are scored together, values of query vectors that one scan carries,
#: scores and products that one step holds.
MAX_BLOCK_QUERIES = 1024
GROUP_VALUES = 4_000_000
CELLS_PER_STEP = 1_000_000
PAIRS_PER_STEP = 1_000_000
DENSE_DIGITS = 6


def sparse_vectors(df: DataFrame, content: str = "content") -> DataFrame:
    """Add the ``sparse`` struct(indices, values) of each row's text. Narrow."""
    return df.withColumn("sparse", sparse_vector(F.col(content)))


def postings(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of sparse vectors: one row per (key, idx, val)."""
    pairs = F.explode(F.arrays_zip("sparse.indices", "sparse.values"))
    return vectors.select(*keys, pairs.alias("p")).select(
        *keys, F.col("p.indices").alias("idx"), F.col("p.values").alias("val")
    )


# --- embedding ---------------------------------------------------------------


class EmbeddingTimeout(Exception):
    """Raised by a model callable when a request took too long."""


MIN_RETRY_CHARS = 1000


def halved(text: str, cause: Exception) -> str:
    """The first half of a text, at least MIN_RETRY_CHARS of it; an error if that is all of it."""
    cut = text[: max(len(text) // 2, MIN_RETRY_CHARS)].rstrip()
    if len(text) <= MIN_RETRY_CHARS or len(cut) == len(text):
        raise RuntimeError("embedding one bounded text timed out") from cause
    return cut


def embed_texts(texts: list[str], model: Callable[[list[str]], list], batch_size: int) -> list:
    """One vector per text, in order; a timed-out request is retried in halves."""
    out: list = []
    size = max(batch_size, 1)
    stack = [texts[i : i + size] for i in range(0, len(texts), size)][::-1]
    while stack:
        batch = stack.pop()
        try:
            vectors = model(batch)
        except EmbeddingTimeout as slow:
            if len(batch) > 1:
                half = len(batch) // 2
                stack += [batch[half:], batch[:half]]
                continue
            stack.append([halved(batch[0], slow)])
            continue
        if len(vectors) != len(batch):
            raise RuntimeError(f"expected {len(batch)} vectors, got {len(vectors)}")
        out.extend(vectors)
    return out


def hashed_embedder(dim: int = 64) -> Callable[[list[str]], list]:
    """A deterministic stand-in model: hashed word counts, normalised."""

    def model(batch: list[str]) -> list:
        from zlib import crc32

        rows = np.zeros((len(batch), dim))
        for i, text in enumerate(batch):
            for word in text.lower().split():
                h = crc32(word.encode())
                rows[i, h % dim] += 1.0 if h & 1024 else -1.0
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        return (rows / np.where(norms == 0, 1, norms)).tolist()

    return model


def embed(
    df: DataFrame,
    load_model: Callable[[], Callable[[list[str]], list]],
    content: str = "content",
    output: str = "embedding",
    batch_size: int = 4,
    max_chars: int = 4000,
) -> DataFrame:
    """Add one vector per row; the model is loaded once per task."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            yield pd.Series(embed_texts(texts.tolist(), model, batch_size))

    return df.withColumn(output, run(bound_input(F.col(content), max_chars)))


# --- search ------------------------------------------------------------------


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1, norms)


def _matrix(batch: pa.RecordBatch, field: str) -> np.ndarray:
    flat = batch.column(field).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(batch.num_rows, -1)


class _DenseBlock:
    """Unit query vectors; scores are cosines rounded to a stable precision."""

    minimum = -np.inf

    def __init__(self, vectors: list, field: str):
        self.field, self.n = field, len(vectors)
        self.matrix = _unit(np.array(vectors, dtype=np.float64)).T

    def steps(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Slices of rows whose scores fit into one step."""
        size = max(1, CELLS_PER_STEP // self.n)
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        return np.round(_unit(_matrix(batch, self.field)) @ self.matrix, DENSE_DIGITS)

    def limits(self, batch: pa.RecordBatch) -> np.ndarray | None:
        return None


class _SparseBlock:
    """Query postings sorted by index; scores are dot products over shared indices.

    An index that many queries hold would make a product for each of them, row by row.
    Such indices are a dense matrix instead, which rows meet by matrix multiplication.
    The largest weight of each index bounds what a row can score with any query.
    """

    minimum = 0.0

    def __init__(self, vectors: list, field: str):
        self.field, self.n = field, len(vectors)
        owner = np.concatenate([np.full(len(v["indices"]), q) for q, v in enumerate(vectors)] or [[]]).astype(np.int64)
        idx = np.concatenate([np.array(v["indices"], dtype=np.int64) for v in vectors] or [[]]).astype(np.int64)
        val = np.concatenate([np.array(v["values"], dtype=np.float64) for v in vectors] or [[]])
        order = np.argsort(idx, kind="stable")
        idx, val, owner = idx[order], val[order], owner[order]
        self.known, first, size = np.unique(idx, return_index=True, return_counts=True)
        self.most = np.maximum.reduceat(val, first) if len(val) else np.zeros(0)
        common = size > max(16, self.n // 8)
        held = np.repeat(common, size)
        # Rare indices: where the postings of each begin, and how many there are.
        self.width = np.where(common, 0, size)
        self.begin = np.concatenate(([0], np.cumsum(self.width)))[:-1]
        self.owner, self.val = owner[~held], val[~held]
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        self.dense = np.zeros((int(common.sum()), self.n))
        np.add.at(self.dense, (np.repeat(self.column, size)[held], owner[held]), val[held])

    def _hits(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place among the known indices, value) of the values that some query asks for."""
        column = batch.column(self.field)
        indices = column.field("indices")
        idx = indices.flatten().to_numpy(zero_copy_only=False)
        val = column.field("values").flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), np.diff(indices.offsets.to_numpy()))
        if not len(self.known):
            return row[:0], idx[:0], val[:0]
        at = np.minimum(np.searchsorted(self.known, idx), len(self.known) - 1)
        hit = self.known[at] == idx
        return row[hit], at[hit], val[hit]

    def steps(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Slices of rows whose products and scores fit into one step; a single row always goes."""
        row, at, _ = self._hits(batch)
        pairs = np.concatenate(([0], np.cumsum(np.bincount(row, self.width[at], batch.num_rows))))
        size = max(1, CELLS_PER_STEP // max(self.n, len(self.dense)))
        start = 0
        while start < batch.num_rows:
            fits = int(np.searchsorted(pairs, pairs[start] + PAIRS_PER_STEP, "right")) - 1
            stop = min(start + size, max(fits, start + 1))
            yield batch.slice(start, stop - start)
            start = stop

    def limits(self, batch: pa.RecordBatch) -> np.ndarray:
        """The most that each row can score with any query."""
        row, at, val = self._hits(batch)
        return np.bincount(row, val * self.most[at], batch.num_rows)

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        row, at, val = self._hits(batch)
        dense = self.column[at] >= 0
        n_dense = len(self.dense)
        if n_dense:
            mine = np.bincount(row[dense] * n_dense + self.column[at[dense]], val[dense], batch.num_rows * n_dense)
            out = mine.reshape(batch.num_rows, n_dense) @ self.dense
        else:
            out = np.zeros((batch.num_rows, self.n))
        row, at, val = row[~dense], at[~dense], val[~dense]
        width = self.width[at]
        place = np.repeat(self.begin[at], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        cell = np.repeat(row, width) * self.n + self.owner[place]
        return out + np.bincount(cell, np.repeat(val, width) * self.val[place], out.size).reshape(out.shape)


BLOCKS = {"dense": _DenseBlock, "sparse": _SparseBlock}


@dataclass(frozen=True)
class _Asked:
    """Queries of one group as the tasks get them: vectors, KBs in scope (None: all), cells to look at (None: all)."""

    qids: list
    vectors: list
    scopes: list
    probes: list | None

    def relevant(self, kb, cell) -> np.ndarray:
        """Numbers of the queries that look at rows of this KB and cell."""
        in_scope = (q for q, scope in enumerate(self.scopes) if scope is None or kb in scope)
        return np.array([q for q in in_scope if self.probes is None or cell in self.probes[q]], dtype=np.int64)


def _best_rows(found: pd.DataFrame, k: int, item: str) -> pd.DataFrame:
    ordered = found.sort_values(["__q", "kb_id", "score", item], ascending=[True, True, False, True])
    return ordered.groupby(["__q", "kb_id"], sort=False).head(k)


def _local_topk(batches: Iterator[pa.RecordBatch], kind: str, asked: _Asked, k: int, field: str, keep: list[str], max_block: int) -> pd.DataFrame | None:
    """Best k rows per (query, kb) over a stream of index batches.

    Rows are taken together by KB and cell; each such part of a batch meets blocks of the
    queries that look at it. A row that cannot reach the k-th score so far of any query of
    a block is left out of its steps.
    """
    item = keep[0]
    blocks: dict[tuple, list] = {}
    floors: dict = {}
    best: list[pd.DataFrame] = []
    size = 0

    def blocks_for(kb, cell) -> list:
        if (kb, cell) not in blocks:
            wanted = asked.relevant(kb, cell)
            parts = [wanted[i : i + max_block] for i in range(0, len(wanted), max_block)]
            known = {tuple(p.tolist()): b for old in blocks.values() for p, b in old}
            blocks[kb, cell] = [(p, known.get(tuple(p.tolist())) or BLOCKS[kind]([asked.vectors[q] for q in p], field)) for p in parts]
        return blocks[kb, cell]

    for whole in batches:
        if not whole.num_rows:
            continue
        keys = ["kb_id"] if asked.probes is None else ["kb_id", "__cell"]
        grouped = whole.select(keys).to_pandas()
        for key, rows in grouped.groupby(keys, sort=False, dropna=False).indices.items():
            kb, cell = (*(key if isinstance(key, tuple) else (key,)), None)[:2]
            held = blocks_for(kb, cell)
            part = whole if len(rows) == whole.num_rows else whole.take(pa.array(rows))
            floor = floors.setdefault(kb, np.full(len(asked.qids), -np.inf))
            for queries, block in held if part.num_rows else []:
                some = part
                limits = block.limits(part)
                if limits is not None:
                    some = part.filter(pa.array((limits > block.minimum) & (limits >= floor[queries].min())))
                for step in block.steps(some):
                    scores = block.scores(step)
                    if step.num_rows >= k:
                        kth = np.partition(scores, step.num_rows - k, axis=0)[step.num_rows - k]
                        floor[queries] = np.maximum(floor[queries], kth)
                    r, q = np.nonzero((scores >= floor[queries]) & (scores > block.minimum))
                    if len(r):
                        taken = step.select(keep).take(pa.array(r)).to_pandas()
                        best.append(taken.assign(kb_id=kb, score=scores[r, q], __q=queries[q]))
                        size += len(r)
            if size > 200_000:
                best = [_best_rows(pd.concat(best), k, item)]
                size = len(best[0])
    return _best_rows(pd.concat(best), k, item) if best else None


def _sizes(queries: DataFrame, fields: tuple[str, ...]):
    """Values of a query's vectors, as a column."""
    sizes = [F.coalesce(F.size(f"{n}.indices" if isinstance(queries.schema[n].dataType, T.StructType) else n), F.lit(0)) for n in fields]
    return sum((F.greatest(s, F.lit(0)) for s in sizes), F.lit(1))


def load_queries(queries: DataFrame, fields: tuple[str, ...], group_values: int = GROUP_VALUES) -> list[Row] | None:
    """All query rows (qid, kb_ids, vectors) if their vectors make one group, else None.

    Their size is summed up before anything is fetched.
    """
    held = queries.select("qid", "kb_ids", *fields)
    if (held.agg(F.sum(_sizes(queries, fields))).first()[0] or 0) > group_values:
        return None
    return held.collect()


def query_groups(queries: DataFrame, fields: tuple[str, ...], group_values: int = GROUP_VALUES) -> Iterator[list[Row]]:
    """Query rows in groups of about ``group_values`` values of vectors; one group is fetched at a time."""
    held = cut_lineage(queries.select("qid", "kb_ids", *fields))
    total = held.agg(F.sum(_sizes(held, fields))).first()[0] or 0
    groups = max(1, -(-2 * total // group_values))
    for n in range(groups):
        yield held.where(F.pmod(F.xxhash64("qid"), F.lit(groups)) == n).collect()


def within_scope(df: DataFrame, rows: list[Row]) -> DataFrame:
    """Only the KBs some query asks for, which prunes a table partitioned by kb_id; all, if a query has no list."""
    if any(r["kb_ids"] is None for r in rows):
        return df
    return df.where(F.col("kb_id").isin(sorted({kb for r in rows for kb in r["kb_ids"]})))


@dataclass(frozen=True)
class CellIndex:
    """An index dealt into cells around ``centroids``; ``table`` is the index with ``__cell``.

    Store the table partitioned by kb_id and __cell: a search then reads its cells only.
    """

    table: DataFrame
    centroids: np.ndarray

    def probes(self, vectors: list, n: int) -> list[set]:
        """The ``n`` cells nearest to each vector."""
        near = _unit(np.array(vectors, dtype=np.float64)) @ self.centroids.T
        return [set(row.tolist()) for row in np.argsort(-near, axis=1, kind="stable")[:, :n]]


#: Vectors that the centroids are learned from, and passes over them.
CELL_SAMPLE, CELL_PASSES = 20_000, 12


def build_cells(index: DataFrame, cells: int, field: str = "embedding", item: str = "chunk_id", sample: int = CELL_SAMPLE) -> CellIndex:
    """Deal every row of an index to the nearest of ``cells`` centroids.

    The centroids come from spherical k-means over ``sample`` vectors, those with the least
    hash of their item; every row is dealt. Fewer vectors than cells make as many cells as vectors.
    """
    drawn = index.where(F.col(field).isNotNull()).orderBy(F.xxhash64(item), item).select(field).limit(sample).collect()
    if not drawn:
        return CellIndex(index.withColumn("__cell", F.lit(0)), np.zeros((1, 1)))
    points = _unit(np.array([r[field] for r in drawn], dtype=np.float64))
    centroids = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)]
    for _ in range(CELL_PASSES):
        owner = np.argmax(points @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, points)
        filled = np.bincount(owner, minlength=len(centroids)) > 0
        centroids = np.where(filled[:, None], _unit(sums), centroids)

    @F.arrow_udf("int")
    def nearest(column: pa.Array) -> pa.Array:
        rows = column.fill_null(pa.scalar([0.0] * centroids.shape[1], column.type)) if column.null_count else column
        matrix = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
        return pa.array(np.argmax(matrix @ centroids.T, axis=1).astype(np.int32))

    return CellIndex(index.withColumn("__cell", nearest(F.col(field))), centroids)


def topk_search(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    field: str,
    kind: str,
    item: str = "chunk_id",
    extra: tuple[str, ...] = ("document_id",),
    query_field: str | None = None,
    loaded: list[Row] | None = None,
    max_block: int = MAX_BLOCK_QUERIES,
    group_values: int = GROUP_VALUES,
    cells: CellIndex | None = None,
    probes: int = 8,
) -> DataFrame:
    """Best k index rows per (query, KB in scope): qid, kb_id, ids, score, kb_rank.

    ``queries`` has qid, kb_ids (the KBs to search, null for all of the index) and a vector,
    named like the index vector ``field`` unless ``query_field`` says otherwise. Equal scores
    are ordered by item id. ``loaded`` may pass the result of ``load_queries`` on. With
    ``cells`` (built from ``index``) a query looks at its ``probes`` nearest cells only.
    """
    asked_field = query_field or field
    keep = [item, *extra]
    asked = queries.where(F.col(asked_field).isNotNull())
    source = index if cells is None else cells.table
    narrow = source.select(*keep, "kb_id", field, *([] if cells is None else ["__cell"])).where(F.col(field).isNotNull())
    schema = T.StructType(
        [
            T.StructField("qid", queries.schema["qid"].dataType),
            T.StructField("kb_id", index.schema["kb_id"].dataType),
            *[T.StructField(c, index.schema[c].dataType) for c in keep],
            T.StructField("score", T.DoubleType()),
        ]
    )
    arrow_schema = to_arrow_schema(schema)

    def scanned(rows: list[Row]) -> DataFrame:
        used = [r for r in rows if r[asked_field] is not None]
        vectors = [r[asked_field] for r in used]
        scopes = [None if r["kb_ids"] is None else set(r["kb_ids"]) for r in used]
        looked_at = None if cells is None else cells.probes(vectors, probes) if vectors else []
        group = _Asked([r["qid"] for r in used], vectors, scopes, looked_at)
        part = within_scope(narrow, used)
        if looked_at is not None:
            part = part.where(F.col("__cell").isin(sorted(set().union(*looked_at))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _local_topk(batches, kind, group, k, field, keep, max_block) if vectors else None
            if found is not None:
                named = found.assign(qid=[group.qids[q] for q in found["__q"]])
                yield from pa.Table.from_pandas(named[arrow_schema.names], schema=arrow_schema, preserve_index=False).to_batches()

        return part.mapInArrow(handing_back(scan), schema)

    rows = loaded if loaded is not None else load_queries(asked, (asked_field,), group_values)
    if rows is not None:
        local = scanned(rows)
    else:
        local = None
        for group in query_groups(asked, (asked_field,), group_values):
            local = scanned(group) if local is None else local.unionByName(scanned(group))
    order = Window.partitionBy("qid", "kb_id").orderBy(F.desc("score"), F.asc(item))
    return local.withColumn("kb_rank", F.row_number().over(order)).where(F.col("kb_rank") <= k)


def recall(found: DataFrame, exact: DataFrame, item: str = "chunk_id") -> float:
    """Share of the exact hits that were found; 1.0 if there are none."""
    keys = ["qid", "kb_id", item]
    both = exact.select(*keys).join(found.select(*keys).withColumn("__hit", F.lit(1)), keys, "left")
    row = both.agg(F.count(F.lit(1)).alias("n"), F.count("__hit").alias("hit")).first()
    return row["hit"] / row["n"] if row["n"] else 1.0


def dense_search(index: DataFrame, queries: DataFrame, k: int, field: str = "embedding", **options) -> DataFrame:
    """Cosine top-k per query and KB; exact unless ``cells`` are given."""
    return topk_search(index, queries, k, field, "dense", **options)


def sparse_search(index: DataFrame, queries: DataFrame, k: int, field: str = "sparse", **options) -> DataFrame:
    """Top-k by dot product of hashed counts; only rows sharing an index appear."""
    return topk_search(index, queries, k, field, "sparse", **options)


def visual_search(index: DataFrame, queries: DataFrame, k: int, field: str = "embedding", **options) -> DataFrame:
    """Cosine top-k over image vectors; every hit keeps its asset and chunk."""
    return topk_search(
        index, queries, k, field, "dense", item="asset_id", extra=("chunk_id", "document_id"), **options
    )


def visual_asset_keys(hits: DataFrame) -> DataFrame:
    """Distinct (document_id, asset_id) keys per query and chunk, best hit first."""
    first = hits.groupBy("qid", "chunk_id", "document_id", "asset_id").agg(F.min("rank").alias("rank"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "document_id", "asset_id")))
    return first.groupBy("qid", "chunk_id").agg(
        F.transform(ordered, lambda k: F.struct(k["document_id"].alias("document_id"), k["asset_id"].alias("asset_id"))).alias("asset_keys")
    )
