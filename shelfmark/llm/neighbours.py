"""Approximate nearest neighbours by a permutation index (operator 9).

A vector is represented by its ``LENGTH`` nearest pivots in order of nearness. Each part
of the index keeps one inverted file per pivot: the vectors that have the pivot, with its
place in their order. A query reads the files of its own pivots only and ranks a part's
vectors by footrule distance; a pivot that is missing from an order counts as standing at
place ``LENGTH``, so that the distance is a constant less ``2 * (LENGTH - max(place, place'))``
for each pivot in common. The nearest share of each part is ranked again by the exact
inner product of the original vectors, in double precision.

Pivots are compared by angle, but the largest inner product may belong to a long vector at a
wider angle. So every vector of the index, pivots included, gets one more component that
brings it to the length of the longest, and queries get a zero there: their angles then
order vectors as inner products do.

Parts hold a bounded number of vectors, and the queries of a part stream past it, so
memory does not grow with either table. Pivots are a bounded sample; every vector is
indexed. Equal vectors are one entry of the index with the smallest keys only: as ties go
to smaller keys, later copies can never be among the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pivots (the bound of the sample), places kept per vector, and share of a part ranked again.
PIVOTS, LENGTH, SHARE = 128, 64, 0.25
#: Vectors to a part, and the groups of parts and queries that a small index is dealt into at least.
PART, GROUPS = 50_000, 16


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v) of the rows whose vector is not null, not zero, and finite throughout."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("key").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))


def choose_pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """``n`` different vectors, those with the least hashes; a fixed choice that any order of rows gives."""
    rows = vectors.groupBy(F.xxhash64("v").alias("h")).agg(F.first("v").alias("v")).orderBy("h").limit(n).collect()
    return np.array([r["v"] for r in rows], dtype=np.float64)


def raised(vectors: np.ndarray, top: float) -> np.ndarray:
    """``vectors`` with one more component that gives each the length ``top``."""
    return np.column_stack((vectors, np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", vectors, vectors), 0.0))))


def orders(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first, by cosine."""
    near = vectors @ (pivots / np.linalg.norm(pivots, axis=1, keepdims=True)).T
    length = min(length, near.shape[1])
    some = np.argpartition(-near, length - 1, axis=1)[:, :length]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable"), axis=1)


class Part:
    """One part of the index."""

    def __init__(self, keys: list[list[int]], vectors: np.ndarray, pivots: np.ndarray, length: int, compared: np.ndarray | None = None):
        """``compared`` stands for the vectors where pivots are ordered."""
        self.keys, self.vectors = keys, vectors
        self.least = np.array([k[0] for k in keys], dtype=np.int64)
        order = orders(vectors if compared is None else compared, pivots, length)
        self.length = order.shape[1]
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.bounds = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))
        self.members = (by_pivot // self.length).astype(np.int32)
        self.places = (by_pivot % self.length).astype(np.int16)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Half of what pivots in common take off the largest footrule distance, for each vector."""
        slices = [slice(self.bounds[p], self.bounds[p + 1]) for p in order]
        members = np.concatenate([self.members[s] for s in slices])
        gains = np.concatenate([self.length - np.maximum(self.places[s], at) for at, s in enumerate(slices)])
        return np.bincount(members, weights=gains, minlength=len(self.keys))

    def nearest(self, key: int, vector: np.ndarray, order: np.ndarray, k: int, share: float) -> list[tuple[float, int]]:
        n = len(self.keys)
        wanted = min(n, max(int(np.ceil(share * n)), k + 1))
        gains = self.footrule(order)
        if wanted < n:
            limit = np.partition(gains, n - wanted)[n - wanted]
            chosen = np.flatnonzero(gains >= limit)  # ties at the limit all come along
        else:
            chosen = np.arange(n)
        scores = np.einsum("ij,j->i", self.vectors[chosen], vector)
        if len(chosen) > k + 1:
            limit = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            chosen, scores = chosen[scores >= limit], scores[scores >= limit]
        found = sorted((-s, other) for s, i in zip(scores.tolist(), chosen.tolist()) for other in self.keys[i] if other != key)
        return [(-s, other) for s, other in found[:k]]


def search(
    df: DataFrame,
    queries: DataFrame,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    pivots: int = PIVOTS,
    length: int = LENGTH,
    share: float = SHARE,
    part: int = PART,
) -> DataFrame:
    """(query_id, rank, ``key``, score) of the ``k`` nearest found of each query among the rows of ``df``.

    ``queries`` has the same two columns. A query never finds its own key. Nearness is
    the inner product; ties go to the smaller key. Vectors that are null, zero, or hold
    null or non-finite components take no part on either side; all others must have one
    length. Rows that repeat a key are found once for each different vector. With no
    usable vector the result is empty.
    """
    rows = usable(df, key, vector)
    chosen = choose_pivots(rows, pivots)
    spark = df.sparkSession
    schema = f"query_id long, rank int, {key} long, score double"
    if not len(chosen):
        return spark.createDataFrame([], schema)
    longest = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    # Lengths beyond double precision stay as they are.
    top = longest if longest is not None and longest < 1e150 else 0.0
    pivot_rows = spark.sparkContext.broadcast(raised(chosen, top))  # at most ``pivots`` vectors
    copies = Window.partitionBy("h", "v").orderBy("key")
    first = rows.distinct().withColumn("h", F.xxhash64("v")).withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
    entries = first.groupBy("h", "v").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # at most k + 1 keys
    total = rows.count()
    parts = max(1, -(-total // part))
    indexed = entries.select(F.pmod("h", F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("side"), "keys", "v")
    wanted = usable(queries, key, vector).distinct()
    # Every query visits every part. A small index is repeated in lanes that share the queries.
    blocks = max(1, -(-GROUPS // parts))
    asked = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("side"), F.array("key").alias("keys"), "v")
    lanes = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = indexed.select("part", lanes.alias("lane"), "side", "keys", "v")
    right = asked.select("part", F.pmod(F.xxhash64("v", "keys"), F.lit(blocks)).cast("int").alias("lane"), "side", "keys", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, vectors, index = None, [], [], None
        for batch in batches:
            place = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            sides, names = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            lists = batch.column(4)
            out = []
            values = lists.flatten().to_numpy().reshape(len(sides), -1)
            asking = [i for i, s in enumerate(sides) if s]
            order = dict(zip(asking, orders(np.column_stack((values[asking], np.zeros(len(asking)))), pivot_rows.value, length))) if asking else {}
            for i, side in enumerate(sides):
                if place[i] != at:
                    at, keys, vectors, index = place[i], [], [], None
                if not side:
                    keys.append(names[i])
                    vectors.append(values[i])
                    continue
                if index is None and keys:
                    held = np.array(vectors)
                    index = Part(keys, held, pivot_rows.value, length, raised(held, top))
                    vectors = []
                if index is not None:
                    out += [(names[i][0], other, s) for s, other in index.nearest(names[i][0], values[i], order[i], k, share)]
            if out:
                q, o, s = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(o, pa.int64()), pa.array(s, pa.float64())], ["query_id", key, "score"])

    dealt = left.union(right).repartition("part", "lane").sortWithinPartitions("part", "lane", "side")
    found = dealt.mapInArrow(run, f"query_id long, {key} long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
