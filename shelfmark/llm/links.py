"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.scratch import discard, written

#: Rounds after which a graph that still changes is taken for a fault.
MOST_ROUNDS = 60
#: Bits of the table that tells which rows of a scan a join will ask for.
KEY_BITS = 1 << 25


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is its smallest node.

    Links may repeat and have any direction. Each round hangs every node and its larger
    neighbours under the smallest neighbour (large star), then the smaller ones under
    the smallest (small star), until nothing changes; the number of rounds grows with
    the logarithm of the longest chain. No step collects a node's neighbours: each takes
    a minimum per node, combined before the shuffle, and joins it back. No table of
    links comes to the driver. An empty table gives an empty table.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs = written(pairs, "links")
    before = None
    for _ in range(MOST_ROUNDS):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        last, pairs = pairs, written(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        discard(last)
        now = pairs.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if now == before:
            stars = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
    raise RuntimeError("components did not settle")


def key_bits(rows: DataFrame, place: Column) -> np.ndarray:
    """Bits of the places of ``rows``, taken modulo KEY_BITS: a table of fixed size whatever the number of rows.

    It lets a scan leave out what surely is not wanted before a join that decides exactly.
    """
    spot = F.pmod(place, F.lit(KEY_BITS)) + 1
    grouped = rows.select(spot.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket"))
    out = np.zeros((KEY_BITS // 32768, 4096), dtype=np.uint8)
    for bucket, bits in grouped.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect():
        out[bucket - 1] = np.frombuffer(bits, dtype=np.uint8)
    return out.reshape(-1)
