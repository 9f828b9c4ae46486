"""N-gram Jaccard join (operator 4).

Documents are rows and word n-grams are columns of a 0/1 incidence matrix; the join is
the product of the matrix with its transpose, kept where overlap / union reaches the
threshold. Size-derived bounds leave most of the product uncomputed:

* A pair can only link if it shares a column among the first ``n - ceil(s * n) + 1`` of
  each row, under any one order of the columns. Only this head of each row takes part.
* Sizes of linked rows differ by a factor of at most ``s``.
* Overlaps are accumulated over the head's columns, and a pair is dropped when what was
  counted and what may still come stay below the least overlap its sizes allow.

* If a column is the first that two rows share, no more than the rest of each row from
  there on can be common; pairs for which that is too little are dropped at that column.

Frequent columns are put last, so that heads hold rare ones. Frequency is counted over
all documents in a hashed table of ``CELLS`` cells. It steers cost only: results are
exact under any order.

Texts with the same words are one class, found by a 128-bit digest, and mostly one row
(a bit table of fixed size lets the others be left out while scanning; those that slip
through do no harm). The product is taken in two passes. The first links each head
column's rows to a leader, the row of a size class in which the column comes earliest:
it has the fewest rare columns of its own, so whatever is similar to another row of the
column is mostly similar to it. Of the leaders of its columns a row takes those that lead most of them.
This settles large groups of near copies without their pairs; frequent columns are dealt
into parts with a leader each. Rows that are then still apart in a crowded column meet the few earliest
rows of all of it. The second pass takes
the full product of the head columns that still hold rows of different components. Pairs
of all passes are compared on heads and then verified on whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.memory import handing_back
from shelfmark.llm.links import KEY_BITS, components, key_bits
from shelfmark.llm.scratch import discard, written
from shelfmark.llm.words import LOWER, Block, blocks, constants, gram_hashes, mix, windows

WIDTH, PERCENT = 5, 80
#: Cells of the frequency table, and cells to a row of it.
CELLS, CELL_ROW = 1 << 25, 1 << 16
#: Parts, for each shuffle partition, into which head columns are dealt to find those of several rows.
PARTS_PER_TASK = 4
#: Head columns that a task deals at once, and rows of a batch of those found.
DEALT_COLUMNS, POSTED = 500_000, 20_000
#: Bytes of text that are cut at once.
TEXT = 1 << 19
#: Pairs with one leader to a group of a comparison.
GROUP = 256
#: Parts into which the rows of a frequent column are dealt in the first pass.
PARTS = 32
#: Leaders that a row is compared with in the first pass: those that lead most of its columns.
LEADERS = 2
#: Rows from which a column that holds different components is crowded, and its rows that the others meet before the product.
CROWD, EARLIEST = 32, 8
#: Passes in which columns are dealt to find leaders, each with its share of them.
SLICES = 4
#: Rows of one column to a tile of the second pass.
TILE = 2000


def sets(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram hash) of the distinct n-grams of each text, in order of both."""
    starts, owner = windows(block, width)
    keys = gram_hashes(block.hashes, starts, width)
    sizes = np.diff(block.first)
    for row in np.flatnonzero((sizes > 0) & (sizes < width)):
        n = int(sizes[row])
        keys = np.append(keys, gram_hashes(block.hashes, block.first[row : row + 1], n, 100 + n))
        owner = np.append(owner, row)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], keys[fresh]


def _cells(keys: np.ndarray, n_cells: int) -> np.ndarray:
    """Cell of each column."""
    return (mix(keys) >> np.uint64(64 - n_cells.bit_length() + 1)).astype(np.int64)


def _flush(held: list[np.ndarray], n_cells: int) -> Iterator[pa.RecordBatch]:
    """Counts of cells as compact rows of CELL_ROW cells."""
    at, n = np.unique(np.concatenate(held), return_counts=True)
    bounds = np.searchsorted(at, np.arange(0, n_cells + 1, CELL_ROW))
    rows = np.flatnonzero(np.diff(bounds))
    place, n = (at % CELL_ROW).astype("<u2"), np.minimum(n, 65535).astype("<u2")

    def packed(row: int) -> bytes:
        """Number of cells seen once, those, then the others and their counts."""
        p, c = place[bounds[row] : bounds[row + 1]], n[bounds[row] : bounds[row + 1]]
        once = p[c == 1]
        return np.array([len(once) % 65536, len(once) // 65536], dtype="<u2").tobytes() + once.tobytes() + p[c > 1].tobytes() + c[c > 1].tobytes()

    for lo in range(0, len(rows), 64):
        some = rows[lo : lo + 64]
        data = [packed(r) for r in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(data, pa.binary())], ["row", "data"])


def cell_bits(source: DataFrame, found, n_cells: int, rule) -> np.ndarray:
    """Bits of the cells whose count over the whole of ``source`` the rule accepts.

    ``found(batch)`` yields arrays of cells. Each task sends the counts of its cells in
    compact rows, which are added up row by row; the result has ``n_cells`` bits whatever
    the corpus is.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for some in found(batch):
                held.append(some.astype(np.int32))
                size += len(some)
                if size > 2_000_000:
                    yield from _flush(held, n_cells)
                    held, size = [], 0
        if size:
            yield from _flush(held, n_cells)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, total = -1, np.zeros(CELL_ROW, dtype=np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([np.packbits(rule(total)).tobytes()], pa.binary())], ["row", "bits"])
        for batch in batches:
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if r != row:
                    if row >= 0:
                        yield out()
                    row, total = r, np.zeros(CELL_ROW, dtype=np.int64)
                values = np.frombuffer(data.as_buffer(), dtype="<u2")
                once = 2 + int(values[0]) + 65536 * int(values[1])
                more = (len(values) - once) // 2
                total[values[2:once]] += 1
                total[values[once : once + more]] += values[once + more :]
        if row >= 0:
            yield out()

    counted = source.mapInArrow(handing_back(count), "row long, data binary")
    summed = counted.repartition("row").sortWithinPartitions("row").mapInArrow(handing_back(add), "row long, bits binary")
    bits = np.zeros((n_cells // CELL_ROW, CELL_ROW // 8), dtype=np.uint8)
    held = written(summed, "cells")
    for r, data in held.collect():  # n_cells bits in all
        bits[r] = np.frombuffer(data, dtype=np.uint8)
    discard(held)
    return bits.reshape(-1)


def _set(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> 3] >> (7 - (cell & 7))) & 1


def _let_through(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """Rows of (key, text, place) whose place has its bit set."""
    at = batch.column(2).to_numpy()
    return batch.filter(pa.array(((bits[at >> 3] >> (at & 7)) & 1).astype(bool)))


def frequent_cells(df: DataFrame, first, width: int) -> np.ndarray:
    """Bits of the cells that hold clearly more columns than a cell's usual share, over the texts that ``first`` lets through."""

    def found(batch: pa.RecordBatch):
        for block in blocks(_let_through(batch, first.value).column(1), LOWER, TEXT):
            starts, _ = windows(block, width)
            yield _cells(gram_hashes(block.hashes, starts, width), CELLS)

    return cell_bits(df, found, CELLS, lambda n: n > n.mean() + 5 * math.sqrt(n.mean()) + 3)


def least_overlap(a, b, percent: int):
    """Least overlap of linked sets of these sizes: percent / (100 + percent) of their sum, rounded up."""
    return -(-percent * (a + b) // (100 + percent))


def digests(df: DataFrame) -> DataFrame:
    """(key, words, h1, h2) of each text of ``df`` (key, text): number of words and digest of their sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), LOWER, TEXT):
                size = np.diff(block.first)
                inside = np.arange(len(block.hashes)) - np.repeat(block.first[:-1], size)
                made = []
                for seed in (3, 5):
                    terms = np.append(block.hashes * constants(int(size.max()), seed)[inside], np.uint64(0))
                    total = np.add.reduceat(terms, np.minimum(block.first[:-1], len(terms) - 1))
                    made.append(pa.array(np.where(size > 0, mix(total + size.astype(np.uint64)), np.uint64(0)).view(np.int64)))
                rows = batch.column(0).slice(block.rows.start, len(block.rows))
                yield pa.RecordBatch.from_arrays([rows, pa.array(size, pa.int64()), *made], ["key", "words", "h1", "h2"])

    return df.select("key", "text").mapInArrow(handing_back(run), "key long, words long, h1 long, h2 long")


def heads(df: DataFrame, first, bits: np.ndarray, width: int, percent: int) -> DataFrame:
    """(key, n, head, hot) of each text of ``df`` (key, text, place) that ``first`` lets through.

    These are set size, first columns, and which of those are frequent.

    Rare columns come first, then frequent ones; equal ranks are in order of their hashes.
    """
    frequent = df.sparkSession.sparkContext.broadcast(bits)  # CELLS bits
    names = ["key", "n", "head", "hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        for batch in batches:
            batch = _let_through(batch, first.value)
            for block in blocks(batch.column(1), LOWER, TEXT):
                owner, keys = sets(block, width)
                rows = len(block.rows)
                size = np.bincount(owner, minlength=rows)
                kind = _set(table, _cells(keys, CELLS))
                # Columns are in order of their hashes already: a stable sort by rank keeps that.
                order = np.argsort(owner * 2 + kind, kind="stable")
                keys, kind = keys[order], kind[order]
                begin = np.concatenate(([0], np.cumsum(size)))
                head = size - (-(-percent * size // 100)) + 1
                head[size == 0] = 0
                lists = np.repeat(begin[:-1], head) + np.arange(head.sum()) - np.repeat(np.cumsum(head) - head, head)
                offsets = pa.array(np.concatenate(([0], np.cumsum(head))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.rows.start, rows),
                        pa.array(size, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(keys[lists].view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array(kind[lists] == 1)),
                    ],
                    names,
                )

    return df.mapInArrow(handing_back(run), "key long, n long, head array<long>, hot array<boolean>")


def _compared(pairs: DataFrame, columns: DataFrame, keep, percent: int) -> DataFrame:
    """The pairs (a, b) for which ``keep(x, y, percent)`` holds of their ``columns`` (key, grams: sorted 64-bit numbers).

    Pairs meet in groups of one ``a``, whose columns travel once to each group; a group
    has GROUP pairs or so and is read as a stream.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    members = dealt.select("a", "part", F.col("b").alias("key")).union(dealt.select("a", "part", F.col("a").alias("key")).distinct())
    placed = members.join(columns, "key").select("a", "part", "key", "grams").repartition("a", "part").sortWithinPartitions("a", "part", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first = None, None
        for batch in batches:
            a, b = [], []
            for x, part, y, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                grams = np.frombuffer(data.as_buffer(), dtype=np.uint64)
                if (x, part) != group:  # a is the smaller key of its pairs, so it comes first
                    group, first = (x, part), np.array(grams)
                elif keep(first, grams, percent):
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return placed.mapInArrow(handing_back(run), "a long, b long")


def _overlap(p: np.ndarray, q: np.ndarray) -> int:
    small, large = (p, q) if len(p) <= len(q) else (q, p)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum())


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = _overlap(p, q)
    return 100 * both >= percent * (len(p) + len(q) - both)


def _may_be_similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two heads, each after its set's size, leave room for the least overlap.

    Beyond the columns common to the heads, no more than the rest of the row whose head
    ends earlier can be common.
    """
    n, m = int(p[0]), int(q[0])
    rest = max(n - (len(p) - 1), m - (len(q) - 1))
    return 100 * min(n, m) >= percent * max(n, m) and _overlap(p[1:], q[1:]) + rest >= least_overlap(n, m, percent)


def verify(pairs: DataFrame, df: DataFrame, table: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose whole sets reach the threshold, written; ``pairs`` is deleted.

    Heads are compared first, whole sets then. Texts of keys that surely are in no pair
    are left out while scanning: a bit table of fixed size tells which, and the join
    decides.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).to_pylist()
            data = [np.append(np.uint64(n), np.sort(x.values.to_numpy().view(np.uint64))).tobytes() for n, x in zip(size, batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["key", "grams"])

    packed = table.where("n > 0").select("key", "n", "head").mapInArrow(handing_back(pack), "key long, grams binary")
    left = written(_compared(pairs, packed, _may_be_similar, percent), "pairs")
    bits = key_bits(left.select(F.explode(F.array("a", "b")).alias("key")), F.xxhash64("key"))
    wanted = df.sparkSession.sparkContext.broadcast(bits)  # KEY_BITS bits
    place = F.pmod(F.xxhash64("key"), F.lit(KEY_BITS)).alias("place")
    source = df.select("key", "text", place)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = wanted.value
        for batch in batches:
            batch = _let_through(batch, marks)
            for block in blocks(batch.column(1), LOWER, TEXT):
                owner, keys = sets(block, width)
                bounds = np.searchsorted(owner, np.arange(len(block.rows) + 1))
                data = [keys[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(block.rows))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, len(block.rows)), pa.array(data, pa.binary())], ["key", "grams"])

    links = written(_compared(left, source.mapInArrow(handing_back(build), "key long, grams binary"), _similar, percent), "links")
    discard(left)
    discard(pairs)
    return links


def _postings(table: DataFrame) -> DataFrame:
    """(key, n, gram, hot, pos) of the head columns that are in more than one row; pos counts from 0.

    Columns are dealt by their hash in packed runs and sorted part by part, so the test is
    exact whatever the corpus is. Frequent columns are taken without it: they are few, and
    the parts hold no large group.
    """
    parts = PARTS_PER_TASK * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = table.select("key", "n", "head", "hot")

    def columns(batch: pa.RecordBatch, hot: bool) -> tuple[np.ndarray, ...]:
        """key, n, gram and pos of the frequent, or of the other head columns of a batch."""
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero(batch.column(3).flatten().to_numpy(zero_copy_only=False) == hot)
        row = np.repeat(np.arange(len(sizes)), sizes)[at]
        return batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row], batch.column(2).flatten().to_numpy()[at], place[at]

    def posted(key: np.ndarray, n: np.ndarray, gram: np.ndarray, pos: np.ndarray, hot: bool) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(key), POSTED):
            some = slice(lo, lo + POSTED)
            flags = pa.array(np.full(len(key[some]), hot))
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(n[some]), pa.array(gram[some]), flags, pa.array(pos[some])], ["key", "n", "gram", "hot", "pos"])

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from posted(*columns(batch, True), True)

    def packed(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """One row for each part: its columns as four runs of numbers."""
        key, n, gram, pos = (np.concatenate(x) for x in zip(*held))
        part = (mix(gram.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        key, n, gram, pos, part = key[order], n[order], gram[order], pos[order], part[order]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        bounds = np.append(first, len(part))
        for lo in range(0, len(first), 64):
            data = [gram[i:j].tobytes() + key[i:j].tobytes() + n[i:j].tobytes() + pos[i:j].tobytes() for i, j in zip(bounds[lo : lo + 64], bounds[lo + 1 : lo + 65])]
            yield pa.RecordBatch.from_arrays([pa.array(part[first[lo : lo + 64]]), pa.array(data, pa.binary())], ["part", "data"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(columns(batch, False))
            size += len(held[-1][0])
            if size > DEALT_COLUMNS:
                yield from packed(held)
                held, size = [], 0
        if size:
            yield from packed(held)

    def shared(runs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Columns of one part that are there twice."""
        gram, key, n, pos = (np.concatenate([r[k] for r in runs]) for k in range(4))
        order = np.argsort(gram, kind="stable")
        gram = gram[order]
        same = gram[1:] == gram[:-1]
        twice = np.append(False, same) | np.append(same, False)
        at = order[twice]
        yield from posted(key[at], n[at], gram[twice], pos[at], False)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs = None, []
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if p != part and runs:
                    yield from shared(runs)
                    runs = []
                part = p
                runs.append(np.frombuffer(data.as_buffer(), dtype=np.int64).reshape(4, -1).copy())
        if runs:
            yield from shared(runs)

    kind = "key long, n long, gram long, hot boolean, pos long"
    rare = narrow.mapInArrow(handing_back(deal), "part long, data binary").repartition("part").sortWithinPartitions("part").mapInArrow(handing_back(gather), kind)
    return narrow.where(F.exists("hot", lambda h: h)).mapInArrow(handing_back(frequent), kind).union(rare)


def _room(n, pos, m, other, percent: int):
    """Whether two rows may be similar whose first common column is at ``pos`` and ``other``."""
    return F.least(n - pos, m - other) >= F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))


def _leader_votes(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b, votes): the rows ``a`` that lead a column of row ``b``, and how many.

    Each row of a column goes with the leader of its size class, and leaders go with those of
    other parts and the class above.
    """
    level = F.floor(F.log(F.col("n").cast("double")) / math.log(1.25)).cast("int")
    dealt = postings.withColumn("level", level).withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(PARTS))).otherwise(F.lit(0)))
    early = F.shiftleft("pos", 36) + F.pmod(F.xxhash64("key"), F.lit(1 << 36))
    group = ["gram", "level", "part"]
    named = [F.min_by("key", early).alias("leader"), F.min_by("n", early).alias("m"), F.min(early).alias("early")]
    leaders = written(dealt.groupBy(*group).agg(*named, F.count("*").alias("rows")), "leaders")
    near = _room(F.col("n"), F.col("pos"), F.col("m"), F.shiftright("early", 36), percent)
    inside = dealt.join(leaders.where("rows > 1"), group).where((F.col("key") != F.col("leader")) & near).select(F.col("leader").alias("a"), F.col("key").alias("b"))
    heads = leaders.groupBy("gram", "level").agg(F.min_by("leader", "early").alias("head"))
    parts = leaders.join(heads, ["gram", "level"]).where("leader <> head").select(F.col("head").alias("a"), F.col("leader").alias("b"))
    above = heads.select("gram", (F.col("level") + 1).alias("level"), F.col("head").alias("other"))
    levels = heads.join(above, ["gram", "level"]).where("head <> other").select(F.col("head").alias("a"), F.col("other").alias("b"))
    found = written(inside.union(parts).union(levels).groupBy("a", "b").agg(F.count("*").alias("votes")), "votes")
    discard(leaders)
    return found


def _leader_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each row with the LEADERS rows that lead most of its columns.

    A row has many columns, with as many leaders where near copies abound. What the chosen
    ones leave apart is left to the full product of the second pass.
    """
    slices = [_leader_votes(postings.where(F.pmod("gram", F.lit(SLICES)) == k), percent) for k in range(SLICES)]
    votes = reduce(DataFrame.union, slices).groupBy("a", "b").agg(F.sum("votes").alias("votes"))
    most = Window.partitionBy("b").orderBy(F.desc("votes"), "a")
    chosen = votes.withColumn("place", F.row_number().over(most)).where(F.col("place") <= LEADERS)
    pairs = written(chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    for some in slices:
        discard(some)
    return pairs


def _apart(postings: DataFrame, links: DataFrame) -> DataFrame:
    """(gram, key, n, pos, component, rows) of the columns that hold rows of different components of ``links``."""
    stars = components(links)
    placed = postings.join(stars, postings["key"] == stars["node"], "left").select("gram", "key", "n", "pos", F.coalesce("component", "key").alias("component"))
    columns = placed.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows"))
    return placed.join(columns.where("low <> high").select("gram", "rows"), "gram")


def _crowd_pairs(apart: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the rows of crowded columns with the EARLIEST rows of these, where components differ.

    Without them the product would hold every member of a large group for each near copy
    that its leaders have missed.
    """
    crowd = apart.where(F.col("rows") >= CROWD)
    early = crowd.withColumn("place", F.row_number().over(Window.partitionBy("gram").orderBy("pos", "key"))).where(F.col("place") <= EARLIEST)
    early = early.select("gram", F.col("key").alias("other"), F.col("component").alias("group"), F.col("n").alias("m"), F.col("pos").alias("at"))
    near = _room(F.col("n"), F.col("pos"), F.col("m"), F.col("at"), percent)
    met = crowd.join(early, "gram").where((F.col("component") != F.col("group")) & near)
    return met.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def _product(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows of different components that share a head column with room for enough overlap.

    The rows of a column are cut into tiles of TILE rows in order of size; each pair of
    tiles that sizes allow is one group, so no group holds more than two tiles.
    """
    order = Window.partitionBy("gram").orderBy("n", "key")
    placed = postings.withColumn("tile", F.floor((F.row_number().over(order) - 1) / TILE).cast("int"))
    tiles = placed.groupBy("gram", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    pairs = tiles.alias("p").join(tiles.alias("q"), (F.col("p.gram") == F.col("q.gram")) & (F.col("p.tile") <= F.col("q.tile")) & (100 * F.col("p.high") >= percent * F.col("q.low")))
    pairs = pairs.select(F.col("p.gram").alias("gram"), F.col("p.tile").alias("p"), F.col("q.tile").alias("q"))
    sides = pairs.select("gram", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("tile"))
    members = sides.join(placed, ["gram", "tile"]).select("gram", "p", "q", "tile", "key", "n", "pos", "component")
    sorted_rows = members.repartition("gram", "p", "q").sortWithinPartitions("gram", "p", "q", "tile", "n", "key")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(table: pa.Table, last: bool):
            marks = [table.column(c).to_numpy() for c in ("gram", "p", "q")]
            change = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            bounds = [0, *change.tolist(), table.num_rows]
            for lo, hi in zip(bounds[: len(bounds) - (1 if last else 2)], bounds[1:]):
                yield lo, hi

        def run(table: pa.Table, lo: int, hi: int):
            part = table.slice(lo, hi - lo)
            key, n, pos, component, tile = (part.column(c).to_numpy() for c in ("key", "n", "pos", "component", "tile"))
            p, q = part.column("p")[0].as_py(), part.column("q")[0].as_py()
            left, right = np.flatnonzero(tile == p), np.flatnonzero(tile == q)
            for i in left:
                others = right[right > i] if p == q else right
                others = others[component[others] != component[i]]
                room = np.minimum(n[i] - pos[i], n[others] - pos[others])
                others = others[(room >= least_overlap(n[i], n[others], percent)) & (100 * n[i] >= percent * n[others]) & (100 * n[others] >= percent * n[i])]
                if len(others):
                    a, b = np.minimum(key[i], key[others]), np.maximum(key[i], key[others])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        def packed(made):
            held, size = [], 0
            for batch in made:
                held.append(batch)
                size += batch.num_rows
                if size > 20_000:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

        def all_groups():
            nonlocal rest
            for batch in batches:
                table = pa.Table.from_batches([batch])
                table = (pa.concat_tables([rest, table]) if rest is not None else table).combine_chunks()
                end = 0
                for lo, hi in groups(table, False):
                    yield from run(table, lo, hi)
                    end = hi
                rest = table.slice(end)
            if rest is not None and rest.num_rows:
                for lo, hi in groups(rest, True):
                    yield from run(rest, lo, hi)

        yield from packed(all_groups())

    return sorted_rows.mapInArrow(handing_back(multiply), "a long, b long").distinct()


def similar(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row: set size, smallest key reachable by links.

    ``key`` holds integers; rows that repeat a key are one row of each distinct set.
    A-Z count as a-z. A text of fewer than ``width`` words has its whole sequence as the
    one element of its set; a null, empty or blank text has no element and no link. A row
    with a null key takes no part: it comes back with nulls.
    """
    texts = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    table = written(digests(texts), "digests")
    classes = table.where("words > 0").groupBy("h1", "h2").agg(F.min("key").alias("first"))
    first = texts.sparkSession.sparkContext.broadcast(key_bits(classes, F.xxhash64("first")))  # KEY_BITS bits

    place = F.pmod(F.xxhash64("key"), F.lit(KEY_BITS)).alias("place")
    single = texts.where("key is not null").select("key", "text", place)
    known = written(heads(single, first, frequent_cells(single, first, width), width, percent), "heads")
    shared = written(_postings(known.where("n > 0")), "postings")
    near = verify(_leader_pairs(shared, percent), texts, known, width, percent)
    crowd = written(_crowd_pairs(_apart(shared, near), percent), "pairs")
    near = near.union(verify(crowd, texts, known, width, percent))
    found = written(_product(_apart(shared, near).drop("rows"), percent), "pairs")
    discard(shared)
    links = near.union(verify(found, texts, known, width, percent))
    group = components(links)
    sizes = written(known.select("key", "n").distinct(), "sizes")
    discard(known)
    top = classes.join(group, classes["first"] == group["node"], "left").select("h1", "h2", "first", F.coalesce("component", "first").alias("component_id"))
    top = top.join(sizes, top["first"] == sizes["key"], "left").select("h1", "h2", "component_id", F.col("n").alias("size"))
    named = table.join(top, ["h1", "h2"], "left")
    present, keyed = F.col("words") > 0, F.col("key").isNotNull()
    return named.select(
        F.col("key").alias(key),
        F.when(keyed, F.when(present, F.col("size")).otherwise(F.lit(0))).cast("long").alias("n_shingles"),
        F.when(keyed, F.when(present, F.col("component_id")).otherwise(F.col("key"))).alias("component_id"),
    )
