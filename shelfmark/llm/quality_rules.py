"""Quality rules (operator 6).

Five counts of a text decide its base verdict. The method's verdict is an importance
weight: byte n-grams of words are hashed into a fixed number of cells, one multinomial is
counted over trusted target texts and one over all raw texts, and a document's score is
the mean over its n-grams of log(target / raw). A document is kept if the score reaches a
fixed threshold. Both multinomials are counted over whole tables; their size is the number
of cells, so they are summed on the driver and broadcast whatever the corpus has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.words import Block, blocks, gram_hashes, windows

CELLS, WIDTH, WINDOW = 1 << 16, 3, 5
#: Least score kept, in nats per n-gram.
THRESHOLD = -0.7
LEAST_WORDS, REPEATED_PERCENT = 10, 20
# The symbols that are counted.
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_MULTIPLIER = np.uint32(2654435761)


def _prefix(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))


def cells(data: np.ndarray, n_cells: int = CELLS, width: int = WIDTH) -> np.ndarray:
    """Cell of the n-gram that starts at each byte (the last ones run past the end and are left out)."""
    if len(data) < width:
        return np.empty(0, dtype=np.int64)
    value = np.zeros(len(data) - width + 1, dtype=np.uint32)
    for i in range(width):
        value = value * np.uint32(257) + data[i : len(data) - width + 1 + i]
    return ((value * _MULTIPLIER) >> np.uint32(32 - n_cells.bit_length() + 1)).astype(np.int64)


def _gram_bounds(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Range of n-gram starts that lie within each text."""
    lo, hi = block.bounds[:-1], np.maximum(block.bounds[1:] - width + 1, block.bounds[:-1])
    return lo, hi


#: Cells to a row of counts.
ROW = 1024


def gram_counts(df: DataFrame, text: str, n_cells: int = CELLS, width: int = WIDTH) -> np.ndarray:
    """Counts per cell over the whole column. Each task sends its counts as rows of ROW cells, which are added up row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_cells, dtype=np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                found = cells(block.data, n_cells, width)
                lo, hi = _gram_bounds(block, width)
                inside = np.zeros(len(found) + 1, dtype=np.int8)
                np.add.at(inside, np.minimum(lo, len(found)), 1)
                np.add.at(inside, np.minimum(hi, len(found)), -1)
                total += np.bincount(found[np.cumsum(inside[:-1]) > 0], minlength=n_cells)
        parts = total.reshape(-1, min(ROW, n_cells))
        held = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([parts[r].tobytes() for r in held], pa.binary())], ["row", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # at most n_cells numbers
        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[row] = sums.get(row, 0) + np.frombuffer(data.as_buffer(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["row", "counts"])

    texts = df.select(F.col(text).cast("string").alias("t")).where("t is not null")
    summed = texts.mapInArrow(run, "row long, counts binary").repartition("row").mapInArrow(add, "row long, counts binary")
    counts = np.zeros((max(n_cells // ROW, 1), min(ROW, n_cells)), dtype=np.float64)
    for row, data in summed.collect():
        counts[row] += np.frombuffer(data, dtype=np.int64)
    return counts.reshape(-1)


def fit(target: DataFrame, raw: DataFrame, text: str = "text", n_cells: int = CELLS, width: int = WIDTH) -> np.ndarray:
    """log(target / raw) of each cell, with one added to every count. Empty tables give ratios of 0."""
    t, r = gram_counts(target, text, n_cells, width) + 1, gram_counts(raw, text, n_cells, width) + 1
    if t.sum() == n_cells:
        return np.zeros(n_cells)
    return np.log(t / t.sum()) - np.log(r / r.sum())


def repeated_words(block: Block, width: int = WINDOW) -> np.ndarray:
    """Words of each text that some window of ``width`` words covers which occurs more than once in that text."""
    starts, owner = windows(block, width)
    n = len(block.rows)
    if not len(starts):
        return np.zeros(n, dtype=np.int64)
    keys = gram_hashes(block.hashes, starts, width)
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(k), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    edges = np.zeros(len(block.hashes) + 1, dtype=np.int64)
    at = starts[order[twice]]
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    covered = _prefix(np.cumsum(edges[:-1]) > 0)
    return covered[block.first[1:]] - covered[block.first[:-1]]


def repeated_lines(block: Block) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    out = np.zeros(len(block.rows), dtype=np.int64)
    data = block.data.tobytes()
    for i in range(len(block.rows)):
        seen: set[bytes] = set()
        for line in data[block.bounds[i] : block.bounds[i + 1]].split(b"\n"):
            if line in seen:
                out[i] += bool(line.strip(b"\x20\x09\x0a\x0b\x0c\x0d"))
            else:
                seen.add(line)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(
    df: DataFrame,
    ratios: np.ndarray,
    text: str = "text",
    threshold: float = THRESHOLD,
    width: int = WIDTH,
) -> DataFrame:
    """``df`` without ``text`` and with the counts, ``score``, ``base_failed`` and ``kept``.

    A null counts as an empty text: no words, score 0, base_failed. Texts are read whole.
    Columns of ``df`` that have the name of a new column are replaced.
    """
    made = [*COUNTS, "score"]
    kept = [c for c in df.columns if c not in (text, *made, "base_failed", "kept")]
    source = df.select(*kept, df[text].cast("string").alias("__text"))
    model = df.sparkSession.sparkContext.broadcast(ratios)  # its size is the number of cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for batch in batches:
            for block in blocks(batch.column("__text")):
                symbols = _prefix(_IS_SYMBOL[block.data])
                heads = _prefix((block.data & 0xC0) != 0x80)
                sizes = np.concatenate(([0], np.cumsum(heads[block.ends] - heads[block.starts])))
                found = cells(block.data, len(weights), width)
                lo, hi = _gram_bounds(block, width)
                sums = np.concatenate(([0.0], np.cumsum(weights[found])))
                lo, hi = np.minimum(lo, len(found)), np.minimum(hi, len(found))
                columns = [
                    np.diff(block.first),
                    np.diff(sizes[block.first]),
                    np.diff(symbols[block.bounds]),
                    repeated_lines(block),
                    repeated_words(block),
                    np.round((sums[hi] - sums[lo]) / np.maximum(hi - lo, 1), 9),
                ]
                part = batch.slice(block.rows.start, len(block.rows))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *map(pa.array, columns)], [*kept, *made])

    schema = source.drop("__text").schema
    for name in COUNTS:
        schema = schema.add(name, "long")
    scored = source.mapInArrow(run, schema.add("score", "double"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
