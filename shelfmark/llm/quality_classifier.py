"""Quality classifier by attention-based multiple-instance learning (operator 10).

A document is a bag of passages of ``WORDS`` words; only the bag has a label. Every
passage is encoded: counts of its hashed byte n-grams, damped by a logarithm and brought
to length one, are projected by a fixed random matrix; shares of symbols, capitals, digits
and repeated words are set beside them, and a learned layer follows. Gated
attention gives each passage a weight, ``softmax(w . (tanh(V h) * sigmoid(U h)))`` over
the passages of its document, and the weighted mean of the passages is scored.

The model is fitted on every passage of every labelled document. Their passages are
encoded once and written to the shared folder; each step of the search for the weights
(L-BFGS) is a scan of what was written, in which a task adds up loss and gradient of its
documents. The driver holds the weights and one such sum per task. Scoring uses every
passage of every whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.quality_rules import cells
from shelfmark.functions.memory import handing_back
from shelfmark.llm.scratch import discard, written
from shelfmark.llm.words import Block, blocks, row_blocks

WORDS, BINS, PROJECTED, HIDDEN, ATTENTION, GRAM = 64, 1024, 48, 24, 16, 3
#: Kinds of bytes whose share of a passage is a feature, each with its scale.
KINDS = ((b"#*$%&|<>", 8.0), (b"!?", 8.0), (bytes(range(65, 91)), 4.0), (bytes(range(48, 58)), 8.0))
INPUT = PROJECTED + len(KINDS) + 4
#: Passes over the training documents, moves that the search remembers, and the gradient at which it ends.
STEPS, MEMORY, FLAT, DECAY = 60, 10, 1e-5, 1e-4
#: Bytes of text that are encoded at once.
ENCODED = 1 << 19
#: Passages that one step of a pass holds, labels that may be broadcast, and digits of a mean that are kept:
#: the order in which tasks are added up cannot change them.
PASSAGES_PER_STEP, MAX_BROADCAST_LABELS, DIGITS = 8192, 500_000, 9


def held_out(key: str) -> Column:
    """Whether a row is kept from training: crc32 of its key as text leaves 1 when divided by 3."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def projection() -> np.ndarray:
    return (np.random.default_rng(7).standard_normal((BINS, PROJECTED)) / np.sqrt(PROJECTED))


def encode(block: Block, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage vectors, number of the first passage of each text). A text without words is one zero passage."""
    n_words = np.diff(block.first)
    counts = np.maximum(-(-n_words // WORDS), 1)
    first = np.concatenate(([0], np.cumsum(counts)))
    starts = np.repeat(block.bounds[:-1], counts)
    inside = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    later = inside > 0
    starts[later] = block.starts[np.repeat(block.first[:-1], counts)[later] + inside[later] * WORDS]
    ends = np.append(starts[1:], len(block.data))
    found = cells(block.data, BINS, GRAM)
    out = np.zeros((first[-1], INPUT))
    stops = np.minimum(ends, np.repeat(block.bounds[1:], counts) - (GRAM - 1))  # n-grams do not run into the next text
    for lo in range(0, first[-1], 512):
        hi = min(lo + 512, first[-1])
        sizes = np.maximum(stops[lo:hi] - starts[lo:hi], 0)
        owner = np.repeat(np.arange(hi - lo), sizes)
        bins = found[np.repeat(starts[lo:hi] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(owner))]
        table = np.bincount(owner * BINS + bins, minlength=(hi - lo) * BINS).reshape(hi - lo, BINS)
        table = np.log1p(table)
        table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)
        out[lo:hi, :PROJECTED] = table @ matrix
    out[:, PROJECTED:] = shares(block, starts, ends, n_words, counts)
    out[np.repeat(n_words == 0, counts)] = 0
    return out, first


def shares(block: Block, starts: np.ndarray, ends: np.ndarray, n_words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shares of kinds of bytes, of words seen before in the passage and just before, mean word length, and fill."""
    columns = []
    size = np.maximum(ends - starts, 1)
    for kind, scale in KINDS:
        member = np.zeros(256, dtype=bool)
        member[list(kind)] = True
        total = np.concatenate(([0], np.cumsum(member[block.data], dtype=np.int64)))
        columns.append(scale * (total[ends] - total[starts]) / size)
    first = np.concatenate(([0], np.cumsum(counts)))
    inside = np.arange(len(block.hashes)) - np.repeat(block.first[:-1], n_words)
    passage = np.repeat(first[:-1], n_words) + inside // WORDS
    words = np.maximum(np.bincount(passage, minlength=first[-1]), 1)
    order = np.lexsort((block.hashes, passage))
    known = np.zeros(len(order), dtype=bool)
    known[1:] = (block.hashes[order[1:]] == block.hashes[order[:-1]]) & (passage[order[1:]] == passage[order[:-1]])
    columns.append(2 * np.bincount(passage[order[known]], minlength=first[-1]) / words)
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (block.hashes[1:] == block.hashes[:-1]) & (passage[1:] == passage[:-1])
    columns.append(4 * np.bincount(passage[again], minlength=first[-1]) / words)
    columns.append(np.bincount(passage, weights=block.ends - block.starts, minlength=first[-1]) / words / 8)
    columns.append(words / WORDS)
    return np.stack(columns, axis=1)


class Model(NamedTuple):
    """Weights; a few thousand numbers."""

    encoder: np.ndarray
    encoder_bias: np.ndarray
    tanh: np.ndarray
    gate: np.ndarray
    attention: np.ndarray
    score: np.ndarray
    bias: np.ndarray


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def start() -> Model:
    make = np.random.default_rng(11).standard_normal
    return Model(
        make((INPUT, HIDDEN)) * np.sqrt(2 / INPUT),
        np.zeros(HIDDEN),
        make((HIDDEN, ATTENTION)) / np.sqrt(HIDDEN),
        make((HIDDEN, ATTENTION)) / np.sqrt(HIDDEN),
        make(ATTENTION) * 0.1,
        make(HIDDEN) / np.sqrt(HIDDEN),
        np.zeros(1),
    )


def forward(model: Model, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Scores of the documents whose passages ``x`` holds, each from ``first[i]`` to ``first[i + 1]``."""
    sizes = np.diff(first)
    h = np.tanh(x @ model.encoder + model.encoder_bias)
    t, g = np.tanh(h @ model.tanh), sigmoid(h @ model.gate)
    logits = (t * g) @ model.attention
    shifted = np.exp(logits - np.repeat(np.maximum.reduceat(logits, first[:-1]), sizes))
    weights = shifted / np.repeat(np.add.reduceat(shifted, first[:-1]), sizes)
    bag = np.add.reduceat(weights[:, None] * h, first[:-1], axis=0)
    return sigmoid(bag @ model.score + model.bias[0]), (h, t, g, weights, bag)


def losses(model: Model, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> tuple[float, Model]:
    """Sum of the documents' log losses, and its gradient."""
    sizes = np.diff(first)
    p, (h, t, g, weights, bag) = forward(model, x, first)
    odds = bag @ model.score + model.bias[0]
    d_out = p - label
    d_bag = np.repeat(d_out[:, None] * model.score, sizes, axis=0)
    d_weight = (d_bag * h).sum(axis=1)
    mean = np.repeat(np.add.reduceat(weights * d_weight, first[:-1]), sizes)
    d_logit = weights * (d_weight - mean)
    d_t = d_logit[:, None] * model.attention * g * (1 - t**2)
    d_g = d_logit[:, None] * model.attention * t * g * (1 - g)
    d_h = weights[:, None] * d_bag + d_t @ model.tanh.T + d_g @ model.gate.T
    d_in = d_h * (1 - h**2)
    slope = Model(x.T @ d_in, d_in.sum(axis=0), h.T @ d_t, h.T @ d_g, (t * g).T @ d_logit, bag.T @ d_out, np.array([d_out.sum()]))
    return float((np.logaddexp(0, odds) - label * odds).sum()), slope


def gradients(model: Model, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> Model:
    """Gradient of the mean log loss."""
    return Model(*(w / len(label) for w in losses(model, x, first, label)[1]))


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(passages of all rows, number of the first of each row and one more) of what ``fit`` has written."""
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int32, count=len(column) + 1, offset=4 * column.offset).astype(np.int64)
    values = np.frombuffer(data, dtype=np.float32, count=(offsets[-1] - offsets[0]) // 4, offset=offsets[0])
    return values.reshape(-1, INPUT), (offsets - offsets[0]) // (4 * INPUT)


def packed(model: Model) -> np.ndarray:
    return np.concatenate([w.ravel() for w in model])


def unpacked(values: np.ndarray) -> Model:
    like = start()
    cuts = np.cumsum([w.size for w in like])[:-1]
    return Model(*(part.reshape(w.shape) for part, w in zip(np.split(values, cuts), like)))


def search(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """The point of least value that L-BFGS finds from ``at`` in at most ``steps`` looks at ``objective`` (value, gradient)."""
    value, slope = objective(at)
    looks, moves, turns = 1, [], []
    while looks < steps and np.abs(slope).max() > FLAT:
        way, scales = slope.copy(), []
        for move, turn in zip(moves[::-1], turns[::-1]):
            scales.append(move @ way / (move @ turn))
            way -= scales[-1] * turn
        way *= moves[-1] @ turns[-1] / (turns[-1] @ turns[-1]) if moves else 1 / max(1.0, np.linalg.norm(slope))
        for move, turn, scale in zip(moves, turns, scales[::-1]):
            way += (scale - turn @ way / (move @ turn)) * move
        length = 1.0
        while looks < steps and length > 1e-6:
            new, (new_value, new_slope) = at - length * way, objective(at - length * way)
            looks += 1
            if new_value <= value - 1e-4 * length * (way @ slope):
                break
            length /= 4
        else:
            return at
        move, turn = new - at, new_slope - slope
        if move @ turn > 1e-10:
            moves, turns = [*moves, move][-MEMORY:], [*turns, turn][-MEMORY:]
        at, value, slope = new, new_value, new_slope
    return at


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", steps: int = STEPS) -> Model:
    """A model from the texts of ``df`` and ``labels`` (``key``, label 0 or 1), all of them.

    Rows without a label or text take no part. A key with several labels has the smallest.
    ``labels`` must hold only rows that training may see. Without both labels the model
    gives the share of label 1 to every text.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col("label").isin(0, 1)).groupBy(key).agg(F.min("label").alias("label"))
    few = usable.limit(MAX_BROADCAST_LABELS + 1).count() <= MAX_BROADCAST_LABELS
    matrix = projection()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), limit=ENCODED):
                x, first = encode(block, matrix)
                data = [x[a:b].astype(np.float32).tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, len(block.rows)), pa.array(data, pa.binary())], ["label", "x"])

    texts = df.select(F.col(key), F.col(text).cast("string").alias("text")).where("text is not null")
    joined = texts.join(F.broadcast(usable) if few else usable, key).select(F.col("label").cast("double"), "text")
    held = written(joined.mapInArrow(handing_back(encoded), "label double, x binary"), "passages")
    counts = {r["label"]: r["count"] for r in held.groupBy("label").count().collect()}
    n = sum(counts.values())

    def objective(values: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean log loss of all documents plus decay, and its gradient, in one pass."""
        model = unpacked(values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, total = 0.0, np.zeros(len(values))
            for batch in (b for b in batches if b.num_rows):
                label = batch.column(0).to_numpy()
                x, first = bags(batch.column(1))
                for lo, hi in row_blocks(first, PASSAGES_PER_STEP):
                    part = x[first[lo] : first[hi]].astype(np.float64)
                    one, slope = losses(model, part, first[lo : hi + 1] - first[lo], label[lo:hi])
                    loss += one
                    total += packed(slope)
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([total.tobytes()], pa.binary())], ["loss", "slope"])

        sums = held.mapInArrow(handing_back(run), "loss double, slope binary").collect()
        slope = sum(np.frombuffer(r["slope"]) for r in sums) / n
        value = sum(r["loss"] for r in sums) / n
        return round(value, DIGITS) + DECAY / 2 * values @ values, np.round(slope, DIGITS) + DECAY * values

    if len(counts) < 2:
        share = np.clip(counts.get(1.0, 0) / n if n else 0.5, 0.01, 0.99)
        model = start()._replace(score=np.zeros(HIDDEN), bias=np.array([np.log(share / (1 - share))]))
    else:
        model = unpacked(search(objective, packed(start()), steps))
    discard(held)
    return model


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with ``out``: the score, 0 to 1, of every whole text.

    A null or blank text is one passage of zeros and gets the score that the model has for
    it. Equal texts get equal scores; other columns never matter. A column ``out`` is replaced.
    """
    kept = [c for c in df.columns if c != out]
    matrix = projection()
    source = df.select(*kept, F.col(text).cast("string").alias("__text"))
    schema = df.select(*kept).schema.add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("__text"), limit=ENCODED):
                x, first = encode(block, matrix)
                scores, _ = forward(model, x, first)
                part = batch.slice(block.rows.start, len(block.rows))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(np.round(scores, 9))], [*kept, out])

    return source.mapInArrow(handing_back(run), schema)
