"""Subword lattice scoring (operator 12).

The model is a unigram over the units of an existing subword vocabulary: its pieces, a
single-byte unit for every byte, and one end of text. A text is the sum over all of its
segmentations into units, so its score is a marginal probability, computed by the forward
recursion in log space.

The vocabulary's own scores weight the segmentations first. They are merge ranks, from
which a unit of rank r gets a share of 1 / (r + 1). Training texts then re-estimate the
shares: forward and backward recursions give the expected count of every unit over all
segmentations, ``ITERATIONS`` times; the first shares stay in as ``PRIOR`` counts.

No unit holds certain byte pairs, such as a letter and the space after it. Every
segmentation has a boundary there, so a text's probability is the product over the chunks
between such places. Equal chunks are computed once: training chunks are counted over the
corpus, and each block (``packed``) scores its distinct ones.

The base score is an add-one unigram of words. Every block asks for the training counts of
its own words; the table of counts grows with the corpus and never meets in one place. The
model has one number per unit, whatever the corpus.

Defined results: a null text is empty and has its end only; repeated rows are scored, and
counted, each; a null key is not held out; without training texts every word has count 0
and the vocabulary's own shares stay. Other columns are not read. An empty table gives an
empty table. A text of any length lies in one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfmark.llm import packed
from shelfmark.llm.packed import look_up, pack, unpack
from shelfmark.llm.scratch import written
from shelfmark.llm.words import LOWER, blocks, constants, mix, powers, text_bytes

ITERATIONS = 2
#: Counts that the vocabulary's own shares stand for.
PRIOR = 32_000
#: Chunks up to this length are worked on together, longer ones by themselves.
TOGETHER = 48
#: Chunks of one length that are worked on together.
ROWS = 20_000
#: Expected counts are added up in steps of 1 / STEPS, so that their sum does not depend on the order.
STEPS = 1 << 16


def held_out(key: Column | str) -> Column:
    """Whether a row is kept from training: crc32 of its key as text leaves 2 when divided by 7."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


class Vocabulary:
    """Units as a trie of arrays, the byte pairs that occur inside units, and the first share of each unit."""

    def __init__(self, ranked: list[bytes]) -> None:
        """``ranked``: pieces by rank; bytes that are no piece follow."""
        share: dict[bytes, float] = {}
        for rank, unit in enumerate([*ranked, *(bytes([b]) for b in range(256))]):
            share[unit] = share.get(unit, 0.0) + 1 / (rank + 1)
        units = sorted(share)
        self.units = units
        self.shares = np.array([share[u] for u in units])
        self.shares /= self.shares.sum()
        state = {b"": 0}
        edges: list[tuple[int, int]] = []
        for unit in units:
            for k in range(1, len(unit) + 1):
                if unit[:k] not in state:
                    state[unit[:k]] = len(state)
                    edges.append((state[unit[: k - 1]] * 256 + unit[k - 1], state[unit[:k]]))
        edges.sort()
        self.keys, self.children = (np.array(x, dtype=np.int64) for x in zip(*edges))
        self.unit_of = np.full(len(state), -1, dtype=np.int64)
        self.unit_of[[state[u] for u in units]] = np.arange(len(units))
        self.inside = np.zeros(1 << 16, dtype=bool)
        for unit in units:
            for a, b in zip(unit, unit[1:]):
                self.inside[a * 256 + b] = True

    @cached_property
    def child(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.children.tolist()))

    def walk(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next state of each, or -1."""
        key = state * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.children[at], -1)


def vocabulary(path: str) -> Vocabulary:
    """The units of a SentencePiece model, ranked by its scores; its byte and control symbols are no pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(-model.get_score(i), i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return Vocabulary([model.id_to_piece(i).replace("▁", " ").encode() for _, i in sorted(pieces)])


class Chunks:
    """Distinct chunks by length: what the recursions work on."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray) -> None:
        self.data, self.lengths = data, lengths
        self.starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, dtype=np.int64)

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(chunk numbers, bytes as rows) of chunks of one length."""
        order = np.argsort(self.lengths, kind="stable")
        bounds = np.flatnonzero(np.diff(self.lengths[order])) + 1
        for same in np.split(order, bounds):
            length = int(self.lengths[same[0]]) if len(same) else 0
            step = ROWS if length <= TOGETHER else 1
            for lo in range(0, len(same), step):
                own = same[lo : lo + step]
                yield own, self.data[self.starts[own][:, None] + np.arange(length)]


#: (from, to, rows, units) of edges that share their places.
Edges = list[tuple[int, int, np.ndarray, np.ndarray]]


def _forward(vocab: Vocabulary, logs: np.ndarray, rows: np.ndarray, keep: bool) -> tuple[np.ndarray, Edges]:
    """Forward log sums at every place of ``rows`` of one length."""
    n, length = rows.shape
    ahead = np.full((length + 1, n), -np.inf)
    ahead[0] = 0
    every, kept = np.arange(n), []
    for i in range(length):
        live, state = every, np.zeros(n, dtype=np.int64)
        for j in range(i, length):
            state = vocab.walk(state, rows[live, j])
            on = state >= 0
            if not on.all():
                live, state = live[on], state[on]
            if not len(live):
                break
            unit = vocab.unit_of[state]
            is_unit = unit >= 0
            at, unit = (live, unit) if is_unit.all() else (live[is_unit], unit[is_unit])
            if len(at):
                ahead[j + 1, at] = np.logaddexp(ahead[j + 1, at], ahead[i, at] + logs[unit])
                if keep:
                    kept.append((i, j + 1, at, unit))
    return ahead, kept


def _long(vocab: Vocabulary, logs: list[float], data: bytes) -> tuple[np.ndarray, Edges]:
    """The same for one long chunk, edge by edge."""
    child, unit_of = vocab.child, vocab.unit_of
    ahead = [0.0] + [-np.inf] * len(data)
    edges = []
    for i in range(len(data)):
        here, state = ahead[i], 0
        for j in range(i, len(data)):
            state = child.get(state * 256 + data[j], -1)
            if state < 0:
                break
            unit = unit_of[state]
            if unit >= 0:
                a, b = ahead[j + 1], here + logs[unit]
                big, small = (a, b) if a > b else (b, a)
                ahead[j + 1] = big + np.log1p(np.exp(small - big))
                edges.append((i, j + 1, unit))
    return np.array(ahead)[:, None], edges


def marginals(vocab: Vocabulary, shares: np.ndarray, chunks: Chunks) -> np.ndarray:
    """Log probability of each chunk: the sum over all of its segmentations."""
    logs, out = np.log(shares), np.zeros(len(chunks.lengths))
    listed = logs.tolist()
    for own, rows in chunks.groups():
        if rows.shape[1] <= TOGETHER:
            out[own] = _forward(vocab, logs, rows, False)[0][-1]
        elif rows.shape[1]:
            out[own] = _long(vocab, listed, rows[0].tobytes())[0][-1]
    return out


def expected(vocab: Vocabulary, shares: np.ndarray, chunks: Chunks, counts: np.ndarray) -> np.ndarray:
    """Expected number of each unit in ``counts`` copies of the chunks, over all segmentations, in steps of 1 / STEPS."""
    logs, out = np.log(shares), np.zeros(len(shares), dtype=np.int64)
    listed = logs.tolist()
    for own, rows in chunks.groups():
        length = rows.shape[1]
        if length <= TOGETHER:
            ahead, edges = _forward(vocab, logs, rows, True)
        else:
            ahead, single = _long(vocab, listed, rows[0].tobytes())
            edges = [(i, j, np.zeros(1, dtype=np.int64), np.array([u])) for i, j, u in single]
        total, n = ahead[-1], counts[own]
        back = np.full_like(ahead, -np.inf)
        back[-1] = 0
        # Edges come by their first place, so backwards all that leave later places are done.
        for i, j, at, unit in reversed(edges):
            way = back[j, at] + logs[unit]
            back[i, at] = np.logaddexp(back[i, at], way)
            weight = np.rint(np.exp(ahead[i, at] + way - total[at]) * n[at] * STEPS)
            if len(unit) > 2000:
                out += np.bincount(unit, weights=weight, minlength=len(out)).astype(np.int64)
            else:
                np.add.at(out, unit, weight.astype(np.int64))
    return out


def cut_chunks(vocab: Vocabulary, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Start of every chunk of the texts within ``bounds``."""
    first = np.zeros(len(data), dtype=bool)
    first[1:] = ~vocab.inside[data[:-1].astype(np.int64) * 256 + data[1:]]
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return np.flatnonzero(first)


#: Unlike words, chunks may hold spaces, and every byte has a number here.
_BYTE = constants(256, 29)


def chunk_keys(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    lengths = np.diff(np.append(starts, len(data)))
    inside = np.arange(len(data)) - np.repeat(starts, lengths)
    # Values depend on place and byte; the length keeps apart what zero bytes could not.
    return mix(np.add.reduceat(_BYTE[data] * powers(int(lengths.max()))[inside], starts) + lengths.astype(np.uint64))


_BLOCK = "block long, size long, ids array<{key}>, held array<boolean>, word_first binary, word_ids binary, word_keys binary, word_n binary, chunk_first binary, chunk_ids binary, chunk_data binary, chunk_lengths binary, chunk_n binary"


class _Held:
    """Texts gathered for the next block."""

    def __init__(self) -> None:
        self.n = 0
        self.ids: list = []
        self.held: list[np.ndarray] = []
        self.words: list[tuple] = []
        self.chunks: list[tuple] = []
        self.bytes: list[pa.Array] = []

    def add(self, vocab: Vocabulary, block, raw: np.ndarray, ids: list, held: np.ndarray) -> None:
        self.ids += ids
        self.held.append(held)
        keys, _, _, local = packed.distinct(block.hashes)
        self.words.append((keys, local, np.diff(block.first)))
        starts = cut_chunks(vocab, raw, block.bounds)
        if len(starts):
            keys, place, _, local = packed.distinct(chunk_keys(raw, starts))
            offsets = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32))
            tiles = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(np.ascontiguousarray(raw))])
            self.bytes.append(tiles.take(pa.array(place)))
        else:
            keys, local = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
        self.chunks.append((keys, local, np.diff(np.searchsorted(starts, block.bounds))))
        self.n += len(block.starts) + len(ids)

    @staticmethod
    def _merged(parts: list[tuple], held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first entry of each text, ids, distinct keys, a place of each among all parts' keys, training counts)."""
        keys, place, _, renamed = packed.distinct(np.concatenate([k for k, _, _ in parts]))
        shift = np.cumsum([0, *(len(k) for k, _, _ in parts)])
        ids = np.concatenate([renamed[a + i.astype(np.int64)] for a, (_, i, _) in zip(shift, parts)])
        sizes = np.concatenate([s for _, _, s in parts])
        counts = np.bincount(ids[np.repeat(~held, sizes)], minlength=len(keys))
        return np.concatenate(([0], np.cumsum(sizes))), ids, keys, place, counts

    def row(self, block: int) -> dict:
        held = np.concatenate(self.held)
        first, ids, keys, _, n = self._merged(self.words, held)
        out = {"block": block, "size": self.n, "ids": self.ids, "held": held.tolist(), "word_first": pack(first), "word_ids": pack(ids), "word_keys": pack(keys), "word_n": pack(n)}
        first, ids, _, place, n = self._merged(self.chunks, held)
        tiles = pa.chunked_array(self.bytes, pa.binary()).combine_chunks().take(pa.array(place)) if len(place) else pa.array([], pa.binary())
        data, offsets = text_bytes(tiles.view(pa.string()))
        return out | {"chunk_first": pack(first), "chunk_ids": pack(ids), "chunk_data": pack(data[offsets[0] : offsets[-1]]), "chunk_lengths": pack(np.diff(offsets)), "chunk_n": pack(n)}


def encoded(documents: DataFrame, key: str, text: str, vocab: Vocabulary, block_words: int) -> DataFrame:
    """Blocks of texts as numbers of their words and chunks."""
    kind = documents.schema[key].dataType
    schema = T.StructType.fromDDL(_BLOCK.format(key=kind.simpleString()))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, made = _Held(), 0
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for block in blocks(batch.column(2), LOWER):
                lo, hi = block.rows.start, block.rows.stop
                gathered.add(vocab, block, raw[offsets[lo] : offsets[hi]], batch.column(0).slice(lo, hi - lo).to_pylist(), held[lo:hi])
                if gathered.n >= block_words:
                    yield pa.RecordBatch.from_pylist([gathered.row(packed.block_number(made))], schema=arrow)
                    gathered, made = _Held(), made + 1
        if gathered.n:
            yield pa.RecordBatch.from_pylist([gathered.row(packed.block_number(made))], schema=arrow)

    rows = documents.select(F.col(key).alias("id"), held_out(key).alias("held"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def word_counts(held: DataFrame) -> DataFrame:
    """Reports of the training count of every word of every block, 0 where only held-out texts have it."""
    arrow, ranges = packed.arrow_schema(packed.REPORT), packed.ranges_for(packed.entries(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, n = unpack(row["word_keys"], np.uint64), unpack(row["word_n"], np.int64)
                order = np.argsort(keys)
                yield packed.report_batch(packed.reports(row["block"], keys[order], n[order], ranges), arrow)

    return held.select("block", "word_keys", "word_n").mapInArrow(run, packed.REPORT)


def _distinct_chunks(row: dict) -> Chunks:
    return Chunks(unpack(row["chunk_data"], np.uint8), unpack(row["chunk_lengths"], np.int64))


def chunk_counts(held: DataFrame) -> DataFrame:
    """(chunk, n): the distinct chunks of all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, n = unpack(row["chunk_lengths"], np.int64), unpack(row["chunk_n"], np.int64)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                chunks = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(unpack(row["chunk_data"], np.uint8))])
                out = pa.RecordBatch.from_arrays([chunks, pa.array(n)], ["chunk", "n"])
                yield out.filter(pa.array(n > 0))

    found = held.select("chunk_data", "chunk_lengths", "chunk_n").mapInArrow(run, "chunk binary, n long")
    return found.groupBy("chunk").agg(F.sum("n").alias("n"))


def learn(counted: DataFrame, ends: int, vocab: Vocabulary, iterations: int = ITERATIONS, prior: int = PRIOR) -> tuple[np.ndarray, float]:
    """(share of each unit, share of the end) from chunk counts and the number of training texts."""
    shares = vocab.shares
    end = 0.5  # before anything is known an end stands beside every unit

    def run(batches: Iterator[pa.RecordBatch], shares: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shares), dtype=np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0).view(pa.string()))
            total += expected(vocab, shares, Chunks(data[offsets[0] : offsets[-1]], np.diff(offsets)), batch.column(1).to_numpy())
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["unit", "n"])

    for _ in range(iterations):
        part = counted.mapInArrow(lambda batches, s=shares: run(batches, s), "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n"))
        found = prior * vocab.shares
        for unit, n in part.collect():  # one row per unit of the vocabulary at most
            found[unit] += n / STEPS
        shares = found / found.sum()
        end = (ends + 1) / (found.sum() + ends + 1)
    return shares, end


def score(documents: DataFrame, vocab: Vocabulary, key: str = "doc_id", text: str = "text", iterations: int = ITERATIONS, block_words: int = packed.BLOCK_WORDS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row. Scores are log10 probabilities."""
    held = written(encoded(documents, key, text, vocab, block_words), "texts")
    counts = written(packed.totals(word_counts(held)), "word-counts")
    n_known, n_words = packed.owned(counts)
    ends = held.select(F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0)).alias("n")).first()["n"]
    train_tokens, kinds = n_words + ends, n_known + (ends > 0)
    shares, end = learn(written(chunk_counts(held), "chunks"), ends, vocab, iterations)
    shares = shares * (1 - end)
    kind = held.schema["ids"].dataType.elementType.simpleString()
    with_lattice = "block long, ids array<{key}>, held array<boolean>, word_first binary, word_ids binary, word_keys binary, lattice binary".format(key=kind)
    arrow = packed.arrow_schema(with_lattice)

    def lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                each = marginals(vocab, shares, _distinct_chunks(row))
                first = unpack(row["chunk_first"], np.int64)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                sums = np.bincount(owner, weights=each[unpack(row["chunk_ids"], np.uint32)], minlength=len(first) - 1)
                out = {k: row[k] for k in ("block", "ids", "held", "word_first", "word_ids", "word_keys")}
                yield pa.RecordBatch.from_pylist([out | {"lattice": pack((sums + np.log(end)) / np.log(10))}], schema=arrow)

    def answer(row: dict, keys: np.ndarray, total: np.ndarray, own: np.ndarray) -> list[dict]:
        at = look_up(unpack(row["word_keys"], np.uint64), keys)
        count = np.where(at >= 0, total[at] if len(total) else 0, 0)
        ids, first = unpack(row["word_ids"], np.uint32), unpack(row["word_first"], np.int64)
        n_texts, sizes = len(first) - 1, np.diff(first)
        owner = np.repeat(np.arange(n_texts), sizes)
        logs = np.bincount(owner, weights=np.log10(count + 1.0)[ids], minlength=n_texts) + np.log10(ends + 1.0)
        base = logs - (sizes + 1) * np.log10(float(train_tokens + kinds + 1))
        seen = np.bincount(owner, weights=(count > 0)[ids], minlength=n_texts).astype(np.int64) + (ends > 0)
        sums = unpack(row["lattice"], np.float64)
        return [
            {"id": i, "held_out": h, "n_tokens": int(n) + 1, "n_known": int(k), "train_tokens": train_tokens, "base_score": float(b), "score": float(s)}
            for i, h, n, k, b, s in zip(row["ids"], row["held"], sizes, seen, base, sums)
        ]

    scored = held.drop("size", "word_n", "chunk_n").mapInArrow(lattice, with_lattice)
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = packed.answered(scored, counts, scored.columns[1:], answer, schema)
    return out.withColumnRenamed("id", key)
