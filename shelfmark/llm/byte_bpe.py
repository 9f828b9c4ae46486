"""Byte-level BPE encoding and decoding (operator 2).

The tokens are the byte strings of a rank file. Each piece of text that the
pre-splitting pattern matches is encoded separately. A piece is mapped from bytes to
Latin-1 characters, so that an Aho-Corasick automaton over the tokens can read it;
the automaton runs over the reversed piece and so gives the longest token that starts
at each byte. The encoder takes the longest token, checks that the pair with the token
before it is one that merging by rank would leave standing, and otherwise tries the
next shorter prefix token or steps back one token. A bit per position keeps a dead end
from being entered twice, which bounds the work by the length of the piece. The answers
for token pairs, for pieces and for runs between single spaces are memoised (each store
is emptied when it reaches a fixed size). Results equal those of merging by rank.

A single space between two characters that are not white space always starts a new
piece and never looks back, so a text may be cut there, each cut run be encoded with the
space before it, and the answer be kept for the next time the run comes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Entries held by the memos of runs, pieces and pairs, per Python worker.
RUNS, PIECES, PAIRS = 350_000, 150_000, 300_000
#: Longer runs and pieces are not memoised.
MEMO_BYTES = 64
#: Rows to an output batch.
ROWS = 200


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens by rank from the lines ``base64 rank`` of a rank file."""
    ranks = {}
    for line in data.splitlines():
        if line:
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not 0 .. n-1")
    return [ranks[i] for i in range(len(ranks))]


class Encoder:
    """Encodes pieces of text; built once per Python worker."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.split = regex.compile(pattern).findall
        self.cut = regex.compile(r"(?<=\S) (?=\S)").split
        self.solid = regex.compile(r"\S(?:.*\S)?", regex.DOTALL).fullmatch
        ids = {t: i for i, t in enumerate(tokens)}
        self.sizes = [len(t) for t in tokens]
        #: The next shorter token that is a prefix of a token, or -1.
        self.shorter = [next((ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ids), -1) for t in tokens]
        automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            automaton.add_word(token[::-1].decode("latin-1"), i)
        automaton.make_automaton()
        self.automaton = automaton
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.runs: dict[str, tuple[int, ...] | None] = {}
        #: The last merge that makes each token, and the token each such pair makes.
        self.halves: list[tuple[int, int] | None] = [None] * len(tokens)
        self.joined: dict[tuple[int, int], int] = {}
        for i, token in enumerate(tokens):
            for cut in range(1, len(token)):
                left, right = ids.get(token[:cut], i), ids.get(token[cut:], i)
                if left < i and right < i and self._stands(left, right):
                    self.halves[i] = (left, right)
                    self.joined[left, right] = i
                    break
        self.pairs.clear()  # answers given while merges were still missing

    def _stands(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves these two tokens side by side.

        Merges are undone from the latest on, always on the token that was made last.
        At each moment the parts that touch across the border must not be a pair that
        merging would have joined before the merge undone just now.
        """
        undone = len(self.tokens) + 1
        while True:
            joined = self.joined.get((left, right))
            if joined is not None and joined < undone:
                return False
            a, b = self.halves[left], self.halves[right]
            if a is None and b is None:
                return True
            # A merge on the left of a border goes first among equals, so undo the right one first.
            if b is None or (a is not None and left > right):
                undone, left = left, a[1]
            else:
                undone, right = right + 1, b[0]

    def stands(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._stands(left, right)
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        size = len(data)
        longest = [-1] * size
        for end, token in self.automaton.iter(data[::-1].decode("latin-1")):
            at = size - 1 - end
            if longest[at] < 0:  # of the tokens that end at one place the longest is reported first
                longest[at] = token
        if size and min(longest) < 0:
            raise ValueError("a byte has no token")
        dead = bytearray(size + 1)
        out: list[int] = []
        at, token = 0, longest[0] if size else -1
        while at < size:
            end = at + self.sizes[token]
            if not dead[end] and (not out or self.stands(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
                continue
            token = self.shorter[token]
            while token < 0:
                # Nothing fits here: take back the token before and try shorter ones in its place.
                dead[at] = 1
                if not out:
                    raise ValueError("no encoding")
                last = out.pop()
                at -= self.sizes[last]
                token = self.shorter[last]
        return out

    def _pieces(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.pieces
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                data = piece.encode()
                ids = tuple(self.encode_piece(data))
                if len(data) <= MEMO_BYTES:
                    if len(known) >= PIECES:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def _run(self, run: str) -> tuple[int, ...] | None:
        """Ids of a space and ``run``; None if white space at an end of ``run`` may belong to a longer piece."""
        ids = tuple(self._pieces(" " + run)) if self.solid(run) else None
        if len(run) <= MEMO_BYTES:
            if len(self.runs) >= RUNS:
                self.runs.clear()
            self.runs[run] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        runs = text.split(" ")
        if self.solid(runs[0]):
            out = self._pieces(runs[0])
            known = self.runs
            for run in runs[1:]:
                ids = known.get(run)
                if ids is None and (run in known or (ids := self._run(run)) is None):
                    break
                out += ids
            else:
                return out
        first, *runs = self.cut(text)
        out = self._pieces(first)
        last = runs.pop() if runs else None
        for run in runs:
            out += self.runs.get(run) or self._run(run)
        return out if last is None else out + self._pieces(" " + last)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, gathered from one string of all tokens."""
        if ids.size and not 0 <= int(ids.min()) <= int(ids.max()) < len(self.tokens):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.places[ids] - ends + sizes, sizes)
        places += np.arange(len(places))
        return self.flat[places].tobytes()


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(ranks: bytes, pattern: str) -> Encoder:
    key = hash(ranks), pattern
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(ranks), pattern)
    return _ENCODERS[key]


def _ranks(df: DataFrame, path: str):
    """The rank file as a broadcast; its size is that of the vocabulary."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` without ``text`` and with ``ids``: array<int> of each whole text.

    A null text counts as empty and gives an empty array. Other columns are kept; a
    column that has the name ``ids`` already is replaced. Equal rows stay equal rows.
    """
    kept = [c for c in df.columns if c not in (text, ids)]
    source = df.select(*kept, df[text].cast("string").alias("__text"))
    schema = T.StructType([f for f in source.schema if f.name != "__text"] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    ranks = _ranks(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                texts = part.column("__text").to_pylist()
                arrays = pa.array([encoder.encode(t) if t else [] for t in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), arrays], [*kept, ids])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``df`` with ``out``: the bytes that the tokens ``ids`` stand for.

    Null or empty ``ids`` give empty bytes. An id that is not in the vocabulary is an error.
    """
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.BinaryType(), False)])
    ranks = _ranks(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                lists = part.column(ids)
                made = [encoder.decode(x.values.to_numpy()) if x.is_valid and len(x) else b"" for x in lists]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(made, pa.binary())], [*kept, out])

    return df.select(*kept).mapInArrow(run, schema)
