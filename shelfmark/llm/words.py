"""Words and word n-grams of Arrow text columns as 64-bit hashes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return. All of them are one-byte characters, so words are cut on the
UTF-8 bytes of a column without making a Python string. Two words have one hash if
their bytes are equal; for a billion different words the chance that any two collide
is about three in a hundred.

Work is done on blocks of about ``BLOCK`` bytes, so that temporaries stay small
whatever size Arrow batches have. A longer text is a block of its own; hashing then
goes over it in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACES)] = False
#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers fixed by ``seed``."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + np.uint64(seed * 0xD1342543DE82EF95 % 2**64)) | np.uint64(1)


_BYTE = constants(256, 1)
_BYTE[list(SPACES)] = 0
_BASE = constants(1, 2)[0]
_POWERS = np.empty(0, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        factors = np.full(size, _BASE, dtype=np.uint64)
        factors[0] = 1
        _POWERS = np.cumprod(factors, dtype=np.uint64)
    return _POWERS[:n]


class Block(NamedTuple):
    """Some whole texts of a column.

    ``rows`` is the range of column rows, ``data`` their bytes, ``bounds`` the byte
    range of each text, ``starts``/``ends`` the byte range of each word, ``hashes``
    the word hashes and ``first`` the number of the first word of each text (one more
    entry than texts).
    """

    rows: range
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def owners(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize)
    if data is None or data.size == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8), offsets.astype(np.int64)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + BLOCK)))
        base, until = starts[lo], ends[hi - 1]
        places = starts[lo:hi] - base
        lengths = np.diff(np.append(places, until - base))
        inside = np.arange(until - base) - np.repeat(places, lengths)
        values = _BYTE[data[base:until]] * powers(int(lengths.max()))[inside]
        out[lo:hi] = np.add.reduceat(values, places)
        lo = hi
    return mix(out)


def row_blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, rows)
        yield lo, hi
        lo = hi


def blocks(column: pa.Array, fold: np.ndarray | None = None, limit: int = BLOCK) -> Iterator[Block]:
    """The texts of ``column`` in blocks of ``limit`` bytes; ``fold`` is a table that replaces each byte first."""
    everything, offsets = text_bytes(column)
    for lo, hi in row_blocks(offsets, limit):
        data = everything[offsets[lo] : offsets[hi]]
        bounds = offsets[lo : hi + 1] - offsets[lo]
        if fold is not None:
            data = fold[data]
        inside = _IS_WORD[data]
        before = np.empty(len(data), dtype=bool)
        before[1:] = inside[:-1]
        before[bounds[:-1][bounds[:-1] < len(data)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(data), dtype=bool)
        after[:-1] = inside[1:]
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        hashes = hash_words(data, starts, ends)
        yield Block(range(lo, hi), data, bounds, starts, ends, hashes, np.searchsorted(starts, bounds))


def windows(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, text number) of every window of ``width`` words of one text."""
    counts = np.maximum(np.diff(block.first) - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return block.first[:-1][owner] + inside, owner


def gram_hashes(hashes: np.ndarray, starts: np.ndarray, width: int, seed: int = 11) -> np.ndarray:
    """Hash of the ``width`` words from each of ``starts``; the order of words counts."""
    factors = constants(width, seed)
    total = np.zeros(len(starts), dtype=np.uint64)
    for i in range(width):
        total += hashes[starts + i] * factors[i]
    return mix(total)
