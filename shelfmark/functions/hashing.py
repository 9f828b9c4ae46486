"""Content hashes, deterministic ids and the hashed sparse vector of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.memory import hand_back
from shelfmark.functions.text import let

SPARSE_MODULUS = 1_000_003
_HEX_DIGITS_PER_WORD = 15
_WORD_RUN = re.compile(r"\w+")
_MEMO_TOKENS = 100_000
_COUNTED_ROWS = 512


def text_hash(col: Column) -> Column:
    """Hex sha256 of the UTF-8 bytes."""
    return F.sha2(col.cast("binary"), 256)


def chunk_id(document_id: Column, chunk_index: Column) -> Column:
    """Stable chunk id, so rebuilding a document rebuilds the same ids."""
    return F.substring(F.sha2(F.concat_ws(":", document_id, chunk_index), 256), 1, 32)


def hash_index(token: Column, modulus: int = SPARSE_MODULUS) -> Column:
    """256-bit sha256 of a token modulo ``modulus``, in exact BIGINT arithmetic.

    The 64 hex digits are read 15 at a time (60 bits) and folded by Horner's
    rule; with a modulus below 2**20 no intermediate leaves 62 bits.
    """

    def fold(digest: Column) -> Column:
        total = F.lit(0).cast("bigint")
        for start in range(0, 64, _HEX_DIGITS_PER_WORD):
            width = min(_HEX_DIGITS_PER_WORD, 64 - start)
            word = F.conv(F.substring(digest, start + 1, width), 16, 10).cast("bigint")
            shift = pow(16, width, modulus)
            total = (total * F.lit(shift).cast("bigint") + word) % F.lit(modulus).cast("bigint")
        return total

    return let(F.sha2(token.cast("binary"), 256), fold)


SPARSE_TYPE = "struct<indices:array<bigint>,values:array<double>>"


def _count_batch(texts: pa.Array, memo: dict[str, int], modulus: int) -> pa.Array:
    flat: list[int] = []
    lengths = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts.to_pylist()):
        found = _WORD_RUN.findall(text.lower()) if text else []
        lengths[i] = len(found)
        for token in found:
            index = memo.get(token)
            if index is None:
                digest = sha256(token.encode("utf-8", "surrogatepass")).digest()
                index = memo[token] = int.from_bytes(digest, "big") % modulus
            flat.append(index)
    row = np.repeat(np.arange(len(texts)), lengths)
    cell, count = np.unique(row * modulus + np.array(flat, dtype=np.int64), return_counts=True)
    offsets = np.searchsorted(cell, np.arange(len(texts) + 1) * modulus).astype(np.int32)
    lists = [
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(part))
        for part in (cell % modulus, count.astype(np.float64))
    ]
    return pa.StructArray.from_arrays(lists, names=["indices", "values"])


def sparse_vector(col: Column, modulus: int = SPARSE_MODULUS) -> Column:
    """struct(indices, values): token counts by hashed index, indices ascending.

    Computed row by row without a shuffle; colliding tokens add up. Up to
    ``_COUNTED_ROWS`` texts are counted with one sort. The built-in form (``hash_index`` over
    ``words``) costs several times more because the digest has to be parsed as
    text, so it is used where single tokens are hashed.
    """

    @F.arrow_udf(SPARSE_TYPE)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo: dict[str, int] = {}
        for texts in batches:
            counted = []
            for lo in range(0, max(len(texts), 1), _COUNTED_ROWS):
                if len(memo) > _MEMO_TOKENS:
                    memo.clear()
                counted.append(_count_batch(texts.slice(lo, _COUNTED_ROWS), memo, modulus))
            yield pa.concat_arrays(counted)
        hand_back()

    return count(col)


def cache_key(*fields: Column) -> Column:
    """Key of one validated request: the hash of its canonical JSON."""
    return F.concat(F.lit("retrieval:"), F.sha2(F.to_json(F.struct(*fields)), 256))
