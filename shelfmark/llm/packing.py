"""Best-fit packing (operator 7).

Documents become pieces of at most ``limit`` tokens. Which sequences are filled by which
lengths depends only on how many pieces there are of each length, a table with at most
``limit`` rows. From it a plan is made: the longest lengths open sequences, and the gap
that each leaves is looked up among the sums of one, two and three available lengths; a
combination that fills it exactly is used as often as the counts allow. What has no exact
complement goes, longest first, to the open gap that it fits best. The plan says, for runs
of equally long pieces, where they go; every piece finds its own place from its number
among the pieces of its length. The plan's size is set by ``limit``, not by the corpus.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.memory import handing_back

LIMIT = 2048
#: Numbering splits the pieces of one length into so many parts.
PARTS = 512
#: Runs of the newer and of the older half of a Python worker's memory, pieces it remembers, and the longest remembered run.
RUNS, PARTS_KEPT, MEMO_CHARS = 200_000, 300_000, 48
# The definition of a tokenizer whose runs may be split before the model sees them.
SHAPE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


_SPACE = re.compile("[\x20\x09-\x0d]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def text_runs(text: str) -> list[str]:
    """Runs between white space; the four separator controls do not count as such."""
    return _SPACE.split(text) if _SEPARATORS.search(text) else text.split()


#: Latin letters that small letters replace one by one, and ASCII characters that are neither letter nor digit.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f", "!-/:-@\\[-`{-~"
_PLAIN = re.compile(f"[{_LETTERS}{_MARKS}0-9]*")
#: The splitting rule of SHAPE for such characters.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[{_MARKS}]+")


class RunTokenizer:
    """Token ids as little-endian 32-bit numbers, one run between ASCII white space at a time.

    The tokenizer must drop white space and never join what it separates; then a text's
    ids are those of its runs in order, and the runs seen before need not be encoded
    again. A tokenizer that brings texts to NFC, makes them small, and splits letters,
    digits and marks from each other does to a run of Latin letters, ASCII digits and marks
    what the pattern of these classes does; where the definition says so, its model is
    asked for the pieces, which are kept, too. All other runs go through the whole
    tokenizer.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        shape = json.loads(definition)
        self.split = SHAPE == {k: shape[k] for k in SHAPE}
        added = [re.escape(x["content"]) for x in shape["added_tokens"]]
        self.special = re.compile("|".join(added)) if added else None
        self.byte_names = _byte_names()

    def piece(self, piece: str) -> bytes:
        found = self.parts.get(piece)
        if found is None:
            if len(self.parts) >= PARTS_KEPT:
                self.parts.clear()
            mapped = piece.encode().decode("latin-1").translate(self.byte_names)
            found = self.parts[piece] = packed_ids([t.id for t in self.model.tokenize(mapped)])
        return found

    def run(self, run: str) -> bytes:
        if not self.split or not _PLAIN.fullmatch(run) or (self.special and self.special.search(run)):
            return packed_ids(self.tokenizer.encode(run, add_special_tokens=False).ids)
        return b"".join([self.piece(part) for part in _PARTS.findall(run.lower())])

    def encode(self, text: str) -> bytes:
        runs = text_runs(text)
        known = self.known
        try:
            return b"".join(map(known.__getitem__, runs))
        except KeyError:
            pass
        out = []
        for run in runs:
            ids = known.get(run)
            if ids is None:
                ids = self.older.get(run)
                if ids is None:
                    ids = self.run(run) if run else b""
                if len(run) <= MEMO_CHARS:
                    if len(known) >= RUNS:
                        # Runs in use come back from the older half one by one; the others go with it.
                        self.older, self.known = known, {}
                        known = self.known
                    known[run] = ids
            out.append(ids)
        return b"".join(out)


def packed_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_names() -> dict[int, int]:
    """The characters that byte-level models use for bytes: printable Latin-1 ones as they are, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


_TOKENIZERS: dict[int, RunTokenizer] = {}


def pieces(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, limit: int = LIMIT) -> DataFrame:
    """Pieces of the tokenised texts: (key, piece, start, length, ids).

    ``tokenizer`` is the path of a definition file. A document's ids are those of its
    whole text (a null counts as empty) and then ``end_id``; they are cut every ``limit``
    ids. Repeated rows give repeated pieces; other columns are not carried.
    """
    with open(tokenizer, encoding="utf-8") as file:
        definition = df.sparkSession.sparkContext.broadcast(file.read())
    tail = np.array([end_id], dtype="<u4").tobytes()
    names = [key, "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = hash(definition.value)
        if mark not in _TOKENIZERS:
            _TOKENIZERS.clear()
            _TOKENIZERS[mark] = RunTokenizer(definition.value)
        encoder = _TOKENIZERS[mark]
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                owners, order, starts, ids = [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    data = encoder.encode(text or "") + tail
                    for n, at in enumerate(range(0, len(data), 4 * limit)):
                        owners.append(row)
                        order.append(n)
                        starts.append(at // 4)
                        ids.append(data[at : at + 4 * limit])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(owners, pa.int32())),
                        pa.array(order, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names,
                )

    source = df.select(F.col(key), F.col(text).cast("string").alias("__text"))
    schema = source.select(key).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary")
    return source.mapInArrow(handing_back(run), schema)


class _Sums:
    """Available counts per length, and an index of the sums that one, two and three of the lengths make.

    ``pairs`` lists the pairs of lengths by their sum, the most unequal first; ``begin``
    tells where each sum starts. A triple is a shorter length and a pair of the rest of the
    sum, so the same index serves it. The index is set by the lengths, at most ``limit`` of
    them; whether a combination is still available is read off the counts.
    """

    def __init__(self, counts: dict[int, int], limit: int):
        self.n = np.zeros(limit + 1, dtype=np.int64)
        for length, count in counts.items():
            self.n[length] = count
        held = np.flatnonzero(self.n)
        low, high = (x.reshape(-1) for x in np.meshgrid(held, held, indexing="ij"))
        kept = (low <= high) & (low + high <= limit)
        low, high = low[kept], high[kept]
        order = np.lexsort((low, low + high))
        self.low, self.high = low[order], high[order]
        self.begin = np.searchsorted(self.low + self.high, np.arange(limit + 2))
        self.held = held

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.n[gap] else None

    def pair(self, gap: int, least: int = 1) -> tuple[int, ...] | None:
        """Two available lengths with the sum ``gap``, as unequal as possible, the shorter at least ``least``."""
        low, high = self.low[self.begin[gap] : self.begin[gap + 1]], self.high[self.begin[gap] : self.begin[gap + 1]]
        at = int(np.searchsorted(low, least))
        fits = (self.n[low[at:]] > 0) & (self.n[high[at:]] > (low[at:] == high[at:]))
        i = int(fits.argmax()) if len(fits) else 0
        return (int(high[at + i]), int(low[at + i])) if len(fits) and fits[i] else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for low in self.held[: np.searchsorted(self.held, gap // 3, "right")].tolist():
            if self.n[low]:
                self.n[low] -= 1
                rest = self.pair(gap - low, low)
                self.n[low] += 1
                if rest:
                    return (*rest, low)
        return None

    def times(self, pattern: tuple[int, ...]) -> int:
        """How often ``pattern`` can be taken."""
        return min(int(self.n[x]) // pattern.count(x) for x in set(pattern))

    def take(self, pattern: tuple[int, ...], times: int) -> None:
        for x in pattern:
            self.n[x] -= times


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences). Uses every piece exactly once."""
    stock = _Sums(counts, limit)
    filled: dict[tuple[int, ...], int] = defaultdict(int)
    opened: list[tuple[int, int]] = []
    for length in range(limit, 0, -1):
        while stock.n[length]:
            gap = limit - length
            stock.n[length] -= 1
            rest = () if gap == 0 else stock.single(gap) or stock.pair(gap) or stock.triple(gap)
            stock.n[length] += 1
            if rest is None:
                opened.append((length, int(stock.n[length])))
                stock.n[length] = 0
            else:
                pattern = (length, *rest)
                times = stock.times(pattern)
                stock.take(pattern, times)
                filled[pattern] += times
    # What is left has no exact complement: longest first into the smallest gap that holds it.
    gaps: list[int] = []
    held: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = limit - sum(pattern)
        if gap == 0:
            filled[pattern] += times
            return
        if not held[gap]:
            bisect.insort(gaps, gap)
        held[gap].append((pattern, times))

    for length, left in opened:
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                fit = limit // length
                whole, rest = divmod(left, fit)
                if whole:
                    put((length,) * fit, whole)
                if rest:
                    put((length,) * rest, 1)
                break
            gap = gaps[at]
            pattern, times = held[gap].pop()
            if not held[gap]:
                gaps.pop(at)
            more = min(gap // length, left)
            used = min(times, left // more)
            if times > used:
                if not held[gap]:
                    bisect.insort(gaps, gap)
                held[gap].append((pattern, times - used))
            put(pattern + (length,) * more, used)
            left -= used * more
    for patterns in held.values():
        for pattern, times in patterns:
            filled[pattern] += times
    return sorted(filled.items(), reverse=True)


def places(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first piece numbers of its runs, the sequence of each run's first piece, and the offset."""
    used: dict[int, int] = defaultdict(int)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for pattern, times in made:
        offset = 0
        for length in pattern:
            runs[length].append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for k, v in runs.items()}


def numbered(df: DataFrame, length: str, order: list[str], out: str, parts: int = PARTS) -> DataFrame:
    """``df`` with the number from 0 of each row among rows of its ``length``.

    The rows of a length are dealt into ``parts`` by a hash, so that no task has to
    order all rows of a frequent length.
    """
    cut = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    inside = Window.partitionBy(length, "__part").orderBy(*order)
    before = Window.partitionBy(length).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    heads = cut.groupBy(length, "__part").agg(F.count("*").alias("n")).select(length, "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return cut.withColumn("__at", F.row_number().over(inside) - 1).join(heads, [length, "__part"]).withColumn(out, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def pack(df: DataFrame, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """``df`` of pieces with ``sequence_id`` and ``offset``; ``df`` should be a written table, it is read twice.

    Needs the columns ``key``, piece and length (1 .. ``limit``); all columns stay.
    Repeated rows are packed each. An empty table stays empty.
    """
    counts = {int(r[0]): int(r[1]) for r in df.groupBy("length").agg(F.count("*")).collect()}  # at most ``limit`` rows
    if counts and not 1 <= min(counts) <= max(counts) <= limit:
        raise ValueError(f"lengths outside 1 .. {limit}")
    found = df.sparkSession.sparkContext.broadcast(places(plan(counts, limit)))
    kept = [c for c in df.columns if c not in ("sequence_id", "offset")]
    schema = df.select(*kept).schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = found.value
        for batch in batches:
            lengths, numbers = batch.column("length").to_numpy(), batch.column("__number").to_numpy()
            sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                firsts, sequences, offsets = runs[int(length)]
                at = np.searchsorted(firsts, numbers[rows], side="right") - 1
                sequence[rows] = sequences[at] + numbers[rows] - firsts[at]
                offset[rows] = offsets[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return numbered(df.select(*kept), "length", [key, "piece"], "__number").mapInArrow(handing_back(run), schema)
