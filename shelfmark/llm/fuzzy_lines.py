"""Line dedup (operator 1).

Lines are normalised: A-Z become small, digits become 0, ASCII punctuation separates
words, and white space no longer counts. In scripts without spaces each character is a
word. Equal normalised lines are one line, however short; a line without any word is left
alone. Two different ones of at least ``LEAST`` words are linked if the edit similarity of
their word sequences, 1 - distance / longer length, is at least ``PERCENT`` %.
Of each group of connected lines only the first occurrence stays: the one in the smallest
document and there the earliest line.

The search is exact. A line of n words allows e(n) = (100 - PERCENT) * n // 100 edits, so two
linked lines share all words but e(n) of the longer one, counted with repeats. In any common
order of the words they then share one of the first e(n) + 1 words of each; lines meet in
the buckets of these words. The order is by counts in a sample of the texts, rare words first;
it sets the size of the buckets, not the links. A bucket with very many lines is dealt into parts,
and every two parts meet. A first pass links each line of a bucket to the first one near it
on either side, which settles large groups of near copies without their pairs; a second
one takes all pairs that are near and still in different groups. Lines whose words, hashed
to the parities of 256 cells, differ in more cells than the edits that their lengths allow
can change are never near; two long lines are held against each other by more cells (``WIDE``),
since 256 say nothing about them. The others are compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.memory import handing_back
from shelfmark.llm.links import KEY_BITS, components, key_bits
from shelfmark.llm.scratch import discard, written
from shelfmark.llm.words import LOWER, Block, blocks, constants, hash_words, mix, text_bytes

LEAST, PERCENT = 4, 80
#: Lines to a bucket before it is split, pairs of lines looked at together, and lines of a bucket whose pairs are all taken.
BUCKET, TILE, SMALL = 4096, 1 << 18, 16
#: From so many words on, a line has so many more cells, 64 to a number. Cells of a longer line are those of a shorter one, split.
WIDE = ((192, 8), (448, 16), (896, 64), (3584, 256))
#: Cells of the word counts; one text in SAMPLE is counted, and one line in SAMPLE when crowded buckets are sought.
CELLS, SAMPLE = 1 << 20, 8
#: Passes over the lines, each with its share of the buckets, and rows of crowded buckets that may be broadcast.
SLICES, MAX_BROADCAST = 4, 1_000_000
#: Bytes of text that are cut at once.
TEXT = 1 << 19

FOLD = LOWER.copy()
FOLD[48:58] = 48
FOLD[[i for i in range(33, 127) if not chr(i).isalnum()]] = 32

#: For each byte, its eight bits in eight one-byte lanes.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)


class Lines(NamedTuple):
    """Lines with words of a block: text number, line number, words (range), digest."""

    text: np.ndarray
    line: np.ndarray
    start: np.ndarray
    end: np.ndarray
    digest: np.ndarray


def simhashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of each run of words: a bit is set if more than half of the words have it."""
    n = ends - starts
    parts = -(-n // 255)  # a lane counts to 255
    first = np.cumsum(parts) - parts
    at = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    until = np.minimum(at + 255, np.repeat(ends, parts))
    values = hashes.view(np.uint8).reshape(-1, 8)
    out = np.zeros(len(starts), dtype=np.uint64)
    for byte in range(8):
        lanes = np.append(_LANES[values[:, byte]], np.uint64(0))
        ones = np.add.reduceat(_run_sums(lanes, at, until).view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little")[:, 0]
        out |= bits.astype(np.uint64) << np.uint64(8 * byte)
    return out


def _run_sums(values: np.ndarray, at: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Sums of the runs; those of the gaps between runs are taken too and dropped."""
    return np.add.reduceat(values, np.stack([at, until], axis=1).reshape(-1))[::2].copy()


def units(block: Block) -> Block:
    """``block`` with each character of a script without spaces as a word of its own."""
    data, size = block.data, len(block.data)
    if not size:
        return block
    at = np.flatnonzero(data[:-1] >= 0xE0)  # characters that have three or four bytes
    two = data[at].astype(np.int64) << 8 | data[at + 1]
    # Thai, Lao, Tibetan; Myanmar; Khmer; kana to ideographs; compatibility ideographs; the planes of rarer ideographs.
    alone = (two >= 0xE0B8) & (two <= 0xE0BF) | (two >= 0xE180) & (two <= 0xE182) | (two >= 0xE19E) & (two <= 0xE19F)
    alone |= (two >= 0xE380) & (two <= 0xE9BF) | (two >= 0xEFA4) & (two <= 0xEFAB) | (two >= 0xF0A0) & (two <= 0xF0BF)
    at = at[alone]
    if not len(at):
        return block
    after = at + np.where(data[at] >= 0xF0, 4, 3)
    starts = np.union1d(block.starts, np.concatenate((at, after)))
    word = np.searchsorted(block.starts, starts, side="right") - 1
    starts = starts[(word >= 0) & (starts < block.ends[word])]
    word = np.searchsorted(block.starts, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], size), block.ends[word])
    return block._replace(starts=starts, ends=ends, hashes=hash_words(data, starts, ends), first=np.searchsorted(starts, block.bounds))


def lines(block: Block) -> Lines:
    """Lines with words of a block that was cut into ``units``."""
    owner = block.owners()
    breaks = np.concatenate(([0], np.cumsum(block.data == 10)))
    line = breaks[block.starts] - breaks[block.bounds[:-1]][owner]
    fresh = np.ones(len(owner), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])
    start = np.flatnonzero(fresh)
    end = np.append(start[1:], len(owner))
    n = end - start
    if not len(start):
        return Lines(start, start, start, end, start)
    factors = constants(int(n.max()), 17)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    terms = block.hashes[np.repeat(start, n) + inside] * factors[inside]
    digest = mix(np.add.reduceat(terms, np.cumsum(n) - n) + n.astype(np.uint64)).view(np.int64)
    return Lines(owner[start], line[start], start, end, digest)


def parities(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each run of words, the parity of each of 256 cells that they hash to: one edit changes two of them at most."""
    bits, word = np.uint64(1) << (hashes >> np.uint64(58)), (hashes >> np.uint64(56)) & np.uint64(3)
    runs = np.stack([starts, ends], axis=1).reshape(-1)
    return [np.bitwise_xor.reduceat(np.append(np.where(word == i, bits, np.uint64(0)), np.uint64(0)), runs)[::2].view(np.int64) for i in range(4)]


def wide(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """For each run of words, the parities of the cells of ``WIDE`` for its length; null for shorter ones."""
    n = ends - starts
    level = np.searchsorted([least for least, _ in WIDE], n, side="right")
    out: list[bytes | None] = [None] * len(n)
    for k, (_, width) in enumerate(WIDE, 1):
        at = np.flatnonzero(level == k)
        if not len(at):
            continue
        size = n[at]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        words = hashes[np.repeat(starts[at], size) + inside]
        place = ((words >> np.uint64(56)) & np.uint64(3) | ((words >> np.uint64(50)) & np.uint64(63)) << np.uint64(2)) % np.uint64(width)
        cell = (place << np.uint64(6) | words >> np.uint64(58)).astype(np.int64)
        odd = np.bincount(np.repeat(np.arange(len(at)), size) * (64 * width) + cell, minlength=64 * width * len(at)) & 1
        for i, row in zip(at, np.packbits(odd.astype(np.uint8), bitorder="little").reshape(len(at), -1)):
            out[i] = row.tobytes()
    return pa.array(out, pa.binary())


def folded(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each width of ``WIDE``: (number of each row in the table or -1, table of the parities folded to that width)."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy() // 8
    found = []
    for _, width in WIDE:
        at = np.flatnonzero(size >= width)
        if not len(at):
            break
        table = np.empty((len(at), width), dtype=np.uint64)
        for own in np.unique(size[at]):
            mine = np.flatnonzero(size[at] == own)
            data = np.frombuffer(b"".join(column.take(pa.array(at[mine])).to_pylist()), dtype=np.uint64)
            table[mine] = np.bitwise_xor.reduce(data.reshape(len(mine), -1, width), axis=1)
        number = np.full(len(size), -1)
        number[at] = np.arange(len(at))
        found.append((number, table))
    return found


def by_line(line: np.ndarray, first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The order by ``line``, which is sorted, and in each line by ``first`` and ``then``."""
    if len(line) and line[-1] < 1 << 16:
        order = np.argsort(first)  # far faster than by two keys, but equal ones come in any order
        order = order[np.argsort(line.astype(np.uint16)[order], kind="stable")]
        a, b = order[:-1], order[1:]
        if not np.any((first[a] == first[b]) & (then[a] != then[b]) & (line[a] == line[b])):
            return order
    return np.lexsort((then, first, line))


def tokens(block: Block, found: Lines) -> tuple[np.ndarray, np.ndarray]:
    """(token, number of its line) by line: the words of ``found``, repeats within a line told apart by their number."""
    n = found.end - found.start
    line = np.repeat(np.arange(len(n)), n)
    hashes = block.hashes[np.repeat(found.start, n) + np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)]
    hashes = hashes[by_line(line, hashes, hashes)]
    order = np.arange(len(hashes))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
    at = np.flatnonzero(fresh)
    before = (np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order))))).astype(np.uint64)
    return np.where(before > 0, mix(hashes + before * np.uint64(0x9E3779B97F4A7C15)), hashes), line


def cells(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(20)) % np.uint64(CELLS)


def counts(df: DataFrame, text: str) -> np.ndarray:
    """Tokens of a sample of the texts by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in map(units, blocks(batch.column(0), FOLD, TEXT)):
                found = lines(block)
                if len(found.line):
                    cell, n = np.unique(cells(tokens(block, found)[0]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n)], ["cell", "n"])

    text = F.col(text).cast("string")
    some = df.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    summed = some.mapInArrow(handing_back(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    out = np.zeros(CELLS, dtype=np.int32)
    out[summed.column("cell").to_numpy()] = np.minimum(summed.column("n").to_numpy(), (1 << 24) - 1)
    return out


def rare(block: Block, found: Lines, table: np.ndarray, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, how many of each line): the rarest tokens of each line, one more than it may have edits, none of short lines."""
    token, line = tokens(block, found)
    rank = table[cells(token)].astype(np.uint64) << np.uint64(40) | token >> np.uint64(24)
    order = by_line(line, rank, token)
    n = found.end - found.start
    inside = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    take = np.where(n < least, 0, np.minimum((100 - percent) * n // 100 + 1, n))
    return token[order][inside < np.repeat(take, n)], take


def occurrences(df: DataFrame, key: str, text: str, least: int, percent: int) -> DataFrame:
    """(key, version, line, again, h, n, q0 .. q3, wide, rare) of every line; again tells a line that the same text had before.

    ``version`` is a hash of the text, which tells texts of one key apart. Lines that are there again have no ``rare`` words and nothing ``wide``.
    """
    names = ["key", "version", "line", "again", "h", "n", "q0", "q1", "q2", "q3", "wide", "rare"]
    table = df.sparkSession.sparkContext.broadcast(counts(df, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for block in map(units, blocks(batch.column(2), FOLD, TEXT)):
                found = lines(block)
                if not len(found.line):
                    continue
                order = np.lexsort((found.line, found.digest, found.text))
                t, h = found.text[order], found.digest[order]
                again = np.zeros(len(order), dtype=bool)
                again[order[1:]] = (t[1:] == t[:-1]) & (h[1:] == h[:-1])
                rows = block.rows.start + found.text
                token, n = rare(block, Lines(*[c[~again] for c in found]), table.value, least, percent)
                taken = np.zeros(len(again) + 1, dtype=np.int32)
                taken[1:][~again] = n
                part = pa.ListArray.from_arrays(pa.array(np.cumsum(taken, dtype=np.int32)), pa.array(token.view(np.int64)))
                columns = [keys[rows], versions[rows], found.line.astype(np.int32), again, found.digest, (found.end - found.start).astype(np.int32)]
                columns += [*parities(block.hashes, found.start, found.end), wide(block.hashes, found.start, np.where(again, found.start, found.end))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), part], names)

    text = F.col(text).cast("string")
    source = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("version"), text.alias("text")).where("key is not null and text is not null")
    return source.mapInArrow(handing_back(run), "key long, version long, line int, again boolean, h long, n int, q0 long, q1 long, q2 long, q3 long, wide binary, rare array<long>")


def _near(nodes: DataFrame, first_only: bool, percent: int, bucket: int) -> DataFrame:
    """Pairs (a, b) of lines ``nodes`` (h, n, q0 .. q3, rare) of different components that may be near.

    ``nodes`` may have the columns component, else each line is one of its own, and wide.

    Lines travel to their buckets in SLICES passes, so a share of them is on disk at a time.
    """
    columns = [c for c in ("h", "n", "q0", "q1", "q2", "q3", "component", "wide") if c in nodes.columns]
    seen = nodes.where(F.pmod("h", F.lit(SAMPLE)) == 0).select(F.explode("rare").alias("w")).groupBy("w").agg((F.count("*") * SAMPLE).alias("lines"))
    crowded = written(seen.where(F.col("lines") > bucket).select("w", F.ceil(F.col("lines") / bucket).alias("parts")), "crowded")
    many = crowded.count()
    crowded = None if not many else F.broadcast(crowded) if many <= MAX_BROADCAST else crowded
    words = nodes.select(*columns, F.explode("rare").alias("w"))
    made = [written(_met(words.where(F.pmod("w", F.lit(SLICES)) == k), crowded, columns, first_only, percent), "pairs") for k in range(SLICES)]
    return reduce(DataFrame.union, made).distinct()


def _met(words: DataFrame, crowded: DataFrame | None, columns: list[str], first_only: bool, percent: int) -> DataFrame:
    """Pairs (a, b) of the rows (``columns``, w) that share a bucket ``w`` and may be near."""
    group = ["w"]
    if crowded is not None:
        dealt = words.join(crowded, "w", "left")
        mine = F.pmod(F.xxhash64("h"), F.col("parts"))
        meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.struct(F.least(mine, k).alias("i"), F.greatest(mine, k).alias("j")))
        alone = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))
        group = ["w", "i", "j"]
        words = dealt.select(*columns, "w", F.explode(F.when(F.col("parts").isNull(), alone).otherwise(meets)).alias("p")).select(*columns, "w", "p.i", "p.j")
    placed = words.repartition(*group).sortWithinPartitions(*group, "n", "h")

    def fitting(c, a, b):
        """Those of the row pairs (a, b), where b is no shorter, that are not ruled out."""
        most, apart = c["most"][b], 0
        for q in ("q0", "q1", "q2", "q3"):
            apart = apart + np.bitwise_count(c[q][a] ^ c[q][b]).astype(np.int32)
            fits = apart <= most
            a, b, most, apart = a[fits], b[fits], most[fits], apart[fits]
        fits = c["component"][a] != c["component"][b]
        a, b = a[fits], b[fits]
        for number, table in c["wide"]:
            fits = np.ones(len(a), dtype=bool)
            both = np.flatnonzero((number[a] >= 0) & (number[b] >= 0))
            step = max(1, TILE // table.shape[1])
            for some in (both[i : i + step] for i in range(0, len(both), step)):
                apart = np.bitwise_count(table[number[a[some]]] ^ table[number[b[some]]]).sum(axis=1, dtype=np.int64)
                fits[some] = apart <= c["most"][b[some]]
            a, b = a[fits], b[fits]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def pairs(table: pa.Table, last: bool):
            """Pairs of the buckets that end in ``table``, and the rows after them."""
            marks = [table.column(x).to_numpy() for x in group]
            change = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            bounds = np.array([0, *change.tolist(), *([table.num_rows] if last else [])])
            size, until = np.diff(bounds), int(bounds[-1])
            if not until:
                return until
            table = table.slice(0, until)
            c = {x: table.column(x).to_numpy() for x in columns if x != "wide"}
            c.setdefault("component", c["h"])
            n = c["n"].astype(np.int64)
            edits = (100 - percent) * n // 100
            c |= {"most": (2 * edits).astype(np.int32), "wide": folded(table.column("wide").combine_chunks()) if "wide" in columns else []}
            # Rows come by length: what may be near a row and no shorter is what follows it, up to the last that allows enough edits.
            bucket = np.repeat(np.arange(len(size)), size)
            count = np.searchsorted(bucket << 32 | n - edits, bucket << 32 | n, side="right") - np.arange(until) - 1
            first = np.repeat(bounds[:-1], size)
            mixed = np.logical_or.reduceat(c["component"] != c["component"][first], bounds[:-1])
            count[~mixed[bucket]] = 0
            total, large, lo = np.cumsum(count), size[bucket] > SMALL, 0
            while lo < until:
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + TILE, side="right")))
                k = count[lo:hi]
                a = np.repeat(np.arange(lo, hi), k)
                a, b = fitting(c, a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k))
                if first_only and len(a):
                    some = ~large[a]  # pairs come in order of a, then b
                    some[np.unique(b, return_index=True)[1]] = True
                    some[np.unique(a, return_index=True)[1]] = True
                    a, b = a[some], b[some]
                if len(a):
                    yield c["h"][a], c["h"][b]
                lo = hi
            return until

        def batch_of(found):
            held = list(_each(found, done))
            if held:
                a, b = (np.concatenate(x) for x in zip(*held))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        done: list[int] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            yield from batch_of(pairs(table, False))
            rest = table.slice(done.pop())
        if rest is not None and rest.num_rows:
            yield from batch_of(pairs(rest, True))

    return placed.mapInArrow(handing_back(run), "a long, b long").distinct()


def _each(found: Iterator, done: list[int]) -> Iterator:
    """The items of a generator; what it returns goes to ``done``."""
    done.append((yield from found))


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences; the columns of the table are bit vectors."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    everything, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = everything, 0, len(a)
    for y in b:
        equal = places.get(y, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        more, less = down | (everything & ~(across | up)), up & across
        distance += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & everything, less << 1 & everything
        up, down = less | (everything & ~(vertical | more)), more & vertical
    return distance


def line_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, number in it, start, end) of each line of the texts between ``offsets``, empty ones too."""
    feeds = offsets[0] + np.flatnonzero(data[offsets[0] : offsets[-1]] == 10)
    n = len(offsets) - 1
    text = np.concatenate((np.arange(n), np.searchsorted(offsets, feeds, side="right") - 1))
    start = np.concatenate((offsets[:-1], feeds + 1))
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    first = np.searchsorted(text, np.arange(n))
    last = np.append(first[1:], len(text))[text] - 1 == np.arange(len(text))
    end = np.where(last, offsets[text + 1], np.append(start[1:], 0) - 1)
    return text, np.arange(len(text)) - first[text], start, end


def _sequences(wanted: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """(h, words) of the lines ``wanted`` (h, first, line): their word hashes, read at their first occurrence."""
    asked = wanted.select("h", F.col("first").alias("key"), "line")
    place = F.col("key").bitwiseXOR(F.shiftright("key", 25)).bitwiseXOR(F.shiftleft(F.col("line").cast("long"), 20))
    bits = df.sparkSession.sparkContext.broadcast(key_bits(asked, place))  # KEY_BITS bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            keys, (data, offsets) = batch.column(0).to_numpy(), text_bytes(batch.column(1))
            text, number, start, end = line_ranges(data, offsets)
            spot = (keys[text] ^ keys[text] >> 25 ^ number << 20) % KEY_BITS
            at = np.flatnonzero((table[spot >> 3] >> (spot & 7)) & 1)
            size, view = end[at] - start[at], memoryview(data)
            picked = pa.py_buffer(b"".join([view[a:b] for a, b in zip(start[at], end[at])]))
            places = pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64))
            for block in map(units, blocks(pa.Array.from_buffers(pa.large_string(), len(at), [None, places, picked]), FOLD, TEXT)):
                found = lines(block)
                row = at[block.rows.start + found.text]
                words = [block.hashes[a:b].tobytes() for a, b in zip(found.start, found.end)]
                columns = [pa.array(keys[text[row]]), pa.array(number[row].astype(np.int32)), pa.array(found.digest), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "line", "h", "words"])

    source = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).where("key is not null")
    read = source.mapInArrow(handing_back(build), "key long, line int, h long, words binary").join(asked, ["h", "key", "line"], "left_semi")
    return read.dropDuplicates(["h"]).select("h", "words")


def _verify(pairs: DataFrame, sequences: DataFrame, percent: int) -> DataFrame:
    """The pairs whose word sequences are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(z.as_buffer(), dtype=np.uint64).tolist() for z in (x, y))
                keep.append(100 * edit_distance(p, q) <= (100 - percent) * max(len(p), len(q)))
            part = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            if part.num_rows:
                yield part

    left = pairs.join(sequences.select(F.col("h").alias("a"), F.col("words").alias("x")), "a")
    both = left.join(sequences.select(F.col("h").alias("b"), F.col("words").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(handing_back(compare), "a long, b long")


def losers(df: DataFrame, key: str, text: str, least: int, percent: int, bucket: int) -> DataFrame:
    """(key, version, gone): numbers of the lines that each text loses."""
    rows = written(occurrences(df, key, text, least, percent), "lines")
    sketch = ["h", "n", "q0", "q1", "q2", "q3", "wide", "rare"]
    once = rows.where("not again").groupBy(*sketch)
    nodes = written(once.agg(F.min("key").alias("first"), F.min_by("line", "key").alias("line"), F.max("key").alias("last")), "nodes")
    places = written(rows.select("key", "version", "line", "again", "h"), "places")
    discard(rows)
    met = _near(nodes.select(*sketch), True, percent, bucket)
    pairs = written(met, "pairs")
    discard(met)
    # Every line that is near another one is in some pair of the first pass.
    some = written(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "h", "left_semi"), "nodes")
    sequences = written(_sequences(some, df, key, text), "sequences")
    near = written(_verify(pairs, sequences, percent), "links")
    placed = some.join(components(near).withColumnRenamed("node", "h"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    placed = written(placed.select(*sketch, "component"), "nodes")
    discard(some)
    met = _near(placed, False, percent, bucket)
    tried = written(met.join(pairs, ["a", "b"], "left_anti"), "pairs")
    links = near.union(written(_verify(tried, sequences, percent), "links"))
    for done in (met, pairs, tried, sequences, placed):
        discard(done)
    grouped = nodes.join(components(links).withColumnRenamed("node", "h"), "h")
    best = grouped.groupBy("component").agg(F.min(F.struct("first", "line", "h")).alias("best"))
    linked = grouped.join(best, "component").select("h", F.col("best.first").alias("keeper"), (F.col("h") == F.col("best.h")).alias("stays"))
    copied = nodes.where("first <> last").join(linked.select("h"), "h", "left_anti").select("h", F.col("first").alias("keeper"), F.lit(True).alias("stays"))
    fate = written(linked.union(copied), "fate")
    for done in (nodes, links):
        discard(done)
    judged = places.join(fate, "h", "left")
    kept = ~F.col("again") & (F.col("keeper").isNull() | (F.col("stays") & (F.col("key") == F.col("keeper"))))
    return judged.where(~kept).groupBy("key", "version").agg(F.collect_set("line").alias("gone"))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, percent: int = PERCENT, bucket: int = BUCKET) -> DataFrame:
    """``df`` with ``text`` reduced to the lines that stay, and ``n_lines`` and ``n_removed``.

    Lines are what ``\\n`` separates; those that stay are unchanged and joined by ``\\n``,
    and a document that loses nothing keeps its text byte for byte. A null text stays null
    and has no lines; an empty text is one line. A row with a null key is returned as it
    is and takes no part. Rows that share a key are one document to the comparison. All columns stay; ``n_lines`` and ``n_removed`` are replaced.
    """
    made = ["n_lines", "n_removed"]
    columns = [c for c in df.columns if c not in made]
    body = F.col(text).cast("string")
    gone = losers(df, key, text, least, percent, bucket).select(F.col("key").alias("__key"), F.col("version").alias("__of"), F.col("gone").alias("__gone"))
    source = df.select(*columns, F.col(key).cast("long").alias("__id"), F.xxhash64(body).alias("__version"))
    joined = source.join(gone, (F.col("__id") == F.col("__key")) & (F.col("__version") == F.col("__of")), "left")

    @F.arrow_udf("string")
    def rest(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for value, drop in zip(texts, numbers):
            if value.is_valid:
                missing = set(drop.values.to_pylist())
                out.append("\n".join([p for j, p in enumerate(value.as_py().split("\n")) if j not in missing]))
            else:
                out.append(None)
        return pa.array(out, pa.string())

    lost = F.col("__gone").isNotNull()
    count = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    changed = joined.withColumn("__rest", rest(F.when(lost, body), F.col("__gone")))
    return changed.select(
        *[F.when(lost, F.col("__rest")).otherwise(body).alias(c) if c == text else F.col(c) for c in columns],
        F.coalesce(count, F.lit(0)).cast("long").alias("n_lines"),
        F.when(lost, F.size("__gone")).otherwise(0).cast("long").alias("n_removed"),
    )
