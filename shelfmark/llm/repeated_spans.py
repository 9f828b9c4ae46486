"""Substring dedup (operator 3).

A window is ``width`` consecutive words of one text. Each window's minimiser is the least
hash of its m-grams of words; consecutive windows with one minimiser form a super-k-mer.
Equal windows have equal minimisers, so a super-k-mer's windows can only recur in
super-k-mers of the same minimiser.

1. Texts are cut into super-k-mers: (document, start, number of windows, minimiser,
   digest of the words). Equal super-k-mers are combined, before and after the shuffle,
   to one row with the smallest document, so copies do not travel.
2. Minimisers seen in one document only are done with. Where one minimiser has several
   different super-k-mers, each travels once, as one packed string of its words, to the
   minimiser's bucket.
3. A bucket sorts the windows of its strings, and gives for every window the smallest
   document in which it starts. A bucket with more strings than fit one task is dealt by
   window instead: its windows are grouped by a 128-bit digest of their words.
4. The answers go back to the occurrences; a document whose window started in a smaller
   document loses the words that the window covers.

Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.scratch import written
from shelfmark.llm.words import Block, blocks, constants, gram_hashes, mix

WIDTH, MINIMISER = 50, 12
#: Strings of one minimiser that one task sorts; more are dealt by window.
BUCKET = 4_000


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    reach, out = 1, values
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def super_kmers(block: Block, width: int, m: int) -> tuple[np.ndarray, ...]:
    """(text, start word within the text, windows, minimiser, digest) of the super-k-mers of a block."""
    total = len(block.hashes)
    span = width - m + 1
    empty = np.empty(0, dtype=np.int64)
    if total < width:
        return empty, empty, empty, empty, empty
    grams = gram_hashes(block.hashes, np.arange(total - m + 1), m)
    least = _sliding_min(grams, span)
    sizes = np.diff(block.first)
    counts = np.maximum(sizes - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    if not len(owner):
        return empty, empty, empty, empty, empty
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    key = least[block.first[:-1][owner] + inside]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(fresh)
    lengths = np.diff(np.append(heads, len(key)))
    # A run longer than the span (a text that repeats itself) is cut, so that strings stay short.
    parts = -(-lengths // span)
    at = np.repeat(heads, parts) + span * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    n = np.minimum(np.repeat(heads + lengths, parts) - at, span)
    text, start = owner[at], inside[at]
    return text, start, n, key[at].view(np.int64), _digests(block.hashes, block.first[text] + start, n + width - 1)


def _digests(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of the words of each run; run lengths count."""
    factors = constants(int(lengths.max()) if len(lengths) else 1, 7)
    out = np.empty(len(starts), dtype=np.uint64)
    for lo in range(0, len(starts), 4096):
        s, n = starts[lo : lo + 4096], lengths[lo : lo + 4096]
        ends = np.cumsum(n)
        within = np.arange(ends[-1]) - np.repeat(ends - n, n)
        out[lo : lo + 4096] = np.add.reduceat(hashes[np.repeat(s, n) + within] * factors[within], ends - n)
    return mix(out + lengths.astype(np.uint64)).view(np.int64)


def cut(df: DataFrame, key: str, text: str, width: int, m: int) -> DataFrame:
    """(key, start, n, mini, sig): the super-k-mers of every text."""
    names = ["key", "start", "n", "mini", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                owner, start, n, mini, sig = super_kmers(block, width, m)
                if len(owner):
                    arrays = [keys[block.rows.start + owner], start.astype(np.int32), n.astype(np.int32), mini, sig]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names)

    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).where(F.col(key).isNotNull()).mapInArrow(run, "key long, start int, n int, mini long, sig long")


def _packed(chosen: DataFrame, df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(mini, sig, first, n, words): each chosen super-k-mer as one string, cut from its first document."""
    asked = chosen.groupBy(F.col("first").alias("key")).agg(F.collect_list(F.struct("start", "n", "mini", "sig")).alias("asked"))
    texts = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    joined = texts.join(asked, "key").select("key", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("asked")
            for block in blocks(batch.column("text")):
                data = block.data.tobytes()
                for i, row in enumerate(block.rows):
                    firsts = batch.column("key")[row].as_py()
                    found = lists[row].values
                    start, n = found.field(0).to_numpy(), found.field(1).to_numpy()
                    at, end = block.first[i] + start, block.first[i] + start + n + width - 1
                    fits = end <= block.first[i + 1]  # another row of this key may have the words
                    strings = [b" ".join(data[block.starts[w] : block.ends[w]] for w in range(a, b)) for a, b in zip(at[fits], end[fits])]
                    keep = pa.array(fits)
                    yield pa.RecordBatch.from_arrays(
                        [found.field(2).filter(keep), found.field(3).filter(keep), pa.array(np.full(len(strings), firsts, dtype=np.int64)), found.field(1).filter(keep), pa.array(strings, pa.binary())],
                        ["mini", "sig", "first", "n", "words"],
                    )

    return joined.mapInArrow(run, "mini long, sig long, first long, n int, words binary")


def _window_table(words: list[bytes], width: int) -> tuple[list[bytes], np.ndarray]:
    """All windows of the strings as bytes, and the number of the string of each."""
    out, owner = [], []
    for i, string in enumerate(words):
        parts = string.split(b" ")
        out += [b" ".join(parts[k : k + width]) for k in range(len(parts) - width + 1)]
        owner += [i] * (len(parts) - width + 1)
    return out, np.array(owner, dtype=np.int64)


def _runs(firsts: np.ndarray) -> list[dict]:
    """(at, n, first) of the runs of windows with one answer."""
    heads = np.flatnonzero(np.append(True, firsts[1:] != firsts[:-1]))
    ends = np.append(heads[1:], len(firsts))
    return [{"at": int(a), "n": int(b - a), "first": int(firsts[a])} for a, b in zip(heads, ends)]


RUNS_TYPE = "array<struct<at: int, n: int, first: long>>"
_RUNS_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("first", pa.int64())]))


def _sorted_buckets(packed: DataFrame, width: int) -> DataFrame:
    """(mini, sig, runs): the smallest document of each window of each string, one bucket after another."""
    placed = packed.repartition("mini").sortWithinPartitions("mini", "first")

    def answer(mini: int, sigs: list[int], firsts: list[int], words: list[bytes]):
        made, owner = _window_table(words, width)
        order = sorted(range(len(made)), key=made.__getitem__)
        first = np.array(firsts, dtype=np.int64)[owner]
        out = first.copy()
        lo = 0
        for hi in range(1, len(order) + 1):
            if hi == len(order) or made[order[hi]] != made[order[lo]]:
                if hi - lo > 1:
                    same = order[lo:hi]
                    out[same] = first[same].min()
                lo = hi
        bounds = np.searchsorted(owner, np.arange(len(words) + 1))
        runs = [_runs(out[bounds[i] : bounds[i + 1]]) for i in range(len(words))]
        return pa.RecordBatch.from_arrays([pa.array([mini] * len(sigs), pa.int64()), pa.array(sigs, pa.int64()), pa.array(runs, _RUNS_ARROW)], ["mini", "sig", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mini, held = None, ([], [], [])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("mini", "sig", "first", "words")]
            for at, sig, first, words in zip(*columns):
                if at != mini:
                    if held[0]:
                        yield answer(mini, *held)
                    mini, held = at, ([], [], [])
                for part, value in zip(held, (sig, first, words)):
                    part.append(value)
        if held[0]:
            yield answer(mini, *held)

    return placed.mapInArrow(run, f"mini long, sig long, runs {RUNS_TYPE}")


def _dealt_buckets(packed: DataFrame, width: int) -> DataFrame:
    """The same answers for minimisers with very many strings: their windows are grouped by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                made, owner = _window_table(part.column("words").to_pylist(), width)
                rows = pa.array(owner)
                inside = np.arange(len(owner)) - np.searchsorted(owner, owner)
                digest = [hashlib.blake2b(x, digest_size=16).digest() for x in made]
                columns = [part.column(c).take(rows) for c in ("mini", "sig", "first")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(inside.astype(np.int32)), pa.array(digest, pa.binary())], ["mini", "sig", "first", "at", "window"])

    rows = packed.mapInArrow(run, "mini long, sig long, first long, at int, window binary")
    least = rows.groupBy("mini", "window").agg(F.min("first").alias("least"))
    found = rows.join(least, ["mini", "window"]).groupBy("mini", "sig").agg(F.collect_list(F.struct("at", F.lit(1).alias("n"), F.col("least").alias("first"))).alias("runs"))
    return found.select("mini", "sig", F.col("runs").cast(RUNS_TYPE))  # a string has few windows


def covered(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, m: int = MINIMISER, bucket: int = BUCKET) -> DataFrame:
    """(key, spans) of the documents that lose words: runs (start, end) of window starts that start earlier elsewhere."""
    pieces = cut(df, key, text, width, m)
    distinct = pieces.groupBy("mini", "sig").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.min_by("start", "key").alias("start"), F.first("n").alias("n"))
    minis = distinct.groupBy("mini").agg(F.count("*").alias("strings"), F.min("first").alias("low"), F.max("last").alias("high")).where("low <> high")
    shared = written(distinct.join(minis.select("mini", "strings"), "mini"), "shared")
    packed = _packed(shared.where("strings > 1"), df, key, text, width)
    if shared.where(F.col("strings") > bucket).isEmpty():
        runs = _sorted_buckets(packed, width)
    else:
        crowded = shared.where(F.col("strings") > bucket).select("mini").distinct()
        packed = written(packed, "packed")
        runs = _sorted_buckets(packed.join(crowded, "mini", "left_anti"), width).union(_dealt_buckets(packed.join(crowded, "mini", "left_semi"), width))
    alone = F.array(F.struct(F.lit(0).alias("at"), F.col("n"), F.col("first"))).cast(RUNS_TYPE)
    single = shared.where("strings = 1").select("mini", "sig", alone.alias("runs"))
    answers = written(runs.where(F.size("runs") > 0).union(single), "answers")
    hits = pieces.join(answers, ["mini", "sig"]).select("key", "start", F.filter("runs", lambda r: r["first"] < F.col("key")).alias("runs")).where(F.size("runs") > 0)
    spans = F.transform("runs", lambda r: F.struct((F.col("start") + r["at"]).alias("start"), (F.col("start") + r["at"] + r["n"]).alias("end")))
    return hits.select("key", spans.alias("spans")).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "kept_words", width: int = WIDTH, m: int = MINIMISER, bucket: int = BUCKET) -> DataFrame:
    """(key, n_words, n_removed, ``out``) of every row of ``df``; ``out`` is the kept words joined by one space.

    A null or blank text has no words. ``key`` holds integers; a row with a null key is
    kept as it is and compared with nothing. Rows that share a key are one document to
    the comparison: their windows are never removed for each other. An empty table gives
    an empty table.
    """
    spans = covered(df, key, text, width, m, bucket)
    texts = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    joined = texts.join(spans, "key", "left").select("key", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            for block in blocks(batch.column("text")):
                data = block.data.tobytes()
                total, removed, kept = [], [], []
                for i, row in enumerate(block.rows):
                    lo, hi = block.first[i], block.first[i + 1]
                    total.append(int(hi - lo))
                    edges = np.zeros(hi - lo + 1, dtype=np.int64)
                    if lists[row].is_valid and hi - lo >= width:
                        start, end = (lists[row].values.field(c).to_numpy() for c in (0, 1))
                        fits = end + width - 1 <= hi - lo
                        np.add.at(edges, start[fits], 1)
                        np.add.at(edges, end[fits] + width - 1, -1)
                    stays = np.cumsum(edges[:-1]) == 0
                    removed.append(int(hi - lo - stays.sum()))
                    words = np.flatnonzero(stays) + lo
                    kept.append(b" ".join([data[a:b] for a, b in zip(block.starts[words].tolist(), block.ends[words].tolist())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(block.rows.start, len(block.rows)), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["key", "n_words", "n_removed", out],
                )

    return joined.mapInArrow(run, f"key long, n_words long, n_removed long, {out} string").withColumnRenamed("key", key)
