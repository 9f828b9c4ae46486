"""Phrase collocation mining (operator 11).

Phrases are found level by level as relations of occurrences (SETM). A relation holds
(place, phrase) sorted by place; a place counts words, with a gap after each piece, so
that "the next place" means "the next word of the same piece". Relations are persisted
in blocks (``packed``). At each level

1. every block merge-joins its occurrences of frequent phrases of k words with its
   occurrences of frequent words at the adjacent place and counts the groups it gets;
2. counts are summed over all blocks by phrase;
3. the groups that reach the least support go back to the blocks that hold them, and a
   semi-join leaves only their occurrences for the next level.

Relations are stored in buckets by block, so that what a block asked for travels to it and
the relation stays where it is; a relation is deleted when the next one is written. Words and phrases are 64-bit hashes while they are counted, seeded by language. Every
part of a frequent phrase is frequent, so all counts that the scores ask for are there.

Defined results: a null text is empty; a null language is ``und``; repeated rows count
as often as they occur; texts without words and empty tables give no phrase; other
columns are not read. A text of any length lies in one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm import packed
from shelfmark.llm.packed import look_up, pack, pack_sorted, unpack, unpack_sorted
from shelfmark.llm.scratch import dealt, discard, written
from shelfmark.llm.words import LOWER, blocks, mix, text_bytes

LEAST, LONGEST, PERCENT, TOP = 30, 4, 80, 2000
UNKNOWN = "und"
# What ends a piece, and what else separates words.
BREAKS, GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"

_IS_BREAK = np.zeros(256, dtype=bool)
_IS_BREAK[list(BREAKS)] = True
_FOLD = LOWER.copy()
_FOLD[list(BREAKS + GAPS)] = 0x20
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Parts into which the last ranking of a language is dealt first.
RANK_PARTS = 64

_BASE = "block long, size long, base_slots binary, base_ids binary, base_keys binary"
_RELATION = f"{_BASE}, slots binary, ids binary, keys binary"
_FOUND = f"{_RELATION}, found array<struct<key: long, first: long, last: long, lang: string, word: string, f: long>>"


def _language(name: str) -> np.uint64:
    return np.uint64(int.from_bytes(blake2b(name.encode(), digest_size=8).digest(), "little"))


class _Held:
    """Words gathered for the next block."""

    def __init__(self) -> None:
        self.n, self.slots, self.keys, self.names, self.langs, self.next = 0, [], [], [], [], 0
        self.counts: dict[str, int] = {}

    def add(self, block, raw: np.ndarray, lang: pa.Array) -> None:
        own = lang.slice(block.rows.start, len(block.rows)).dictionary_encode()
        names = own.dictionary.to_pylist()
        owner = block.owners()
        code = own.indices.to_numpy()[owner]
        for k, n in enumerate(np.bincount(code, minlength=len(names)).tolist()):
            if n:
                self.counts[names[k]] = self.counts.get(names[k], 0) + n
        piece = np.cumsum(_IS_BREAK[raw])[block.starts] + owner
        gaps = np.concatenate(([0], np.cumsum(np.diff(piece) > 0)))
        slots = np.arange(len(piece)) + gaps + self.next
        keys = mix(block.hashes ^ np.array([_language(x) for x in names], dtype=np.uint64)[code])
        unique, place, _, ids = packed.distinct(keys)
        # Words and what lies between them tile the bytes: even entries are the words.
        edges = np.empty(2 * len(block.starts), dtype=np.int32)
        edges[::2], edges[1::2] = block.starts, block.ends
        tiles = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(block.data)])
        self.names += tiles.take(pa.array(2 * place)).to_pylist()
        self.langs += [names[k] for k in code[place]]
        self.keys.append((unique, ids))
        self.slots.append(slots)
        self.n += len(slots)
        self.next = int(slots[-1]) + 2

    def row(self, block: int) -> dict:
        every = np.concatenate([u for u, _ in self.keys])
        keys, place, _, renamed = packed.distinct(every)
        bounds = np.cumsum([0, *[len(u) for u, _ in self.keys]])
        ids = np.concatenate([renamed[a + i] for a, (_, i) in zip(bounds, self.keys)])
        kinds = sorted(self.counts)
        code = {x: k for k, x in enumerate(kinds)}
        return {
            "block": block,
            "size": self.n,
            "slots": pack_sorted(np.concatenate(self.slots)),
            "ids": pack(ids),
            "keys": pack(keys),
            "words": pack(np.frombuffer(b" ".join(self.names[p] for p in place), dtype=np.uint8)),
            "langs": pack(np.array([code[self.langs[p]] for p in place], dtype=np.uint32)),
            "n": [{"lang": x, "n": self.counts[x]} for x in kinds],
        }


_WORDS = "block long, size long, slots binary, ids binary, keys binary, words binary, langs binary, n array<struct<lang: string, n: long>>"


def occurrences(documents: DataFrame, text: str, lang: str, block_words: int) -> DataFrame:
    """Blocks of word occurrences of all texts."""
    arrow = packed.arrow_schema(_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, made = _Held(), 0
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for block in blocks(batch.column(1), _FOLD):
                if not len(block.starts):
                    continue
                held.add(block, raw[offsets[block.rows.start] : offsets[block.rows.stop]], batch.column(0))
                if held.n >= block_words:
                    yield pa.RecordBatch.from_pylist([held.row(packed.block_number(made))], schema=arrow)
                    held, made = _Held(), made + 1
        if held.n:
            yield pa.RecordBatch.from_pylist([held.row(packed.block_number(made))], schema=arrow)

    rows = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))
    return rows.where("text is not null").mapInArrow(run, _WORDS)


def word_counts(words: DataFrame) -> DataFrame:
    arrow, ranges = packed.arrow_schema(packed.REPORT), packed.ranges_for(packed.entries(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = unpack(row["keys"], np.uint64), np.bincount(unpack(row["ids"], np.uint32))
                order = np.argsort(keys)
                yield packed.report_batch(packed.reports(row["block"], keys[order], counts[order], ranges), arrow)

    return words.select("block", "ids", "keys").mapInArrow(run, packed.REPORT)


def frequent_words(row: dict, keys: np.ndarray, total: np.ndarray, own: np.ndarray) -> list[dict]:
    """The occurrences of frequent words of a block, and the words it is to name."""
    local = unpack(row["keys"], np.uint64)
    at = look_up(local, keys)
    ids = unpack(row["ids"], np.uint32)
    kept = (at >= 0)[ids]
    number = np.cumsum(at >= 0) - 1
    slots = unpack_sorted(row["slots"], np.int64)[kept]
    names, langs = unpack(row["words"], np.uint8).tobytes().split(b" "), unpack(row["langs"], np.uint32)
    kinds = [x["lang"] for x in row["n"]]
    named = [i for i in np.flatnonzero(at >= 0) if own[at[i]]]
    found = [{"key": int(local[i].view(np.int64)), "first": None, "last": None, "lang": kinds[langs[i]], "word": names[i].decode(errors="replace"), "f": int(total[at[i]])} for i in named]
    return [_relation(row["block"], (slots, number[ids[kept]].astype(np.uint32), local[at >= 0]), None, found)]


def _relation(block: int, base: tuple, level: tuple | None, found: list[dict]) -> dict:
    out = {"block": block, "size": len((level or base)[0]), "found": found}
    for prefix, part in (("base_", base), ("", level)):
        slots, ids, keys = part or base
        if prefix or part is not None:
            out |= {f"{prefix}slots": pack_sorted(slots), f"{prefix}ids": pack(ids), f"{prefix}keys": pack(keys)}
    return out


def _part(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpack_sorted(row[f"{prefix}slots"], np.int64), unpack(row[f"{prefix}ids"], np.uint32), unpack(row[f"{prefix}keys"], np.uint64)


def extend(row: dict, width: int) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge-join of the occurrences of ``width`` words with the words at the adjacent place.

    Returns (base relation, places, phrase keys, first keys, last keys).
    """
    base = _part(row, "base_")
    slots, ids, keys = base if row["slots"] is None else _part(row, "")
    at = np.searchsorted(base[0], slots + width)
    held = at < len(base[0])
    held[held] = base[0][at[held]] == slots[held] + width
    first, last = keys[ids[held]], base[2][base[1][at[held]]]
    return base, slots[held], mix(first * _STEP + last + np.uint64(width)), first, last


def extended_counts(relations: DataFrame, width: int) -> DataFrame:
    arrow, ranges = packed.arrow_schema(packed.REPORT), packed.ranges_for(packed.entries(relations))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, made, _, _ = extend(row, width)
                yield packed.report_batch(packed.reports(row["block"], *np.unique(made, return_counts=True), ranges), arrow)

    return relations.drop("found", "size").mapInArrow(run, packed.REPORT)


def frequent_phrases(width: int):
    def answer(row: dict, keys: np.ndarray, total: np.ndarray, own: np.ndarray) -> list[dict]:
        base, slots, made, first, last = extend(row, width)
        at = look_up(made, keys)
        kept = at >= 0
        if not kept.any():
            return []
        slots, made, at, first, last = slots[kept], made[kept], at[kept], first[kept], last[kept]
        unique, place, _, ids = packed.distinct(made)
        signed = lambda x: int(x.view(np.int64))
        found = [
            {"key": signed(made[p]), "first": signed(first[p]), "last": signed(last[p]), "lang": None, "word": None, "f": int(total[at[p]])}
            for p in place
            if own[at[p]]
        ]
        wanted = np.zeros(len(base[0]), dtype=bool)
        spots = np.searchsorted(base[0], slots + width + 1)
        wanted[spots[spots < len(base[0])]] = True
        left = (base[0][wanted], base[1][wanted], base[2])
        return [_relation(row["block"], left, (slots, ids, unique), found)]

    return answer


def phrases(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, block_words: int = packed.BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(all frequent phrases, words by language).

    The first is (lang, words, f) for phrases of 1 to ``longest`` words that occur
    ``least`` times or more, the second (lang, n).
    """
    words = dealt(occurrences(documents, text, lang, block_words), "words", "block")
    n = written(words.select(F.explode("n").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n")), "totals")
    enough = written(packed.totals(word_counts(words), least), "frequent")
    relations = dealt(packed.answered(words, enough, words.columns[2:], frequent_words, _FOUND), "relation", "block")
    single = written(relations.select(F.inline("found")).select("key", "lang", "word", "f"), "single")
    discard(words)
    discard(enough)
    level = single.select("key", "lang", F.array("word").alias("words"), "f")
    out = level
    for width in range(1, longest):
        enough = written(packed.totals(extended_counts(relations, width), least), "frequent")
        before, relations = relations, dealt(packed.answered(relations, enough, relations.columns[2:-1], frequent_phrases(width), _FOUND), "relation", "block")
        made = relations.select(F.inline("found")).select("key", "first", "last", "f")
        shorter = level.select(F.col("key").alias("first"), "lang", "words")
        named = made.join(shorter, "first").join(single.select(F.col("key").alias("last"), "word"), "last")
        level = written(named.select("key", "lang", F.concat("words", F.array("word")).alias("words"), "f"), "level")
        discard(before)
        discard(enough)
        out = out.union(level)
    discard(relations)
    return out.select("lang", "words", "f"), n


def wide(column: str) -> str:
    return f"cast({column} as decimal(20, 0))"


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, percent: int = PERCENT, top: int | None = TOP, block_words: int = packed.BLOCK_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language, all of them without ``top``.

    A candidate's score is the lowest of its cuts. Candidates that lie inside a longer
    one with at least ``percent`` of their occurrences go. Products are decimals of up to
    38 digits.
    """
    every, n = phrases(documents, text, lang, least, longest, block_words)
    every = written(every.select("lang", "words", F.array_join("words", " ").alias("phrase"), "f"), "phrases")
    known = lambda part, count: every.select("lang", F.col("phrase").alias(part), F.col("f").alias(count))
    long = every.where(F.size("words") >= 2)
    cut = "transform(sequence(1, size(words) - 1), k -> struct(k, array_join(slice(words, 1, k), ' ') as head, array_join(slice(words, k + 1, size(words)), ' ') as tail))"
    cuts = long.select("lang", "phrase", "f", F.expr(f"inline({cut})"))
    cuts = cuts.join(known("head", "l"), ["lang", "head"]).join(known("tail", "r"), ["lang", "tail"])
    score = F.expr(f"cast(2000000 as decimal(10, 0)) * {wide('f')} div ({wide('l')} + {wide('r')})")
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", F.col("f").alias("a"))).alias("best"))
    inside = long.where(F.size("words") >= 3).select(
        "lang",
        "f",
        F.explode(F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' '))))")).alias("phrase"),
    )
    holder = inside.groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    swallowed = F.expr(f"coalesce(100 * {wide('within')} >= {percent} * {wide('best.a')}, false)")
    left = lowest.join(holder, ["lang", "phrase"], "left").where(~swallowed).select("lang", "phrase", "best.a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
        left = left.withColumn("__place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("__place") <= top).drop("__place")
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
