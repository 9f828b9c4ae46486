"""Conversation structure repair (operator 13).

A conversation is repaired by the cheapest edits that turn its roles into an optional
system turn followed by user and assistant in alternation. States and rows span a
lattice: node (i, q) means that i rows are done and the roles so far lead to state q;
keeping, changing, deleting and inserting turns are its edges. The cheapest way is found
by Dijkstra's search from both ends at once. When the heaps meet, all crossings that cost
as much as the best are finished, and the least audit among them wins.

Rows that are equal in turn, role and text are counted, not listed, and rows that must go
are one edge for a whole run. Rows are sorted over the cluster by conversation and turn
and cut into parts of at most ``PART_ROWS`` rows, so a conversation may own any share of
them. A part that is a whole conversation is solved at once. Every other part is solved
for each pair of states at its ends; ``chain`` then picks the states, looking at a few
short strings per part, and the parts are repaired where they are.

Defined results: null roles and texts are one space; rows of a null conversation are a
conversation; rows of one turn stand in the order of role and text (of their first 64
characters first); repeated rows are duplicates. A conversation without rows has no turn,
cost 0 and an empty audit. An empty table gives empty tables. Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heappop, heappush
from itertools import groupby, islice
from os.path import commonprefix

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfmark.llm.scratch import written

PART_ROWS = 256
# What blank texts consist of, how a turn may end, and what edits cost.
BLANK, ENDS = "\x20\x09\x0a\x0b\x0c\x0d", ".!?"
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
FINAL = (START, ASSISTANT)
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: State after a turn is put in or given another role.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}

#: An item is (initial, truncated) for a turn that may stay, or a number of turns that must go.
Item = tuple[str, bool] | int
Way = tuple[int, str]


class Lattice:
    """Edges between (rows done, state)."""

    def __init__(self, items: tuple[Item, ...]) -> None:
        self.items = items

    def _step(self, item: Item, q: int) -> Iterator[tuple[int, int, str]]:
        """(state, cost, audit) after an item."""
        if isinstance(item, int):
            yield q, DELETE * item, "D" * item
            return
        initial, cut = item
        more = TRUNCATED * cut
        yield q, DELETE, "D"
        if (q, initial) in _KEPT:
            yield _KEPT[q, initial], more, "K"
        yield _NEXT[q], REROLE + more, "R"

    def after(self, node: tuple[int, int]) -> Iterator[tuple[tuple[int, int], int, str]]:
        i, q = node
        if i < len(self.items):
            for to, cost, audit in self._step(self.items[i], q):
                yield (i + 1, to), cost, audit
        yield (i, _NEXT[q]), INSERT, "I"

    def before(self, node: tuple[int, int]) -> Iterator[tuple[tuple[int, int], int, str]]:
        i, q = node
        for p in STATES:
            if i:
                for to, cost, audit in self._step(self.items[i - 1], p):
                    if to == q:
                        yield (i - 1, p), cost, audit
            if _NEXT[p] == q:
                yield (i, p), INSERT, "I"


class _Side:
    """One of the two searches. Among nodes of one cost, those with less behind them go first, so that free edges never lead back to a settled node."""

    def __init__(self, sources: Iterable[tuple[int, int]], forward: bool, length: int) -> None:
        self.forward, self.length = forward, length
        self.reached: dict[tuple[int, int], Way] = {}
        self.settled: dict[tuple[int, int], Way] = {}
        self.heap: list[tuple[int, int, tuple[int, int]]] = []
        for node in sources:
            self.reach(node, (0, ""))

    def reach(self, node: tuple[int, int], way: Way) -> None:
        old = self.reached.get(node)
        if old is None or way < old:
            self.reached[node] = way
            if old is None or way[0] < old[0]:
                heappush(self.heap, (way[0], node[0] if self.forward else self.length - node[0], node))

    def top(self) -> int | None:
        while self.heap and (self.heap[0][2] in self.settled or self.heap[0][0] > self.reached[self.heap[0][2]][0]):
            heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def settle(self) -> tuple[int, int]:
        node = heappop(self.heap)[2]
        self.settled[node] = self.reached[node]
        return node


def cheapest(items: tuple[Item, ...], start: int, goals: tuple[int, ...]) -> Way | None:
    """Least (cost, audit) from ``start`` before the items to one of ``goals`` after them."""
    lattice, n = Lattice(items), len(items)
    ahead, back = _Side([(0, start)], True, n), _Side([(n, q) for q in goals], False, n)
    best: Way | None = None

    def cross(left: Way, cost: int, audit: str, right: Way) -> None:
        nonlocal best
        total = left[0] + cost + right[0]
        if best is None or total <= best[0]:
            way = (total, left[1] + audit + right[1])
            best = way if best is None else min(best, way)

    while (a := ahead.top()) is not None or back.top() is not None:
        b = back.top()
        if best is not None and (a or 0) + (b or 0) > best[0]:
            break
        if b is None or a is not None and a <= b:
            node = ahead.settle()
            way = ahead.settled[node]
            if node in back.settled:
                cross(way, 0, "", back.settled[node])
            for to, cost, audit in lattice.after(node):
                if to in back.settled:
                    cross(way, cost, audit, back.settled[to])
                ahead.reach(to, (way[0] + cost, way[1] + audit))
        else:
            node = back.settle()
            way = back.settled[node]
            if node in ahead.settled:
                cross(ahead.settled[node], 0, "", way)
            for to, cost, audit in lattice.before(node):
                if to in ahead.settled:
                    cross(ahead.settled[to], cost, audit, way)
                back.reach(to, (way[0] + cost, audit + way[1]))
    return best


#: Short conversations repeat the same few patterns.
_known = lru_cache(20_000)(cheapest)


def solved(items: tuple[Item, ...], start: int, goals: tuple[int, ...]) -> Way | None:
    small = len(items) <= 12 and all(not isinstance(x, int) or x < 100 for x in items)
    return (_known if small else cheapest)(items, start, goals)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the planted faults: by a checksum of conversation and turn a row
    is dropped (no copies), emptied, loses its full stops, is doubled, or becomes the user's."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(shown("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ENDS, "")).otherwise(shown("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def judged(rows: DataFrame) -> DataFrame:
    """Equal rows counted (n), with what is wrong with them: blank, seen (in an earlier turn), cut (truncated)."""
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    shown = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    counted = counted.withColumn("same", F.sha2(F.concat_ws("\0", shown, "role", "text").cast("binary"), 256))
    turn = F.struct(F.col("turn").isNotNull().alias("present"), F.col("turn").alias("turn"))
    firsts = counted.where("n > 0").groupBy("same").agg(F.min(turn).alias("first"))
    body = F.rtrim(F.col("text"), F.lit(BLANK))
    return counted.join(firsts, "same", "left").select(
        "conv_id",
        "turn",
        "role",
        "text",
        "n",
        (body == "").alias("blank"),
        F.coalesce(~F.col("first.turn").eqNullSafe(F.col("turn")), F.lit(False)).alias("seen"),
        (~F.right(body, F.lit(1)).isin(*ENDS)).alias("cut"),
    )


def items_of(row: dict) -> list[Item]:
    if not row["n"]:
        return []
    if row["blank"] or row["seen"]:
        return [row["n"]]
    return [(row["role"][:1], row["cut"]), *([row["n"] - 1] if row["n"] > 1 else [])]


def counts_of(rows: list[dict]) -> dict:
    """What two adjacent parts need to know of each other to add up their counts."""
    out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "first": None, "last": None, "low": None, "high": None}
    for row in rows:
        n, initial, turn = row["n"], row["role"][:1], row["turn"]
        if not n:
            continue
        stays = not (row["blank"] or row["seen"])
        one = {"blank": n * row["blank"], "duplicate": (n - 1 if stays else n) * (not row["blank"]), "truncated": int(stays and row["cut"])}
        one |= {"illegal": n - 1, "turns": int(turn is not None), "first": initial, "last": initial, "low": turn, "high": turn}
        out = added(out, one)
    return out


def added(a: dict, b: dict) -> dict:
    if b["first"] is None or a["first"] is None:
        return a if b["first"] is None else b
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["last"] + b["first"] not in _LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {"first": a["first"], "last": b["last"], "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}


def _sorted_rows(df: DataFrame) -> DataFrame:
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.substring("role", 1, 64).asc(), F.substring("text", 1, 64).asc()]
    return df.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")


def parts(judged_rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(conv_id, part, summary, rows): the rows of every conversation in order, cut into parts; parts are numbered in order.

    The summary holds the counts of a part and its ways: from each state to each, or the one way of a whole conversation.
    """
    kind = judged_rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("part", T.LongType()), T.StructField("summary", T.StringType()), T.StructField("rows", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def made(conv, number: int, rows: list[dict], whole: bool) -> dict:
        items = tuple(x for row in rows for x in items_of(row))
        if whole:
            ways = [(START, START, solved(items, START, FINAL))]
        else:
            ways = [(p, q, way) for p in STATES for q in STATES if (way := solved(items, p, (q,)))]
        held = [[r["role"], r["text"], items_of(r)] for r in rows if r["n"]]
        summary = {"counts": counts_of(rows), "ways": [[p, q, *way] for p, q, way in ways], "whole": whole}
        return {"conv_id": conv, "part": number, "summary": json.dumps(summary), "rows": zstandard.compress(json.dumps(held).encode(), 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out = TaskContext.get().partitionId() << 32, []
        rows = (row for batch in batches for row in batch.to_pylist())
        groups = groupby(rows, key=lambda row: row["conv_id"])
        held: tuple | None = None  # the last part, until it is known whether its task goes on

        def flush(following: bool) -> Iterator[dict]:
            """``following``: another conversation follows in this task."""
            if held:
                conv, k, piece, alone = held
                yield made(conv, k, piece, alone and following)

        for place, (conv, group) in enumerate(groups):
            out += flush(True)
            held, first = None, True
            while piece := list(islice(group, part_rows)):
                out += flush(False)
                held = (conv, number, piece, place > 0 and first)
                number, first = number + 1, False
                if len(piece) == part_rows:
                    held = (*held[:3], False)
            if len(out) >= 500:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        out += flush(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _sorted_rows(judged_rows).mapInArrow(run, schema)


def _chained(summaries: Iterable[dict]) -> Iterator[dict]:
    """Entry state and audit of each part of one conversation, in order; the last has the counts, the cost and the whole audit.

    Of the ways to each state only the ends that differ are kept as strings; what they share is settled.
    """
    settled: list[str] = []
    ways: dict[int, tuple[int, str, tuple | None]] = {START: (0, "", None)}
    counts, last = None, None
    for row in summaries:
        summary = json.loads(row["summary"])
        last, counts = row, added(counts, summary["counts"]) if counts else summary["counts"]
        made: dict[int, tuple[int, str, tuple]] = {}
        for p, q, cost, audit in summary["ways"]:
            if p in ways:
                before = ways[p]
                way = (before[0] + cost, before[1] + audit, (before[2], row["part"], p, audit))
                if q not in made or way[:2] < made[q][:2]:
                    made[q] = way
        shared = len(commonprefix([way[1] for way in made.values()]))
        settled.append(next(iter(made.values()))[1][:shared])
        ways = {q: (cost, audit[shared:], path) for q, (cost, audit, path) in made.items()}
    cost, audit, path = min((ways[q] for q in FINAL if q in ways), key=lambda way: way[:2])
    steps = []
    while path:
        path, part, entry, own = path
        steps.append({"conv_id": last["conv_id"], "part": part, "entry": entry, "edits": own})
    gaps = 0 if counts["low"] is None else counts["high"] - counts["low"] + 1 - counts["turns"]
    verdict = {k: counts[k] for k in ("blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost, "audit": "".join(settled) + audit}
    for k, step in enumerate(reversed(steps)):
        yield step | {"verdict": verdict if k == len(steps) - 1 else None}


_VERDICT = "gaps: long, blank: long, duplicate: long, truncated: long, illegal: long, cost: long, audit: string"


def _ordered(df: DataFrame) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "part")


def _batches(rows: Iterable[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def chain(parted: DataFrame) -> DataFrame:
    """(conv_id, part, entry, edits, verdict) of every part; reads summaries only."""
    schema = T.StructType([parted.schema["conv_id"], *T.StructType.fromDDL(f"part long, entry int, edits string, verdict struct<{_VERDICT}>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        yield from _batches((step for _, group in groupby(rows, key=lambda r: r["conv_id"]) for step in _chained(group)), arrow)

    return _ordered(parted.select("conv_id", "part", "summary")).mapInArrow(run, schema)


def turns_of(rows: list, entry: int, edits: str) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of the turns that stay or come in."""
    items = [(role, text, item) for role, text, own in rows for item in own]
    q, at, done = entry, 0, 0
    while done < len(edits):
        edit = edits[done]
        if edit == "I":
            q = _NEXT[q]
            yield _ROLE[q], "", edit
            done += 1
            continue
        role, text, item = items[at]
        at += 1
        done += item if isinstance(item, int) else 1
        if edit == "K":
            q = _KEPT[q, role[:1]]
            yield role, text, edit
        elif edit == "R":
            q = _NEXT[q]
            yield _ROLE[q], text, edit


def applied(parted: DataFrame, steps: DataFrame) -> DataFrame:
    """(conv_id, part, place, role, text, edit): the repaired turns, in the order of part and place."""
    schema = T.StructType([parted.schema["conv_id"], *T.StructType.fromDDL("part long, place int, role string, text string, edit string").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    rows = json.loads(zstandard.decompress(row["rows"]))
                    for place, (role, text, edit) in enumerate(turns_of(rows, row["entry"], row["edits"])):
                        yield {"conv_id": row["conv_id"], "part": row["part"], "place": place, "role": role, "text": text, "edit": edit}

        yield from _batches(turns(), arrow)

    return parted.select("conv_id", "part", "rows").join(steps.select("part", "entry", "edits"), "part").mapInArrow(run, schema)


def repair(rows: DataFrame, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """(verdicts, turns) of conversations (conv_id, turn, role, text, copies); ``copies`` 0 keeps a conversation without its row.

    Verdicts: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Turns: as ``applied``.
    """
    parted = written(parts(judged(rows), part_rows), "conversation-parts")
    steps = written(chain(parted), "conversation-steps")
    return steps.where("verdict IS NOT NULL").select("conv_id", "verdict.*"), applied(parted, steps)


def digest(turns: DataFrame, out: str = "repaired_sha256") -> DataFrame:
    """SHA-256 of ``role:text`` of the turns of each conversation, joined by line feeds. Turns stream through; none is kept."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField(out, T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[dict]:
            rows = (row for batch in batches for row in batch.to_pylist())
            for conv, group in groupby(rows, key=lambda r: r["conv_id"]):
                state = sha256()
                for k, row in enumerate(group):
                    state.update(f"{'\n' if k else ''}{row['role']}:{row['text']}".encode())
                yield {"conv_id": conv, out: state.hexdigest()}

        yield from _batches(digests(), arrow)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, schema)


def repaired_digest(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Verdicts with the digest of the repaired turns."""
    verdicts, turns = repair(rows, part_rows)
    digests = digest(turns).withColumnRenamed("conv_id", "other")
    empty: Column = F.lit(sha256(b"").hexdigest())
    joined = verdicts.join(digests, verdicts["conv_id"].eqNullSafe(digests["other"]), "left")
    return joined.select(*verdicts.columns, F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
