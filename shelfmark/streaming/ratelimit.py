"""Sliding-window admission per key, as a batch job and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfmark.session import cut_lineage

#: Rounds of guessing; what is not settled then is chained.
ROUNDS = 3
Held = list[int]


def admit(times: np.ndarray, held: Held, limit: int, window_ms: int) -> tuple[np.ndarray, np.ndarray, Held]:
    """(allowed, seconds to wait, admitted times inside the window) for one key's events in time order.

    ``held`` are the admitted times before. Events are passed in leaps: as many as there
    is room for are admitted, then all are refused until the oldest admitted one expires.
    """
    n = len(times)
    allowed, wait = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int32)
    if limit <= 0:
        wait[:] = 1
        return allowed, wait, []
    at, held, first = 0, list(held), 0
    while at < n:
        now = times[at]
        while first < len(held) and held[first] <= now - window_ms:
            first += 1
        room = limit - (len(held) - first)
        if room > 0:
            to = min(at + room, n)
            allowed[at:to] = True
            held = held[first:] + times[at:to].tolist()
            first = 0
        else:
            free = held[first] + window_ms
            to = at + int(np.searchsorted(times[at:], free))
            wait[at:to] = np.maximum(1, -((times[at:to] - free) // 1000))
        at = to
    return allowed, wait, held[first:]


def _live(held: Held, now: int, window_ms: int) -> Held:
    return [t for t in held if t > now - window_ms]


def _key_runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of equal keys of a sorted batch."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    yield from zip(edges, edges[1:])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.RecordBatch]]:
    for batch in batches:
        if batch.num_rows:
            for lo, hi in _key_runs(batch.column("key")):
                yield batch.column("key")[lo].as_py(), batch.slice(lo, hi - lo)


def _times(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("ts_ms").to_numpy()


def _ends(placed: DataFrame, limit: int, window_ms: int, entries: dict[int, Held] | None) -> list[dict]:
    """What each task knows of its first and last key, if its first key starts from ``entries`` (from nothing by default).

    With ``entries`` only those tasks answer. One row per task comes back.
    """
    key = placed.schema["key"]
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", key.dataType), T.StructField("last", key.dataType), *T.StructType.fromDDL("start long, single boolean, held array<long>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if entries is not None and part not in entries:
            return
        held, first, last, start, single = list((entries or {}).get(part, [])), None, None, None, True
        for k, rows in _stretches(batches):
            times = _times(rows)
            if start is None:
                first, last, start = k, k, int(times[0])
            elif k != last:
                last, held, single = k, [], False
            held = admit(times, held, limit, window_ms)[2]
        if start is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "last": last, "start": start, "single": single, "held": held}], schema=arrow)

    return [r.asDict() for r in placed.mapInArrow(run, schema).collect()]


def _chained(placed: DataFrame, groups: dict[int, tuple[int, Held, bool]], limit: int, window_ms: int) -> dict[int, Held]:
    """Entry states of tasks by going through their times alone, in leaps.

    ``groups`` gives each task the number of its chain, the entry state to the first of a
    chain, and whether the chain goes on through it. A task's times travel as one packed
    row; a chain holds one at a time.
    """

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if part in groups:
            held = [_times(b) for b in batches] if groups[part][2] else []
            steps = np.diff(np.concatenate([np.zeros(1, dtype=np.int64), *held]))
            yield pa.RecordBatch.from_pydict({"chain": pa.array([groups[part][0]], pa.int64()), "part": pa.array([part], pa.int32()), "steps": pa.array([zstandard.compress(steps.tobytes(), 1)], pa.binary())})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, held = None, []
        for batch in batches:
            for c, part, steps in zip(*(batch.column(n) for n in ("chain", "part", "steps"))):
                if c.as_py() != chain:
                    chain, held = c.as_py(), groups[part.as_py()][1]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part.as_py()], pa.int32()), "held": pa.array([held], pa.list_(pa.int64()))})
                held = admit(np.cumsum(np.frombuffer(zstandard.decompress(steps.as_py()), dtype=np.int64)), held, limit, window_ms)[2]

    packed = placed.mapInArrow(times, "chain long, part int, steps binary")
    walked = packed.repartition("chain").sortWithinPartitions("chain", "part").mapInArrow(walk, "part int, held array<long>")
    return {r["part"]: list(r["held"]) for r in walked.collect()}


def entry_states(placed: DataFrame, limit: int, window_ms: int, rounds: int = ROUNDS) -> dict[int, Held]:
    """State in which the first key of each task begins; tasks that are not listed begin with nothing.

    Only a key that fills whole tasks passes a guess on. All tasks are first tried from
    nothing; then those whose true entry state differs from the one tried are done again,
    all at once. Traffic with a pause, or light enough for the guess to come true on the
    way, settles in a round or two. What has not settled after ``rounds`` is chained.
    The states come to the driver: one of at most ``limit`` times per task.
    """
    ends = sorted(_ends(placed, limit, window_ms, None), key=lambda e: e["part"])
    tried: dict[int, Held] = {}

    def begun(k: int) -> Held:
        if not k or ends[k - 1]["last"] != ends[k]["first"]:
            return []
        return _live(ends[k - 1]["held"], ends[k]["start"], window_ms)

    def differing() -> list[int]:
        return [k for k, e in enumerate(ends) if e["single"] and begun(k) != tried.get(e["part"], [])]

    for _ in range(rounds):
        if not (again := differing()):
            break
        todo = {ends[k]["part"]: begun(k) for k in again}
        done = {e["part"]: e for e in _ends(placed, limit, window_ms, todo)}
        for k in again:
            ends[k]["held"] = done[ends[k]["part"]]["held"]
        tried |= todo
    states = {e["part"]: begun(k) for k, e in enumerate(ends)}
    open_ends, chain = set(differing()), None
    groups: dict[int, tuple[int, Held, bool]] = {}
    for k, end in enumerate(ends):
        if not (k and ends[k - 1]["single"] and ends[k - 1]["last"] == end["first"]):
            chain = None
        if chain is None and k in open_ends:
            chain = k  # all before it in its key has settled
        if chain is not None:
            groups[end["part"]] = (chain, begun(k), end["single"])
    if groups:
        states |= _chained(placed, groups, limit, window_ms)
    return {part: held for part, held in states.items() if held}


def rate_limit(events: DataFrame, limit: int, window_seconds: int, rounds: int = ROUNDS) -> DataFrame:
    """Admission of every event (key, event_id, ts_ms) in time order.

    Only admitted events count. Retry-after is in whole seconds, at least 1. Events are
    sorted over the cluster by key and time, so a key may own any share of them: each
    task decides a stretch of its events, from the state in which the stretch before it
    ends (``entry_states``). An event without a time is not decided: both columns are null.
    """
    window_ms = window_seconds * 1000
    narrow = events.select("key", "event_id", F.col("ts_ms").cast("long").alias("ts_ms"))
    schema = T.StructType([*narrow.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.IntegerType())])
    arrow = to_arrow_schema(schema)
    order = ["key", "ts_ms", "event_id"]
    timed = narrow.where("ts_ms is not null")
    placed = cut_lineage(timed.repartitionByRange(*order).sortWithinPartitions(*order))
    entries = entry_states(placed, limit, window_ms, rounds)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, begun = list(entries.get(TaskContext.get().partitionId(), [])), None, False
        for key, rows in _stretches(batches):
            if begun and key != now:
                held = []
            now, begun = key, True
            allowed, wait, held = admit(_times(rows), held, limit, window_ms)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(allowed), pa.array(wait)], schema=arrow)

    untimed = narrow.where("ts_ms is null").select("*", F.lit(None).cast("boolean").alias("allowed"), F.lit(None).cast("int").alias("retry_after"))
    return placed.mapInArrow(decide, schema).unionByName(untimed)


class Admission(StatefulProcessor):
    """Admitted times of a key, as list state, and its newest time, as value state.

    The rows of a key in one micro-batch come in frames. A key with one frame is decided
    from it. Of a key with more, only a frame is in memory: frames are put away by time
    slot in map state, and the slots are then taken back in order of time.
    """

    def __init__(self, limit: int, window_ms: int, columns: dict[str, str], expire_idle: bool) -> None:
        self.limit, self.window_ms, self.columns, self.expire_idle = limit, window_ms, columns, expire_idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long")
        self.newest = handle.getValueState("newest", "at long")
        self.waiting = handle.getMapState("waiting", "slot long, frame int", f"event_id array<{self.columns['event_id']}>, ts_ms array<long>")

    def decided(self, key: tuple, ids: np.ndarray, times: np.ndarray, held: Held) -> tuple[pd.DataFrame, Held]:
        order = np.lexsort((ids, times))
        ids, times = ids[order], times[order]
        allowed, wait, held = admit(times, held, self.limit, self.window_ms)
        frame = pd.DataFrame({"event_id": ids, "ts_ms": times, "allowed": allowed, "retry_after": wait})
        frame.insert(0, "key", [key[0]] * len(frame))
        return frame, held

    def put_away(self, frames: Iterator[pd.DataFrame]) -> dict[int, list[int]]:
        slots: dict[int, list[int]] = {}
        for number, frame in enumerate(frames):
            for slot, rows in frame.groupby(frame["ts_ms"] // self.window_ms):
                self.waiting.updateValue((int(slot), number), (rows["event_id"].tolist(), rows["ts_ms"].tolist()))
                slots.setdefault(int(slot), []).append(number)
        return slots

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = iter(rows)
        first, second = next(rows), next(rows, None)
        held = [at for (at,) in self.held.get()]
        newest = self.newest.get()[0] if self.newest.exists() else None
        if second is None:
            frame, held = self.decided(key, first["event_id"].to_numpy(), first["ts_ms"].to_numpy(), held)
            yield frame
            top = int(frame["ts_ms"].iloc[-1])
        else:

            def frames() -> Iterator[pd.DataFrame]:
                yield first
                yield second
                yield from rows

            slots = self.put_away(frames())
            for slot in sorted(slots):
                ids, times = [], []
                for number in slots[slot]:
                    some_ids, some_times = self.waiting.getValue((slot, number))
                    ids += some_ids
                    times += some_times
                    self.waiting.removeKey((slot, number))
                frame, held = self.decided(key, np.array(ids), np.array(times, dtype=np.int64), held)
                yield frame
                top = int(frame["ts_ms"].iloc[-1])
        self.held.put([(int(t),) for t in held])
        self.newest.update((top if newest is None else max(top, newest),))
        if self.expire_idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.window_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, limit: int, window_seconds: int, expire_idle: bool = False) -> DataFrame:
    """The same decision on a stream, for keys of any type.

    Rows of one micro-batch are taken in time order, one micro-batch after another. With
    ``expire_idle`` a timer drops the state of a key that was quiet for a window of
    processing time; leave it off for ``availableNow`` runs, which such timers would keep
    from ending. Needs the RocksDB state store, which ``session.configure`` sets.
    """
    narrow = events.select("key", "event_id", F.col("ts_ms").cast("long").alias("ts_ms")).where("ts_ms is not null")
    columns = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    schema = f"key {columns['key']}, event_id {columns['event_id']}, ts_ms long, allowed boolean, retry_after int"
    processor = Admission(limit, window_seconds * 1000, columns, expire_idle)
    mode = "ProcessingTime" if expire_idle else "None"
    return narrow.groupBy("key").transformWithStateInPandas(processor, schema, "append", mode)


def admission_sink(events: DataFrame, limit: int, window_seconds: int, path: str, checkpoint: str):
    """Start a stream of decisions into Parquet files below ``path``; runs until caught up."""
    decided = rate_limit_stream(events, limit, window_seconds)
    return decided.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
