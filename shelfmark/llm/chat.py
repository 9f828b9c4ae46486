"""Chat formatting: tool-call linking (operator 8).

Calls and results are tables of their own. They are joined by hash on (conversation,
identifier), put in an order in which every call comes after the calls whose results it
uses, their arguments are checked against the schema of their tool, and every message,
call and result becomes one row with one canonical JSON text. Rows of one conversation
are never collected: a conversation is its rows in the order of ``position``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.scratch import written

#: The wave of calls that cannot be ordered; it comes after all others.
LAST = 2**31 - 2
#: Rounds of ordering after which the placed calls are written anew as one table.
REWRITE = 16
#: Numbering deals the rows of a conversation into parts by turn, so many turns to a part.
TURNS = 1000


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, and characters as they are. Whole floats are written as integers."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("not a JSON number")
            return int(x) if x == int(x) and abs(x) < 2**53 else x
        return x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _has_type(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or value == int(value))
    return kind in _TYPES and isinstance(value, _TYPES[kind])


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """Where ``value`` breaks ``schema``: type, enum, const, bounds, required, properties, additionalProperties, items."""
    out = []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_has_type(value, k) for k in kinds):
        return [f"{path}: not {'/'.join(kinds)}"]
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        out.append(f"{path}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{path}: not const")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            out.append(f"{path}: out of range")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
        out.append(f"{path}: length")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{path}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            out += violations(item, schema["items"], f"{path}[{i}]")
    return out


def checked_arguments(arguments: str | None, schema: str | None) -> tuple[str | None, str | None]:
    """(canonical arguments, fault) of a call; ``schema`` is null for an unknown tool."""
    try:
        value = json.loads(arguments or "")
        text = canonical(value)
    except (ValueError, RecursionError):
        return arguments, "not JSON"
    if schema is None:
        return text, "unknown tool"
    found = violations(value, json.loads(schema))
    return text, "; ".join(found) or None


def _checked(calls: DataFrame) -> DataFrame:
    """``calls`` with ``arguments`` in canonical form and ``fault``."""
    kind = "struct<arguments: string, fault: string>"
    check = F.udf(lambda a, s: checked_arguments(a, s), kind, useArrow=True)
    return calls.withColumn("__c", check("arguments", "schema")).withColumn("arguments", F.col("__c.arguments")).withColumn("fault", F.col("__c.fault")).drop("__c", "schema")


def ordered(calls: DataFrame) -> DataFrame:
    """``calls`` (conv_id, call_id, turn, ready, uses) with ``wave``, ``at`` and ``done``; identifiers are unique.

    ``ready`` is the turn of the call's result, or null. ``wave`` is 0, or one more than
    the largest of the calls it uses; ``at`` is the turn at which the call can be made, its
    own or the latest ``done`` of those; ``done`` is the later of ``at`` and ``ready``. So
    (turn, wave) order puts every call after the results that it uses. Each round places
    the calls all of whose used calls are placed; only calls that use others take part.
    What is never placed (a cycle) has nulls; a used call that is unknown is not waited for.
    """
    keys = ["conv_id", "call_id"]
    needs = calls.select(*keys, F.explode("uses").alias("used")).distinct()
    known = calls.select("conv_id", F.col("call_id").alias("used"))
    edges = written(needs.join(known, ["conv_id", "used"]), "edges")
    turns = calls.select(*keys, "turn", "ready")
    start = turns.join(edges.select(*keys).distinct(), keys, "left_anti")
    done = lambda at: F.greatest(at, "ready").alias("done")
    total = written(start.select(*keys, F.lit(0).alias("wave"), F.col("turn").alias("at"), done(F.col("turn"))), "waves")
    wave = 0
    while not edges.isEmpty():
        wave += 1
        placed = total.select("conv_id", F.col("call_id").alias("used"), F.col("done").alias("used_done"))
        joined = edges.join(placed, ["conv_id", "used"], "left")
        free = joined.groupBy(*keys).agg(F.max("used_done").alias("after"), F.count(F.when(F.col("used_done").isNull(), 1)).alias("missing")).where("missing = 0")
        moved = free.join(turns, keys).withColumn("at", F.greatest("turn", "after"))
        fresh = written(moved.select(*keys, F.lit(wave).alias("wave"), "at", done(F.col("at"))), "waves")
        if fresh.isEmpty():
            break
        total = total.union(fresh) if wave % REWRITE else written(total.union(fresh), "waves")
        edges = written(edges.join(fresh.select(*keys), keys, "left_anti"), "edges")
    return calls.join(total, keys, "left")


def link(messages: DataFrame, calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """(conv_id, position, turn, kind, call_id, status, json): one row per message, call and result.

    * ``messages``: conv_id, turn, role, text
    * ``calls``: conv_id, call_id, turn, tool, arguments (JSON text), uses (array of call ids)
    * ``results``: conv_id, call_id, turn, content
    * ``tools``: tool, schema (JSON text); a tool listed twice has its least text

    In a turn the message comes first, then the calls that use no others, their results,
    the calls that use those, and so on. A call that uses the result of a later turn moves
    to that turn; a result never comes before its call. Position counts from 0. A call is
    ``ok``, ``no result``, ``duplicate`` (of an identifier the earliest call counts, by
    turn, tool and arguments), ``no identifier``, ``unordered`` (in a cycle), or the fault
    of its arguments; a result is ``ok``, ``duplicate``, or ``no call``; a message is
    ``ok``. Arguments that are not JSON stay as they are. Repeated rows are kept. Null
    texts count as empty, a null conversation or identifier links with nothing, other
    columns are not carried. Empty tables give no rows.
    """
    keys = ["conv_id", "call_id"]
    calls = calls.select("conv_id", "call_id", "turn", "tool", F.coalesce("arguments", F.lit("")).alias("arguments"), F.coalesce("uses", F.array().cast("array<string>")).alias("uses"))
    results = results.select("conv_id", "call_id", "turn", F.coalesce("content", F.lit("")).alias("content"))
    lone = F.col("conv_id").isNull() | F.col("call_id").isNull()
    first = lambda *by: Window.partitionBy(*keys).orderBy("turn", *by)
    numbered = calls.where(~lone).withColumn("n", F.row_number().over(first("tool", "arguments"))).union(calls.where(lone).withColumn("n", F.lit(1)))
    schemas = tools.where("schema is not null").groupBy("tool").agg(F.min("schema").alias("schema"))
    judged = _checked(numbered.join(schemas, "tool", "left"))
    answers = results.where(~lone).withColumn("n", F.row_number().over(first("content"))).union(results.where(lone).withColumn("n", F.lit(0)))
    answered = answers.where(~lone & (F.col("n") == 1)).select(*keys, F.col("turn").alias("ready"))
    main = judged.where(~lone & (F.col("n") == 1)).join(answered, keys, "left")
    status = F.when(F.col("wave").isNull(), "unordered").when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("ready").isNull(), "no result").otherwise("ok")
    linked = written(ordered(main).drop("uses").withColumn("status", status), "calls")
    extra = judged.where(lone | (F.col("n") > 1)).drop("uses").withColumn("status", F.when(lone, "no identifier").otherwise("duplicate"))
    call_rows = linked.unionByName(extra, allowMissingColumns=True).select(
        "conv_id", F.coalesce("at", "turn").alias("turn"), F.coalesce("wave", F.lit(LAST)).alias("wave"), F.lit(1).alias("rank"), F.lit("call").alias("kind"), "call_id", "status",
        F.col("tool").alias("a"), F.col("arguments").alias("b"),
    )
    placed = linked.select(*keys, F.coalesce("at", "turn").alias("call_turn"), F.coalesce("wave", F.lit(LAST)).alias("wave"))
    result_rows = answers.join(placed, keys, "left").select(
        "conv_id", F.greatest("turn", "call_turn").alias("turn"), F.coalesce("wave", F.lit(LAST + 1)).alias("wave"), F.lit(2).alias("rank"), F.lit("result").alias("kind"), "call_id",
        F.when(F.col("call_turn").isNull(), "no call").when(F.col("n") > 1, "duplicate").otherwise("ok").alias("status"),
        F.lit(None).cast("string").alias("a"), F.col("content").alias("b"),
    )
    message_rows = messages.select(
        "conv_id", "turn", F.lit(-1).alias("wave"), F.lit(0).alias("rank"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("ok").alias("status"),
        F.col("role").alias("a"), F.coalesce("text", F.lit("")).alias("b"),
    )
    rows = message_rows.unionByName(call_rows).unionByName(result_rows)
    return _positions(rows).mapInArrow(_serialise, "conv_id long, position long, turn long, kind string, call_id string, status string, json string")


def _positions(rows: DataFrame) -> DataFrame:
    """``rows`` with ``position``; a conversation with very many turns is numbered in parts."""
    cut = rows.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long")).withColumn("part", F.floor(F.col("turn") / TURNS))
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "wave", "rank", "kind", "call_id", "status", "a", "b")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = cut.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    same = F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & F.col("x.part").eqNullSafe(F.col("y.part"))
    joined = cut.withColumn("at", F.row_number().over(inside) - 1).alias("x").join(heads.alias("y"), same)
    return joined.select("x.conv_id", (F.col("y.before") + F.col("x.at")).cast("long").alias("position"), "x.turn", "x.kind", "x.call_id", "x.status", "x.a", "x.b")


def _serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Canonical JSON of each row from its two texts."""
    for batch in batches:
        out = []
        for kind, call_id, a, b in zip(*(batch.column(c).to_pylist() for c in ("kind", "call_id", "a", "b"))):
            if kind == "message":
                out.append(canonical({"role": a, "content": b}))
            elif kind == "result":
                out.append(canonical({"role": "tool", "tool_call_id": call_id, "content": b}))
            else:
                function = {"name": a, "arguments": b}
                out.append(canonical({"role": "assistant", "tool_calls": [{"id": call_id, "type": "function", "function": function}]}))
        columns = [batch.column(c) for c in ("conv_id", "position", "turn", "kind", "call_id", "status")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string())], ["conv_id", "position", "turn", "kind", "call_id", "status", "json"])
