import json
import random
from collections import defaultdict

import pytest

from shelfmark.llm import chat as C

SCHEMA = {"type": "object", "properties": {"q": {"type": "string"}, "n": {"type": "integer", "minimum": 1}}, "required": ["q"], "additionalProperties": False}


@pytest.mark.parametrize(
    "arguments, fault",
    [
        ('{"q": "x"}', None), ('{"n": 2.0, "q": ""}', None), ('{"n": 0, "q": ""}', "$.n: out of range"), ("{}", "$.q: missing"), ('{"q": 1}', "$.q: not string"),
        ('{"q": "x", "z": 1}', "$.z: unknown"), ("[]", "$: not object"), ("{", "not JSON"), (None, "not JSON"), ('{"q": "x", "n": true}', "$.n: not integer"), ('{"n": NaN, "q": ""}', "not JSON"),
    ],
)
def test_arguments(arguments, fault):
    assert C.checked_arguments(arguments, json.dumps(SCHEMA))[1] == fault


def test_canonical():
    assert C.canonical({"b": [1.0, 2.5, {"z": None, "a": "é\n"}], "a": True}) == '{"a":true,"b":[1,2.5,{"a":"é\\n","z":null}]}'
    assert C.checked_arguments('{ "q" : "x" }', None) == ('{"q":"x"}', "unknown tool")


def tables(spark, messages, calls, results):
    return (
        spark.createDataFrame(messages, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS position", "'x' AS status"),
        spark.createDataFrame(calls, "conv_id long, call_id string, turn long, tool string, arguments string, uses array<string>"),
        spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"),
        spark.createDataFrame([("t", json.dumps(SCHEMA))], "tool string, schema string"),
    )


def test_random_links_are_in_order(spark):
    r = random.Random(8)
    messages, calls, results, uses = [], [], [], {}
    for conv in range(15):
        ids = [f"c{i}" for i in range(10)]
        order = r.sample(ids, 10)
        for turn in range(8):
            messages.append((conv, turn, "user", f"m{turn}"))
        for n, name in enumerate(order):
            used = r.sample(order[:n], min(n, r.choice([0, 0, 1, 2]))) + (["nobody"] if r.random() < 0.1 else [])
            uses[conv, name] = used
            calls.append((conv, name, r.randrange(8), "t", '{"q":"x"}', used))
            if r.random() < 0.8:
                results.append((conv, name, r.randrange(8), f"r{name}"))
    rows = C.link(*tables(spark, messages, calls, results)).collect()
    assert len(rows) == len(messages) + len(calls) + len(results)
    place, end, seen = {}, {}, defaultdict(list)
    for x in rows:
        seen[x["conv_id"]].append(x["position"])
        if x["kind"] == "call":
            place[x["conv_id"], x["call_id"]] = x["position"]
            assert x["status"] == ("ok" if any(y[:2] == (x["conv_id"], x["call_id"]) for y in results) else "no result")
        if x["kind"] == "result":
            end[x["conv_id"], x["call_id"]] = x["position"]
    for conv, positions in seen.items():
        assert sorted(positions) == list(range(len(positions)))
    for key, used in uses.items():
        assert key not in end or end[key] > place[key]
        for other in used:
            if (key[0], other) in place:
                assert place[key] > max(place[key[0], other], end.get((key[0], other), 0))


def test_states(spark):
    messages = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (2, 0, None, None)]
    calls = [
        (1, "a", 1, "t", '{"q":"x"}', []), (1, "a", 2, "t", '{"q":"y"}', []), (1, "b", 1, "u", "{}", None), (1, "c", 1, "t", '{"q":"x"}', ["d"]), (1, "d", 1, "t", '{"q":"x"}', ["c"]),
        (1, "e", 1, "t", None, ["e"]), (1, None, 3, "t", '{"q":"x"}', []), (None, "a", 3, "t", '{"q":"x"}', []), (1, "f", 4, "t", '{"q":"x"}', ["a"]),
    ]
    results = [(1, "a", 5, "one"), (1, "a", 6, "two"), (1, "zzz", 1, None), (None, "a", 1, "w"), (1, "f", 0, "early")]
    rows = C.link(*tables(spark, messages, calls, results)).collect()
    found = sorted((x["kind"], x["conv_id"] or -1, x["call_id"] or "", x["status"]) for x in rows)
    assert found == sorted(
        [("message", 1, "", "ok"), ("message", 1, "", "ok"), ("message", 2, "", "ok")]
        + [("call", 1, "a", "ok"), ("call", 1, "a", "duplicate"), ("call", 1, "b", "unknown tool"), ("call", 1, "c", "unordered"), ("call", 1, "d", "unordered"), ("call", 1, "e", "unordered")]
        + [("call", 1, "", "no identifier"), ("call", -1, "a", "no identifier"), ("call", 1, "f", "ok")]
        + [("result", 1, "a", "ok"), ("result", 1, "a", "duplicate"), ("result", 1, "zzz", "no call"), ("result", -1, "a", "no call"), ("result", 1, "f", "ok")]
    )
    at = {(x["kind"], x["call_id"], x["status"]): x for x in rows if x["conv_id"] == 1}
    assert at["call", "f", "ok"]["turn"] == 5 and at["call", "f", "ok"]["position"] > at["result", "a", "ok"]["position"]
    assert at["result", "f", "ok"]["position"] > at["call", "f", "ok"]["position"]
    assert json.loads(at["call", "a", "ok"]["json"])["tool_calls"][0]["function"] == {"name": "t", "arguments": '{"q":"x"}'}


def test_long_chain_and_empty(spark):
    calls = [(1, f"c{i}", 0, "t", '{"q":"x"}', [f"c{i - 1}"] if i else []) for i in range(20)]
    out = C.link(*tables(spark, [], calls, []))
    rows = sorted(out.collect(), key=lambda x: x["position"])
    assert [x["call_id"] for x in rows] == [f"c{i}" for i in range(20)]
    assert C.link(*tables(spark, [], [], [])).count() == 0


def test_query(spark):
    from shelfmark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    rows = QUERIES["op8_chat"](spark, sf).collect()
    speech = {(r["conv_id"], r["turn"]): r for r in turns}
    assert sum(x["kind"] == "message" for x in rows) == len(turns)
    for x in rows:
        body = json.loads(x["json"])
        assert x["json"] == C.canonical(body)
        if x["kind"] == "message":
            assert body == {"role": speech[x["conv_id"], x["turn"]]["role"], "content": speech[x["conv_id"], x["turn"]]["text"]}
        elif x["kind"] == "result":
            conv, turn = map(int, x["call_id"].removeprefix("call-").split("-"))
            assert body["content"] == speech[conv, turn + 1]["text"]
            assert x["status"] == ("ok" if speech[conv, turn]["role"] == "assistant" else "no call")
        else:
            conv, turn = map(int, x["call_id"].removeprefix("call-").split("-"))
            limit, kind = (turn * 3 + conv) % 8, (conv + turn) % 5
            answered = (conv, turn + 1) in speech and speech[conv, turn + 1]["role"] == "user"
            text = speech[conv, turn]["text"]
            if conv % 17 == 3:
                want = "not JSON"
            elif kind == 4:
                want = "unknown tool"
            elif kind < 2 and not 1 <= limit <= 5:
                want = "$.limit: out of range"
            else:
                want = "ok" if answered else "no result"
            assert x["status"] == want, (x, text)
