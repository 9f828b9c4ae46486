import random
import re
import zlib
from hashlib import sha256

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import conversation_repair as C

SF = "/root/testdata/sf0.01"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
ROLE = {2: "user", 3: "assistant"}


def plain(items, start=0, goals=(0, 3)):
    """Least (cost, audit, states) by going through all rows with all states; states as in the operator."""
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    other = {0: 2, 1: 2, 2: 3, 3: 2}

    def put_in(ways):
        for _ in range(3):
            for q, (c, a) in list(ways.items()):
                ways[other[q]] = min(ways.get(other[q], (1 << 60, "")), (c + 3, a + "I"))
        return ways

    ways = put_in({start: (0, "")})
    for item in items:
        new = {}
        for q, (c, a) in ways.items():
            if isinstance(item, int):
                moves = [(q, 4 * item, "D" * item)]
            else:
                initial, cut = item
                moves = [(q, 4, "D"), (other[q], 3 + 3 * cut, "R")] + [(to, 3 * cut, "K") for to in [kept.get((q, initial))] if to is not None]
            for to, cost, e in moves:
                new[to] = min(new.get(to, (1 << 60, "")), (c + cost, a + e))
        ways = put_in(new)
    return min((ways[q] for q in goals if q in ways), default=None)


def expected(rows):
    """Result rows from one pass over each conversation."""
    hurt, out = {}, []
    for conv, turn, role, text in rows:
        mine = hurt.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, mine in hurt.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, items, counts = set(), [], [0, 0, 0]
        for _, role, text in mine:
            body = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            items.append(1 if fault in (0, 1) else (role[:1], fault == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = plain(items)
        lines, last, todo = [], None, iter(mine)
        for e in audit:
            row = None if e == "I" else next(todo)
            if e != "D":
                role = row[1] if e == "K" else "assistant" if last == "u" else "user"
                lines.append(f"{role}:{'' if row is None else row[2]}")
                last = role[:1]
        out.append((conv, gaps, *counts, illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


items = st.lists(st.one_of(st.integers(1, 3), st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.booleans())), max_size=9)


@settings(max_examples=400, deadline=None)
@given(items, st.sampled_from(C.STATES), st.sampled_from([C.FINAL, (0,), (1,), (2,), (3,)]))
def test_both_ends_find_the_least_audit(sequence, start, goals):
    assert C.cheapest(tuple(sequence), start, goals) == plain(sequence, start, goals)


def made(seed):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "so on", "", " \t\n", "x" * 3000 + ".", "Yes. ", "a ", "…", "é.\x0b"]
    rows = []
    for conv in range(60):
        for turn in range(r.randrange(1, 12)):
            role = r.choice(["system"] if turn == 0 and conv % 3 == 0 else ["user", "assistant"] if conv % 2 else ["user", "assistant", "tool", "", None, "admin"])
            rows.append((conv, None if r.random() < 0.05 else turn + 3 * (r.random() < 0.1), role, r.choice(texts) if r.random() < 0.5 else f"text {conv} {turn}" + r.choice([".", "", "?"])))
    rows += [(None, t, "user" if t % 2 else "assistant", f"none {t}.") for t in range(5)] + [(None, None, None, None)] * 3
    rows += [(99, 1, "user", "again.")] * 40 + [(98, t, "user", "same text.") for t in range(50)]
    return rows + [(97, t, ["user", "assistant"][t % 2] if t % 17 else "user", f"turn {t}" + "." * (t % 13 > 0)) for t in range(400)] + [(96, None, "user", f"{t:04d}") for t in range(30)]


def found(rows, **options):
    hurt = C.damaged(rows)
    return sorted((tuple(r) for r in C.repaired_digest(hurt, **options).select(*COLUMNS).collect()), key=repr)


def test_all_conversations(spark):
    rows = made(5)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part long, verdict string").repartition(3)
    want = expected(rows)
    assert found(df) == want
    assert found(df, part_rows=3) == want


def test_turns_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "tool", "42.")], "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    verdicts, turns = C.repair(df.withColumn("copies", F.lit(1).cast("long")))
    assert verdicts.first()["audit"] == "KRR"
    assert [tuple(r) for r in turns.orderBy("part", "place").select("role", "text", "edit").collect()] == [("system", "Be kind.", "K"), ("user", "Hello.", "R"), ("assistant", "42.", "R")]
    assert found(df.limit(0)) == []


def test_query(spark):
    from shelfmark.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = sorted((tuple(r) for r in QUERIES["op13_conversation_repair"](spark, SF).select(*COLUMNS).collect()), key=repr)
    assert got == sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op13_conversation_repair']})").fetchall(), key=repr)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == expected(rows)
