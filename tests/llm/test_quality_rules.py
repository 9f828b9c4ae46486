import math
import re
from collections import Counter

import numpy as np

from shelfmark.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
    seen, repeats = set(), 0
    for line in (text or "").split("\n"):
        repeats += bool(line in seen and WORD.search(line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(covered)


ROWS = [
    (1, "a b c d e f a b c d e g h\nx\nx\n\n\nx ## $|"), (2, None), (3, ""), (4, " \n\t \x0b"), (5, "é ü 日本 <b>" * 900), (6, "one\x1ctwo three\x85four five"),
    (7, "w " * 40_000), (7, "w " * 40_000), (8, "Plain words that say something new each time they are read aloud."),
]


def test_counts(spark):
    df = spark.createDataFrame([(i, t, 0.5) for i, t in ROWS], "doc_id long, text string, score double")
    got = sorted(tuple(r) for r in Q.judge(df, np.zeros(Q.CELLS)).select("doc_id", *Q.COUNTS, "base_failed").collect())
    want = []
    for i, t in ROWS:
        counts = base(t)
        want.append((i, *counts, counts[0] < 10 or 100 * counts[4] > 20 * counts[0]))
    assert got == sorted(want)
    assert Q.judge(df.limit(0), np.zeros(Q.CELLS)).count() == 0


def test_ratio(spark):
    good = [(i, f"the river runs past stones number {i} and on") for i in range(30)]
    bad = [(100 + i, f"### $$$ %%% |{i}| &&& *** <<>> ||| ###") for i in range(30)]
    target = spark.createDataFrame(good, "doc_id long, text string")
    raw = spark.createDataFrame(good + bad, "doc_id long, text string")
    ratios = Q.fit(target, raw)
    counts = [Counter(), Counter()]
    for side, rows in zip(counts, (good, good + bad)):
        for _, text in rows:
            side.update(Q.cells(np.frombuffer(text.encode(), dtype=np.uint8)).tolist())
    total = [sum(c.values()) + Q.CELLS for c in counts]
    scores = {r["doc_id"]: r["score"] for r in Q.judge(raw, ratios).collect()}
    for i, text in good + bad:
        cells = Q.cells(np.frombuffer(text.encode(), dtype=np.uint8)).tolist()
        want = sum(math.log((counts[0][c] + 1) / total[0]) - math.log((counts[1][c] + 1) / total[1]) for c in cells) / len(cells)
        assert abs(scores[i] - want) < 1e-8
    assert min(scores[i] for i, _ in good) > max(scores[i] for i, _ in bad)
    assert not Q.fit(target.limit(0), raw.limit(0)).any()


def test_query(spark):
    from shelfmark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op6_quality_rules"](spark, sf)
    got = {r["doc_id"]: r for r in rows.collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(texts)
    for row in texts:
        assert tuple(got[row["doc_id"]][c] for c in Q.COUNTS) == base(row["text"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [got[i] for i, q in labels.items() if q and not got[i]["base_failed"]]
    junk = [got[i] for i, q in labels.items() if not q]
    assert all(r["kept"] for r in clean)
    assert sum(r["kept"] for r in junk) <= 0.05 * len(junk)
