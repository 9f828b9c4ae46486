import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import fuzzy_lines as L
from tests.llm import plain


def words(line):
    low = line.translate(plain.LOWER)
    return tuple(plain.WORD.findall(re.sub(r"[!-/:-@\[-`{-~]", " ", re.sub("[0-9]", "0", low))))


def expected(documents, percent=80, least=4):
    """doc_id -> (lines, removed, text) by comparing all pairs of different lines by edit similarity alone.

    Equal lines are one line however short; shorter ones than ``least`` words have no other link.
    """
    first, rows = {}, []
    for i in sorted(documents):
        for j, line in enumerate((documents[i] or "").split("\n")):
            if w := words(line):
                rows.append((i, j, w))
                first.setdefault(w, (i, j))
    nodes = list(first)
    links = [
        (i, j)
        for i in range(len(nodes))
        for j in range(i)
        if min(len(nodes[i]), len(nodes[j])) >= least
        and 100 * abs(len(nodes[i]) - len(nodes[j])) <= (100 - percent) * max(len(nodes[i]), len(nodes[j]))
        and 100 * plain.distance(nodes[i], nodes[j]) <= (100 - percent) * max(len(nodes[i]), len(nodes[j]))
    ]
    group = plain.grouped(range(len(nodes)), links)
    best = {}
    for k, w in enumerate(nodes):
        best[group[k]] = min(best.get(group[k], (2**62, 0)), first[w])
    number = {w: k for k, w in enumerate(nodes)}
    gone = {(i, j) for i, j, w in rows if best[group[number[w]]] != (i, j)}
    out = {}
    for i, text in documents.items():
        parts = [] if text is None else text.split("\n")
        kept = [p for j, p in enumerate(parts) if (i, j) not in gone]
        out[i] = (len(parts), len(parts) - len(kept), None if text is None else "\n".join(kept))
    return out, len(links)


def near_lines(seed, groups=6, copies=12):
    """Documents with lines that differ in a word or two, exact copies, and lines of their own."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice([6, 30, 90, 300]))] for _ in range(groups)]
    documents = {}
    for i in range(groups * copies):
        lines = []
        for _ in range(4):
            line = list(r.choice(bases))
            for _ in range(r.randint(0, 2)):
                line[r.randrange(len(line))] = r.choice(vocabulary)
            lines.append(" ".join(line))
        lines.append(" ".join(r.choice(vocabulary) for _ in range(12)))
        documents[i] = "\n".join(lines)
    return documents


def run(spark, documents, **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in documents.items()], "doc_id long, text string, line string")
    out = L.dedup(df, **more)
    assert out.columns == ["doc_id", "text", "line", "n_lines", "n_removed"]
    return {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in out.collect()}


def test_near_lines(spark):
    documents = near_lines(3)
    want, links = expected(documents)
    assert links > 10
    assert run(spark, documents) == want


def test_crowded_buckets_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(L, "TILE", 4)
    documents = near_lines(5)
    assert run(spark, documents, bucket=3) == expected(documents)[0]


def test_odd_rows(spark):
    documents = {
        1: None, 2: "", 3: "\n\n", 4: "One two three four five.\nshort line\nONE, two; three four five!", 5: "one two three four five",
        6: "ends with a line feed here\n", 7: "ends with a line feed here", 8: "page 12 of 300 in all", 9: "Page 99 of 512 in all", 10: "long " * 30_000,
    }
    assert run(spark, documents) == expected(documents)[0]
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["text"]) for r in L.dedup(df).collect())
    assert got == [(-1, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "")]
    assert L.dedup(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(a=st.lists(st.integers(0, 4), max_size=30), b=st.lists(st.integers(0, 4), max_size=30))
def test_edit_distance(a, b):
    assert L.edit_distance(a, b) == plain.distance(a, b)


def test_simhash_of_long_lines():
    r = np.random.default_rng(1)
    hashes = r.integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    starts, ends = np.array([0, 3, 10, 1200]), np.array([3, 8, 1100, 2000])
    got = L.simhashes(hashes, starts, ends)
    for s, e, g in zip(starts, ends, got):
        want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[s:e]) > e - s)
        assert int(g) == want


def test_query(spark):
    import hashlib

    from shelfmark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    documents = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want, _ = expected(documents)
    for r in QUERIES["op1_fuzzy_lines"](spark, sf).collect():
        n, removed, text = want[r["doc_id"]]
        assert (r["n_lines"], r["n_removed"], r["kept_sha256"]) == (n, removed, hashlib.sha256(text.encode()).hexdigest())


def test_all_lines_of_the_stated_similarity(spark, monkeypatch):
    documents = near_lines(11) | {200 + i: t for i, t in enumerate(["one two three four five", "one two three four", "six six seven six eight six", "six six seven eight six six", "Chapter 1: the sea at night", "Chapter 2: the lake at night"])}
    want, links = expected(documents)
    assert links > 100
    assert run(spark, documents) == want
    monkeypatch.setattr(L, "TILE", 4)
    monkeypatch.setattr(L, "SMALL", 2)
    assert run(spark, documents, bucket=3) == want


def test_short_lines_and_scripts_without_spaces(spark):
    documents = {
        1: "Read more\nread, MORE\nMenu\n\n---", 2: "Read more\nHome\n\n---", 3: "menu\nread less",
        4: "今天天气很好我们去公园散步", 5: "今天天气很好我们去公园跑步", 6: "他说abc明天一定会回来的吧\n你好", 7: "你好\n他說abc明天一定会回来的吧\n日本語",
        8: "สวัสดีครับผมชื่อสมชาย", 9: "สวัสดีครับผมชื่อสมชัย", 10: "안녕하세요반갑습니다여러분", 11: "안녕하세요반갑습니다여러불",
    }
    got = {i: text for i, (_, _, text) in run(spark, documents).items()}
    assert got == {
        1: "Read more\nMenu\n\n---", 2: "Home\n\n---", 3: "read less",
        4: documents[4], 5: "", 6: documents[6], 7: "日本語", 8: documents[8], 9: "", 10: documents[10], 11: documents[11],
    }


def test_unrelated_long_lines_never_meet_word_by_word(spark):
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    documents = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([400, 700, 1200])))) for i in range(30)]
    nodes = L.occurrences(spark.createDataFrame(documents, "doc_id long, text string"), "doc_id", "text", 4, 80).withColumn("component", F.col("h"))
    assert L._near(nodes, False, 80, 4096).count() == 0


def test_long_lines_of_different_widths(spark):
    """Copies of long lines that lose words, so that their sketches have 4, 8, 16 or 64 numbers."""
    r = random.Random(4)
    documents, at = {}, 0
    for n in (200, 460, 910):
        line = [f"{r.choice('abcdefgh')}{r.choice('abcdefgh')}{r.choice('abcdefgh')}" for _ in range(n)]
        for lost in (0, n // 20, n // 8, n // 4):
            gone = set(r.sample(range(n), lost))
            documents[at] = " ".join(w for i, w in enumerate(line) if i not in gone)
            at += 1
    want, links = expected(documents)
    assert 6 <= links < 18
    assert run(spark, documents) == want


@settings(max_examples=200, deadline=None)
@given(a=st.lists(st.integers(0, 900), min_size=185, max_size=215), b=st.lists(st.integers(0, 900), min_size=430, max_size=470))
def test_wide_sketches_fold(a, b):
    """Folded to the narrower width, a sketch is the one that the narrower width would have had."""
    hashes = L.mix(np.array(a + b, dtype=np.uint64))
    starts, ends = np.array([0, len(a)]), np.array([len(a), len(a) + len(b)])
    got = L.wide(hashes, starts, ends)
    assert [len(x) if x else 0 for x in got.to_pylist()] == [64 * (len(a) >= 192), 64 + 64 * (len(b) >= 448)]
    number, table = L.folded(got)[0]
    assert (number == [0 if len(a) >= 192 else -1, 1 if len(a) >= 192 else 0]).all()
    cells = np.bincount(((hashes[len(a):] >> np.uint64(56)) & np.uint64(3) | ((hashes[len(a):] >> np.uint64(50)) & np.uint64(1)) << np.uint64(2)).astype(np.int64) * 64 + (hashes[len(a):] >> np.uint64(58)).astype(np.int64), minlength=512) & 1
    assert (np.packbits(cells.astype(np.uint8), bitorder="little").view(np.uint64) == table[-1]).all()


def test_lines_of_texts():
    texts = ["a\n\nb\n", "", "\n", "xy", "p\nq"]
    data, offsets = np.frombuffer("".join(["zz", *texts]).encode(), dtype=np.uint8), 2 + np.cumsum([0] + [len(t) for t in texts])
    got = [(int(t), int(k), data[a:b].tobytes().decode()) for t, k, a, b in zip(*L.line_ranges(data, offsets))]
    assert got == [(i, k, line) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n"))]
