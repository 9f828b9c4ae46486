import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfmark.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=20))
def test_plan_uses_every_piece_once(counts):
    made = P.plan(counts, 32)
    used = Counter()
    for lengths, times in made:
        assert sum(lengths) <= 32 and times > 0
        for x in lengths:
            used[x] += times
    assert used == Counter(counts)
    total = sum(k * v for k, v in counts.items())
    assert sum(t for _, t in made) <= 2 * -(-total // 32) + 1
    runs = P.places(made)
    for length, (firsts, _, _) in runs.items():
        assert firsts[0] == 0 and (np.diff(firsts) > 0).all()


def test_exact_complements():
    assert sum(t for _, t in P.plan({20: 10, 12: 10}, 32)) == 10
    assert sum(t for _, t in P.plan({20: 10, 7: 10, 5: 10}, 32)) == 10
    assert sum(t for _, t in P.plan({20: 10, 6: 10, 4: 10, 2: 10}, 32)) == 10
    assert P.plan({}, 32) == []


def expected(rows, limit):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), limit)):
            part = ids[at : at + limit]
            out.append((i, n, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    return sorted(out, key=repr)


def check_packed(rows, limit):
    spans = {}
    for r in rows:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(spans)


ROWS = [(1, "Hello world, it's 42!"), (2, None), (3, ""), (4, "  \n\t "), (5, "a\x1cb \x85 ΣΑΣ İ ﬁ é"), (6, "word " * 5000), (7, "<|endoftext|> x"), (8, "same"), (8, "same"), (9, "日本語 テキスト")]


def test_pieces_equal_the_library(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, piece int")
    got = P.pieces(df, PATH).select("doc_id", "piece", "start", "length", F.crc32("ids"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(ROWS, 2048)
    assert P.pieces(df.limit(0), PATH).count() == 0


def test_pack_hot_length_and_empty(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "if(id % 3 = 0, 1000L, 1 + id % 900) AS length")
    rows = P.pack(df).collect()
    assert len(rows) == 3000
    total = sum(r["length"] for r in rows)
    assert check_packed(rows, 2048) <= 1.03 * total / 2048 + 1
    assert P.pack(df.limit(0)).count() == 0


def test_query(spark):
    from shelfmark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op7_packing"](spark, sf).collect()
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == expected(documents, 2048)
    assert check_packed(rows, 2048) <= -(-sum(r["length"] for r in rows) // 2048) + 3
