import random

import numpy as np
import pytest

from shelfmark.llm import ngram_join as J
from shelfmark.llm.links import components
from tests.llm import plain


def run(spark, documents):
    df = spark.createDataFrame([(i, t, 1) for i, t in documents.items()], "doc_id long, text string, n int")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.similar(df).collect()}


def near_documents(seed, bases=8, copies=14):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    documents, n = {}, 0
    for _ in range(bases):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 12, 60, 200]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(text) // 40))):
                text[r.randrange(len(text))] = r.choice(vocabulary).upper()
            if r.random() < 0.2:
                text = text + passage[: r.randint(1, 30)]
            if r.random() < 0.3:
                text = text[r.randint(0, len(text) // 8) :]
            documents[n] = " ".join(text)
            n += 1
    for _ in range(30):
        documents[n] = " ".join([r.choice(vocabulary) for _ in range(r.randint(2, 12))] + passage)
        n += 1
    documents[n], documents[n + 1], documents[n + 2], documents[n + 3] = None, "", " \n ", documents[0].upper()
    return documents


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed, monkeypatch):
    if seed == 2:  # small tiles, groups and parts
        monkeypatch.setattr(J, "TILE", 3)
        monkeypatch.setattr(J, "GROUP", 2)
        monkeypatch.setattr(J, "PARTS", 2)
    documents = near_documents(seed)
    want = plain.near_copies(documents)
    assert len({c for _, c in want.values()}) < len(want) - 20
    assert run(spark, documents) == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A B C D E F G"), (3, None), (4, "x " * 60_000)], "doc_id long, text string")
    got = sorted(tuple(r) for r in J.similar(df).collect())
    assert got == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 1, 4)]
    assert J.similar(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    want = plain.grouped({x for p in links if p[0] != p[1] for x in p}, links)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark):
    from shelfmark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    documents = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op4_ngram_join"](spark, sf).collect()}
    assert got == plain.near_copies(documents)


def test_null_keys_take_no_part(spark):
    from shelfmark.llm import ngram_join

    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text), (5, text), (3, text), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.similar(df).collect()), key=repr)
    assert got == [(3, 3, 3), (5, 3, 3), (None, None, None), (None, None, None)]


def test_columns_of_one_row_are_not_posted(spark):
    """300,000 columns of one row each, which no table of bits tells apart, and two that rows share."""
    draw = np.random.default_rng(5)
    rows = [(k, 5000, draw.integers(-(2**63), 2**63 - 1, 3000).tolist(), [False] * 3000) for k in range(100)]
    rows[3][2][7] = rows[60][2][9] = 11
    rows[4][2][0], rows[4][3][0] = 12, True
    table = spark.createDataFrame(rows, "key long, n long, head array<long>, hot array<boolean>")
    got = sorted(tuple(r) for r in J._postings(table).collect())
    assert got == [(3, 5000, 11, False, 7), (4, 5000, 12, True, 0), (60, 5000, 11, False, 9)]


def test_large_group_of_near_copies_is_linked_before_the_product(spark, monkeypatch):
    """400 copies of a text, each with some of its words changed: what the product is left with."""
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    documents = {}
    for n in range(400):
        text = list(base)
        for at in r.sample(range(150), r.randint(0, 4)):
            text[at] = f"x{r.randrange(10**6)}"
        documents[n] = " ".join(text)
    sent, product = [], J._product
    monkeypatch.setattr(J, "_product", lambda *rest: sent.append(product(*rest).count()) or product(*rest))
    assert run(spark, documents) == plain.near_copies(documents)
    assert sum(sent) < 4 * len(documents)
