import zlib

import numpy as np
import pyarrow as pa

from shelfmark.llm import quality_classifier as Q
from shelfmark.llm.words import blocks


def test_gradients():
    r = np.random.default_rng(1)
    x, first, label = r.standard_normal((9, Q.INPUT)), np.array([0, 1, 4, 9]), np.array([1.0, 0.0, 1.0])
    model = Q.start()

    def loss(m):
        p, _ = Q.forward(m, x, first)
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean()

    for i, (w, g) in enumerate(zip(model, Q.gradients(model, x, first, label))):
        at = np.unravel_index(r.integers(w.size), w.shape)
        change = np.zeros_like(w)
        change[at] = 1e-5
        up, down = list(model), list(model)
        up[i], down[i] = w + change, w - change
        assert abs((loss(Q.Model(*up)) - loss(Q.Model(*down))) / 2e-5 - g[at]) < 1e-6


def test_passages_do_not_depend_on_neighbours():
    texts = ["", "one", " \n", "a word or two " * 100, "é " * 65, "x" * 5000, "tail"]
    matrix = Q.projection()
    block = next(blocks(pa.array(texts)))
    x, first = Q.encode(block, matrix)
    assert np.diff(first).tolist() == [1, 1, 1, 7, 2, 1, 1]
    for i, text in enumerate(texts):
        alone, _ = Q.encode(next(blocks(pa.array([text]))), matrix)
        assert np.abs(alone - x[first[i] : first[i + 1]]).max() < 1e-6


def test_short_last_passage():
    text = "w " * 64 + "x"
    matrix = Q.projection()
    alone, first = Q.encode(next(blocks(pa.array([text]))), matrix)
    beside, _ = Q.encode(next(blocks(pa.array([text, "yz"]))), matrix)
    assert first.tolist() == [0, 2] and np.abs(alone - beside[:2]).max() < 1e-6


def test_score_table(spark):
    rows = [(1, "good plain words here", 9.0), (1, "good plain words here", 9.0), (2, None, 1.0), (3, "", 1.0), (4, " \t\n", 1.0), (5, "long " * 80_000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = sorted((r["doc_id"], r["score"]) for r in Q.score(df, Q.start()).collect())
    assert got[0] == got[1] and got[2][1] == got[3][1] == got[4][1]
    assert all(0 <= s <= 1 for _, s in got)
    assert Q.score(df.limit(0), Q.start()).count() == 0


def test_fit_without_labels_or_with_one(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    ones = spark.createDataFrame([(i, 1) for i in range(5)] + [(None, 0), (3, None), (3, 7)], "doc_id long, label int")
    assert {r["score"] for r in Q.score(docs, Q.fit(docs, none)).collect()} == {0.5}
    assert {r["score"] for r in Q.score(docs, Q.fit(docs, ones)).collect()} == {0.99}


def test_fit_sees_every_document_and_passage(spark):
    def fitted(texts, labels):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return Q.packed(Q.fit(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, label int"), steps=3))

    many, labels = [f"text {i}" for i in range(4100)], [i % 2 for i in range(4100)]
    hashes = {r["id"]: r["h"] for r in spark.range(4100).selectExpr("id", "xxhash64(id) AS h").collect()}
    last = max(hashes, key=hashes.get)
    turned = [1 - x if i == last else x for i, x in enumerate(labels)]
    assert np.abs(fitted(many, labels) - fitted(many, turned)).max() > 0
    words = ["plain"] * 64 * 200
    odd = words[:64] + ["#$%&"] * 64 + words[128:]  # the second of 200 passages
    assert np.abs(fitted([" ".join(words), "x y"], [1, 0]) - fitted([" ".join(odd), "x y"], [1, 0])).max() > 0


def test_search_finds_the_least_value():
    seen = []

    def valley(at):
        seen.append(at)
        x, y = at
        return (1 - x) ** 2 + 100 * (y - x * x) ** 2, np.array([-2 * (1 - x) - 400 * x * (y - x * x), 200 * (y - x * x)])

    assert np.abs(Q.search(valley, np.array([-1.2, 1.0]), 100) - 1).max() < 1e-4 and len(seen) <= 100


def test_query_on_held_out_rows(spark):
    from shelfmark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op10_quality_classifier"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert r["predicted"] == (r["score"] >= 0.5)
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    right = sum(got[r["doc_id"]]["predicted"] == r["quality"] for r in labels)
    assert len(labels) > 80 and right >= 0.95 * len(labels)
