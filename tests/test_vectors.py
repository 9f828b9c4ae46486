import numpy as np
import pytest

from shelfmark.operators import vectors as V


def corpus(spark, n=300, dim=6, kbs=3):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(n // 3, dim))
    rows = [(f"c{i:04d}", i, int(i % kbs) if i % 2 else 0, [float(x) for x in base[i % len(base)]]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "chunk_id string, document_id long, kb_id long, embedding array<float>")


def expected_dense(rows, query, scope, k):
    def cosine(a, b):
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        return round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 6)

    out = []
    for kb in scope:
        scored = sorted(((-cosine(r[3], query), r[0]) for r in rows if r[2] == kb))[:k]
        out += [(kb, c, -s, n + 1) for n, (s, c) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("max_block", [512, 2])
def test_dense_search_is_exact_on_both_paths(spark, max_block):
    """One block of queries, and the grid that is used for more queries."""
    rows, index = corpus(spark)
    queries = [(q, [0, 2] if q % 2 else [0, 1, 2], rows[q * 7][3]) for q in range(9)]
    asked = spark.createDataFrame(queries, "qid long, kb_ids array<long>, embedding array<float>")
    got = V.dense_search(index, asked, 10, max_block=max_block).collect()
    for q, scope, vector in queries:
        mine = sorted((r["kb_id"], r["chunk_id"], r["score"], r["kb_rank"]) for r in got if r["qid"] == q)
        assert mine == expected_dense(rows, vector, scope, 10)


@pytest.mark.parametrize("max_block", [512, 2])
def test_sparse_search_is_exact_on_both_paths(spark, max_block):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 30))) for _ in range(200)]
    rows = [(f"c{i:03d}", i, i % 2, t) for i, t in enumerate(texts)]
    index = V.sparse_vectors(spark.createDataFrame(rows, "chunk_id string, document_id long, kb_id long, content string"))
    asked = [(q, [0, 1], t) for q, t in enumerate(["w1 w2 w2", "w3", "nothing", "w5 w6 w7 w39 w1"])]
    queries = V.sparse_vectors(spark.createDataFrame(asked, "qid long, kb_ids array<long>, content string"))
    got = V.sparse_search(index, queries, 8, max_block=max_block).collect()
    for q, scope, text in asked:
        for kb in scope:
            scored = []
            for c, _, k, t in rows:
                score = sum(text.split().count(w) * t.split().count(w) for w in set(text.split()))
                if k == kb and score > 0:
                    scored.append((-score, c))
            want = [(c, -float(s)) for s, c in sorted(scored)[:8]]
            mine = sorted((r for r in got if r["qid"] == q and r["kb_id"] == kb), key=lambda r: r["kb_rank"])
            assert [(r["chunk_id"], r["score"]) for r in mine] == want


@pytest.mark.parametrize("kind", ["dense", "sparse"])
def test_queries_of_several_groups_and_open_scopes(spark, kind):
    """Queries that do not fit into one scan, with and without a list of KBs."""
    rows, index = corpus(spark, 240)
    asked = [(q, None if q % 3 == 0 else [0, 2], rows[q][3]) for q in range(40)]
    queries = spark.createDataFrame(asked, "qid long, kb_ids array<long>, embedding array<float>")
    if kind == "sparse":
        counts = lambda df: df.withColumn("sparse", V.F.struct(V.F.array(*[V.F.lit(i) for i in range(6)]).cast("array<bigint>").alias("indices"), V.F.transform("embedding", lambda x: V.F.ceil(V.F.abs(x)).cast("double")).alias("values")))
        index, queries = counts(index), counts(queries)
    run = V.dense_search if kind == "dense" else V.sparse_search
    one = sorted(tuple(r) for r in run(index, queries, 5).collect())
    assert sorted(tuple(r) for r in run(index, queries, 5, group_values=60, max_block=3).collect()) == one
    if kind == "dense":
        for q, scope, vector in asked:
            mine = sorted((r[1], r[2], r[4], r[5]) for r in one if r[0] == q)
            assert mine == expected_dense(rows, vector, scope or [0, 1, 2], 5)


def test_many_sparse_queries_with_common_indices_stay_bounded(spark, monkeypatch):
    """3,000 queries that share indices with each other and with every row equal brute force; every step is bounded."""
    rng = np.random.default_rng(9)

    def vector():
        rare = rng.choice(np.arange(10, 2000), size=6, replace=False)
        indices = np.sort(np.concatenate(([0, 1, 2], rare)))
        return {"indices": [int(i) for i in indices], "values": [float(v) for v in rng.integers(1, 5, size=9)]}

    vectors, rows = [vector() for _ in range(3000)], [(f"c{i:03d}", i, i % 2, vector()) for i in range(300)]
    monkeypatch.setattr(V, "PAIRS_PER_STEP", 2000)
    monkeypatch.setattr(V, "CELLS_PER_STEP", 60_000)
    block = V._SparseBlock(vectors[:1024], "sparse")
    assert sorted(block.known[block.column >= 0]) == [0, 1, 2]
    schema = "chunk_id string, document_id long, kb_id long, sparse struct<indices: array<long>, values: array<double>>"
    index = spark.createDataFrame(rows, schema)
    batch = index.toArrow().combine_chunks().to_batches()[0]
    steps = list(block.steps(batch))
    assert sum(s.num_rows for s in steps) == 300
    for step in steps:
        row, at, _ = block._hits(step)
        assert step.num_rows * block.n <= 60_000 and (step.num_rows == 1 or block.width[at].sum() <= 2000)
    queries = spark.createDataFrame([(q, [0, 1], v) for q, v in enumerate(vectors)], "qid long, kb_ids array<long>, sparse struct<indices: array<long>, values: array<double>>")
    got = {(r["qid"], r["kb_id"], r["kb_rank"]): (r["chunk_id"], r["score"]) for r in V.sparse_search(index, queries, 3).collect()}
    dense = lambda v: np.bincount(v["indices"], v["values"], 2000)
    scores = np.array([dense(r[3]) for r in rows]) @ np.array([dense(v) for v in vectors]).T
    for q in range(3000):
        for kb in (0, 1):
            want = sorted((-scores[i, q], rows[i][0]) for i in range(300) if i % 2 == kb)[:3]
            assert [got[q, kb, n + 1] for n in range(3)] == [(c, -s) for s, c in want]


def test_cells_find_nearly_all_neighbours(spark):
    """Recall at the default number of probes, and all hits when every cell is looked at."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    points = centres[rng.integers(60, size=8000)] + 0.4 * rng.normal(size=(8000, 16))
    rows = [(f"c{i:05d}", i, i % 2, [float(x) for x in p]) for i, p in enumerate(points)]
    index = spark.createDataFrame(rows + [("none", -1, 0, None)], "chunk_id string, document_id long, kb_id long, embedding array<float>").repartition(4)
    queries = spark.createDataFrame([(q, None, rows[q * 37][3]) for q in range(100)], "qid long, kb_ids array<long>, embedding array<float>")
    exact = V.dense_search(index, queries, 10)
    cells = V.build_cells(index, 64)
    assert cells.table.where("embedding is not null").groupBy("__cell").count().count() > 50
    found = V.dense_search(index, queries, 10, cells=cells, probes=8)
    assert V.recall(found, exact) >= 0.95
    every = V.dense_search(index, queries, 10, cells=cells, probes=64)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    assert V.build_cells(index.limit(0), 4).table.count() == 0


def test_running_best_survives_many_batches(spark):
    """A small Arrow batch size makes the stream prune across batches."""
    rows, index = corpus(spark, 900)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        query = [(0, [0, 1, 2], rows[5][3])]
        asked = spark.createDataFrame(query, "qid long, kb_ids array<long>, embedding array<float>")
        got = V.dense_search(index.repartition(3), asked, 7).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    mine = sorted((r["kb_id"], r["chunk_id"], r["score"], r["kb_rank"]) for r in got)
    assert mine == expected_dense(rows, query[0][2], [0, 1, 2], 7)


def test_postings(spark):
    df = V.sparse_vectors(spark.createDataFrame([("a", "x y x")], "chunk_id string, content string"))
    assert sorted(r["val"] for r in V.postings(df, ["chunk_id"]).collect()) == [1.0, 2.0]


def test_embedding_retries_in_halves():
    calls = []

    def model(batch):
        calls.append([len(t) for t in batch])
        if sum(map(len, batch)) > 2500:
            raise V.EmbeddingTimeout
        return [[float(len(t))] for t in batch]

    texts = ["a" * 10, "b" * 3000, "c" * 20]
    assert V.embed_texts(texts, model, 4) == [[10.0], [1500.0], [20.0]]
    assert [3000] in calls

    def slow(batch):
        raise V.EmbeddingTimeout

    with pytest.raises(RuntimeError, match="timed out"):
        V.embed_texts(["x" * 4000], slow, 4)
    with pytest.raises(RuntimeError, match="expected 2"):
        V.embed_texts(["x", "y"], lambda b: [[1.0]], 4)


def test_embed_keeps_order_and_bounds_input(spark):
    def load():
        return lambda batch: [[float(len(t))] for t in batch]

    df = spark.createDataFrame([(i, "x" * i) for i in (1, 5, 9, 30)], "i int, content string")
    got = {r["i"]: r["embedding"] for r in V.embed(df, load, batch_size=2, max_chars=8).collect()}
    assert got == {1: [1.0], 5: [5.0], 9: [8.0], 30: [8.0]}


def test_visual_asset_keys_are_distinct_and_ordered(spark):
    rows = [(1, "c", 7, "a2", 2), (1, "c", 7, "a1", 5), (1, "c", 7, "a2", 9), (1, "d", 8, "a3", 1)]
    df = spark.createDataFrame(rows, "qid int, chunk_id string, document_id int, asset_id string, rank int")
    got = {r["chunk_id"]: [k["asset_id"] for k in r["asset_keys"]] for r in V.visual_asset_keys(df).collect()}
    assert got == {"c": ["a2", "a1"], "d": ["a3"]}


def test_few_kbs_never_deal_documents_by_kb(spark):
    from shelfmark.operators.filters import beside
    from shelfmark.plans.ingest import build_chunks

    docs = spark.range(2000).selectExpr("id AS document_id", "id % 4 AS kb_id", "'n' AS name", "'txt' AS file_type", "array('t') AS tags", "repeat('word ', 20) AS content")
    # As in the queries, the KBs come from a table as large as the documents.
    kbs = docs.select("kb_id").distinct().selectExpr("kb_id", "8 AS chunk_size", "0 AS chunk_overlap", "'active' AS status")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = build_chunks(docs, kbs)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        many = beside(spark.range(200_001).withColumnRenamed("id", "kb_id"))
        assert "Broadcast" not in docs.join(many, "kb_id", "left_semi")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    made = build_chunks(docs, kbs)
    assert made.select("document_id").distinct().count() == 2000 and made.count() == 6000


def test_dealt_tables_take_more_tasks_as_they_grow(spark):
    from shelfmark.fixtures import dealt

    cores = spark.sparkContext.defaultParallelism
    rows = 5_000 * (cores + 2)
    made = dealt(spark.range(0, rows, 1, 1))
    assert made.rdd.getNumPartitions() == cores + 2 and made.distinct().count() == rows
    assert dealt(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == cores


def test_steps_of_a_search_stay_small():
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(5)
    many = lambda n, of: [np.sort(r.choice(of, 60, replace=False)) for _ in range(n)]
    asked = V._Asked(list(range(1000)), [{"indices": i.tolist(), "values": [1.0] * 60} for i in many(1000, 4000)], [None] * 1000, None)
    rows = many(4000, 4000)
    sparse = pa.StructArray.from_arrays([pa.array([i.tolist() for i in rows]), pa.array([[1.0] * 60] * 4000)], ["indices", "values"])
    columns = [pa.array([f"{n:032d}" for n in range(4000)]), pa.array(range(4000)), pa.array([0] * 4000), sparse]
    batch = pa.RecordBatch.from_arrays(columns, ["chunk_id", "document_id", "kb_id", "sparse"])
    tracemalloc.start()
    found = V._local_topk(iter([batch]), "sparse", asked, 20, "sparse", ["chunk_id", "document_id"], 1024)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert len(found) == 20_000 and peak < 110
    held = np.zeros((4000, 4000))
    held[np.repeat(np.arange(4000), 60), np.concatenate(rows)] = 1
    for q in (0, 999):
        scores = held[:, asked.vectors[q]["indices"]].sum(axis=1)
        best = sorted(range(4000), key=lambda n: (-scores[n], n))[:20]
        assert found[found["__q"] == q]["document_id"].tolist() == best


def test_sparse_vectors_of_long_batches(spark):
    texts = [f"a{n % 7} b{n} b{n}" if n % 5 else None for n in range(1300)]
    made = V.sparse_vectors(spark.createDataFrame(list(enumerate(texts)), "n long, content string").coalesce(1)).orderBy("n").collect()
    for n, text in enumerate(texts):
        assert sorted(made[n]["sparse"]["values"]) == ([1.0, 2.0] if text else [])
