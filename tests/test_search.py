import pytest
from pyspark.sql import functions as F

from shelfmark.functions.hashing import cache_key
from shelfmark.operators import ranking as R
from shelfmark.operators import results as J
from shelfmark.operators.vectors import sparse_vectors
from shelfmark.operators import vectors as V
from shelfmark.plans.search import Corpus, SearchOptions, StageClock, advanced_search, advanced_search_with_stats, column_reranker, multi_search, search

DOCS = [
    # id, kb, name, source, authority, status
    (1, 1, "guide", "manual", 2, "published"),
    (2, 1, "law", "statute", 1, "published"),
    (3, 1, "draft", "manual", 1, "draft"),
    (4, 2, "other", "manual", 1, "published"),
    (5, 9, "closed", "manual", 1, "published"),
]
CHUNKS = [
    ("c1", 1, 1, 0, "solar panel output and panel care", None),
    ("c2", 2, 1, 0, "panel rules", None),
    ("c3", 3, 1, 0, "panel panel panel", None),
    ("c4", 4, 2, 0, "a panel elsewhere", "c1"),
    ("c5", 5, 9, 0, "panel closed", None),
]


@pytest.fixture(scope="module")
def corpus(spark):
    kbs = spark.createDataFrame([(1, "active"), (2, "active"), (9, "archived")], "kb_id long, status string")
    docs = spark.createDataFrame(
        DOCS, "document_id long, kb_id long, name string, governance_source_type string, authority_level int, review_status string"
    ).withColumn("current_version", F.lit(1))
    chunks = spark.createDataFrame(
        CHUNKS, "chunk_id string, document_id long, kb_id long, chunk_index int, content string, parent_chunk_id string"
    )
    tagged = chunks.withColumns({"chunk_type": F.lit("text"), "tags": F.when(F.col("document_id") == 2, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))})
    return Corpus(kbs, docs, chunks, sparse_index=sparse_vectors(tagged))


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), "qid string, query string, kb_ids array<long>")


def ids(output, qid="q"):
    rows = output.results.where(F.col("qid") == qid).orderBy("rank").collect()
    return [r["chunk_id"] for r in rows]


def test_published_by_default_and_authority_first(spark, corpus):
    out = search(ask(spark, ("q", "panel", None)), corpus)
    # level 1 documents first, whatever their score; drafts and inactive KBs never
    assert ids(out) == ["c2", "c4", "c1"]
    (stats,) = out.stats().collect()
    assert (stats["total_candidates"], stats["after_fusion"], stats["after_rerank"]) == (4, 4, 3)


def test_scope_filters_and_modes(spark, corpus):
    scoped = ask(spark, ("q", "panel", [2]), ("bad", "panel", [2, 9]))
    out = search(scoped, corpus)
    assert ids(out) == ["c4"] and ids(out, "bad") == []
    everything = SearchOptions(filters={"include_unpublished": True})
    assert ids(search(ask(spark, ("q", "panel", [1])), corpus, everything)) == ["c3", "c2", "c1"]
    tagged = SearchOptions(filters={"tags": ["x"]})
    assert ids(search(ask(spark, ("q", "panel", None)), corpus, tagged)) == ["c2"]
    early = SearchOptions(governance_mode="pre")
    out = search(ask(spark, ("q", "panel", None)), corpus, early)
    assert ids(out) == ["c2", "c4", "c1"] and out.stats().first()["total_candidates"] == 3


def test_rerank_and_threshold(spark, corpus):
    scored = column_reranker(F.when(F.col("chunk_id") == "c4", 0.9).otherwise(F.lit(None)))
    assert ids(search(ask(spark, ("q", "panel", None)), corpus, SearchOptions(), scored)) == ["c4", "c2", "c1"]
    off = search(ask(spark, ("q", "panel", None)), corpus, SearchOptions(enable_rerank=False), scored)
    assert {r["rerank_score"] for r in off.results.collect()} == {None}
    # the documented sample threshold is above any fused score
    assert ids(search(ask(spark, ("q", "panel", None)), corpus, SearchOptions(score_threshold=0.5))) == []


def test_kb_lists_may_be_concatenated(spark):
    hits = spark.createDataFrame(
        [("q", 1, "a", 0.1), ("q", 2, "b", 0.9), ("q", 1, "c", 0.2)], "qid string, kb_id long, chunk_id string, score double"
    )
    order = lambda mode: [r["chunk_id"] for r in R.rank_candidates(hits, mode).orderBy("rank").collect()]
    assert order("score") == ["b", "c", "a"] and order("concat") == ["c", "a", "b"]


def test_fusion_keeps_first_rank_without_closing_gaps(spark):
    rows = [("dense", "x", 1), ("dense", "x", 2), ("dense", "y", 3), ("sparse", "y", 1)]
    df = spark.createDataFrame(rows, "ranking string, chunk_id string, rank int").withColumns(
        {"qid": F.lit(1), "document_id": F.lit(1), "kb_id": F.lit(1)}
    )
    got = {r["chunk_id"]: r["score"] for r in R.rrf_fuse(df).collect()}
    assert got == {"x": round(1 / 61, 12), "y": round(1 / 63 + 1 / 61, 12)}


def test_candidate_limits():
    assert R.candidate_limit(5) == 100
    assert R.candidate_limit(5, {"include_unpublished": True}) == 25
    assert R.candidate_limit(5, {"include_unpublished": True, "max_authority_level": 2}) == 100


def test_advanced_merge_keeps_best_and_earliest(spark, corpus):
    asked = spark.createDataFrame([(1, "panel and solar, rules", None)], "request_id long, query string, kb_ids array<long>")
    rows = advanced_search(asked, corpus, decompose=True).orderBy("rank").collect()
    assert {r["chunk_id"] for r in rows} == {"c1", "c2", "c4"}
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    merged = R.merge_responses(
        spark.createDataFrame(
            [(1, 0, "a", 0.5, "first"), (1, 1, "a", 0.5, "second"), (1, 1, "b", 0.7, "x"), (1, 2, "c", 0.1, "y")],
            "request_id long, query_pos int, chunk_id string, score double, note string",
        ),
        2,
    ).orderBy("rank").collect()
    assert [(r["chunk_id"], r["note"]) for r in merged] == [("b", "x"), ("a", "first")]


def test_advanced_search_reports_stats_of_one_run(spark, corpus):
    asked = spark.createDataFrame([(1, "panel and solar, rules", None), (2, "nothing", None), (3, "panel", [77])], "request_id long, query string, kb_ids array<long>")
    results, stats = advanced_search_with_stats(asked, corpus, decompose=True)
    plain = sorted(tuple(r) for r in advanced_search(asked, corpus, decompose=True).select("request_id", "rank", "chunk_id").collect())
    assert sorted(tuple(r) for r in results.select("request_id", "rank", "chunk_id").collect()) == plain
    rows = {r["request_id"]: r for r in stats.collect()}
    # "panel" finds 4 candidates, "solar" 1, "rules" 1; drafts go after fusion
    assert (rows[1]["total_candidates"], rows[1]["after_fusion"], rows[1]["after_rerank"]) == (6, 6, 3)
    assert [(rows[i]["total_candidates"], rows[i]["after_rerank"]) for i in (2, 3)] == [(0, 0), (0, 0)]
    assert {"embedding_ms", "sparse_search_ms", "fusion_ms", "fetch_content_ms", "rerank_ms"} == set(rows[1]["stages"])
    assert all(abs(sum(r["stages"].values()) - r["total_latency_ms"]) <= len(r["stages"]) for r in rows.values())
    assert rows[1]["total_latency_ms"] > rows[2]["total_latency_ms"] > 0


def test_stage_clock_counts_rows(spark):
    clock = StageClock()
    assert clock.run("a", spark.range(7)).count() == 7 and clock.rows == {"a": 7} and clock.ms["a"] >= 0


def test_scope_is_no_list_and_governance_comes_before_texts(spark, corpus):
    from shelfmark.operators.filters import open_scope

    asked = ask(spark, ("all", "panel", None), ("empty", "panel", []), ("some", "panel", [2, 1, 2]), ("bad", "panel", [2, 9, 8]))
    got = {r["qid"]: (r["kb_ids"], r["missing"], r["scope_error"]) for r in open_scope(asked, corpus.knowledge_bases).collect()}
    assert got == {"all": (None, 0, None), "empty": (None, 0, None), "some": ([2, 1], 0, None), "bad": ([2], 2, "knowledge_base_not_found")}
    closed = open_scope(asked, corpus.knowledge_bases.where("status = 'archived'")).where("qid = 'all'").first()
    assert closed["scope_error"] == "no_active_knowledge_base"
    plan = search(asked, corpus).results._jdf.queryExecution().optimizedPlan().toString()
    # Children are listed below their parents: the texts' scan joins what governance has left.
    governed = next(line for line in plan.splitlines() if "published" in line)
    joined = [line for line in plan.splitlines() if "Join" in line and "chunk_id" in line]
    assert joined and plan.index(joined[-1]) < plan.index(governed)


def test_metadata_option_and_cells(spark, corpus):
    with_metadata = corpus.chunks.withColumn("metadata", F.create_map(F.lit("a"), F.lit("b")))
    tables = Corpus(corpus.knowledge_bases, corpus.documents, with_metadata, sparse_index=corpus.sparse_index)
    one = ask(spark, ("q", "solar", None))
    assert search(one, tables).results.first()["metadata"] == {"a": "b"}
    assert search(one, tables, SearchOptions(include_metadata=False)).results.first()["metadata"] == {}
    dense = corpus.sparse_index.select("chunk_id", "document_id", "kb_id", "chunk_type", "tags", F.array(F.length("chunk_id").cast("float"), F.col("document_id").cast("float")).alias("embedding"))
    both = Corpus(corpus.knowledge_bases, corpus.documents, corpus.chunks, dense_index=dense, dense_cells=V.build_cells(dense, 2))
    vectors = one.withColumn("dense", F.array(F.lit(2.0), F.lit(1.0)).cast("array<float>"))
    exact = Corpus(corpus.knowledge_bases, corpus.documents, corpus.chunks, dense_index=dense)
    assert ids(search(vectors, both, SearchOptions(probes=2))) == ids(search(vectors, exact))


def test_cache_hits_are_logged(spark):
    reused = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", 0.5)], "request_id long, rank int, chunk_id string, rerank_score double")
    (row,) = J.cache_hit_log(reused, spark.createDataFrame([(1, "q")], "request_id long, query string")).collect()
    assert (row["retrieved_chunk_ids"], row["rerank_scores"], row["total_latency_ms"], row["stage_latencies"]) == (["a", "b"], [0.0, 0.5], 0, {"cache_hit": 1})


def test_multi_search_keeps_lists_apart(spark, corpus):
    asked = spark.createDataFrame([(1, ["solar", "rules", "nothing"], None)], "request_id long, queries array<string>, kb_ids array<long>")
    rows = multi_search(asked, corpus).collect()
    assert sorted((r["query_pos"], r["chunk_id"]) for r in rows) == [(0, "c1"), (1, "c2")]


def test_parent_and_assets(spark, corpus):
    out = search(ask(spark, ("q", "elsewhere", None)), corpus, SearchOptions(include_parent_context=True)).results
    assert out.first()["parent_chunk"]["content"] == CHUNKS[0][4]

    doc, first, second = "00000000-0000-0000-0000-000000000001", *[f"00000000-0000-0000-0000-0000000000a{i}" for i in (1, 2)]
    url = f"/api/v1/documents/{doc}/assets/{first}"
    results = spark.createDataFrame([("q", "c", f"![]({url}) {url}"), ("q", "d", "none")], "qid string, chunk_id string, content string")
    assets = spark.createDataFrame(
        [(doc, first, "image", "a.png", "image/png", 1), (doc, second, "image", "b.png", "image/png", 2)],
        "document_id string, asset_id string, asset_type string, source_path string, content_type string, file_size long",
    )
    hits = spark.createDataFrame([("q", "c", [(doc, second), (doc, first), (doc, "gone")])], "qid string, chunk_id string, asset_keys array<struct<document_id:string,asset_id:string>>")
    got = {r["chunk_id"]: [a["source_path"] for a in r["assets"]] for r in J.attach_assets(results, assets, hits).collect()}
    assert got == {"c": ["a.png", "b.png"], "d": []}
    chunks = spark.createDataFrame([("c0", doc, 0, "intro"), ("c1", doc, 1, url), ("c2", doc, 2, url)], "chunk_id string, document_id string, chunk_index int, content string")
    linked = {r["asset_id"]: r["chunk_id"] for r in J.link_assets(assets, chunks).collect()}
    assert linked == {first: "c1", second: "c0"}


def test_cached_responses_are_reused(spark):
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    raw = spark.createDataFrame([(1, "a", 0), (2, "a", 400), (3, "b", 10), (4, "b", 20), (5, "a", 290), (6, "c", 5)], "request_id long, query string, s int")
    asked = raw.select("request_id", cache_key(F.col("query")).alias("cache_key"), at(F.col("s")).alias("requested_at"))
    stored = spark.createDataFrame([("a", -5, "old"), ("a", 280, "new"), ("c", 50, "late")], "query string, s int, response_id string")
    cache = stored.select(cache_key(F.col("query")).alias("cache_key"), at(F.col("s")).alias("stored_at"), "response_id")
    got = {r["request_id"]: (r["response_id"], r["cache_hit"], r["computed"]) for r in J.reuse_results(asked, cache).collect()}
    assert got == {
        1: ("old", True, False), 2: ("new", True, False), 3: ("3", False, True), 4: ("3", False, False),
        5: ("new", True, False), 6: ("6", False, True),
    }
    change = spark.range(1).select(at(F.lit(285)).alias("changed_at"))
    voided = J.reuse_results(asked, cache, voided_at=change).collect()
    assert not any(r["cache_hit"] for r in voided)


def test_logs_and_feedback(spark):
    results = spark.createDataFrame([(1, 2, "b", 0.1), (1, 1, "a", None)], "request_id long, rank int, chunk_id string, rerank_score double")
    log = {r["request_id"]: r for r in J.retrieval_log(results, spark.createDataFrame([(1,), (2,)], "request_id long")).collect()}
    assert log[1]["retrieved_chunk_ids"] == ["a", "b"] and log[1]["rerank_scores"] == [None, 0.1]
    assert log[2]["retrieved_chunk_ids"] == []
    logs = spark.createDataFrame([(1, "bad", "x"), (1, None, None), (2, None, None)], "request_id long, feedback string, feedback_detail string")
    given = spark.createDataFrame([(1, "good", None), (7, "bad", "?")], "request_id long, feedback string, feedback_detail string")
    rows = sorted((r["request_id"], r["feedback"] or "", r["feedback_detail"]) for r in J.apply_feedback(logs, given).collect())
    assert rows == [(1, "good", None), (1, "good", None), (2, "", None)]
    assert [r["request_id"] for r in J.unmatched_feedback(logs, given).collect()] == [7]
