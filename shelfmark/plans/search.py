"""Search: any number of requests answered by one logical plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from time import perf_counter

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfmark.functions.hashing import sparse_vector
from shelfmark.functions.text import expand_query
from shelfmark.operators.filters import active_kbs, beside, governance_predicate, include_metadata, open_scope, payload_filter
from shelfmark.operators.ranking import (
    authority_rank,
    candidate_limit,
    merge_responses,
    rank_candidates,
    rerank_order,
    rrf_fuse,
    score_threshold,
    top_per_query,
    union_rankings,
)
from shelfmark.operators.results import attach_assets, hydrate, parent_context, retrieval_stats
from shelfmark.operators.vectors import CellIndex, dense_search, load_queries, sparse_search, visual_asset_keys, visual_search, within_scope
from shelfmark.session import cut_lineage

# Rows of fused candidates that may be broadcast: about 100 bytes each.
MAX_BROADCAST_ROWS = 200_000

# A reranker adds ``rerank_score`` to (qid, query, chunk_id, content) rows.
Reranker = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class SearchOptions:
    """Options shared by the requests of one call.

    ``governance_mode`` is ``post`` (filter fused candidates, so fewer than
    ``top_k`` may remain) or ``pre`` (filter the indexes first). ``probes`` is the number
    of cells a query looks at in indexes that are dealt into cells.
    """

    top_k: int = 5
    filters: dict = field(default_factory=dict)
    enable_rerank: bool = True
    enable_visual_search: bool = True
    include_parent_context: bool = False
    score_threshold: float | None = None
    kb_merge: str = "score"
    governance_mode: str = "post"
    include_metadata: bool = True
    probes: int = 8


@dataclass(frozen=True)
class Corpus:
    """Tables a search reads. Indexes a corpus lacks are skipped.

    Dense and visual indexes may come with their ``cells``, which makes their search approximate.
    """

    knowledge_bases: DataFrame
    documents: DataFrame
    chunks: DataFrame
    sparse_index: DataFrame | None = None
    dense_index: DataFrame | None = None
    visual_index: DataFrame | None = None
    assets: DataFrame | None = None
    dense_cells: CellIndex | None = None
    visual_cells: CellIndex | None = None


class StageClock:
    """Runs the stages of a search one by one and notes what each took and made.

    A stage's rows are counted while it runs (``observe``) and written to the checkpoint
    folder, so neither the stages after it nor the statistics compute it again.
    """

    def __init__(self) -> None:
        self.ms: dict[str, int] = {}
        self.rows: dict[str, int] = {}

    def run(self, stage: str, df: DataFrame) -> DataFrame:
        seen, started = Observation(), perf_counter()
        done = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        self.ms[stage] = self.ms.get(stage, 0) + int((perf_counter() - started) * 1000)
        self.rows[stage] = self.rows.get(stage, 0) + seen.get["rows"]
        return done


@dataclass(frozen=True)
class SearchOutput:
    """Results and what led to them; ``rejected`` holds the requests with a scope error.

    ``fused`` carries a broadcast hint where its size is bounded, so chunks are not dealt to meet it.
    """

    results: DataFrame
    candidates: DataFrame
    fused: DataFrame
    requests: DataFrame
    rejected: DataFrame

    def stats(self) -> DataFrame:
        return retrieval_stats(self.candidates, self.fused, self.results, self.requests)


def table_reranker(scores: DataFrame) -> Reranker:
    """Scores looked up by (qid, chunk_id); a missing one counts as 0."""

    def score(candidates: DataFrame) -> DataFrame:
        known = scores.select("qid", "chunk_id", "rerank_score")
        return candidates.join(known, ["qid", "chunk_id"], "left").withColumn(
            "rerank_score", F.coalesce("rerank_score", F.lit(0.0))
        )

    return score


def column_reranker(expression: Column) -> Reranker:
    """Scores given by an expression or pandas UDF over query, content and ids."""
    return lambda candidates: candidates.withColumn("rerank_score", F.coalesce(expression, F.lit(0.0)))


def disabled_reranker(candidates: DataFrame) -> DataFrame:
    """A switched-off model scores everything 0, leaving authority and fused order."""
    return candidates.withColumn("rerank_score", F.lit(0.0))


def rerank_candidates(lists: DataFrame, score: Column) -> DataFrame:
    """Order caller-supplied document lists (request_id, query, documents) by score."""
    from pyspark.sql import Window

    exploded = lists.select("request_id", "query", F.posexplode("documents").alias("index", "document"))
    scored = exploded.withColumn("score", F.coalesce(score, F.lit(0.0)))
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), F.asc("index"))
    return scored.withColumn("rank", F.row_number().over(order))


def search(
    requests: DataFrame,
    corpus: Corpus,
    options: SearchOptions = SearchOptions(),
    reranker: Reranker = disabled_reranker,
    clock: StageClock | None = None,
) -> SearchOutput:
    """Answer requests (qid, query, kb_ids and, when known, dense / visual vectors).

    Per KB and modality the top candidates are taken, ranked, fused, cut to the
    candidate limit, joined to their documents, filtered by governance, given their texts,
    reranked, ordered by authority and cut to ``top_k``. With a ``clock`` the stages run
    one after another and are measured.
    """
    limit = candidate_limit(options.top_k, options.filters)
    staged = (lambda stage, df: clock.run(stage, df)) if clock else (lambda stage, df: df)
    checked = open_scope(requests, corpus.knowledge_bases)
    scoped = checked.where("scope_error is null")

    def reachable(index: DataFrame) -> DataFrame:
        filtered = payload_filter(index, options.filters)
        if loaded is None or any(r["kb_ids"] is None for r in loaded):
            # Prunes the partitions of an index that is stored by KB.
            filtered = filtered.join(active, "kb_id", "left_semi")
        if options.governance_mode != "pre":
            return filtered
        visible = corpus.documents.where(governance_predicate(options.filters)).select("document_id")
        return filtered.join(visible, "document_id", "left_semi")

    asked = scoped
    if corpus.sparse_index is not None:
        asked = asked.withColumn("sparse", sparse_vector(F.col("query")))
    wanted = {
        "dense": corpus.dense_index is not None,
        "sparse": corpus.sparse_index is not None,
        "visual": corpus.visual_index is not None and options.enable_visual_search,
    }
    fields = tuple(name for name, on in wanted.items() if on and name in asked.columns)
    # One job fetches the query vectors when they form a small block.
    loaded = load_queries(asked, fields)
    active = beside(active_kbs(corpus.knowledge_bases))

    def dealt(cells: CellIndex | None) -> dict:
        if cells is None:
            return {}
        return {"cells": CellIndex(reachable(cells.table), cells.centroids), "probes": options.probes}

    rankings: dict[str, DataFrame] = {}
    asset_keys_by_chunk = None
    if "dense" in fields:
        hits = dense_search(reachable(corpus.dense_index), asked, limit, query_field="dense", loaded=loaded, **dealt(corpus.dense_cells))
        rankings["dense"] = staged("vector_search_ms", rank_candidates(hits, options.kb_merge))
    if "sparse" in fields:
        hits = sparse_search(reachable(corpus.sparse_index), asked, limit, loaded=loaded)
        rankings["sparse"] = staged("sparse_search_ms", rank_candidates(hits, options.kb_merge))
    if "visual" in fields:
        hits = visual_search(reachable(corpus.visual_index), asked, limit, query_field="visual", loaded=loaded, **dealt(corpus.visual_cells))
        ranked = staged("visual_search_ms", rank_candidates(hits, options.kb_merge, item="asset_id"))
        rankings["visual"] = ranked
        asset_keys_by_chunk = visual_asset_keys(ranked)

    candidates = union_rankings(rankings)
    fused = staged("fusion_ms", top_per_query(
        score_threshold(rrf_fuse(candidates), options.score_threshold), limit, rank="fused_rank"
    ))

    # At most ``limit`` narrow rows per request: a small block of requests bounds them.
    bounded = loaded is not None and len(loaded) * limit <= MAX_BROADCAST_ROWS
    placed = F.broadcast(fused) if bounded else fused
    chunks = corpus.chunks if loaded is None else within_scope(corpus.chunks, loaded)
    hydrated = staged("fetch_content_ms", hydrate(placed, chunks, corpus.documents, governance_predicate(options.filters)))

    if options.enable_rerank:
        scored = reranker(hydrated.join(requests.select("qid", "query"), "qid"))
    else:
        scored = hydrated.withColumn("rerank_score", F.lit(None).cast("double"))
    ordered = authority_rank(rerank_order(scored, options.enable_rerank), options.enable_rerank)
    results = staged("rerank_ms", ordered.where(F.col("rank") <= options.top_k))
    if "metadata" in results.columns:
        results = include_metadata(results, options.include_metadata)
    if options.include_parent_context:
        results = parent_context(results, corpus.chunks)
    if corpus.assets is not None:
        results = attach_assets(results, corpus.assets, asset_keys_by_chunk)
    return SearchOutput(results, candidates, placed, scoped.select("qid"), checked.where("scope_error is not null"))


def expand_requests(
    requests: DataFrame,
    rewrite: bool = False,
    hyde: bool = False,
    decompose: bool = False,
    max_sub_queries: int = 3,
) -> DataFrame:
    """One row per query to run: request_id, query_pos, qid, query."""
    queries = expand_query(F.col("query"), F.lit(rewrite), F.lit(hyde), F.lit(decompose), max_sub_queries)
    others = [c for c in requests.columns if c != "query"]
    return requests.select(*others, F.posexplode(queries).alias("query_pos", "query")).withColumn(
        "qid", F.concat_ws("#", "request_id", "query_pos")
    )


def advanced_search(
    requests: DataFrame,
    corpus: Corpus,
    options: SearchOptions = SearchOptions(),
    reranker: Reranker = disabled_reranker,
    vectors: Callable[[DataFrame], DataFrame] = lambda df: df,
    **enhancements,
) -> DataFrame:
    """Search with query enhancement: every sub-query of every request in one run.

    Results of a request's queries are merged by best fused score, which drops
    the rerank and authority order. ``vectors`` may add dense / visual columns.
    """
    expanded = expand_requests(requests, **enhancements)
    found = search(vectors(expanded), corpus, options, reranker).results
    keys = expanded.select("qid", "request_id", "query_pos")
    return merge_responses(found.join(keys, "qid"), options.top_k)


def advanced_search_with_stats(
    requests: DataFrame,
    corpus: Corpus,
    options: SearchOptions = SearchOptions(),
    reranker: Reranker = disabled_reranker,
    vectors: Callable[[DataFrame], DataFrame] = lambda df: df,
    **enhancements,
) -> tuple[DataFrame, DataFrame]:
    """(results, stats): ``advanced_search`` in one measured run, with statistics per request.

    Stats has request_id, total_candidates, after_fusion, after_rerank, stages (ms by
    stage) and total_latency_ms. Candidates and fused rows are summed over a request's
    sub-queries, after_rerank counts its merged results. All sub-queries run together: each
    is charged an equal share of a stage, and a request the sum over its sub-queries.
    """
    clock = StageClock()
    started = perf_counter()
    expanded = cut_lineage(vectors(expand_requests(requests, **enhancements)))
    clock.ms["embedding_ms"] = int((perf_counter() - started) * 1000)
    out = search(expanded, corpus, options, reranker, clock)
    keys = expanded.select("qid", "request_id", "query_pos")
    results = merge_responses(out.results.join(keys, "qid"), options.top_k)

    def per_request(df: DataFrame, name: str) -> DataFrame:
        return df.join(keys.select("qid", "request_id"), "qid").groupBy("request_id").agg(F.count(F.lit(1)).alias(name))

    counted = keys.groupBy("request_id").agg(F.count(F.lit(1)).alias("__n"))
    parts = {"total_candidates": out.candidates, "after_fusion": out.fused}
    for name, df in parts.items():
        counted = counted.join(per_request(df, name), "request_id", "left")
    merged = results.groupBy("request_id").agg(F.count(F.lit(1)).alias("after_rerank"))
    counted = counted.join(merged, "request_id", "left").na.fill(0, [*parts, "after_rerank"])
    run = max(1, expanded.count())
    share = lambda ms: F.round(F.lit(ms) * F.col("__n") / run).cast("bigint")
    stages = F.create_map(*[x for name, ms in clock.ms.items() for x in (F.lit(name), share(ms))])
    return results, counted.select("request_id", *parts, "after_rerank", stages.alias("stages"), share(sum(clock.ms.values())).alias("total_latency_ms"))


def multi_search(
    requests: DataFrame,
    corpus: Corpus,
    options: SearchOptions = SearchOptions(),
    reranker: Reranker = disabled_reranker,
    vectors: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Requests holding a list ``queries``; each query keeps its own result list."""
    each = requests.select(
        *[c for c in requests.columns if c != "queries"], F.posexplode("queries").alias("query_pos", "query")
    ).withColumn("qid", F.concat_ws("#", "request_id", "query_pos"))
    found = search(vectors(each), corpus, options, reranker).results
    return found.join(each.select("qid", "request_id", "query_pos"), "qid")
