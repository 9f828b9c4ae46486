"""Checks of search, ranking, fusion and what is built on results."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import fixtures as X
from shelfmark.checks.base import LIMIT, check, fuse_sql
from shelfmark.functions.assets import asset_url
from shelfmark.functions.hashing import chunk_id
from shelfmark.operators import context as O
from shelfmark.operators import ranking as R
from shelfmark.operators import results as J
from shelfmark.operators.vectors import (
    build_cells,
    dense_search,
    embed,
    hashed_embedder,
    postings,
    sparse_search,
    sparse_vectors,
    visual_search,
)
from shelfmark.plans.search import (
    Corpus,
    SearchOptions,
    advanced_search,
    advanced_search_with_stats,
    column_reranker,
    multi_search,
    rerank_candidates,
    search,
    table_reranker,
)

big = "bigint"


def requests(spark, sf):
    return X.requests(spark, sf).withColumn("qid", F.col("request_id"))


def scoped_vectors(spark, sf):
    active = F.array(*[F.lit(i).cast(big) for i in range(3)])
    return X.query_vectors(spark, sf).select(F.col("request_id").alias("qid"), active.alias("kb_ids"), "embedding")


def scoped_texts(spark, sf):
    active = F.array(*[F.lit(i).cast(big) for i in range(3)])
    asked = requests(spark, sf).withColumn("kb_ids", active)
    return sparse_vectors(asked, "query")


def sparse_index(spark, sf):
    return sparse_vectors(X.chunks(spark, sf))


def corpus(spark, sf, *, dense=True, visual=True):
    chunks = X.chunks(spark, sf)
    return Corpus(
        X.knowledge_bases(spark, sf),
        X.documents(spark, sf).drop("content", "tags"),
        chunks.drop("tags", "content_hash"),
        sparse_index=sparse_vectors(chunks),
        dense_index=X.dense_index(spark, sf) if dense else None,
        visual_index=X.visual_index(spark, sf) if visual else None,
    )


def vector_requests(spark, sf):
    vectors = X.query_vectors(spark, sf).select(
        "request_id", F.col("embedding").alias("dense"), F.col("embedding").alias("visual")
    )
    return requests(spark, sf).join(vectors, "request_id", "left")


def fixture_scores():
    return column_reranker(F.expr("(document_id * 31 + qid * 17) % 1000 / 1000.0D"))


def full_search(spark, sf, **options):
    return search(vector_requests(spark, sf), corpus(spark, sf), SearchOptions(**options), fixture_scores())


def hits(df, *ids):
    return df.select(
        F.col("qid").alias("request_id"), *ids, F.round("score", 6).alias("score"), F.col("kb_rank").cast(big).alias("kb_rank")
    )


# --- vectors ---------------------------------------------------------------------------


@check(
    "sparse_vectors",
    "SELECT chunk_id, idx, val FROM cpost",
    ("cpost",),
)
def _(spark, sf):
    return postings(sparse_index(spark, sf), ["chunk_id"])


@check("embed", "SELECT chunk_id, 64::bigint AS dim FROM chunks", ("chunks",))
def _(spark, sf):
    vectors = embed(X.chunks(spark, sf).select("chunk_id", "content"), hashed_embedder, batch_size=64)
    return vectors.select("chunk_id", F.size("embedding").cast(big).alias("dim"))


@check(
    "sparse_search",
    "SELECT qid AS request_id, kb_id, chunk_id, document_id, score, kb_rank FROM sparse_hits",
    ("sparse_hits",),
)
def _(spark, sf):
    found = sparse_search(sparse_index(spark, sf), scoped_texts(spark, sf), LIMIT)
    return hits(found, "kb_id", "chunk_id", "document_id")


@check(
    "dense_search",
    "SELECT qid AS request_id, kb_id, chunk_id, document_id, score, kb_rank FROM dense_hits",
    ("dense_hits",),
)
def _(spark, sf):
    found = dense_search(X.dense_index(spark, sf), scoped_vectors(spark, sf), LIMIT)
    return hits(found, "kb_id", "chunk_id", "document_id")


@check(
    "dense_cells",
    "SELECT qid AS request_id, kb_id, chunk_id, document_id, score, kb_rank FROM dense_hits",
    ("dense_hits",),
)
def _(spark, sf):
    """Search over an index in 16 cells; all are looked at, so nothing may be missing."""
    index = X.dense_index(spark, sf)
    found = dense_search(index, scoped_vectors(spark, sf), LIMIT, cells=build_cells(index, 16), probes=16)
    return hits(found, "kb_id", "chunk_id", "document_id")


@check(
    "visual_search",
    "SELECT qid AS request_id, kb_id, asset_id, chunk_id, score, kb_rank FROM visual_hits",
    ("visual_hits",),
)
def _(spark, sf):
    found = visual_search(X.visual_index(spark, sf), scoped_vectors(spark, sf), LIMIT)
    return hits(found, "kb_id", "asset_id", "chunk_id")


# --- ranks and fusion --------------------------------------------------------------------


@check(
    "rank_candidates",
    """SELECT qid AS request_id, chunk_id, rank AS score_rank,
  row_number() OVER (PARTITION BY qid ORDER BY kb_id, score DESC, chunk_id) AS concat_rank FROM dense_hits""",
    ("dense_hits",),
)
def _(spark, sf):
    found = dense_search(X.dense_index(spark, sf), scoped_vectors(spark, sf), LIMIT)
    by_score = R.rank_candidates(found).withColumnRenamed("rank", "score_rank")
    both = R.rank_candidates(by_score, "concat")
    return both.select(
        F.col("qid").alias("request_id"),
        "chunk_id",
        F.col("score_rank").cast(big).alias("score_rank"),
        F.col("rank").cast(big).alias("concat_rank"),
    )


def two_rankings(spark, sf):
    vectors = scoped_vectors(spark, sf)
    dense = R.rank_candidates(dense_search(X.dense_index(spark, sf), vectors, LIMIT))
    visual = R.rank_candidates(visual_search(X.visual_index(spark, sf), vectors, LIMIT), item="asset_id")
    return R.union_rankings({"dense": dense, "visual": visual})


@check(
    "rrf_fuse",
    f"SELECT qid AS request_id, chunk_id, round(score, 9) AS score FROM ({fuse_sql({'dense': 'dense_hits', 'visual': 'visual_hits'})})",
    ("dense_hits", "visual_hits"),
)
def _(spark, sf):
    fused = R.rrf_fuse(two_rankings(spark, sf))
    return fused.select(F.col("qid").alias("request_id"), "chunk_id", F.round("score", 9).alias("score"))


@check(
    "score_threshold",
    f"""SELECT qid AS request_id, chunk_id, round(score, 9) AS score
FROM ({fuse_sql({'dense': 'dense_hits', 'visual': 'visual_hits'})}) WHERE score >= 0.02""",
    ("dense_hits", "visual_hits"),
)
def _(spark, sf):
    kept = R.score_threshold(R.rrf_fuse(two_rankings(spark, sf)), 0.02)
    return kept.select(F.col("qid").alias("request_id"), "chunk_id", F.round("score", 9).alias("score"))


@check(
    "candidate_limit",
    """SELECT item_id AS request_id, ((1 + item_id % 50) * CASE WHEN item_id % 2 = 0 AND item_id % 3 <> 0 THEN 5 ELSE 20 END)::bigint
  AS candidate_limit FROM benchmark""",
)
def _(spark, sf):
    i = F.col("request_id")
    limit = R.candidate_limit_column((1 + i % 50), i % 2 == 0, i % 3 == 0)
    return requests(spark, sf).select("request_id", limit.cast(big).alias("candidate_limit"))


@check(
    "hydrate",
    "SELECT qid AS request_id, chunk_id, document_id, chunk_index::bigint AS chunk_index, sha256(content) AS content_hash, document_name, authority_level::bigint AS authority_level FROM hydrated",
    ("hydrated",),
)
def _(spark, sf):
    c = corpus(spark, sf)
    fused = search(vector_requests(spark, sf), c, SearchOptions(), fixture_scores()).fused
    rows = J.hydrate(fused, c.chunks, c.documents)
    return rows.select(
        F.col("qid").alias("request_id"),
        "chunk_id",
        "document_id",
        F.col("chunk_index").cast(big).alias("chunk_index"),
        F.sha2("content", 256).alias("content_hash"),
        "document_name",
        F.col("authority_level").cast(big).alias("authority_level"),
    )


@check(
    "rerank",
    "SELECT qid AS request_id, chunk_id, rerank_score FROM reranked",
    ("reranked",),
)
def _(spark, sf):
    c = corpus(spark, sf)
    fused = search(vector_requests(spark, sf), c).fused
    rows = J.hydrate(fused, c.chunks, c.documents).where("review_status = 'published'")
    table = rows.select("qid", "chunk_id", F.expr("(document_id * 31 + qid * 17) % 1000 / 1000.0D").alias("rerank_score"))
    return table_reranker(table)(rows).select(F.col("qid").alias("request_id"), "chunk_id", "rerank_score")


@check(
    "rerank_sort",
    "SELECT qid AS request_id, chunk_id, rerank_rank, plain_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, fused_rank) AS plain_rank FROM reranked)",
    ("reranked",),
)
def _(spark, sf):
    c = corpus(spark, sf)
    fused = search(vector_requests(spark, sf), c).fused
    rows = J.hydrate(fused, c.chunks, c.documents).where("review_status = 'published'")
    scored = fixture_scores()(rows)
    ranked = R.rerank_order(scored).withColumnRenamed("rerank_rank", "__with")
    both = R.rerank_order(ranked, enabled=False)
    return both.select(
        F.col("qid").alias("request_id"),
        "chunk_id",
        F.col("__with").cast(big).alias("rerank_rank"),
        F.col("rerank_rank").cast(big).alias("plain_rank"),
    )


@check(
    "authority_rank",
    """SELECT qid AS request_id, chunk_id, authority_level::bigint AS authority_level,
  row_number() OVER (PARTITION BY qid ORDER BY authority_level, rerank_score DESC, rerank_rank) AS rank FROM reranked""",
    ("reranked",),
)
def _(spark, sf):
    c = corpus(spark, sf)
    fused = search(vector_requests(spark, sf), c).fused
    rows = J.hydrate(fused, c.chunks, c.documents).where("review_status = 'published'")
    ranked = R.authority_rank(R.rerank_order(fixture_scores()(rows)))
    return ranked.select(
        F.col("qid").alias("request_id"), "chunk_id", F.col("authority_level").cast(big).alias("authority_level"), F.col("rank").cast(big).alias("rank")
    )


@check(
    "rerank_candidates",
    """SELECT request_id, index, document, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, index) AS rank FROM (
  SELECT request_id, n - 1 AS index, lines[n] AS document, ((request_id * 7 + len(lines[n])) % 10)::double AS score FROM (
    SELECT request_id, lines, unnest(range(1, len(lines) + 1)) AS n FROM (
      SELECT doc_id AS request_id, string_split(text, chr(10)) AS lines FROM documents)))""",
)
def _(spark, sf):
    # A caller's list: the lines of one text.
    d = X.documents(spark, sf)
    lists = d.select(F.col("document_id").alias("request_id"), F.lit("q").alias("query"), F.split("content", "\n").alias("documents"))
    scored = rerank_candidates(lists, ((F.col("request_id") * 7 + F.length("document")) % 10).cast("double"))
    return scored.select(
        "request_id", F.col("index").cast(big).alias("index"), "document", "score", F.col("rank").cast(big).alias("rank")
    )


# --- search ----------------------------------------------------------------------------------


def result_rows(df):
    return df.select(
        F.col("qid").alias("request_id"),
        F.col("rank").cast(big).alias("rank"),
        "chunk_id",
        "document_id",
        F.round("score", 9).alias("score"),
        "rerank_score",
        F.col("authority_level").cast(big).alias("authority_level"),
    )


RESULT_SQL = """SELECT qid AS request_id, rank, chunk_id, document_id, round(score, 9) AS score, rerank_score,
  authority_level::bigint AS authority_level FROM results"""


@check("hybrid_search", RESULT_SQL, ("results",))
def _(spark, sf):
    return result_rows(full_search(spark, sf).results)


@check(
    "retrieval_stats",
    f"""SELECT request_id, coalesce(total_candidates, 0) AS total_candidates, coalesce(after_fusion, 0) AS after_fusion, coalesce(after_rerank, 0) AS after_rerank FROM
  (SELECT qid AS request_id FROM reqs) LEFT JOIN (SELECT qid AS request_id, count(*) AS total_candidates FROM (
     SELECT qid FROM dense_hits UNION ALL SELECT qid FROM sparse_hits UNION ALL SELECT qid FROM visual_hits) GROUP BY qid) USING (request_id)
  LEFT JOIN (SELECT qid AS request_id, count(*) AS after_fusion FROM trimmed GROUP BY qid) USING (request_id)
  LEFT JOIN (SELECT qid AS request_id, count(*) AS after_rerank FROM results GROUP BY qid) USING (request_id)""",
    ("results",),
)
def _(spark, sf):
    return full_search(spark, sf).stats().withColumnRenamed("qid", "request_id")


SPARSE_ONLY = """SELECT {keys}, chunk_id, document_id, score, authority_level FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY authority_level, score DESC, chunk_id) AS rank FROM (
    SELECT {keys}, f.chunk_id, f.document_id, f.score, d.authority_level FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, chunk_id) AS fr FROM (
        SELECT {keys}, chunk_id, document_id, round(1.0::double / (60 + row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, chunk_id)), 12) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY {keys}, kb_id ORDER BY score DESC, chunk_id) AS kr FROM (
            SELECT {qkeys}, chunk_id, document_id, kb_id, sum(q.val * c.val) AS score
            FROM xpost q JOIN cpost c USING (idx) WHERE kb_id < 3 GROUP BY ALL)
        ) WHERE kr <= 100)
    ) f JOIN docs d ON f.document_id = d.document_id WHERE fr <= 100 AND d.review_status = 'published')
) WHERE rank <= 5"""


def _xpost(source: str) -> str:
    from shelfmark.checks.base import sparse_sql

    return sparse_sql(f"({source})", "request_id, query_pos", "query")


HYDE = "'This hypothetical reference document answers the query: ' || q || '. It contains the key terms, entities, and context needed for retrieval.'"
EXPANDED = f"""SELECT request_id, pos - 1 AS query_pos, qs[pos] AS query FROM (
  SELECT request_id, qs, unnest(range(1, len(qs) + 1)) AS pos FROM (
    SELECT request_id, [q, {HYDE}] || CASE WHEN len(parts) <= 1 THEN [] ELSE list_filter(parts[1:3], lambda p: p <> q) END AS qs FROM (
      SELECT request_id, q, list_filter(list_transform(regexp_split_to_array(q, '\\s*(?:\\band\\b|,|，|;|；|\\?|？)\\s*'), lambda p: trim(p)), lambda p: p <> '') AS parts
      FROM (SELECT item_id AS request_id, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[?？。.!！]+$', '') AS q FROM benchmark))))"""
UNIQUE_EXPANDED = f"""SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY p) - 1 AS query_pos, query FROM (
  SELECT request_id, min(query_pos) AS p, query FROM ({EXPANDED}) GROUP BY request_id, query)"""


@check(
    "expand_queries",
    UNIQUE_EXPANDED,
)
def _(spark, sf):
    from shelfmark.plans.search import expand_requests

    rows = expand_requests(X.requests(spark, sf), rewrite=True, hyde=True, decompose=True, max_sub_queries=3)
    return rows.select("request_id", F.col("query_pos").cast(big).alias("query_pos"), "query")


@check(
    "advanced_search",
    f"""SELECT request_id, rank, chunk_id, round(score, 9) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id, chunk_id ORDER BY score DESC, query_pos) AS n
    FROM ({SPARSE_ONLY.format(keys='request_id, query_pos', qkeys='q.request_id, q.query_pos').replace('xpost q', '(' + _xpost(UNIQUE_EXPANDED) + ') q')}))
  WHERE n = 1) WHERE rank <= 5""",
    ("cpost", "docs"),
)
def _(spark, sf):
    found = advanced_search(
        X.requests(spark, sf),
        corpus(spark, sf, dense=False, visual=False),
        rewrite=True,
        hyde=True,
        decompose=True,
        max_sub_queries=3,
    )
    return found.select(
        "request_id", F.col("rank").cast(big).alias("rank"), "chunk_id", F.round("score", 9).alias("score")
    )


ADVANCED_HITS = f"""SELECT request_id, query_pos, row_number() OVER (PARTITION BY request_id, query_pos, kb_id ORDER BY score DESC, chunk_id) AS kr FROM (
  SELECT q.request_id, q.query_pos, chunk_id, kb_id, sum(q.val * c.val) AS score FROM ({_xpost(UNIQUE_EXPANDED)}) q JOIN cpost c USING (idx) WHERE kb_id < 3 GROUP BY ALL)"""


@check(
    "advanced_stats",
    f"""SELECT item_id AS request_id, coalesce(sum(e.n), 0)::bigint AS total_candidates, coalesce(sum(least(e.n, 100)), 0)::bigint AS after_fusion,
  least(coalesce(max(b.n), 0), 5)::bigint AS after_rerank, true AS timed
FROM benchmark LEFT JOIN (SELECT request_id, query_pos, count(*) FILTER (kr <= 100) AS n FROM ({ADVANCED_HITS}) GROUP BY ALL) e ON e.request_id = item_id
LEFT JOIN (SELECT request_id, count(DISTINCT chunk_id) AS n FROM ({SPARSE_ONLY.format(keys='request_id, query_pos', qkeys='q.request_id, q.query_pos').replace('xpost q', '(' + _xpost(UNIQUE_EXPANDED) + ') q')}) GROUP BY ALL) b ON b.request_id = item_id
GROUP BY item_id""",
    ("cpost", "docs"),
)
def _(spark, sf):
    """Statistics of one measured run; latencies differ from run to run, so only their sum is looked at."""
    tables = corpus(spark, sf, dense=False, visual=False)
    _, stats = advanced_search_with_stats(X.requests(spark, sf), tables, rewrite=True, hyde=True, decompose=True, max_sub_queries=3)
    timed = F.abs(F.aggregate(F.map_values("stages"), F.lit(0).cast(big), lambda a, b: a + b) - F.col("total_latency_ms")) <= F.size("stages")
    return stats.select("request_id", "total_candidates", "after_fusion", "after_rerank", timed.alias("timed"))


@check(
    "cache_hit_log",
    """SELECT qid AS request_id, coalesce(string_agg(chunk_id, ',' ORDER BY rank), '') AS chunk_ids, count(chunk_id) AS scores, 0::bigint AS total_latency_ms, 1::bigint AS cache_hit
FROM reqs LEFT JOIN results USING (qid) WHERE qid % 2 = 0 GROUP BY qid""",
    ("results", "reqs"),
)
def _(spark, sf):
    """Log rows of the requests that a cache answered: every other one, with results of an unranked search."""
    found = full_search(spark, sf).results.withColumnRenamed("qid", "request_id")
    log = J.cache_hit_log(found, X.requests(spark, sf).where("request_id % 2 = 0").select("request_id"))
    return log.select(
        "request_id",
        F.array_join("retrieved_chunk_ids", ",").alias("chunk_ids"),
        F.size("rerank_scores").cast(big).alias("scores"),
        "total_latency_ms",
        F.col("stage_latencies")["cache_hit"].alias("cache_hit"),
    )


MULTI = "SELECT item_id // 10 AS request_id, item_id % 10 AS query_pos, text AS query FROM benchmark"


@check(
    "multi_search",
    f"""SELECT request_id, query_pos, chunk_id, round(score, 9) AS score FROM ({SPARSE_ONLY.format(keys='request_id, query_pos', qkeys='q.request_id, q.query_pos').replace('xpost q', '(' + _xpost(MULTI) + ') q')})""",
    ("cpost", "docs"),
)
def _(spark, sf):
    r = X.requests(spark, sf)
    position = F.col("request_id") % 10
    # Ten passages to a request; a request holds at most 20 queries.
    lists = r.groupBy(F.floor(F.col("request_id") / 10).alias("request_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), "query"))), lambda x: x["query"]).alias("queries"),
        F.first("kb_ids").alias("kb_ids"),
    )
    found = multi_search(lists, corpus(spark, sf, dense=False, visual=False))
    return found.select(
        "request_id", F.col("query_pos").cast(big).alias("query_pos"), "chunk_id", F.round("score", 9).alias("score")
    )


@check(
    "merge_responses",
    """SELECT request_id, chunk_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT qid % 10 AS request_id, chunk_id, max(round(score, 9)) AS score FROM results GROUP BY ALL)) WHERE rank <= 5""",
    ("results",),
)
def _(spark, sf):
    found = full_search(spark, sf).results
    merged = found.select(
        (F.col("qid") % 10).alias("request_id"), F.col("qid").alias("query_pos"), "chunk_id", F.round("score", 9).alias("score"), "rank"
    )
    best = R.merge_responses(merged, 5)
    return best.select("request_id", "chunk_id", "score", F.col("rank").cast(big).alias("rank"))


# --- results ------------------------------------------------------------------------------------


@check(
    "parent_context",
    """SELECT c.chunk_id, p.chunk_id AS parent_id, sha256(p.content) AS parent_hash FROM chunks c
  LEFT JOIN chunks p ON p.document_id = c.document_id AND p.chunk_index = 0 AND c.chunk_index > 0""",
    ("chunks",),
)
def _(spark, sf):
    c = X.chunks(spark, sf)
    parent = F.when(F.col("chunk_index") > 0, chunk_id(F.col("document_id"), F.lit(0)))
    joined = J.parent_context(c.withColumn("parent_chunk_id", parent), c)
    return joined.select(
        "chunk_id", F.col("parent_chunk.id").alias("parent_id"), F.sha2("parent_chunk.content", 256).alias("parent_hash")
    )


def uuid_of(col):
    """A UUID-shaped id from a number, so that asset URLs can be built."""
    return F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(col.cast("string"), 12, "0"))


UUID_SQL = "('00000000-0000-0000-0000-' || lpad(({0})::varchar, 12, '0'))"


def linked_chunks(spark, sf):
    """Chunks that mention assets: their own document's and that of the next chunk index."""
    c = X.chunks(spark, sf)
    d = uuid_of(F.col("document_id"))
    mention = lambda n: asset_url(d, uuid_of(F.col("document_id") * 1000 + n))
    text = F.concat(
        F.col("content"),
        F.lit(" ![a]("),
        mention(F.col("chunk_index") + 1),
        F.lit(") ![b]("),
        mention(F.col("chunk_index")),
        F.lit(") "),
        mention(F.col("chunk_index")),
    )
    return c.select("chunk_id", d.alias("document_id"), "chunk_index", text.alias("content"))


def linked_assets(spark, sf):
    c = X.chunks(spark, sf).where("chunk_index % 3 <> 2")
    return c.select(
        uuid_of(F.col("document_id")).alias("document_id"),
        uuid_of(F.col("document_id") * 1000 + F.col("chunk_index") * 2).alias("asset_id"),
        F.lit("image").alias("asset_type"),
        F.concat(F.lit("images/"), "chunk_index", F.lit(".png")).alias("source_path"),
        F.when(F.col("chunk_index") % 2 == 0, "image/png").otherwise("text/csv").alias("content_type"),
        (F.col("chunk_index") + 1).cast(big).alias("file_size"),
    )


ASSETS_CTE = f"""SELECT {UUID_SQL.format('document_id')} AS document_id, {UUID_SQL.format('document_id * 1000 + chunk_index * 2')} AS asset_id,
  chunk_index AS k, document_id AS d FROM chunks WHERE chunk_index % 3 <> 2"""
USES_SQL = """SELECT chunk_id, document_id AS d, chunk_index, 0 AS pos, chunk_index + 1 AS n FROM chunks
  UNION ALL SELECT chunk_id, document_id, chunk_index, 1, chunk_index FROM chunks"""


@check(
    "attach_assets",
    f"""SELECT chunk_id, coalesce(string_agg(asset_id, ',' ORDER BY pos), '') AS assets FROM (
  SELECT c.chunk_id, a.asset_id, u.pos FROM chunks c LEFT JOIN ({USES_SQL}) u ON c.chunk_id = u.chunk_id
  LEFT JOIN ({ASSETS_CTE}) a ON a.d = u.d AND a.k * 2 = u.n) GROUP BY chunk_id""",
    ("chunks",),
)
def _(spark, sf):
    rows = linked_chunks(spark, sf).withColumn("qid", F.lit(0))
    found = J.attach_assets(rows, linked_assets(spark, sf))
    return found.select("chunk_id", F.array_join(F.transform("assets", lambda a: a["id"]), ",").alias("assets"))


@check(
    "link_assets",
    f"""SELECT a.asset_id, coalesce(min_by(u.chunk_id, u.chunk_index), any_value(f.chunk_id)) AS chunk_id
FROM ({ASSETS_CTE}) a LEFT JOIN ({USES_SQL}) u ON a.d = u.d AND a.k * 2 = u.n
JOIN chunks f ON f.document_id = a.d AND f.chunk_index = 0 GROUP BY a.asset_id""",
    ("chunks",),
)
def _(spark, sf):
    return J.link_assets(linked_assets(spark, sf), linked_chunks(spark, sf)).select("asset_id", "chunk_id")


@check(
    "retrieval_log",
    """SELECT qid AS request_id, coalesce(string_agg(chunk_id, ',' ORDER BY rank), '') AS chunk_ids,
  coalesce(string_agg(printf('%.3f', rerank_score), ',' ORDER BY rank), '') AS scores
FROM reqs LEFT JOIN results USING (qid) GROUP BY qid""",
    ("results", "reqs"),
)
def _(spark, sf):
    found = full_search(spark, sf).results.withColumnRenamed("qid", "request_id")
    log = J.retrieval_log(found, X.requests(spark, sf).select("request_id"))
    return log.select(
        "request_id",
        F.array_join("retrieved_chunk_ids", ",").alias("chunk_ids"),
        F.array_join(F.transform("rerank_scores", lambda s: F.format_string("%.3f", s)), ",").alias("scores"),
    )


def stage_logs(spark, sf):
    """Stage latencies of the sub-queries of a request, taken from the events table."""
    from shelfmark.sources.tables import read_table

    e = read_table(spark, sf, "events")
    return e.select(
        (F.col("user_id")).alias("request_id"),
        F.create_map(
            F.col("event_type"), F.floor("value").cast("int"), F.lit("rerank_ms"), (F.col("event_id") % 7).cast("int")
        ).alias("stage_latencies"),
    )


@check(
    "stage_latency",
    """SELECT request_id, stage, sum(ms)::bigint AS total_ms FROM (
  SELECT user_id AS request_id, event_type AS stage, floor(value)::bigint AS ms FROM events
  UNION ALL SELECT user_id, 'rerank_ms', event_id % 7 FROM events) GROUP BY ALL""",
)
def _(spark, sf):
    return J.stage_latency_sum(stage_logs(spark, sf))


@check(
    "apply_feedback",
    """SELECT qid AS request_id, CASE WHEN qid % 3 = 0 THEN CASE WHEN qid % 2 = 0 THEN 'good' ELSE 'bad' END ELSE NULL END AS feedback,
  CASE WHEN qid % 3 = 0 THEN 'note ' || qid END AS feedback_detail FROM reqs""",
    ("reqs",),
)
def _(spark, sf):
    r = X.requests(spark, sf)
    text = F.lit(None).cast("string")
    logs = r.select("request_id", text.alias("feedback"), text.alias("feedback_detail"))
    i = F.col("request_id")
    given = r.where(i % 3 == 0).select(
        "request_id",
        F.when(i % 2 == 0, "good").otherwise("bad").alias("feedback"),
        F.concat(F.lit("note "), i).alias("feedback_detail"),
        F.lit(2).alias("given_at"),
    )
    earlier = given.withColumns({"feedback": F.lit("unsure"), "feedback_detail": text, "given_at": F.lit(1)})
    return J.apply_feedback(logs, earlier.union(given))


@check(
    "unmatched_feedback",
    "SELECT qid + 1 AS request_id FROM reqs WHERE qid + 1 NOT IN (SELECT qid FROM reqs WHERE qid % 2 = 0)",
    ("reqs",),
)
def _(spark, sf):
    r = X.requests(spark, sf).select("request_id")
    return J.unmatched_feedback(r.where("request_id % 2 = 0"), r.select((F.col("request_id") + 1).alias("request_id")))


@check(
    "reuse_results",
    """WITH ev AS (SELECT event_id, user_id || ':' || event_type AS k, epoch_us(ts) AS us FROM events),
stored AS (SELECT event_id AS response_id, k, us FROM ev WHERE event_id % 3 = 0),
asked AS (SELECT event_id AS request_id, k, us FROM ev WHERE event_id % 3 <> 0),
served AS (SELECT a.*, (SELECT max_by(s.response_id, s.us) FROM stored s WHERE s.k = a.k AND a.us >= s.us AND a.us - s.us < 86400000000) AS hit FROM asked a)
SELECT request_id, coalesce(hit, first)::bigint AS response_id, hit IS NOT NULL AS cache_hit, hit IS NULL AND first = request_id AS computed FROM (
  SELECT *, CASE WHEN hit IS NULL THEN first_value(request_id) OVER (PARTITION BY k, hit IS NULL ORDER BY us, request_id) END AS first FROM served)""",
)
def _(spark, sf):
    from shelfmark.sources.tables import read_table

    e = read_table(spark, sf, "events")
    key = F.concat_ws(":", "user_id", "event_type")
    i = F.col("event_id")
    at = F.col("ts").cast("timestamp")
    asked = e.where(i % 3 != 0).select(i.alias("request_id"), key.alias("cache_key"), at.alias("requested_at"))
    stored = e.where(i % 3 == 0).select(i.cast("string").alias("response_id"), key.alias("cache_key"), at.alias("stored_at"))
    served = J.reuse_results(asked, stored, ttl_seconds=86400)
    return served.select("request_id", F.col("response_id").cast(big).alias("response_id"), "cache_hit", "computed")


# --- context and answers -------------------------------------------------------------------------


@check(
    "number_sources",
    "SELECT qid AS request_id, 'S' || rank AS source_id, chunk_id FROM results",
    ("results",),
)
def _(spark, sf):
    numbered = O.number_sources(full_search(spark, sf).results)
    return numbered.select(F.col("qid").alias("request_id"), "source_id", "chunk_id")


@check(
    "source_context",
    """SELECT q.qid AS request_id, coalesce(nullif(c.text, ''), 'No source chunks were retrieved.') AS context
FROM reqs q LEFT JOIN (SELECT qid, arg_max(text, rank) AS text FROM context_steps GROUP BY qid) c ON c.qid = q.qid""",
    ("reqs", "context_steps"),
)
def _(spark, sf):
    found = full_search(spark, sf).results.withColumn("page_num", F.lit(None).cast("int"))
    answered = O.source_context(requests(spark, sf).select("qid", "query"), found, 2000)
    return answered.select(F.col("qid").alias("request_id"), "context")


@check(
    "extractive_answer",
    """SELECT q.qid AS request_id, coalesce('## Answer' || chr(10) || chr(10) || 'Reason.' || chr(10) || chr(10) ||
  'These are the highest-scoring MCP source chunks for checking RAG recall.' || chr(10) || chr(10) || ex || chr(10) || chr(10) ||
  '## Sources' || chr(10) || chr(10) || li,
  '## Answer' || chr(10) || chr(10) || 'MCP retrieval returned no usable sources, so this question cannot be answered from the current knowledge bases.'
  || chr(10) || chr(10) || '## Question' || chr(10) || chr(10) || trim(q.query)) AS answer
FROM reqs q LEFT JOIN (SELECT qid,
  string_agg('### S' || rank || ' - ' || document_name || chr(10) || chr(10) || trim(content), chr(10) ORDER BY rank) FILTER (WHERE rank <= 3) AS ex,
  string_agg('- [S' || rank || '] `' || document_name || '` - authority ' || authority_level || ' - ' || review_status || ' - chunk `' || chunk_id ||
    '` - score `' || printf('%.4f', score) || '`', chr(10) ORDER BY rank) AS li FROM results GROUP BY qid) r ON q.qid = r.qid""",
    ("results", "reqs"),
)
def _(spark, sf):
    found = full_search(spark, sf).results
    answered = O.extractive_answer(requests(spark, sf).select("qid", "query"), found, "Reason.")
    return answered.select(F.col("qid").alias("request_id"), "answer")


def pictured_results(spark, sf):
    """Chunks as results of one question per document, with their assets."""
    rows = linked_chunks(spark, sf).withColumns({"qid": F.col("document_id"), "rank": F.col("chunk_index") + 1})
    return J.attach_assets(rows, linked_assets(spark, sf))


@check(
    "select_images",
    f"""SELECT qid, asset_id, image_rank FROM (
  SELECT qid, asset_id, row_number() OVER (PARTITION BY qid ORDER BY r, p) AS image_rank FROM (
    SELECT a.document_id AS qid, a.asset_id, arg_min(u.chunk_index, u.chunk_index * 2 + u.pos) AS r, arg_min(u.pos, u.chunk_index * 2 + u.pos) AS p
    FROM ({ASSETS_CTE}) a JOIN ({USES_SQL}) u ON a.d = u.d AND a.k * 2 = u.n WHERE a.k % 2 = 0 GROUP BY ALL)) WHERE image_rank <= 2""",
    ("chunks",),
)
def _(spark, sf):
    chosen = O.select_images(pictured_results(spark, sf), 2)
    return chosen.select("qid", "asset_id", F.col("image_rank").cast(big).alias("image_rank"))


@check("asset_section")
def _(spark, sf):
    numbered = O.number_sources(pictured_results(spark, sf))
    sources = O._sources(numbered, F.col("source_id"), F.col("assets"))
    labelled = O.labelled_assets(F.col("sources"))
    return sources.select("qid", O.asset_section(F.lit("Answer."), labelled).alias("answer"))
