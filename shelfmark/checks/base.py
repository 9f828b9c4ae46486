"""Registry of check queries, and the fixture derivations stated in SQL.

Each check is a Spark query over the shared input tables and, where one exists,
an independent SQL statement of the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def check(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a Spark query, with the SQL body and the CTEs it reads."""

    def register(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(uses, sql)
        return query

    return register


def with_ctes(uses: tuple[str, ...], body: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        needs, _ = CTES[name]
        for need in needs:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in uses:
        visit(name)
    if not ordered:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + "\n" + body


def cte(name: str, body: str, needs: tuple[str, ...] = ()) -> None:
    CTES[name] = (needs, body)


def hash_index_sql(token: str) -> str:
    """sha256(token) mod 1000003 from eight 32-bit words."""
    total = "0::bigint"
    for word in range(8):
        piece = f"('0x' || substr(sha256({token}), {word * 8 + 1}, 8))::bigint"
        total = f"(({total}) * 954414 + {piece}) % 1000003"
    return total


def sparse_sql(source: str, keys: str, text: str) -> str:
    """Postings (keys, idx, val) of a text column."""
    return f"""
SELECT {keys}, idx, sum(n)::double AS val FROM (
  SELECT {keys}, w.idx, n FROM (
    SELECT {keys}, tok, count(*) AS n FROM (
      SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS tok FROM {source}
    ) GROUP BY ALL
  ) JOIN (
    SELECT tok AS wtok, {hash_index_sql('tok')} AS idx FROM (
      SELECT DISTINCT unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS tok FROM {source})
  ) w ON tok = w.wtok
) GROUP BY ALL"""


def split_sql(tokens: str = "t", size: int = 128, overlap: int = 16) -> str:
    step = size - overlap
    return (
        f"CASE WHEN len({tokens}) = 0 THEN 0 WHEN len({tokens}) <= {size} THEN 1 "
        f"ELSE 1 + ceil((len({tokens}) - {size}) / {step}.0)::int END"
    )


cte(
    "kbs",
    """SELECT DISTINCT doc_id % 4 AS kb_id, 'kb-' || (doc_id % 4) AS name, 'BAAI/bge-m3' AS embedding_model,
  1024 AS embedding_dim, 128 AS chunk_size, 16 AS chunk_overlap,
  CASE WHEN doc_id % 4 = 3 THEN 'archived' ELSE 'active' END AS status FROM documents""",
)
cte(
    "docs",
    """SELECT doc_id AS document_id, doc_id % 4 AS kb_id,
  'doc-' || CASE WHEN doc_id % 20 = 9 THEN doc_id - 4 ELSE doc_id END AS name, 'txt' AS file_type,
  strlen(text) AS file_size, NULL::varchar AS minio_path, sha256(text) AS file_hash, 'text' AS source_type,
  NULL::varchar AS source_url, source AS governance_source_type, (1 + doc_id % 5)::int AS authority_level,
  ['published', 'published', 'reviewed', 'draft', 'deprecated'][((doc_id // 5) % 5)::int + 1] AS review_status,
  1 AS current_version,
  ['completed', 'completed', 'completed', 'pending', 'processing', 'failed'][(doc_id % 6)::int + 1] AS status,
  CASE WHEN doc_id % 6 = 5 THEN 'parse error ' || doc_id END AS error_message,
  lang, source, 0 AS chunk_count, 1704067200 + doc_id * 60 AS created_s, text AS content FROM documents""",
)
cte(
    "toks",
    r"""SELECT document_id, kb_id, lang, source,
  list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '') AS t FROM docs""",
    ("docs",),
)
cte(
    "wins",
    f"""SELECT document_id, kb_id, lang, source, i AS chunk_index, list_slice(t, i * 112 + 1, i * 112 + 128) AS w
  FROM (SELECT *, unnest(range({split_sql()})) AS i FROM toks)""",
    ("toks",),
)
cte(
    "chunks",
    """SELECT substr(sha256(document_id || ':' || chunk_index), 1, 32) AS chunk_id, document_id, kb_id, lang, source,
  chunk_index, CASE WHEN list_max(list_transform(w, lambda x: len(x))) = 1 THEN array_to_string(w, '')
  ELSE array_to_string(w, ' ') END AS content FROM wins""",
    ("wins",),
)
cte("cpost", sparse_sql("chunks", "chunk_id, document_id, kb_id", "content"), ("chunks",))
cte("reqs", "SELECT item_id AS qid, text AS query FROM benchmark")
cte("qpost", sparse_sql("reqs", "qid", "query"), ("reqs",))
cte(
    "dense_index",
    """SELECT substr(sha256(doc_id || ':' || 0), 1, 32) AS chunk_id, doc_id AS document_id, doc_id % 4 AS kb_id,
  lang, source, embedding, label FROM embeddings JOIN documents ON vec_id = doc_id""",
)
cte("qvec", "SELECT item_id AS qid, embedding AS qe FROM benchmark JOIN embeddings ON item_id = vec_id")


def topk_hits(name: str, body: str, needs: tuple[str, ...], limit: int, item: str = "chunk_id") -> None:
    cte(
        name,
        f"""SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {item}) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid, kb_id ORDER BY score DESC, {item}) AS kb_rank FROM ({body})
) WHERE kb_rank <= {limit}""",
        needs,
    )


LIMIT = 100  # top_k 5 with the default governance filter
SPARSE_BODY = """SELECT qid, chunk_id, document_id, kb_id, sum(q.val * c.val) AS score
  FROM qpost q JOIN cpost c USING (idx) WHERE kb_id < 3 GROUP BY ALL"""
DENSE_BODY = """SELECT qid, chunk_id, document_id, kb_id,
  round(list_cosine_similarity(embedding::double[], qe::double[]), 6) AS score
  FROM dense_index CROSS JOIN qvec WHERE kb_id < 3"""
VISUAL_BODY = """SELECT qid, document_id AS asset_id, chunk_id, document_id, kb_id,
  round(list_cosine_similarity(embedding::double[], qe::double[]), 6) AS score
  FROM dense_index CROSS JOIN qvec WHERE kb_id < 3 AND label = 0"""
topk_hits("sparse_hits", SPARSE_BODY, ("qpost", "cpost"), LIMIT)
topk_hits("dense_hits", DENSE_BODY, ("qvec", "dense_index"), LIMIT)
topk_hits("visual_hits", VISUAL_BODY, ("qvec", "dense_index"), LIMIT, "asset_id")


def fuse_sql(lists: dict[str, str], key: str = "qid") -> str:
    stacked = " UNION ALL ".join(
        f"SELECT '{n}' AS ranking, {key}, chunk_id, document_id, kb_id, rank FROM {t}" for n, t in lists.items()
    )
    return f"""SELECT {key}, chunk_id, any_value(document_id) AS document_id, any_value(kb_id) AS kb_id,
  round(sum(1.0::double / (60 + rank)), 12) AS score FROM (
    SELECT ranking, {key}, chunk_id, document_id, kb_id, min(rank) AS rank FROM ({stacked}) GROUP BY ALL
  ) GROUP BY {key}, chunk_id"""


cte(
    "fused",
    fuse_sql({"dense": "dense_hits", "sparse": "sparse_hits", "visual": "visual_hits"}),
    ("dense_hits", "sparse_hits", "visual_hits"),
)
cte(
    "trimmed",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS fused_rank
  FROM fused) WHERE fused_rank <= {LIMIT}""",
    ("fused",),
)
cte(
    "hydrated",
    """SELECT f.*, c.chunk_index, c.content, d.name AS document_name, d.governance_source_type, d.authority_level,
  d.review_status, d.current_version AS document_version
  FROM trimmed f JOIN chunks c USING (chunk_id) JOIN docs d ON f.document_id = d.document_id""",
    ("trimmed", "chunks", "docs"),
)
RERANK = "((document_id * 31 + qid * 17) % 1000) / 1000.0::double"
cte(
    "reranked",
    f"""SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, fused_rank) AS rerank_rank FROM (
  SELECT *, {RERANK} AS rerank_score FROM hydrated WHERE review_status = 'published')""",
    ("hydrated",),
)
cte(
    "results",
    """SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY qid ORDER BY authority_level, rerank_score DESC, rerank_rank) AS rank FROM reranked) WHERE rank <= 5""",
    ("reranked",),
)


# --- folds stated as recursive queries ---------------------------------------------------

cte(
    "sheet_lines",
    """SELECT o_orderpriority AS sheet, o_orderkey + 1 AS row_number,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS position,
  'R' || (o_orderkey + 1) || ': ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || printf('%.2f', o_totalprice) ||
  CASE WHEN o_orderkey % 3 = 0 THEN ' | ' || strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS line FROM orders""",
)
cte(
    "sheet_steps",
    """SELECT sheet, position, row_number, line, 1 AS part, 1 AS lines, len(line) + 1 AS chars FROM sheet_lines WHERE position = 0
UNION ALL SELECT sheet, position, row_number, line, CASE WHEN fresh THEN part + 1 ELSE part END, CASE WHEN fresh THEN 1 ELSE lines + 1 END,
  CASE WHEN fresh THEN len(line) + 1 ELSE chars + len(line) + 1 END FROM (
    SELECT l.*, s.part, s.lines, s.chars, s.lines >= 100 OR s.chars + len(l.line) > 500 AS fresh
    FROM sheet_steps s JOIN sheet_lines l ON l.sheet = s.sheet AND l.position = s.position + 1)""",
    ("sheet_lines",),
)
cte(
    "timed_events",
    """SELECT user_id AS key, event_id, epoch_us(ts) // 1000 AS ts_ms,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events""",
)
cte(
    "limit_steps",
    """SELECT key, event_id, ts_ms, n, [ts_ms] AS held, true AS allowed, 0 AS retry_after FROM timed_events WHERE n = 1
UNION ALL SELECT key, event_id, ts_ms, n, CASE WHEN len(inside) < 3 THEN list_append(inside, ts_ms) ELSE inside END, len(inside) < 3,
  CASE WHEN len(inside) < 3 THEN 0 ELSE greatest(1, (inside[1] + 3600000 - ts_ms + 999) // 1000) END FROM (
    SELECT e.*, list_filter(s.held, lambda t: t > e.ts_ms - 3600000) AS inside
    FROM limit_steps s JOIN timed_events e ON e.key = s.key AND e.n = s.n + 1)""",
    ("timed_events",),
)
cte(
    "turn_blocks",
    r"""SELECT conv_id AS d, turn, text, CASE WHEN turn % 5 = 4 THEN 'code' ELSE 'text' END AS kind, role = 'system' AS heading,
  list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n
FROM conversations WHERE trim(text, E' \n\t') <> ''""",
)


def _joined(words: str) -> str:
    return f"array_to_string({words}, ' ')"


MERGE_STEP = f"""SELECT d, n, turn, CASE WHEN atomic THEN []::varchar[] WHEN over THEN held[len(held) - least(6, len(held)) + 1:] || t ELSE held || t END AS held,
  CASE WHEN atomic THEN NULL WHEN over OR len(held) = 0 THEN turn ELSE opener END AS opener,
  CASE WHEN flushed OR over THEN [{{'c': {_joined('before')}, 'k': 'text', 'o': opener}}] ELSE [] END ||
  CASE WHEN kind <> 'text' THEN [{{'c': text, 'k': kind, 'o': turn}}]
    WHEN len(t) > 40 THEN list_transform(range(0, len(t) - 6, 34), lambda i: {{'c': {_joined('t[i + 1:i + 40]')}, 'k': 'text', 'o': turn}}) ELSE [] END AS made
FROM (SELECT *, NOT atomic AND len(held) > 0 AND len(held) + len(t) > 40 AS over FROM (
  SELECT *, CASE WHEN flushed THEN []::varchar[] ELSE before END AS held FROM (
    SELECT *, kind <> 'text' OR len(t) > 40 AS atomic, len(before) > 0 AND (kind <> 'text' OR len(t) > 40 OR heading) AS flushed FROM ({{0}}))))"""
cte(
    "merge_steps",
    MERGE_STEP.replace("{0}", "SELECT *, []::varchar[] AS before, NULL::bigint AS opener FROM turn_blocks WHERE n = 1")
    + " UNION ALL "
    + MERGE_STEP.replace(
        "{0}", "SELECT b.*, s.held AS before, s.opener FROM merge_steps s JOIN turn_blocks b ON b.d = s.d AND b.n = s.n + 1"
    ),
    ("turn_blocks",),
)
cte(
    "overlap_steps",
    r"""SELECT document_id, chunk_index, text, 0 AS n, text AS before FROM (SELECT *, trim(content, E' \n\t') AS text FROM chunks WHERE chunk_index = 0)
UNION ALL SELECT document_id, chunk_index, text, n, right(before || CASE WHEN before <> '' AND text <> '' AND n = 0 THEN E'\n\n' ELSE '' END || substr(text, n + 1), 8000) FROM (
  SELECT *, CASE WHEN len(regexp_replace(substr(text, 1, m), '\s', '', 'g')) >= 12 THEN m ELSE 0 END AS n FROM (
    SELECT *, coalesce(list_max(list_filter(range(12, least(len(before), len(text), 8000) + 1), lambda k: suffix(before, substr(text, 1, k)))), 0) AS m FROM (
    SELECT c.document_id, c.chunk_index, trim(c.content, E' \n\t') AS text, s.before
    FROM overlap_steps s JOIN chunks c ON c.document_id = s.document_id AND c.chunk_index = s.chunk_index + 1)))""",
    ("chunks",),
)
cte(
    "dedup_rows",
    """SELECT document_id, document_id % 2 AS kb, name, file_hash, row_number() OVER (PARTITION BY document_id % 2 ORDER BY document_id) AS n FROM docs""",
    ("docs",),
)
cte(
    "dedup_steps",
    """SELECT kb, n, document_id, [name] AS names, [file_hash] AS hashes, NULL::varchar AS reason FROM dedup_rows WHERE n = 1
UNION ALL SELECT kb, n, document_id, CASE WHEN reason IS NULL THEN list_append(names, name) ELSE names END,
  CASE WHEN reason IS NULL THEN list_append(hashes, file_hash) ELSE hashes END, reason FROM (
    SELECT r.*, s.names, s.hashes, CASE WHEN list_contains(s.names, r.name) THEN 'duplicate_name' WHEN list_contains(s.hashes, r.file_hash) THEN 'duplicate_file_hash' END AS reason
    FROM dedup_steps s JOIN dedup_rows r ON r.kb = s.kb AND r.n = s.n + 1)""",
    ("dedup_rows",),
)
CONTEXT_STEP = """SELECT qid, rank, CASE WHEN over THEN room_left ELSE room_left - len(block) END AS room_left, over,
  CASE WHEN over THEN text ELSE text || CASE WHEN text = '' THEN '' ELSE E'\n\n' END || block END AS text FROM (
  SELECT *, was_over OR room <= 0 AS over, head || E'\n' || CASE WHEN len(body) > room THEN rtrim(left(body, greatest(room, 0)), E' \n\t') || E'\n...[truncated]' ELSE body END AS block FROM (
    SELECT *, room_left - len(head) - 16 AS room FROM ({0})))"""
cte(
    "sources",
    """SELECT qid, rank, '[S' || rank || '] document=' || document_name || ', authority_level=' || authority_level || ', review_status=' || review_status ||
  ', source_type=' || governance_source_type || ', version=' || document_version || ', chunk_id=' || chunk_id || ', score=' || printf('%.4f', score) AS head,
  trim(content, E' \n\t') AS body FROM results""",
    ("results",),
)
cte(
    "context_steps",
    CONTEXT_STEP.format("SELECT *, 2000 AS room_left, false AS was_over, '' AS text FROM sources WHERE rank = 1")
    + " UNION ALL "
    + CONTEXT_STEP.format(
        "SELECT s.qid, s.rank, s.head, s.body, c.room_left, c.over AS was_over, c.text FROM context_steps c JOIN sources s ON s.qid = c.qid AND s.rank = c.rank + 1"
    ),
    ("sources",),
)
