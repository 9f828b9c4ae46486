"""Checks of chunking, reports, filters and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import fixtures as X
from shelfmark.checks.base import check, split_sql
from shelfmark.functions.hashing import text_hash
from shelfmark.operators import chunking as C
from shelfmark.operators import filters as B
from shelfmark.operators import reports as D
from shelfmark.plans.ingest import build_chunks, ingest
from shelfmark.sources.tables import read_table

big = "bigint"


@check(
    "merge_blocks",
    """SELECT d AS document_id, row_number() OVER (PARTITION BY d ORDER BY n, i) - 1 AS chunk_index, made[i].k AS chunk_type, made[i].c AS content, made[i].o AS opener
FROM (SELECT d, n, made, unnest(range(1, len(made) + 1)) AS i FROM (
  SELECT d, n, made FROM merge_steps
  UNION ALL SELECT d, n + 1, [{'c': array_to_string(held, ' '), 'k': 'text', 'o': opener}] FROM merge_steps
    WHERE len(held) > 0 AND (d, n) IN (SELECT (d, max(n)) FROM turn_blocks GROUP BY d)))""",
    ("merge_steps",),
)
def _(spark, sf):
    made = C.merge_blocks(X.blocks(spark, sf), 40, 6)
    return made.select("document_id", F.col("chunk_index").cast(big).alias("chunk_index"), "chunk_type", "content", F.col("opener").cast(big).alias("opener"))


@check(
    "build_chunks",
    "SELECT chunk_id, document_id, chunk_index::bigint AS chunk_index, sha256(content) AS content_hash FROM chunks",
    ("chunks",),
)
def _(spark, sf):
    docs = X.dealt(X.documents(spark, sf)).withColumn("route", F.lit("text"))
    made = build_chunks(docs, X.knowledge_bases(spark, sf))
    return made.select("chunk_id", "document_id", F.col("chunk_index").cast(big).alias("chunk_index"), "content_hash")


MIXED_KINDS = ["txt", "md", "html", "pdf", "png", "exe", "txt", "txt"]


def mixed_documents(spark, sf):
    """Documents of all kinds by turns of eight; the seventh is of an unknown KB, the eighth has no content."""
    d = X.dealt(X.documents(spark, sf).select("document_id", "kb_id", "name", "tags", "content"))
    turn, lines = F.col("document_id") % 8, F.split("content", "\n")
    marked = F.replace(F.replace("content", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    image = F.concat(F.lit(" ![p](data:image/png;base64,"), F.base64(F.col("content").cast("binary")), F.lit(")"))
    listed = F.to_json(F.transform(lines, lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))))
    return d.select(
        "document_id",
        F.when(turn == 6, 99).otherwise(F.col("kb_id")).alias("kb_id"),
        "name",
        F.element_at(F.array(*[F.lit(k) for k in MIXED_KINDS]), (turn + 1).cast("int")).alias("file_type"),
        "tags",
        F.when(turn == 1, F.concat(F.lit("# Head\n\nbody"), F.regexp_replace(image, r"[\r\n]", "")))
        .when(turn == 2, F.concat(F.lit("<h1>T</h1><p>"), marked, F.lit("</p>")))
        .when((turn == 3) & (F.col("document_id") % 16 == 3), F.lit("[]"))
        .when(turn == 3, listed)
        .when(turn != 7, F.col("content"))
        .alias("content"),
    )


@check(
    "ingest_outcomes",
    f"""SELECT document_id, CASE WHEN reason IS NULL THEN 'completed' ELSE 'failed' END AS status, reason AS error, coalesce(n, -1) AS chunk_count FROM (
  SELECT document_id, CASE document_id % 8 WHEN 3 THEN CASE WHEN document_id % 16 = 3 THEN 'empty_layout' END WHEN 4 THEN 'unsupported_image'
    WHEN 5 THEN 'Unsupported document type: exe' WHEN 6 THEN 'unknown_kb' WHEN 7 THEN 'missing_content' END AS reason,
    CASE document_id % 8 WHEN 0 THEN {split_sql()} WHEN 1 THEN 2 END::bigint AS n FROM toks)""",
    ("toks",),
)
def _(spark, sf):
    """One row per document of every kind: completed, or the reason; chunk counts of plain and Markdown texts."""
    done = ingest(mixed_documents(spark, sf), X.knowledge_bases(spark, sf)).outcomes
    return done.select("document_id", "status", "error", F.when(F.col("document_id") % 8 < 2, F.col("chunk_count").cast(big)).otherwise(F.lit(-1).cast(big)).alias("chunk_count"))


@check(
    "ingest_mixed",
    """SELECT document_id, 1::bigint AS images, sha256(content) AS image_hash, true AS linked, 0::bigint AS paths_left FROM docs WHERE document_id % 8 = 1""",
    ("docs",),
)
def _(spark, sf):
    """Embedded images of documents of all kinds in one ingest: content, a chunk that holds their URL, and no path left in any chunk."""
    done = ingest(mixed_documents(spark, sf), X.knowledge_bases(spark, sf), once=True)
    counts = done.assets.groupBy("document_id").agg(F.count(F.lit(1)).alias("images"), F.max("file_hash").alias("image_hash"))
    held = done.chunks.select("chunk_id", "content")
    linked = done.assets.join(held.withColumnRenamed("content", "text"), "chunk_id").groupBy("document_id").agg(F.bool_and(F.col("text").contains(F.col("url"))).alias("linked"))
    paths = done.chunks.groupBy("document_id").agg(F.count(F.when(F.col("content").contains("](assets/"), 1)).alias("paths_left"))
    return counts.join(linked, "document_id").join(paths, "document_id")


def pictured_documents(spark, sf):
    """(documents, delivered assets): every document as Markdown, HTML or a layout list with a picture after every line.

    Each picture is a file of its own. References to it are written in the ways its aliases allow.
    """
    d = X.dealt(X.documents(spark, sf).select("document_id", "kb_id", "name", "tags", "content"))
    turn, lines = F.col("document_id") % 3, F.split("content", "\n")
    path = lambda n: F.concat(F.lit("images/p("), n.cast("string"), F.lit(").png"))
    marked = F.transform(lines, lambda t, n: F.concat(F.lit("![p]( "), path(n), F.lit(" )\n\nline "), n.cast("string")))
    tags = F.transform(lines, lambda t, n: F.concat(F.lit("<p>line "), n.cast("string"), F.lit("</p><img src='./IMAGES/P("), n.cast("string"), F.lit(").png'>")))
    listed = F.to_json(F.flatten(F.transform(lines, lambda t, n: F.array(
        F.struct(F.lit("text").alias("type"), F.concat(F.lit("line "), n.cast("string")).alias("text"), F.lit(None).cast("string").alias("img_path")),
        F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), path(n).alias("img_path")),
    ))))
    docs = d.select(
        "document_id", "kb_id", "name", "tags",
        F.when(turn == 0, "md").when(turn == 1, "html").otherwise("pdf").alias("file_type"),
        F.when(turn == 0, F.array_join(marked, "\n\n")).when(turn == 1, F.array_join(tags, "")).otherwise(listed).alias("content"),
    )
    files = d.select("document_id", "kb_id", F.posexplode(lines).alias("asset_index", "line"))
    assets = files.select(
        "document_id", "kb_id", "asset_index", F.lit("image").alias("asset_type"), path(F.col("asset_index")).alias("source_path"),
        F.lit("image/png").alias("content_type"), F.array(F.concat(F.lit("./"), path(F.col("asset_index")))).alias("aliases"),
        F.col("line").cast("binary").alias("content"),
    )
    return docs, assets


@check(
    "ingest_assets",
    """SELECT document_id, len(string_split(content, chr(10)))::bigint AS images, true AS linked, 0::bigint AS paths_left FROM docs""",
    ("docs",),
)
def _(spark, sf):
    """Files delivered beside documents of three kinds in one ingest: each hangs on a chunk that holds its URL, and no path is left."""
    docs, files = pictured_documents(spark, sf)
    done = ingest(docs, X.knowledge_bases(spark, sf), assets=files, once=True)
    held = done.chunks.select("chunk_id", F.col("content").alias("text"))
    assets = done.assets.join(held, "chunk_id").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("images"), F.bool_and(F.col("text").contains(F.col("url"))).alias("linked")
    )
    paths = done.chunks.groupBy("document_id").agg(F.count(F.when(F.lower("content").contains("images/"), 1)).alias("paths_left"))
    return assets.join(paths, "document_id")


@check("build_structured_chunks")
def _(spark, sf):
    pages = X.dealt(read_table(spark, sf, "pages")).select(
        F.col("page_id").alias("document_id"),
        (F.col("page_id") % 4).alias("kb_id"),
        F.col("url").alias("name"),
        F.lit("html").alias("file_type"),
        F.array().cast("array<string>").alias("tags"),
        F.col("html").alias("content"),
    )
    done = ingest(pages, X.knowledge_bases(spark, sf))
    return done.chunks.select("document_id", F.col("chunk_index").cast(big).alias("chunk_index"), "chunk_type", "content", "metadata")


def sheet_lines(spark, sf):
    """Orders as worksheets: one sheet per priority, rows numbered by order key.

    Rows are keyed by their order number, so positions come from the key itself
    after one ordered count per sheet.
    """
    from shelfmark.operators.segments import running

    o = read_table(spark, sf, "orders")
    cells = F.array(
        F.col("o_orderkey").cast("string"),
        "o_orderstatus",
        F.format_string("%.2f", "o_totalprice"),
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")),
    )
    rows = C.sheet_rows(
        o.withColumn("row_number", F.col("o_orderkey") + 1).withColumnRenamed("o_orderpriority", "sheet"),
        ["sheet"],
        cells,
        "row_number",
    )
    counted = running(rows, ["sheet"], "row_number", {"__n": ("sum", F.lit(1))})
    return counted.withColumn("position", F.col("__n") - 1).drop("__n")


@check(
    "sheet_chunks",
    """SELECT sheet, part AS chunk_part, 'Sheet: ' || sheet || chr(10) || string_agg(line, chr(10) ORDER BY position) AS content,
  min(row_number) AS row_start, max(row_number) AS row_end, count(*) AS row_count FROM sheet_steps GROUP BY sheet, part""",
    ("sheet_steps",),
)
def _(spark, sf):
    made = C.sheet_chunks(sheet_lines(spark, sf), ["sheet"], "sheet", "position")
    return made.withColumns({c: F.col(c).cast(big) for c in ("chunk_part", "row_count")})


@check(
    "sheet_rows",
    """SELECT o_orderpriority AS sheet, o_orderkey + 1 AS row_number, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS position,
  'R' || (o_orderkey + 1) || ': ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || printf('%.2f', o_totalprice) ||
  CASE WHEN o_orderkey % 3 = 0 THEN ' | ' || strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS line FROM orders""",
)
def _(spark, sf):
    return sheet_lines(spark, sf).select("sheet", "row_number", F.col("position").cast(big).alias("position"), "line")


@check(
    "sheet_profile",
    """SELECT 'orders' AS workbook, count(DISTINCT o_orderpriority) AS sheet_count, count(*) AS row_count,
  sum(CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 3 END)::bigint AS cell_count FROM orders""",
)
def _(spark, sf):
    return D.sheet_profile(sheet_lines(spark, sf).withColumn("workbook", F.lit("orders")), ["workbook"], "sheet")


@check(
    "merge_overlaps",
    "SELECT document_id, chunk_index, n AS overlap_characters, sha256(substr(text, n + 1)) AS unique_hash FROM overlap_steps",
    ("overlap_steps",),
)
def _(spark, sf):
    made = C.merge_overlaps(X.chunks(spark, sf))
    return made.select("document_id", F.col("chunk_index").cast(big).alias("chunk_index"), F.col("overlap_characters").cast(big).alias("overlap_characters"), text_hash(F.col("unique_content")).alias("unique_hash"))


@check(
    "overlap_stats",
    """SELECT document_id, sum(n)::bigint AS total_overlap_characters, count(*) FILTER (WHERE n > 0) AS overlapped_chunk_count
FROM overlap_steps GROUP BY document_id""",
    ("overlap_steps",),
)
def _(spark, sf):
    return C.overlap_stats(C.merge_overlaps(X.chunks(spark, sf)))


@check(
    "rebuild_documents",
    r"""SELECT document_id, 0 AS part, string_agg(CASE WHEN chunk_index > 0 AND text <> '' AND n = 0 THEN chr(10) || chr(10) ELSE '' END || substr(text, n + 1), '' ORDER BY chunk_index) AS content
FROM overlap_steps GROUP BY document_id""",
    ("overlap_steps",),
)
def _(spark, sf):
    return C.rebuild_documents(C.merge_overlaps(X.chunks(spark, sf)))


# --- filters -------------------------------------------------------------------------------------


@check(
    "governance_filter",
    """SELECT 'default' AS mode, document_id FROM docs WHERE review_status = 'published'
UNION ALL SELECT 'open', document_id FROM docs WHERE authority_level <= 3
UNION ALL SELECT 'exact', document_id FROM docs WHERE review_status = 'reviewed' AND governance_source_type = 'src6' AND authority_level = 2
UNION ALL SELECT 'blank', document_id FROM docs WHERE review_status = 'published'""",
    ("docs",),
)
def _(spark, sf):
    d = X.documents(spark, sf)
    modes = {
        "default": {},
        "open": {"include_unpublished": True, "review_status": "draft", "max_authority_level": 3},
        "exact": {"review_status": "reviewed", "governance_source_type": "src6", "authority_level": 2},
        "blank": {"review_status": "", "authority_level": "2"},
    }
    parts = [B.governance_filter(d, f).select(F.lit(m).alias("mode"), "document_id") for m, f in modes.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@check(
    "payload_filter",
    "SELECT chunk_id FROM chunks WHERE lang = 'en' AND source = 'src1'",
    ("chunks",),
)
def _(spark, sf):
    return B.payload_filter(X.chunks(spark, sf), {"chunk_type": "text", "tags": ["en", "src1", 5]}).select("chunk_id")


@check(
    "kb_scope",
    """SELECT item_id AS request_id, CASE item_id % 4 WHEN 0 THEN '0,1,2' WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE '0' END AS kbs,
  CASE item_id % 4 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END::bigint AS missing,
  CASE WHEN item_id % 4 >= 2 THEN 'knowledge_base_not_found' END AS scope_error FROM benchmark""",
)
def _(spark, sf):
    r = X.requests(spark, sf)
    lists = F.array(
        F.array().cast("array<bigint>"),
        F.array(F.lit(1).cast(big)),
        F.array(F.lit(2).cast(big), F.lit(3).cast(big)),
        F.array(F.lit(0).cast(big), F.lit(77).cast(big)),
    )
    asked = r.withColumn("kb_ids", F.get(lists, (F.col("request_id") % 4).cast("int")))
    scoped = B.kb_scope(asked, X.knowledge_bases(spark, sf))
    return scoped.select(
        "request_id",
        F.array_join(F.sort_array("kb_ids").cast("array<string>"), ",").alias("kbs"),
        F.col("missing").cast(big).alias("missing"),
        "scope_error",
    )


@check(
    "list_documents",
    "SELECT document_id, name, status FROM docs WHERE kb_id = 1 AND status = 'completed' ORDER BY created_s DESC, document_id LIMIT 50",
    ("docs",),
)
def _(spark, sf):
    return B.list_documents(X.documents(spark, sf), kb_id=1).select("document_id", "name", "status")


@check(
    "facet_search",
    """SELECT 'active' AS facet, document_id FROM docs WHERE status IN ('pending', 'processing') AND contains(lower(name), 'doc-1')
UNION ALL SELECT 'failed', document_id FROM docs WHERE status = 'failed' AND contains(error_message, 'parse error 1')
UNION ALL SELECT 'draft', document_id FROM docs WHERE review_status = 'draft' AND governance_source_type = 'src16'""",
    ("docs",),
)
def _(spark, sf):
    d = X.documents(spark, sf)
    found = {
        "active": B.facet_search(d, "active", text=" DOC-1"),
        "failed": B.facet_search(d, "failed", text="Parse Error 1"),
        "draft": B.facet_search(d, "draft", source="src16"),
    }
    parts = [df.select(F.lit(n).alias("facet"), "document_id") for n, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check(
    "list_kbs",
    "SELECT kb_id, name, true AS listed FROM kbs WHERE status = 'active' UNION ALL SELECT kb_id, name, false FROM kbs",
    ("kbs",),
)
def _(spark, sf):
    k = X.knowledge_bases(spark, sf)
    active = B.list_kbs(k).select("kb_id", "name", F.lit(True).alias("listed"))
    return active.unionByName(B.list_kbs(k, include_inactive=True).select("kb_id", "name", F.lit(False).alias("listed")))


@check(
    "page_chunks",
    """SELECT c.chunk_id, c.chunk_index::bigint AS chunk_index, t.total FROM chunks c
  JOIN (SELECT document_id, count(*) AS total FROM chunks GROUP BY document_id) t USING (document_id) WHERE c.chunk_index BETWEEN 2 AND 6""",
    ("chunks",),
)
def _(spark, sf):
    page = B.page_chunks(X.chunks(spark, sf), offset=2, limit=5)
    return page.select("chunk_id", F.col("chunk_index").cast(big).alias("chunk_index"), "total")


def raw_documents(spark, sf):
    i = F.col("document_id")
    return X.documents(spark, sf).select(
        "document_id",
        F.when(i % 31 == 0, "").otherwise(F.col("name")).alias("name"),
        F.when(i % 29 == 0, "").otherwise(F.col("content")).alias("content"),
        F.when(i % 23 == 0, "exe").when(i % 2 == 0, "markdown").alias("file_type"),
        F.when(i % 19 == 0, "   ").otherwise(F.concat(F.lit(" "), "governance_source_type")).alias("governance_source_type"),
        F.when(i % 17 == 0, 0).otherwise(F.col("authority_level")).alias("authority_level"),
        F.when(i % 13 == 0, "secret").otherwise(F.col("review_status")).alias("review_status"),
    )


@check(
    "validate_documents",
    """SELECT document_id, CASE WHEN document_id % 19 = 0 THEN '' ELSE governance_source_type END AS governance_source_type,
  CASE WHEN document_id % 31 = 0 THEN 'invalid_name' WHEN document_id % 29 = 0 THEN 'empty_content' WHEN document_id % 23 = 0 THEN 'invalid_file_type'
    WHEN document_id % 19 = 0 THEN 'invalid_governance_source_type' WHEN document_id % 17 = 0 THEN 'invalid_authority_level'
    WHEN document_id % 13 = 0 THEN 'invalid_review_status' END AS reason FROM docs""",
    ("docs",),
)
def _(spark, sf):
    return B.validate_documents(raw_documents(spark, sf)).select("document_id", "governance_source_type", "reason")


@check(
    "validate_kbs",
    """SELECT s_suppkey AS kb_id, CASE WHEN s_suppkey % 11 = 0 THEN 'invalid_name' WHEN s_suppkey % 7 = 0 THEN 'invalid_embedding_dim' WHEN s_suppkey % 5 = 0 THEN 'invalid_chunk_size'
  WHEN s_suppkey % 3 = 0 THEN 'invalid_chunk_overlap' WHEN count(*) OVER (PARTITION BY n) > 1 THEN 'duplicate_name' END AS reason
FROM (SELECT *, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE 'kb ' || s_nationkey END AS n FROM supplier)""",
)
def _(spark, sf):
    s = read_table(spark, sf, "supplier")
    i = F.col("s_suppkey")
    kbs = s.select(
        i.alias("kb_id"),
        F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("kb "), "s_nationkey")).alias("name"),
        F.when(i % 7 == 0, 0).alias("embedding_dim"),
        F.when(i % 5 == 0, 127).alias("chunk_size"),
        F.when(i % 3 == 0, -1).alias("chunk_overlap"),
        F.lit("active").alias("status"),
    )
    return B.validate_kbs(kbs).select("kb_id", "reason")


@check(
    "validate_requests",
    """SELECT item_id AS request_id, CASE WHEN item_id % 7 = 0 THEN 'empty_query' WHEN item_id % 5 = 0 THEN 'invalid_top_k' WHEN item_id % 3 = 0 THEN 'invalid_score_threshold'
  WHEN item_id % 2 = 0 THEN 'invalid_max_sub_queries' END AS reason FROM benchmark""",
)
def _(spark, sf):
    r = X.requests(spark, sf)
    i = F.col("request_id")
    asked = r.select(
        "request_id",
        F.when(i % 7 == 0, "").otherwise(F.col("query")).alias("query"),
        F.when(i % 5 == 0, 51).alias("top_k"),
        F.when(i % 3 == 0, -0.5).alias("score_threshold"),
        F.when(i % 2 == 0, 9).alias("max_sub_queries"),
    )
    return B.validate_requests(asked).select("request_id", "reason")


def asset_table(spark, sf):
    """Page bodies as stored assets."""
    p = read_table(spark, sf, "pages")
    i = F.col("page_id")
    return p.select(
        (i % 10).alias("document_id"),
        i.alias("asset_id"),
        F.floor(i / 10).alias("asset_index"),
        F.when(i % 9 == 0, "file").otherwise("image").alias("asset_type"),
        X.pick(["image/png", "IMAGE/JPEG; q=1", "image/svg+xml", "text/html", "image/webp "], i % 5).alias("content_type"),
        F.octet_length("html").cast(big).alias("file_size"),
        F.encode("html", "UTF-8").alias("content"),
    )


@check("image_assets", "SELECT page_id AS asset_id FROM pages WHERE page_id % 9 <> 0 AND page_id % 5 IN (0, 1, 4)")
def _(spark, sf):
    return B.image_assets(asset_table(spark, sf)).select("asset_id")


@check(
    "export_assets",
    """SELECT page_id AS asset_id, CASE WHEN n <= 5000 THEN sha256(base64(encode(html))) END AS data_hash,
  CASE WHEN n <= 5000 AND page_id % 5 IN (0, 2, 4) THEN sha256('data:' || ['image/png', '', 'image/svg+xml', '', 'image/webp '][(page_id % 5)::int + 1] || ';base64,' || base64(encode(html))) END AS uri_hash,
  CASE WHEN n > 5000 THEN 'asset is ' || n || ' bytes, larger than max_bytes=5000' END AS reason FROM (SELECT *, strlen(html) AS n FROM pages)""",
)
def _(spark, sf):
    out = B.export_assets(asset_table(spark, sf), 5000)
    return out.select("asset_id", F.sha2("data", 256).alias("data_hash"), F.sha2("data_uri", 256).alias("uri_hash"), "reason")


@check("list_assets", "SELECT page_id AS asset_id FROM pages WHERE page_id % 10 = 3")
def _(spark, sf):
    return B.list_assets(asset_table(spark, sf), 3).select("asset_id")


# --- reports ---------------------------------------------------------------------------------------


@check(
    "kb_counts",
    """SELECT k.kb_id, k.status, coalesce(d.n, 0) AS document_count, coalesce(c.n, 0) AS chunk_count FROM (SELECT * FROM kbs UNION ALL SELECT * REPLACE (4 AS kb_id) FROM kbs WHERE kb_id = 3) k
  LEFT JOIN (SELECT kb_id, count(*) AS n FROM docs GROUP BY kb_id) d ON d.kb_id = k.kb_id
  LEFT JOIN (SELECT kb_id, count(*) AS n FROM chunks GROUP BY kb_id) c ON c.kb_id = k.kb_id""",
    ("kbs", "docs", "chunks"),
)
def _(spark, sf):
    kbs = X.knowledge_bases(spark, sf)
    empty = kbs.where("kb_id = 3").withColumn("kb_id", F.lit(4).cast(kbs.schema["kb_id"].dataType))  # holds no document
    counted = D.kb_counts(kbs.unionByName(empty), X.documents(spark, sf), X.chunks(spark, sf))
    return counted.select("kb_id", "status", "document_count", "chunk_count")


@check(
    "document_facets",
    """SELECT count(*) AS total, sum(document_id % 9)::bigint AS chunks, count(*) FILTER (WHERE status IN ('pending', 'processing')) AS active,
  count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE review_status = 'draft') AS draft,
  count(*) FILTER (WHERE review_status = 'reviewed') AS reviewed, count(*) FILTER (WHERE review_status = 'published') AS published,
  count(*) FILTER (WHERE review_status = 'deprecated') AS deprecated, count(*) FILTER (WHERE review_status IN ('draft', 'reviewed')) AS draft_like FROM docs""",
    ("docs",),
)
def _(spark, sf):
    return D.document_facets(X.documents(spark, sf).withColumn("chunk_count", F.col("document_id") % 9))


@check("source_labels", "SELECT DISTINCT source AS governance_source_type FROM documents WHERE source <> ''")
def _(spark, sf):
    return D.source_labels(X.documents(spark, sf))


@check(
    "corpus_overview",
    """SELECT (SELECT count(*) FROM kbs) AS knowledge_bases, (SELECT count(*) FROM kbs WHERE status = 'active') AS active,
  (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM chunks) AS chunks""",
    ("kbs", "docs", "chunks"),
)
def _(spark, sf):
    return D.corpus_overview(D.kb_counts(X.knowledge_bases(spark, sf), X.documents(spark, sf), X.chunks(spark, sf)))
