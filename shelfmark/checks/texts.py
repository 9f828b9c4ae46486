"""Checks of text functions, sources and parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import fixtures as X
from shelfmark.checks.base import check, split_sql
from shelfmark.functions import progress as P
from shelfmark.functions import text as T
from shelfmark.functions.hashing import text_hash
from shelfmark.operators import chunking as C
from shelfmark.operators import parsing as M
from shelfmark.operators import reports
from shelfmark.operators.references import rewrite_asset_refs
from shelfmark.sources import tables as S

big = "bigint"


def texts(spark, sf):
    return X.documents(spark, sf).select("document_id", "kb_id", "name", "content")


def query_texts(spark, sf):
    """Passages dressed up as questions: spread spaces, separators, closing marks."""
    b = S.read_table(spark, sf, "benchmark")
    t = F.col("text")
    dressed = F.concat(F.lit("  "), F.substring(t, 1, 40), F.lit("  and "), F.substring(t, 41, 30), F.lit("; "), F.substr(t, F.lit(71)), F.lit(" ?! "))
    return b.select(F.col("item_id").alias("request_id"), dressed.alias("query"))


QUERY_SQL = """(SELECT item_id AS request_id, '  ' || substr(text, 1, 40) || '  and ' || substr(text, 41, 30) || '; ' ||
  substr(text, 71) || ' ?! ' AS query FROM benchmark)"""


@check("source_files")
def _(spark, sf):
    return S.source_files(spark, sf, "*.parquet").drop("content")


@check(
    "register_text",
    """SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'txt' ELSE 'md' END AS file_type, strlen(text) AS file_size,
  sha256(text) AS file_hash, 'text' AS source_type FROM documents""",
)
def _(spark, sf):
    i = F.col("document_id")
    rows = texts(spark, sf).withColumn(
        "file_type", F.when(i % 3 == 0, F.lit(None)).when(i % 3 == 1, "markdown").otherwise("md")
    )
    return S.source_text(rows).select("document_id", "file_type", "file_size", "file_hash", "source_type")


@check(
    "register_pages",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'page ' || page_id ELSE url END AS name, 'html' AS file_type,
  'url' AS source_type, url AS source_url, NULL::varchar AS file_hash, sha256(html) AS content_hash FROM pages""",
)
def _(spark, sf):
    pages = S.read_table(spark, sf, "pages").withColumn(
        "name", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("page "), "page_id"))
    )
    rows = S.source_pages(pages)
    return rows.select(
        "page_id", "name", "file_type", "source_type", "source_url", "file_hash", text_hash(F.col("content")).alias("content_hash")
    )


@check(
    "rewrite_query",
    f"SELECT request_id, regexp_replace(trim(regexp_replace(query, '\\s+', ' ', 'g')), '[?？。.!！]+$', '') AS rewritten FROM {QUERY_SQL}",
)
def _(spark, sf):
    return query_texts(spark, sf).select("request_id", T.rewrite_query(F.col("query")).alias("rewritten"))


@check(
    "decompose_query",
    f"""SELECT request_id, i - 1 AS pos, parts[i] AS part FROM (SELECT request_id, parts, unnest(range(1, least(len(parts), 3) + 1)) AS i FROM (
  SELECT request_id, list_filter(list_transform(regexp_split_to_array(query, '\\s*(?:\\band\\b|,|，|;|；|\\?|？)\\s*'), lambda p: trim(p, E' \\n\\t')), lambda p: p <> '') AS parts FROM {QUERY_SQL}))""",
)
def _(spark, sf):
    parts = T.decompose_query(F.col("query"), 3)
    return query_texts(spark, sf).select("request_id", F.posexplode(parts).alias("pos", "part")).withColumn(
        "pos", F.col("pos").cast(big)
    )


@check(
    "hyde_text",
    "SELECT item_id AS request_id, 'This hypothetical reference document answers the query: ' || text || '. It contains the key terms, entities, and context needed for retrieval.' AS hyde FROM benchmark",
)
def _(spark, sf):
    return X.requests(spark, sf).select("request_id", T.hyde_text(F.col("query")).alias("hyde"))


def mixed_contents(spark, sf):
    """Documents and pages under several declared types, some with Markdown added."""
    i = F.col("document_id")
    docs = texts(spark, sf).select(
        F.concat(F.lit("d"), i).alias("id"),
        X.pick(["txt", "md", ".HTML", "pdf", "csv"], i % 5).alias("file_type"),
        F.concat(X.pick(["", "# Head\n", "- item\n", "```\ncode\n```\n", "|a|b|\n|-|-|\n", "x $a_b$ ", "![p](q.png) "], i % 7), "content").alias("content"),
    )
    pages = S.read_table(spark, sf, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("id"),
        X.pick(["html", "htm", "txt"], F.col("page_id") % 3).alias("file_type"),
        F.col("html").alias("content"),
    )
    return docs.unionByName(pages)


MIXED_SQL = """(SELECT 'd' || doc_id AS id, ['txt', 'md', '.HTML', 'pdf', 'csv'][(doc_id % 5)::int + 1] AS file_type,
  ['', '# Head' || chr(10), '- item' || chr(10), '```' || chr(10) || 'code' || chr(10) || '```' || chr(10),
   '|a|b|' || chr(10) || '|-|-|' || chr(10), 'x $a_b$ ', '![p](q.png) '][(doc_id % 7)::int + 1] || text AS content FROM documents
  UNION ALL SELECT 'p' || page_id, ['html', 'htm', 'txt'][(page_id % 3)::int + 1], html FROM pages)"""
MD_TEST = r"""(regexp_matches(s, '(?m)^#{1,6}\s+\S') OR contains(s, '```') OR regexp_matches(s, '!\[[^\]]*\]\([^)]+\)')
  OR regexp_matches(s, '\|.+\|\s*\r?\n\|[-:|\s]+\|'))"""
HTML_TEST = r"""(regexp_matches(s, '(?i)^\s*<!doctype\s+html') OR
  regexp_matches(s, '(?i)<\s*(html|body|main|article|section|h[1-6]|p|table|ul|ol|pre|blockquote)\b'))"""


@check(
    "content_type",
    f"""SELECT id, CASE WHEN k IN ('html', 'htm') AND {HTML_TEST} THEN 'text/html; charset=utf-8'
  WHEN k IN ('md', 'markdown', 'pdf') OR {MD_TEST} THEN 'text/markdown; charset=utf-8' ELSE 'text/plain; charset=utf-8' END AS content_type
FROM (SELECT id, ltrim(lower(file_type), '.') AS k, substr(content, 1, 6000) AS s FROM {MIXED_SQL})""",
)
def _(spark, sf):
    return mixed_contents(spark, sf).select("id", T.parsed_content_type(F.col("file_type"), F.col("content")).alias("content_type"))


@check(
    "content_kind",
    f"""SELECT id, CASE WHEN k IN ('md', 'markdown') THEN 'markdown' WHEN k IN ('html', 'htm') THEN 'html'
  WHEN {MD_TEST} OR regexp_matches(s, '(?m)^\\s*[-*+]\\s+\\S') OR regexp_matches(s, '(?s)(^|[^\\\\])\\$\\$.+?\\$\\$')
    OR regexp_matches(s, '(?s)\\\\\\(.+?\\\\\\)|\\\\\\[.+?\\\\\\]') OR regexp_matches(s, '(?m)(^|[^\\\\])\\$[^$\\n]*(\\\\[a-zA-Z]+|[=^_])[^$\\n]*\\$') THEN 'markdown'
  WHEN {HTML_TEST} THEN 'html' ELSE 'text' END AS content_kind
FROM (SELECT id, ltrim(lower(file_type), '.') AS k, substr(content, 1, 6000) AS s FROM {MIXED_SQL})""",
)
def _(spark, sf):
    return mixed_contents(spark, sf).select("id", T.content_kind(F.col("file_type"), F.col("content")).alias("content_kind"))


@check("content_hash", "SELECT doc_id AS document_id, sha256(text) AS content_hash FROM documents")
def _(spark, sf):
    return texts(spark, sf).select("document_id", text_hash(F.col("content")).alias("content_hash"))


@check(
    "bound_input",
    """SELECT doc_id AS document_id, sha256(CASE WHEN len(text) > 1000 THEN regexp_replace(substr(text, 1, 1000), '\\s+$', '') ELSE text END) AS bounded FROM documents""",
)
def _(spark, sf):
    return texts(spark, sf).select("document_id", text_hash(T.bound_input(F.col("content"), 1000)).alias("bounded"))


@check(
    "tokenize",
    "SELECT document_id, len(t)::bigint AS n_tokens, sha256(array_to_string(t, chr(31))) AS token_hash FROM toks",
    ("toks",),
)
def _(spark, sf):
    rows = texts(spark, sf).select("document_id", T.tokenize(F.col("content")).alias("t"))
    return rows.select(
        "document_id", F.size("t").cast(big).alias("n_tokens"), text_hash(F.array_join("t", "\x1f")).alias("token_hash")
    )


@check(
    "paragraphs",
    """SELECT document_id, i - 1 AS block_index, ps[i] AS content FROM (SELECT document_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (
  SELECT doc_id AS document_id, list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)),
    lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS ps FROM documents))""",
)
def _(spark, sf):
    spaced = F.replace(F.col("content"), F.lit(". "), F.lit(".\n\n"))
    rows = C.paragraph_blocks(texts(spark, sf).select("document_id", spaced.alias("content")))
    return rows.withColumn("block_index", F.col("block_index").cast(big))


@check(
    "split_large",
    "SELECT document_id, chunk_index::bigint AS chunk_index, content FROM chunks",
    ("chunks",),
)
def _(spark, sf):
    return X.chunks(spark, sf).select("document_id", F.col("chunk_index").cast(big).alias("chunk_index"), "content")


@check(
    "chunk_index",
    f"""SELECT document_id, (n - 1)::bigint AS last_index, n::bigint AS n_chunks FROM (
  SELECT document_id, {split_sql()} AS n FROM toks) WHERE n > 0""",
    ("toks",),
)
def _(spark, sf):
    return (
        X.chunks(spark, sf)
        .groupBy("document_id")
        .agg(F.max("chunk_index").cast(big).alias("last_index"), F.count(F.lit(1)).alias("n_chunks"))
    )


@check(
    "progress",
    """SELECT doc_id AS document_id, (46 + floor(38 * least(1.0::double, (doc_id % 40)::double / 30)))::bigint AS overall,
  floor(least(1.0::double, (doc_id % 40)::double / 30) * 100)::double AS stage,
  CASE WHEN s IN ('completed', 'failed') THEN 100 WHEN doc_id % 4 = 0 THEN doc_id % 90 WHEN s = 'pending' THEN 18 ELSE 24 END::bigint AS shown
FROM (SELECT *, ['completed', 'completed', 'completed', 'pending', 'processing', 'failed'][(doc_id % 6)::int + 1] AS s FROM documents)""",
)
def _(spark, sf):
    i = F.col("document_id")
    done = (i % 40).cast("int")
    stored = F.when(i % 4 == 0, i % 90)
    d = X.documents(spark, sf)
    record = P.progress_struct("embedding", P.progress_between(F.lit(46), F.lit(84), done, F.lit(30)), "processing", "x")
    return d.select(
        "document_id",
        record["progress"].cast(big).alias("overall"),
        P.stage_percent(done, F.lit(30)).cast("double").alias("stage"),
        P.document_progress(F.col("status"), stored).cast(big).alias("shown"),
    )


# --- parsing ---------------------------------------------------------------------------------


@check(
    "text_blocks",
    "SELECT doc_id AS document_id, 0::bigint AS block_index, text AS content, 'text' AS chunk_type FROM documents WHERE trim(text) <> ''",
)
def _(spark, sf):
    rows = M.text_blocks(texts(spark, sf).select("document_id", "content"))
    return rows.withColumn("block_index", F.col("block_index").cast(big))


def markdown_docs(spark, sf):
    """Documents turned into Markdown: headings, a list, a table, code and images."""
    lines = F.split("content", "\n")
    i = F.col("document_id")

    def dress(line, n):
        level = F.repeat(F.lit("#"), (1 + n % 3).cast("int"))
        return (
            F.when(n % 7 == 0, F.concat(level, F.lit(" "), line))
            .when(n % 7 == 2, F.concat(F.lit("- "), line))
            .when(n % 7 == 3, F.concat(F.lit("```\n"), line, F.lit("\n\nmore\n```")))
            .when(n % 7 == 4, F.concat(F.lit("![pic](images/p"), n, F.lit(".png)")))
            .when(n % 7 == 5, F.concat(F.lit("|a|b|\n|---|---|\n|"), line, F.lit("|x|")))
            .otherwise(line)
        )

    text = F.array_join(F.transform(lines, dress), "\n\n")
    return X.dealt(texts(spark, sf)).select("document_id", "kb_id", "name", F.concat(text, F.lit("\n")).alias("content"))


def block_rows(df):
    return df.select(
        "document_id",
        F.col("block_index").cast(big).alias("block_index"),
        "chunk_type",
        "block_type",
        F.col("heading_level").cast(big).alias("heading_level"),
        F.array_join("title_path", " / ").alias("title_path"),
        "content",
    )


@check("markdown_blocks")
def _(spark, sf):
    return block_rows(M.markdown_blocks(markdown_docs(spark, sf)))


@check("html_blocks")
def _(spark, sf):
    pages = X.dealt(S.read_table(spark, sf, "pages"))
    rows = pages.select(F.col("page_id").alias("document_id"), F.col("html").alias("content"))
    return block_rows(M.html_blocks(rows))


def image_docs(spark, sf):
    """Documents with an embedded image after every line; every third is broken."""
    lines = F.split("content", "\n")

    def dress(line, n):
        data = F.regexp_replace(F.base64(line.cast("binary")), r"\s", "")
        payload = F.when(n % 3 == 2, F.lit("@@")).otherwise(data)
        return F.concat(line, F.lit(" ![p]("), F.lit("data:image/png;base64,"), payload, F.lit(")"))

    return texts(spark, sf).select(
        "document_id", "kb_id", "name", F.array_join(F.transform(lines, dress), "\n").alias("content")
    )


@check(
    "data_images",
    """SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY n) - 1) AS asset_index,
  'assets/' || name || '-' || row_number() OVER (PARTITION BY document_id ORDER BY n) || '.png' AS source_path,
  strlen(line) AS file_size, sha256(line) AS file_hash FROM (
  SELECT document_id, name, n - 1 AS n, lines[n] AS line FROM (
    SELECT document_id, name, lines, unnest(range(1, len(lines) + 1)) AS n FROM (SELECT document_id, name, string_split(content, chr(10)) AS lines FROM docs)))
WHERE n % 3 <> 2 AND line <> ''""",
    ("docs",),
)
def _(spark, sf):
    rows = M.asset_rows(M.extract_data_images(X.dealt(image_docs(spark, sf))))
    return rows.select(
        "document_id", F.col("asset_index").cast(big).alias("asset_index"), "source_path", "file_size", "file_hash"
    )


def layout_docs(spark, sf):
    """Layout JSON built from the lines of each document."""
    lines = F.split("content", "\n")

    def block(line, n):
        kind = F.when(n % 6 == 1, "table").when(n % 6 == 2, "equation").when(n % 6 == 3, "image").when(n % 6 == 4, "list").otherwise("text")
        return F.struct(
            kind.alias("type"),
            F.when(~kind.isin("list"), line).alias("text"),
            F.when(n % 6 == 0, 1 + n % 2).alias("level"),
            F.floor(n / 4).alias("page_idx"),
            F.array(n, n + 1).alias("bbox"),
            F.when(kind == "list", F.array(line, F.lit("two"))).alias("list_items"),
            F.when(kind == "image", F.array(F.lit("cap]"))).alias("caption"),
            F.when(kind == "image", F.concat(F.lit("images/"), n, F.lit(".png"))).alias("img_path"),
        )

    return texts(spark, sf).select("document_id", F.to_json(F.transform(lines, block)).alias("layout_json"))


@check(
    "content_list_blocks",
    r"""SELECT document_id, chunk_type, block_type, page_num, content, bbox FROM (SELECT document_id, n,
  CASE n % 6 WHEN 1 THEN 'table' WHEN 2 THEN 'equation' WHEN 3 THEN 'image' ELSE 'text' END AS chunk_type,
  CASE n % 6 WHEN 1 THEN 'table' WHEN 2 THEN 'equation' WHEN 3 THEN 'image' WHEN 4 THEN 'list' ELSE 'text' END AS block_type,
  (n // 4 + 1)::bigint AS page_num, '{"points":[' || n || ',' || (n + 1) || ']}' AS bbox,
  CASE n % 6 WHEN 2 THEN CASE WHEN t = '' THEN '' ELSE '$$' || chr(10) || t || chr(10) || '$$' END
    WHEN 3 THEN 'cap]' || chr(10) || '![cap\]](images/' || n || '.png)'
    WHEN 4 THEN ltrim(regexp_replace(line, '^\s+|\s+$', '', 'g') || chr(10) || 'two', chr(10)) ELSE t END AS content
FROM (SELECT document_id, n, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM (
  SELECT document_id, n - 1 AS n, lines[n] AS line FROM (
  SELECT document_id, lines, unnest(range(1, len(lines) + 1)) AS n FROM (SELECT document_id, string_split(content, chr(10)) AS lines FROM docs)))))
WHERE content <> ''""",
    ("docs",),
)
def _(spark, sf):
    rows = M.content_list_blocks(X.dealt(layout_docs(spark, sf)))
    return rows.select("document_id", "chunk_type", "block_type", F.col("page_num").cast(big).alias("page_num"), "content", "bbox")


@check(
    "route_by_type",
    """SELECT id, CASE WHEN k = 'txt' THEN 'text' WHEN k = 'md' THEN 'markdown' WHEN k IN ('html', 'htm') THEN 'html' WHEN k = 'pdf' THEN 'layout' END AS route,
  CASE WHEN k = 'csv' THEN 'Unsupported document type: csv' END AS error FROM (SELECT id, ltrim(lower(file_type), '.') AS k FROM """
    + MIXED_SQL
    + ")",
)
def _(spark, sf):
    return M.route_by_type(mixed_contents(spark, sf)).select("id", "route", "error")


@check(
    "title_path",
    """SELECT document_id, block_index, coalesce((SELECT p.title FROM heads p WHERE p.document_id = b.document_id AND p.block_index < b.block_index
    ORDER BY p.block_index DESC LIMIT 1), '') AS title_path FROM b""".replace(
        "SELECT document_id, block_index, coalesce(",
        """WITH b AS (SELECT conv_id AS document_id, turn AS block_index, role, text FROM conversations),
heads AS (SELECT document_id, block_index, regexp_replace(string_split(regexp_replace(text, '^\\s+', ''), chr(10))[1], '\\s+$', '') AS title FROM b WHERE role = 'user')
SELECT document_id, block_index, coalesce(""",
        1,
    ),
)
def _(spark, sf):
    b = X.blocks(spark, sf).withColumn("heading_level", F.when(F.col("block_type") == "user", 1).otherwise(0))
    rows = M.title_path(b)
    return rows.select(
        "document_id", F.col("block_index").cast(big).alias("block_index"), F.array_join("title_path", " / ").alias("title_path")
    )


@check(
    "title_path_levels",
    """SELECT document_id, block_index, array_to_string(CASE WHEN level > 0 AND title <> '' THEN list_reduce(heads[:-2], lambda s, x: CASE WHEN x[1] = '0' THEN s ELSE list_append(s[1:x[1]::int - 1], x[2]) END)
  ELSE list_reduce(heads, lambda s, x: CASE WHEN x[1] = '0' THEN s ELSE list_append(s[1:x[1]::int - 1], x[2]) END) END, ' / ') AS title_path FROM (
  SELECT document_id, block_index, level, title, list_prepend([]::varchar[], list([CASE WHEN title = '' THEN '0' ELSE level::varchar END, title]) OVER (PARTITION BY document_id ORDER BY block_index)) AS heads FROM (
    SELECT conv_id AS document_id, turn AS block_index, (turn * 7 + conv_id) % 6 AS level,
      regexp_replace(string_split(regexp_replace(text, '^\\s+', ''), chr(10))[1], '\\s+$', '') AS title FROM conversations))""",
)
def _(spark, sf):
    """Headings of five levels in any order, so that levels are skipped and popped."""
    b = X.blocks(spark, sf).withColumn("heading_level", ((F.col("block_index") * 7 + F.col("document_id")) % 6).cast("int"))
    rows = M.title_path(b, segment_rows=3)
    return rows.select("document_id", F.col("block_index").cast(big).alias("block_index"), F.array_join("title_path", " / ").alias("title_path"))


@check(
    "block_profile",
    """SELECT conv_id AS document_id, count(*) AS block_count, count(DISTINCT turn) AS page_count,
  count(*) FILTER (WHERE role = 'user') AS user_blocks FROM conversations GROUP BY conv_id""",
)
def _(spark, sf):
    p = reports.block_profile(X.blocks(spark, sf))
    return p.select(
        "document_id",
        "block_count",
        "page_count",
        F.coalesce(F.try_element_at("block_types", F.lit("user")), F.lit(0)).alias("user_blocks"),
    )


@check(
    "rewrite_refs",
    """SELECT document_id, block_index, 'see [x](/api/v1/documents/' || document_id || '/assets/' || block_index || ') and <img SRC="' ||
  CASE WHEN block_index % 2 = 0 THEN '/api/v1/documents/' || document_id || '/assets/' || block_index ELSE 'other.png' END || '"> ' || text AS content
FROM (SELECT conv_id AS document_id, turn AS block_index, text FROM conversations)""",
)
def _(spark, sf):
    b = X.blocks(spark, sf).select("document_id", "block_index", "content")
    n = F.col("block_index")
    name = F.concat(F.lit("images/Fig("), n, F.lit(").png"))
    upper = F.concat(F.lit("IMAGES/fig("), n, F.lit(").png"))
    text = F.concat(
        F.lit("see [x]( "), name, F.lit(" ) and <img SRC=\""), F.when(n % 2 == 0, upper).otherwise("other.png"), F.lit('"> '), "content"
    )
    aliases = b.select(
        "document_id",
        name.alias("alias"),
        F.concat(F.lit("/api/v1/documents/"), "document_id", F.lit("/assets/"), n).alias("url"),
        n.alias("asset_index"),
    )
    rows = rewrite_asset_refs(b.withColumn("content", text), aliases)
    return rows.withColumn("block_index", F.col("block_index").cast(big))
