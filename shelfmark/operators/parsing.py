"""From document text to typed blocks.

A document's text is one value, so parsing is a narrow per-row step: blocks come
out as an array and are exploded only where a long table is wanted. No shuffle
and no grouping by document is involved.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.assets import file_extension, source_stem
from shelfmark.functions.markup import (
    data_images,
    html_fragments,
    layout_fragments,
    markdown_fragments,
    splice_images,
)
from shelfmark.functions.text import LINE_BREAK, WS, WS_CHARS, let, normalized_type, strip
from shelfmark.operators.segments import SEGMENT_ROWS, fold_segments

_IMAGE_REF = rf"!\[([^\]]*)\]\(([^){WS_CHARS}]+)(?:{WS}+[^)]*)?\)"
_TABLE_RULE = rf"\A{WS}*\|?{WS}*:?-{{3,}}:?{WS}*(?:\|{WS}*:?-{{3,}}:?{WS}*)+\|?{WS}*\z"
_HEADING_MARK = rf"\A#{{1,6}}{WS}+"
_FENCE_START = rf"\A{WS}*(?:```|~~~)"
_LIST_START = rf"\A{WS}*(?:[-*+]{WS}+|\p{{Nd}}+[.)]{WS}+)"
# File types by parser.
MARKDOWN_TYPES = ["md", "markdown"]
HTML_TYPES = ["html", "htm"]
LAYOUT_TYPES = ["docx", "pdf", "ppt", "pptx", "xlsx"]
IMAGE_TYPES = ["jpeg", "jpg", "png"]
# Layout block types kept as their own chunk type.
LAYOUT_CHUNK_TYPES = {"image": "image", "chart": "image", "table": "table", "equation": "equation"}

# Columns every scanner returns besides its own.
_SCANNED = "content:string,heading_level:int,title_path:array<string>"


def _scan(fields: str, scanner) -> Callable[[Column], Column]:
    """An Arrow-batched scanner from a text column to an array of structs."""

    @F.pandas_udf(f"array<struct<{fields}>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([scanner(text or "") for text in texts], dtype=object)

    return run.asNondeterministic()


def heading_title(content: Column) -> Column:
    """First line of a heading without its marks."""
    bare = F.regexp_replace(strip(content), _HEADING_MARK, "")
    return strip(F.get(F.split(bare, LINE_BREAK, -1), F.lit(0)))


def _block(index, scanned, kind, block_type, page, bbox, attrs) -> Column:
    return F.struct(
        index.cast("int").alias("block_index"),
        scanned["content"].alias("content"),
        kind.alias("chunk_type"),
        page.cast("int").alias("page_num"),
        bbox.cast("string").alias("bbox"),
        scanned["heading_level"].alias("heading_level"),
        F.coalesce(scanned["title_path"], F.array().cast("array<string>")).alias("title_path"),
        block_type.alias("block_type"),
        attrs.alias("attrs"),
    )


def _present(**values: Column) -> Column:
    """Map of the values that are not null or empty."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "")))


# --- Markdown ------------------------------------------------------------------------


def markdown_block_type(block: Column) -> Column:
    lines = F.filter(F.split(block, LINE_BREAK, -1), lambda line: strip(line) != "")
    return (
        F.when(block.rlike(_FENCE_START), "code")
        .when(block.rlike(_IMAGE_REF), "image")
        .when(F.coalesce(F.get(lines, F.lit(1)).rlike(_TABLE_RULE), F.lit(False)), "table")
        .when(block.rlike(_HEADING_MARK), "heading")
        .when(block.rlike(_LIST_START), "list")
        .otherwise("paragraph")
    )


def markdown_block_array(text: Column) -> Column:
    """Blocks of a Markdown text as array<struct>; a heading line is never atomic."""

    def typed(b: Column, i: Column) -> Column:
        block, plain = b["content"], b["heading_level"] == 0

        def build(kind: Column) -> Column:
            image = plain & (kind == "image")
            refs = F.regexp_extract_all(block, F.lit(_IMAGE_REF), F.lit(2))
            attrs = _present(
                image_path=F.when(image, F.regexp_extract(block, _IMAGE_REF, 2)),
                image_caption=F.when(image, strip(F.regexp_extract(block, _IMAGE_REF, 1))),
                image_refs=F.when(image, F.array_join(refs, "\n")),
            )
            atomic = plain & kind.isin("image", "table", "code")
            null = F.lit(None)
            return _block(i, b, F.when(atomic, kind).otherwise("text"), kind, null, null, attrs)

        return let(markdown_block_type(block), build)

    return F.transform(_scan(_SCANNED, markdown_fragments)(text), typed)


# --- HTML ----------------------------------------------------------------------------


def html_block_array(html: Column) -> Column:
    """Blocks of a page as array<struct>."""

    def typed(b: Column, i: Column) -> Column:
        kind, null = b["block_type"], F.lit(None)
        attrs = _present(image_path=b["image_path"], image_caption=b["image_caption"])
        return _block(
            i, b, F.when(kind.isin("image", "table"), kind).otherwise("text"), kind, null, null, attrs
        )

    fields = f"{_SCANNED},block_type:string,image_path:string,image_caption:string"
    return F.transform(_scan(fields, html_fragments)(html), typed)


def rendered_html(blocks: Column) -> Column:
    """Preview fragment of parsed blocks."""

    def escaped(text: Column) -> Column:
        for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            text = F.replace(text, F.lit(mark), F.lit(entity))
        return text

    def one(b: Column) -> Column:
        tag = F.when(b["heading_level"].between(1, 6), F.concat(F.lit("h"), b["heading_level"])).otherwise("p")
        text = F.concat(F.lit("<"), tag, F.lit(">"), escaped(b["content"]), F.lit("</"), tag, F.lit(">"))
        return F.when(b["chunk_type"].isin("image", "table"), b["content"]).otherwise(text)

    return F.array_join(F.transform(blocks, one), "\n")


# --- layout JSON -----------------------------------------------------------------------


def layout_block_array(layout_json: Column) -> Column:
    """All blocks of a layout list, the empty ones included (they count in profiles)."""
    extras = ("table_caption", "image_caption", "image_path", "latex")

    def typed(b: Column, i: Column) -> Column:
        chunk_type = F.lit("text")
        for name, shown in LAYOUT_CHUNK_TYPES.items():
            chunk_type = F.when(b["block_type"] == name, shown).otherwise(chunk_type)
        attrs = _present(**{k: b[k] for k in extras})
        return _block(i, b, chunk_type, b["block_type"], b["page_num"], b["bbox"], attrs)

    fields = f"{_SCANNED},block_type:string,page_num:int,bbox:string," + ",".join(f"{e}:string" for e in extras)
    return F.transform(_scan(fields, layout_fragments)(layout_json), typed)


def is_layout_list(layout_json: Column) -> Column:
    """Whether a text is a JSON list, which is what a layout parser must deliver."""
    kind = F.schema_of_variant(F.try_parse_json(layout_json))
    return F.coalesce(kind.startswith("ARRAY"), F.lit(False))


def content_list_blocks(docs: DataFrame, layout: str = "layout_json") -> DataFrame:
    """Typed blocks of layout JSON, one row per block with content.

    ``block_counts`` on every row keeps the counts over all blocks, also those
    dropped for being empty, and ``page_count`` the distinct pages.
    """
    keep = [c for c in docs.columns if c != layout]
    parsed = docs.select(*keep, layout_block_array(F.col(layout)).alias("__all"))
    summary = parsed.select(
        *keep,
        F.size("__all").alias("content_blocks"),
        F.size(F.array_distinct(F.filter(F.transform("__all", lambda b: b["page_num"]), lambda p: p.isNotNull()))).alias("page_count"),
        F.filter("__all", lambda b: b["content"] != "").alias("blocks"),
    )
    return explode_blocks(summary, reindex=True)


# --- plain text, data images, routing ----------------------------------------------------


def explode_blocks(df: DataFrame, reindex: bool = False) -> DataFrame:
    keep = [c for c in df.columns if c != "blocks"]
    rows = df.select(*keep, F.posexplode("blocks").alias("__at", "b")).select(*keep, "__at", "b.*")
    if reindex:
        rows = rows.withColumn("block_index", F.col("__at"))
    return rows.drop("__at")


def text_blocks(docs: DataFrame, text: str = "content") -> DataFrame:
    """One text block per document with any visible text."""
    keep = [c for c in docs.columns if c != text]
    return docs.where(strip(F.col(text)) != "").select(
        *keep, F.lit(0).alias("block_index"), F.col(text).alias("content"), F.lit("text").alias("chunk_type")
    )


def _array_job(docs: DataFrame, text: str, build) -> DataFrame:
    keep = [c for c in docs.columns if c != text]
    return explode_blocks(docs.select(*keep, build(F.col(text)).alias("blocks")))


def markdown_blocks(docs: DataFrame, text: str = "content") -> DataFrame:
    """Typed Markdown blocks; a heading carries the path before itself."""
    return _array_job(docs, text, markdown_block_array)


def html_blocks(docs: DataFrame, text: str = "content") -> DataFrame:
    """Typed HTML blocks; a heading carries the path before itself."""
    return _array_job(docs, text, html_block_array)


_FOUND = "array<struct<start:int,stop:int,head:string,tail:string,kind:string,data:string>>"


def extract_data_images(docs: DataFrame, text: str = "content", name: str = "name", html: Column | bool = False, url: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rewrite ``text`` and add ``embedded``: the images that were inside it.

    An image whose base64 text cannot be decoded, or is empty, stays where it is.
    ``html`` may be a column that tells it row by row; rows where it is null are left
    alone. The text then holds the image's path, or what ``url`` makes of its number.
    """
    @F.pandas_udf(_FOUND)
    def find(texts: pd.Series, marked: pd.Series) -> pd.Series:
        return pd.Series([data_images(t or "", bool(h)) if h is not None and h == h else [] for t, h in zip(texts, marked)], dtype=object)

    @F.pandas_udf("string")
    def splice(texts: pd.Series, images: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not len(i) else splice_images(t, list(i)) for t, i in zip(texts, images)], dtype=object)

    marked = F.lit(html) if isinstance(html, bool) else html
    decoded = F.transform(
        F.col("__found"),
        lambda i: F.struct(*[i[c].alias(c) for c in ("start", "stop", "head", "tail", "kind")], F.try_to_binary(i["data"], F.lit("base64")).alias("content")),
    )
    usable = F.filter(decoded, lambda i: F.octet_length(i["content"]) > 0)

    def named(i: Column, n: Column) -> Column:
        extension = F.when(i["kind"] == "image/jpeg", ".jpg").otherwise(file_extension(i["kind"]))
        path = F.concat(F.lit("assets/"), source_stem(F.col(name)), F.lit("-"), n + 1, extension)
        shown = i.withField("source_path", path)
        return shown.withField("url", url(n) if url else path)

    # Non-deterministic to the optimizer, so each scan stays a projection of its own and runs once.
    searched = docs.withColumn("__found", find.asNondeterministic()(F.col(text), marked))
    found = searched.withColumn("__usable", usable).withColumn("__images", F.transform("__usable", named))
    return found.withColumns(
        {
            text: splice.asNondeterministic()(F.col(text), F.transform("__images", lambda i: i.dropFields("content", "source_path"))),
            "embedded": F.transform("__images", lambda i: F.struct(i["source_path"].alias("source_path"), i["kind"].alias("content_type"), i["content"].alias("content"))),
        }
    ).drop("__found", "__usable", "__images")


def asset_rows(docs: DataFrame, embedded: str = "embedded") -> DataFrame:
    """Asset rows of extracted images, with the aliases they are referred to by."""
    rows = docs.select("document_id", "kb_id", F.posexplode(embedded).alias("asset_index", "a"))
    path = F.col("a.source_path")
    return rows.select(
        "document_id",
        "kb_id",
        "asset_index",
        F.lit("image").alias("asset_type"),
        path.alias("source_path"),
        F.col("a.content_type").alias("content_type"),
        F.octet_length("a.content").cast("bigint").alias("file_size"),
        F.sha2("a.content", 256).alias("file_hash"),
        F.array(path, F.concat(F.lit("./"), path)).alias("aliases"),
        F.col("a.content").alias("content"),
    )


def route_by_type(docs: DataFrame, file_type: str = "file_type") -> DataFrame:
    """Add ``route`` (text, markdown, html, layout, image) or an ``error`` for other types."""
    kind = normalized_type(F.col(file_type))
    route = (
        F.when(kind == "txt", "text")
        .when(kind.isin(MARKDOWN_TYPES), "markdown")
        .when(kind.isin(HTML_TYPES), "html")
        .when(kind.isin(LAYOUT_TYPES), "layout")
        .when(kind.isin(IMAGE_TYPES), "image")
    )
    return docs.withColumns(
        {
            "route": route,
            "error": F.when(route.isNull(), F.concat(F.lit("Unsupported document type: "), kind)),
        }
    )


# --- title paths over a long block table ---------------------------------------------------


def _pushed(stack: list[str], level: int, title: str | None) -> list[str]:
    """The stack of titles after a heading: it pops down to ``level - 1`` titles at most, then pushes its own."""
    return [*stack[: level - 1], title] if title is not None else stack


def summarize_titles(rows) -> dict:
    """What a segment does to a stack of titles, for every depth the stack may have.

    A heading of level L keeps min(depth, L - 1) titles of the stack it meets, so a segment
    keeps some titles from the bottom and puts its own on top. Which ones depends on the
    depth at its start only, and depths from its highest level on are all alike.
    """
    heads = [(row["heading_level"], row["__title"]) for row in rows if row["__title"] is not None]
    ways = []
    for depth in range(max((level for level, _ in heads), default=0)):
        # Titles that were there before stand as their place; they only ever go from the top.
        stack: list = list(range(depth))
        for level, title in heads:
            stack = _pushed(stack, level, (title,))
        kept = sum(isinstance(x, int) for x in stack)
        ways.append([kept, [x[0] for x in stack[kept:]]])
    return {"ways": ways}


def advance_titles(state: dict | None, summary: dict) -> dict:
    stack = state["stack"] if state else []
    if summary["ways"]:
        kept, own = summary["ways"][min(len(stack), len(summary["ways"]) - 1)]
        stack = stack[:kept] + own
    return {"stack": stack}


def title_path(
    blocks: DataFrame, inclusive: bool = False, max_level: int | None = None, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Add ``title_path`` to (document_id, block_index, heading_level, content) rows.

    The path is a stack: a heading of level L pops down to L - 1 titles before its own is
    pushed; one without a title leaves it alone. A heading shows the path before itself
    unless ``inclusive``. ``block_index`` counts blocks from 0. Long documents are cut into
    segments that are summarised by what they do to a stack, so one fold does it, whatever
    the levels. ``max_level`` treats deeper headings as headings of that level.
    """
    title = heading_title(F.col("content"))
    level = F.col("heading_level") if max_level is None else F.least(F.col("heading_level"), F.lit(max_level))
    marked = blocks.withColumn("__title", F.when((level > 0) & (title != ""), title)).withColumn("__level", level)
    schema = T.StructType([*blocks.schema.fields, T.StructField("title_path", T.ArrayType(T.StringType()))])

    names = blocks.columns

    def leveled(rows):
        for row in rows:
            yield {**row, "heading_level": row["__level"]}

    def fold(rows, entry, last):
        stack = entry["stack"] if entry else []
        for row in rows:
            after = _pushed(stack, row["__level"], row["__title"])
            shown = after if inclusive or row["__title"] is None else stack
            yield {**{c: row[c] for c in names}, "title_path": list(shown)}
            stack = after

    return fold_segments(
        marked, ["document_id"], "block_index", fold, lambda rows: summarize_titles(leveled(rows)), advance_titles, schema, segment_rows
    )
