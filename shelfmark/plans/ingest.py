"""Ingest: documents in, chunks with vectors out, and an outcome for every document.

Parsing, merging and vector building work inside each document's row, so the whole
path is narrow: one scan and one parse per document, no shuffle between the document
scan and the chunk rows. Each document ends as chunks or with an error.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.assets import asset_id, asset_url, url_id
from shelfmark.functions.hashing import chunk_id, text_hash
from shelfmark.functions.text import once, paragraphs, tokenize
from shelfmark.operators.chunking import CHUNK_FIELDS, merge_block_arrays, window_array
from shelfmark.operators.filters import beside
from shelfmark.operators.parsing import (
    asset_rows,
    extract_data_images,
    html_block_array,
    is_layout_list,
    layout_block_array,
    markdown_block_array,
    route_by_type,
)
from shelfmark.operators.references import referenced_aliases, rewrite_texts
from shelfmark.operators.results import link_assets
from shelfmark.operators.vectors import sparse_vectors
from shelfmark.session import cut_lineage
from shelfmark.sources.sinks import content_snapshot

NOT_A_LIST = "Layout output is not a list"
_MERGE_FIELDS = ("block_index", "content", "chunk_type", "page_num", "bbox", "heading_level")
_MERGE_TYPE = "array<struct<block_index:int,content:string,chunk_type:string,page_num:int,bbox:string,heading_level:int,attrs:string>>"

#: A block parser turns a text column into an array of typed blocks; see ``operators.parsing``.
BlockParser = Callable[[Column], Column]
PARSERS: dict[str, BlockParser] = {"markdown": markdown_block_array, "html": html_block_array, "layout": layout_block_array}


@dataclass(frozen=True)
class Ingested:
    """What ingest makes. ``whole`` is one row per document and feeds the others: write or persist it to parse once."""

    whole: DataFrame
    chunks: DataFrame
    assets: DataFrame
    failed: DataFrame
    outcomes: DataFrame
    snapshot: DataFrame


def block_metadata(block: Column) -> Column:
    """Chunk metadata of one block as JSON: attributes, type, path, level, page and box."""
    return F.to_json(
        F.struct(
            block["block_type"].alias("block_type"),
            F.when(F.size(block["title_path"]) > 0, block["title_path"]).alias("title_path"),
            F.when(block["heading_level"] > 0, block["heading_level"]).alias("heading_level"),
            block["page_num"].alias("page_num"),
            block["bbox"].alias("bbox"),
            block["attrs"].alias("attrs"),
        )
    )


def merge_input(blocks: Column) -> Column:
    """Blocks with content, reduced to what the merge reads."""
    return F.transform(
        F.filter(blocks, lambda b: b["content"] != ""),
        lambda b: F.struct(*[b[f].alias(f) for f in _MERGE_FIELDS], block_metadata(b).alias("attrs")),
    ).cast(_MERGE_TYPE)


def plain_blocks(texts: Column) -> Column:
    """An array of texts as untyped blocks for the merge."""
    null = F.lit(None)
    return F.transform(
        texts,
        lambda t, i: F.struct(
            i.alias("block_index"), t.alias("content"), F.lit("text").alias("chunk_type"), null.cast("int").alias("page_num"),
            null.cast("string").alias("bbox"), F.lit(0).alias("heading_level"), F.lit('{"block_type":"text"}').alias("attrs"),
        ),
    ).cast(_MERGE_TYPE)


def overlaid(base: Column, top: Column) -> Column:
    """JSON object ``base`` with the keys of JSON object ``top`` set over it; either may be null."""
    fields = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    both = F.map_concat(F.map_filter(fields(base), lambda k, _: ~F.array_contains(F.map_keys(fields(top)), k)), fields(top))
    return F.when(base.isNull(), top).otherwise(F.to_json(both))


def delivered_assets(assets: DataFrame) -> DataFrame:
    """Assets that a layout parser delivered as files, with the id and URL they get.

    ``assets`` has document_id, kb_id, asset_index, asset_type, source_path, content_type and
    content, and may have ``aliases``. Their ids do not meet those of embedded images.
    """
    known = F.col("aliases") if "aliases" in assets.columns else F.array().cast("array<string>")
    index = F.concat(F.lit("file-"), F.col("asset_index").cast("string"))
    named = assets.withColumn("aliases", F.array_distinct(F.concat(F.array("source_path"), F.coalesce(known, F.array().cast("array<string>")))))
    return named.select(
        "document_id", "kb_id", "asset_index", "asset_type", "source_path", "content_type",
        F.octet_length("content").cast("bigint").alias("file_size"), F.sha2("content", 256).alias("file_hash"),
        "aliases", "content", asset_id(F.col("document_id"), index).alias("asset_id"),
    )


def with_asset_urls(parsed: DataFrame, assets: DataFrame) -> DataFrame:
    """Parsed documents whose blocks and texts refer to delivered assets by URL.

    The blocks are written once: references are looked for in them, and then replaced.
    """
    held = cut_lineage(parsed)
    url = asset_url(url_id(F.col("document_id")), F.col("asset_id"))
    aliases = delivered_assets(assets).select("document_id", F.explode("aliases").alias("alias"), url.alias("url"), "asset_index")
    is_list = F.col("route") == "layout"
    texts = F.concat(F.array(F.when(~is_list, F.col("content"))), F.transform("__blocks", lambda b: b["content"]))
    pairs = referenced_aliases(held.select("document_id", texts.alias("content")), aliases, ["document_id"])
    done = held.join(pairs, "document_id", "left").withColumn("__texts", rewrite_texts(texts, F.col("__pairs")))
    blocks = F.transform("__blocks", lambda b, i: b.withField("content", F.get("__texts", i + 1)))
    text = F.when(is_list, F.col("content")).otherwise(F.get("__texts", F.lit(0)))
    return done.withColumns({"__blocks": blocks, "content": text}).select(*parsed.columns)


def parse_documents(docs: DataFrame, kbs: DataFrame, parsers: Mapping[str, BlockParser] = PARSERS, assets: DataFrame | None = None) -> DataFrame:
    """One row per document with ``error``, ``embedded`` images and ``made``, the array of its chunks.

    ``docs`` has document_id, kb_id, name, file_type, tags and content, and may have
    ``metadata``, a JSON object that chunk metadata is laid over. The KB table gives chunk
    size and overlap; it is broadcast if it is small. Errors: unknown_kb,
    missing_content, unsupported_image, an unsupported type or a layout text that is no
    list, and empty_layout or empty_document where nothing visible was found. A Markdown
    text without blocks is cut into paragraphs. References to ``assets`` (see
    ``delivered_assets``) become their URLs before blocks are merged into chunks.
    """
    sizes = kbs.select("kb_id", "chunk_size", "chunk_overlap", F.lit(True).alias("__kb"))
    joined = route_by_type(docs).join(beside(sizes), "kb_id", "left")
    route, text = F.col("route"), F.col("content")
    error = (
        F.when(F.col("__kb").isNull(), "unknown_kb")
        .when(text.isNull(), "missing_content")
        .when(route == "image", "unsupported_image")
        .when((route == "layout") & ~is_layout_list(F.when(route == "layout", text)), NOT_A_LIST)
        .otherwise(F.col("error"))
    )
    checked = joined.withColumn("error", error)
    usable = F.col("error").isNull()
    place = lambda n: asset_url(url_id(F.col("document_id")), asset_id(F.col("document_id"), n))
    marked = F.when(usable & (route == "html"), True).when(usable & (route == "markdown"), False)
    lifted = extract_data_images(checked, html=marked, url=place)
    # Every parser sees the texts of its own route only and gives the others no block.
    own = {name: F.when(usable & (route == name), text).otherwise(F.lit("")) for name in parsers}
    blocks = F.concat(*[merge_input(parse(own[name])) for name, parse in parsers.items()])
    parsed = lifted.withColumn("__blocks", blocks)
    if assets is not None:
        parsed = with_asset_urls(parsed, assets)
    bare = usable & (route == "markdown") & (F.size("__blocks") == 0)
    filled = parsed.withColumn("__blocks", F.when(bare, plain_blocks(paragraphs(text))).otherwise(F.col("__blocks")))
    size, overlap = F.coalesce("chunk_size", F.lit(1)), F.coalesce("chunk_overlap", F.lit(0))
    filled = filled.withColumn("__merged", merge_block_arrays(F.col("__blocks"), size, overlap))
    merged = F.col("__merged")
    filled = filled.withColumn("__tokens", once(tokenize(F.when(usable & (route == "text"), text).otherwise(F.lit("")))))
    windows = window_array(F.col("__tokens"), size, overlap)
    kind = T.ArrayType(T.StructType([f for f in CHUNK_FIELDS if f.name != "opener"]))
    null = F.lit(None)
    plain = F.transform(
        windows,
        lambda w, i: F.struct(i.alias("chunk_index"), w.alias("content"), F.lit("text").alias("chunk_type"), null.alias("page_num"), null.alias("bbox"), F.lit('{"block_type":"text"}').alias("attrs")),
    ).cast(kind)
    structured = F.transform(merged, lambda c: F.struct(*[c[f.name].alias(f.name) for f in kind.elementType.fields])).cast(kind)
    made = filled.withColumn("made", once(F.when(route == "text", plain).otherwise(structured)))
    empty = F.when(usable & (F.size("made") == 0), F.when(route == "layout", "empty_layout").otherwise("empty_document"))
    base = F.col("metadata").cast("string") if "metadata" in docs.columns else F.lit(None).cast("string")
    return made.select(
        "document_id", "kb_id", "name", "tags", F.coalesce("error", empty).alias("error"), "embedded",
        F.when(usable, text).alias("content"), base.alias("metadata"), "made",
    )


def chunk_rows(whole: DataFrame) -> DataFrame:
    """Chunks of parsed documents."""
    one = whole.where("error is null").select("document_id", "kb_id", "tags", "metadata", F.explode("made").alias("c"))
    return one.select(
        chunk_id(F.col("document_id"), F.col("c.chunk_index")).alias("chunk_id"),
        "document_id",
        "kb_id",
        "tags",
        F.col("c.chunk_index").alias("chunk_index"),
        F.col("c.content").alias("content"),
        text_hash(F.col("c.content")).alias("content_hash"),
        F.col("c.chunk_type").alias("chunk_type"),
        F.col("c.page_num").alias("page_num"),
        F.col("c.bbox").alias("bbox"),
        overlaid(F.col("metadata"), F.col("c.attrs")).alias("metadata"),
    )


def split(whole: DataFrame, delivered: DataFrame | None = None) -> Ingested:
    """Tables of parsed documents; ``whole`` is what ``parse_documents`` made, best read back from where it was written.

    ``delivered`` are the assets that came as files; those of documents that failed are left out.
    """
    bare = chunk_rows(whole)
    done = whole.where("error is null")
    assets = asset_rows(done).withColumn("asset_id", asset_id(F.col("document_id"), F.col("asset_index")))
    if delivered is not None:
        assets = assets.unionByName(delivered_assets(delivered).join(done.select("document_id"), "document_id", "left_semi"))
    by_url = lambda df: df.withColumn("__of", F.col("document_id")).withColumn("document_id", url_id(F.col("document_id")))
    linked = link_assets(by_url(assets), by_url(bare.select("chunk_id", "document_id", "chunk_index", "content")).drop("__of"))
    placed = linked.withColumn("url", asset_url(F.col("document_id"), F.col("asset_id"))).withColumn("document_id", F.col("__of")).drop("__of")
    status = F.when(F.col("error").isNull(), "completed").otherwise("failed")
    outcomes = whole.select("document_id", status.alias("status"), "error", F.when(F.col("error").isNull(), F.size("made")).otherwise(0).alias("chunk_count"))
    snapshot = content_snapshot(whole.where("error is null"), F.lit("text/plain; charset=utf-8"))
    return Ingested(whole, sparse_vectors(bare), placed, outcomes.where("error is not null").select("document_id", "error"), outcomes, snapshot)


def ingest(docs: DataFrame, kbs: DataFrame, parsers: Mapping[str, BlockParser] = PARSERS, assets: DataFrame | None = None, once: bool = False) -> Ingested:
    """Chunks with sparse vectors, assets linked to chunks, parsed texts, and an outcome per document.

    Embedded images become assets, and their places in the text become asset URLs; so do
    references to ``assets``, the files that came with layout lists. ``once`` writes the
    parsed documents to the checkpoint folder, so that using several tables parses once.
    """
    whole = parse_documents(docs, kbs, parsers, assets)
    return split(cut_lineage(whole) if once else whole, assets)


def build_chunks(docs: DataFrame, kbs: DataFrame) -> DataFrame:
    """Chunks only, without vectors."""
    return chunk_rows(parse_documents(docs, kbs))
