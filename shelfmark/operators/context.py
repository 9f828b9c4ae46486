"""Prompt context and extractive answers from search results.

Rows are results (qid, rank, ...) of one question each; a question has at most
``top_k`` of them, so folding them per question is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.assets import is_image
from shelfmark.functions.text import rstrip, strip

# Texts and limits of the assembled context and answer.
NO_SOURCES = "No source chunks were retrieved."
TRUNCATED = "\n...[truncated]"
ASSETS_TITLE = "Source assets:"
MIN_CONTEXT_CHARS = 1000
BLOCK_RESERVE = 16
ANSWER_INTRO = "These are the highest-scoring MCP source chunks for checking RAG recall."
NO_SOURCE_ANSWER = (
    "## Answer\n\nMCP retrieval returned no usable sources, so this question cannot be "
    "answered from the current knowledge bases.\n\n## Question\n\n"
)
ASSET_SECTION = "\n\n## Source Assets\n\n"
EXCERPTS = 3


def number_sources(results: DataFrame) -> DataFrame:
    return results.withColumn("source_id", F.concat(F.lit("S"), F.col("rank")))


def source_heading() -> Column:
    page = F.coalesce(F.concat(F.lit(", page "), F.col("page_num")), F.lit(""))
    return F.concat(
        F.lit("["),
        F.col("source_id"),
        F.lit("] document="),
        F.col("document_name"),
        page,
        F.lit(", authority_level="),
        F.col("authority_level"),
        F.lit(", review_status="),
        F.col("review_status"),
        F.lit(", source_type="),
        F.col("governance_source_type"),
        F.lit(", version="),
        F.col("document_version"),
        F.lit(", chunk_id="),
        F.col("chunk_id"),
        F.lit(", score="),
        F.format_string("%.4f", "score"),
    )


def asset_lines(assets: Column) -> Column:
    """Text lines describing a source's assets; empty without any."""
    lines = F.transform(
        assets,
        lambda a, i: F.concat(
            F.lit("- asset "),
            i + 1,
            F.lit(": id="),
            a["id"],
            F.lit(", type="),
            a["content_type"],
            F.lit(", url="),
            a["url"],
            F.lit(", source_path="),
            a["source_path"],
        ),
    )
    listed = F.array_join(F.concat(F.array(F.lit(ASSETS_TITLE)), lines), "\n")
    return F.when(F.size(assets) > 0, listed).otherwise("")


def _sources(results: DataFrame, *fields: Column) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", *fields)))
    return results.groupBy("qid").agg(ordered.alias("sources"))


def source_context(questions: DataFrame, results: DataFrame, max_chars: int) -> DataFrame:
    """Sources of each question serialised within a character budget.

    The last source that fits is cut; those after it are left out.
    """
    numbered = number_sources(results)
    fields = [
        source_heading().alias("heading"),
        (asset_lines(F.col("assets")) if "assets" in results.columns else F.lit("")).alias("lines"),
        strip(F.col("content")).alias("text"),
    ]
    start = F.struct(
        F.lit(max(MIN_CONTEXT_CHARS, max_chars)).alias("left"),
        F.lit(False).alias("full"),
        F.lit("").alias("text"),
    )

    def add(acc: Column, source: Column) -> Column:
        room = acc["left"] - F.length(source["heading"]) - F.length(source["lines"]) - BLOCK_RESERVE
        full = acc["full"] | (room <= 0)
        cut = F.concat(rstrip(F.substr(source["text"], F.lit(1), F.greatest(room, F.lit(0)))), F.lit(TRUNCATED))
        text = F.when(F.length(source["text"]) > room, cut).otherwise(source["text"])
        block = F.concat_ws("\n", source["heading"], F.nullif(source["lines"], F.lit("")), text)
        return F.struct(
            F.when(full, acc["left"]).otherwise(acc["left"] - F.length(block)).alias("left"),
            full.alias("full"),
            F.when(full, acc["text"])
            .otherwise(F.concat(acc["text"], F.when(acc["text"] == "", "").otherwise("\n\n"), block))
            .alias("text"),
        )

    folded = _sources(numbered, *fields).select("qid", F.aggregate("sources", start, add)["text"].alias("context"))
    return questions.join(folded, "qid", "left").withColumn(
        "context", F.coalesce(F.nullif("context", F.lit("")), F.lit(NO_SOURCES))
    )


def asset_section(answer: Column, assets: Column) -> Column:
    """Append links of assets the answer does not show yet.

    ``assets`` is array<struct(label, url, content_type)> in source order.
    """
    missing = F.filter(assets, lambda a: ~F.contains(answer, a["url"]))
    urls = F.transform(missing, lambda a: a["url"])
    first = F.filter(missing, lambda a, i: F.array_position(urls, a["url"]) == i + 1)
    lines = F.transform(
        first,
        lambda a: F.concat(
            F.when(is_image(a["content_type"]), "![").otherwise("- ["), a["label"], F.lit("]("), a["url"], F.lit(")")
        ),
    )
    with_section = F.concat(rstrip(answer), F.lit(ASSET_SECTION), F.array_join(lines, "\n"))
    return F.when(F.size(lines) > 0, with_section).otherwise(answer)


def labelled_assets(sources: Column) -> Column:
    return F.flatten(
        F.transform(
            sources,
            lambda s: F.transform(
                s["assets"],
                lambda a, i: F.struct(
                    F.concat(s["source_id"], F.lit(" asset "), i + 1).alias("label"),
                    a["url"].alias("url"),
                    a["content_type"].alias("content_type"),
                ),
            ),
        )
    )


def extractive_answer(questions: DataFrame, results: DataFrame, reason: str) -> DataFrame:
    """A Markdown answer: reason, the first three excerpts, the source list."""
    numbered = number_sources(results)
    excerpt = F.concat(
        F.lit("### "), F.col("source_id"), F.lit(" - "), F.col("document_name"), F.lit("\n\n"), strip(F.col("content"))
    )
    line = F.concat(
        F.lit("- ["),
        F.col("source_id"),
        F.lit("] `"),
        F.col("document_name"),
        F.lit("` - authority "),
        F.col("authority_level"),
        F.lit(" - "),
        F.col("review_status"),
        F.lit(" - chunk `"),
        F.col("chunk_id"),
        F.lit("` - score `"),
        F.format_string("%.4f", "score"),
        F.lit("`"),
    )
    fields = [excerpt.alias("excerpt"), line.alias("line"), F.col("source_id")]
    if "assets" in results.columns:
        fields.append(F.col("assets"))
    excerpts = F.array_join(F.transform(F.slice("sources", 1, EXCERPTS), lambda s: s["excerpt"]), "\n")
    lines = F.array_join(F.transform("sources", lambda s: s["line"]), "\n")
    body = F.concat(
        F.lit(f"## Answer\n\n{reason}\n\n{ANSWER_INTRO}\n\n"), excerpts, F.lit("\n\n## Sources\n\n"), lines
    )
    if "assets" in results.columns:
        body = asset_section(body, labelled_assets(F.col("sources")))
    answered = _sources(numbered, *fields).select("qid", body.alias("answer"))
    empty = F.concat(F.lit(NO_SOURCE_ANSWER), strip(F.col("query")))
    return questions.join(answered, "qid", "left").withColumn("answer", F.coalesce("answer", empty))


def select_images(results: DataFrame, n: int) -> DataFrame:
    """First ``n`` distinct image assets per question, in source order."""
    shown = number_sources(results).select(
        "qid", "rank", "source_id", F.posexplode("assets").alias("pos", "asset")
    )
    pictures = shown.where(is_image(F.col("asset.content_type")))
    first = pictures.groupBy("qid", F.col("asset.id").alias("asset_id")).agg(
        F.min(F.struct("rank", "pos")).alias("at"),
        F.min_by("source_id", F.struct("rank", "pos")).alias("source_id"),
        F.min_by("asset.url", F.struct("rank", "pos")).alias("url"),
    )
    order = Window.partitionBy("qid").orderBy("at")
    return first.withColumn("image_rank", F.row_number().over(order)).where(F.col("image_rank") <= n)
