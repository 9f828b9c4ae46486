"""Column expressions over text: whitespace, tokens, query rewriting, content kinds.

All of them are built-in functions, so they stay inside the JVM. Regular
expressions spell out Unicode whitespace and word characters because Java's
``\\s`` and ``\\w`` are ASCII by default; ``(?d)`` makes ``.``, ``^`` and ``$``
treat only a line feed as the end of a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes.
WS_CHARS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_CHARS}]"
NON_WS = f"[^{WS_CHARS}]"
WORD = r"[\p{L}\p{N}_]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
CJK = r"[\u3400-\u9fff]"
# Closing marks dropped from a query, and separators of sub-queries.
QUERY_TAIL = r"[?？。.!！]+\z"
QUERY_SEPARATOR = rf"{WS}*(?:(?<!{WORD})and(?!{WORD})|,|，|;|；|\?|？){WS}*"
# Hypothetical-document template.
HYDE_HEAD = "This hypothetical reference document answers the query: "
HYDE_TAIL = ". It contains the key terms, entities, and context needed for retrieval."
# An image target starting with one of these loses its inner spaces.
ASSET_TARGET_PREFIXES = ["/api/", "http://", "https://", "images/", "./images/"]

SNIFF_CHARS = 6000
DEFAULT_MAX_INPUT_CHARS = 4000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside one expression."""
    return F.transform(F.array(value), body)[0]


def once(value: Column) -> Column:
    """``value``, computed a single time per row however often the column is used.

    To the optimizer it is not deterministic, so it stays in a projection of its own:
    no filter and no later projection repeats it.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def strip(col: Column) -> Column:
    """Trim every kind of whitespace on both sides."""
    return F.regexp_replace(col, rf"\A{WS}+|{WS}+\z", "")


def rstrip(col: Column) -> Column:
    return F.regexp_replace(col, rf"{WS}+\z", "")


def collapse_whitespace(col: Column) -> Column:
    return F.regexp_replace(strip(col), rf"{WS}+", " ")


def replace_matches(
    text: Column, pattern: str, replacement: Callable[[Column, Column], Column]
) -> Column:
    """Regex replace where each replacement is an expression of (match, position).

    The pieces between matches and the matches are zipped back together, so no
    text is scanned more than twice.
    """
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def stitch(found: Column) -> Column:
        return F.array_join(
            F.transform(
                pieces,
                lambda piece, i: F.concat(
                    piece,
                    F.when(i < F.size(found), replacement(F.get(found, i), i)).otherwise(F.lit("")),
                ),
            ),
            "",
        )

    return F.when(F.regexp_like(text, F.lit(pattern)), let(matches, stitch)).otherwise(text)


# --- tokens -----------------------------------------------------------------


def contains_cjk(col: Column) -> Column:
    return col.rlike(CJK)


def tokenize(col: Column) -> Column:
    """Characters for text holding a CJK ideograph, whitespace words otherwise."""
    characters = F.split(F.regexp_replace(col, f"{WS}+", ""), "")
    words = F.split(col, f"{WS}+")
    return F.filter(F.when(contains_cjk(col), characters).otherwise(words), lambda t: t != "")


def repair_image_refs(col: Column) -> Column:
    """Close up Markdown image references that tokenising spread apart."""
    frame = rf"!{WS}*\[{WS}*([^\]]*?){WS}*\]{WS}*\({WS}*([^)]+?){WS}*\)"

    def rebuild(match: Column, _: Column) -> Column:
        alt = strip(F.regexp_extract(match, frame, 1))
        target = strip(F.regexp_extract(match, frame, 2))
        compact = F.regexp_replace(target, f"{WS}+", "")
        known = F.lit(False)
        for prefix in ASSET_TARGET_PREFIXES:
            known = known | compact.startswith(prefix)
        return F.concat(F.lit("!["), alt, F.lit("]("), F.when(known, compact).otherwise(target), F.lit(")"))

    return F.when(F.contains(col, F.lit("!")), replace_matches(col, frame, rebuild)).otherwise(col)


def join_tokens(tokens: Column) -> Column:
    """Single characters are joined directly, anything else with spaces."""
    joined = F.when(
        F.forall(tokens, lambda t: F.length(t) == 1), F.array_join(tokens, "")
    ).otherwise(F.array_join(tokens, " "))
    return repair_image_refs(joined)


def words(col: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(col), F.lit(f"{WORD}+"), F.lit(0))


def paragraphs(col: Column) -> Column:
    return F.filter(F.transform(F.split(col, "\n\n"), strip), lambda p: p != "")


# --- queries ----------------------------------------------------------------


def rewrite_query(col: Column) -> Column:
    return F.regexp_replace(collapse_whitespace(col), QUERY_TAIL, "")


def decompose_query(col: Column, max_sub_queries: int | Column = 3) -> Column:
    parts = F.filter(F.transform(F.split(col, QUERY_SEPARATOR, -1), strip), lambda p: p != "")
    limit = F.lit(max_sub_queries) if isinstance(max_sub_queries, int) else max_sub_queries
    return let(
        parts, lambda p: F.when(F.size(p) <= 1, F.array(col)).otherwise(F.slice(p, F.lit(1), limit))
    )


def hyde_text(col: Column) -> Column:
    return F.concat(F.lit(HYDE_HEAD), col, F.lit(HYDE_TAIL))


def expand_query(
    query: Column, rewrite: Column, hyde: Column, decompose: Column, max_sub_queries: int | Column = 3
) -> Column:
    """Ordered distinct queries to run: main, hypothetical document, sub-queries."""
    main = F.when(rewrite & (rewrite_query(query) != ""), rewrite_query(query)).otherwise(query)

    def expand(base: Column) -> Column:
        everything = F.concat(
            F.array(base),
            F.when(hyde, F.array(hyde_text(base))).otherwise(F.array().cast("array<string>")),
            F.when(decompose, decompose_query(base, max_sub_queries)).otherwise(
                F.array().cast("array<string>")
            ),
        )
        return F.array_distinct(F.filter(F.transform(everything, strip), lambda q: q != ""))

    return let(main, expand)


def bound_input(col: Column, max_chars: int = DEFAULT_MAX_INPUT_CHARS) -> Column:
    """Cut an embedding input; a cut text also loses its trailing whitespace."""
    return F.when(F.length(col) > max_chars, rstrip(F.substring(col, 1, max_chars))).otherwise(col)


# --- content kinds ----------------------------------------------------------

# What counts as HTML or Markdown.
_HTML_TAGS = "html|body|main|article|section|h[1-6]|p|table|ul|ol|pre|blockquote"
_HEADING_LINE = rf"(?md)^#{{1,6}}{WS}+{NON_WS}"
_IMAGE_REF = r"!\[[^\]]*\]\([^)]+\)"
_PIPE_TABLE = rf"(?d)\|.+\|{WS}*\r?\n\|[-:|{WS_CHARS}]+\|"


def looks_like_markdown(col: Column) -> Column:
    sample = F.substring(col, 1, SNIFF_CHARS)
    return (
        sample.rlike(_HEADING_LINE)
        | sample.contains("```")
        | sample.rlike(_IMAGE_REF)
        | sample.rlike(_PIPE_TABLE)
    )


def looks_like_html(col: Column) -> Column:
    sample = F.substring(col, 1, SNIFF_CHARS)
    doctype = rf"(?i)\A{WS}*<!doctype{WS}+html"
    tag = rf"(?i)<{WS}*(?:{_HTML_TAGS})(?!{WORD})"
    return sample.rlike(doctype) | sample.rlike(tag)


def normalized_type(file_type: Column) -> Column:
    """Lower-cased type without leading dots; a missing or empty type is txt."""
    present = F.when(file_type.isNull() | (file_type == ""), F.lit("txt")).otherwise(file_type)
    return F.regexp_replace(F.lower(present), r"\A\.+", "")


def parsed_content_type(file_type: Column, content: Column) -> Column:
    kind = normalized_type(file_type)
    return (
        F.when(kind.isin("html", "htm") & looks_like_html(content), "text/html; charset=utf-8")
        .when(
            kind.isin("md", "markdown", "pdf") | looks_like_markdown(content),
            "text/markdown; charset=utf-8",
        )
        .otherwise("text/plain; charset=utf-8")
    )


def content_kind(file_type: Column, content: Column) -> Column:
    """The viewer's wider test: list bullets and formulas count as Markdown too."""
    kind = F.regexp_replace(F.lower(F.coalesce(file_type, F.lit(""))), r"\A\.", "")
    sample = F.substring(content, 1, SNIFF_CHARS)
    markdown = (
        looks_like_markdown(content)
        | sample.rlike(rf"(?md)^{WS}*[-*+]{WS}+{NON_WS}")
        | sample.rlike(r"(?s)(?:^|[^\\])\$\$.+?\$\$")
        | sample.rlike(r"(?s)\\\(.+?\\\)|\\\[.+?\\\]")
        | sample.rlike(r"(?m)(?:^|[^\\])\$[^$\n]*(?:\\[a-zA-Z]+|[=^_])[^$\n]*\$")
    )
    return (
        F.when(kind.isin("md", "markdown"), "markdown")
        .when(kind.isin("html", "htm"), "html")
        .when(markdown, "markdown")
        .when(looks_like_html(content), "html")
        .otherwise("text")
    )


def decode_text(content: Column) -> Column:
    """UTF-8 bytes to text; malformed bytes become the replacement character."""
    return F.make_valid_utf8(content.cast("string"))
