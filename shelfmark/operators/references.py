"""Rewriting of asset references inside block text.

The starts of targets are found in the text and joined on equality with those of the
aliases of the document, so no block is compared with every alias and no alias is gathered
that the text does not mean. The replacement itself looks targets up, the longest first.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.assets import is_external, normalize_reference
from shelfmark.functions.text import rstrip

_LINK = re.compile(r"\]\(\s*")
_ATTRIBUTE = re.compile(r"""(?:src|href)\s*=\s*["']""", re.IGNORECASE)


def _closings(text: str, start: int, marks: str, extra: int):
    """The next ``extra + 1`` closing marks after ``start``."""
    at = start
    for _ in range(extra + 1):
        spots = [p for p in (text.find(m, at) for m in marks) if p >= 0]
        if not spots:
            return
        at = min(spots)
        yield at
        at += 1


def reference_targets(text: str, parens: int, quotes: int) -> list[dict]:
    """Possible link targets with the span a replacement would cover.

    An alias may itself contain closing parentheses or quotes; ``parens`` and
    ``quotes`` are the most any alias has, so every possible end is tried.
    """
    found = []
    for match in _LINK.finditer(text):
        for stop in _closings(text, match.end(), ")", parens):
            target = text[match.end() : stop].rstrip()
            found.append({"start": match.start() + 2, "stop": stop, "folded": False, "target": target})
    for match in _ATTRIBUTE.finditer(text):
        for stop in _closings(text, match.end(), "\"'", quotes):
            target = text[match.end() : stop].lower()
            found.append({"start": match.end(), "stop": stop, "folded": True, "target": target})
    return [f for f in found if f["target"]]


def splice(text: str, edits: list) -> str:
    """Apply non-overlapping edits, the longest at each place first."""
    out, done = [], 0
    for edit in sorted(edits, key=lambda e: (e["start"], -e["stop"])):
        if edit["start"] >= done:
            out += [text[done : edit["start"]], edit["url"]]
            done = edit["stop"]
    return "".join([*out, text[done:]])


def reference_prefixes(text: str) -> set[tuple[bool, str]]:
    """(folded, start of the target) of every link and attribute: what stands before the first mark that may close it."""
    found = set()
    for match in _LINK.finditer(text):
        for stop in _closings(text, match.end(), ")", 0):
            found.add((False, text[match.end() : stop].rstrip()))
    for match in _ATTRIBUTE.finditer(text):
        for stop in _closings(text, match.end(), "\"'", 0):
            found.add((True, text[match.end() : stop].lower()))
    return found


def rewritten(text: str, known: dict[tuple[bool, str], str], parens: int, quotes: int) -> str:
    """``text`` with the targets of ``known`` replaced, the longest at each place; a URL that was put in is not looked at again."""
    targets = reference_targets(text, parens, quotes)
    return splice(text, [{**t, "url": known[t["folded"], t["target"]]} for t in targets if (t["folded"], t["target"]) in known])


def alias_keys(aliases: DataFrame) -> DataFrame:
    """(document_id, folded, prefix, target, url) of usable aliases.

    Links take an alias as it is, attributes in any case. ``prefix`` is its part before the
    first mark that may close a reference, which a text can be searched for without knowing
    the alias. Of several assets with one alias the last wins.
    """
    clean = (
        aliases.withColumn("alias", normalize_reference(F.col("alias")))
        .where((F.col("alias") != "") & ~is_external(F.col("alias")))
        .groupBy("document_id", "alias")
        .agg(F.max_by("url", "asset_index").alias("url"))
    )
    linked = clean.select("document_id", F.lit(False).alias("folded"), rstrip(F.substring_index("alias", ")", 1)).alias("prefix"), F.col("alias").alias("target"), "url")
    any_case = clean.groupBy("document_id", F.lower("alias").alias("target")).agg(F.min_by("url", "alias").alias("url"))
    quoted = any_case.select("document_id", F.lit(True).alias("folded"), F.regexp_extract("target", "\\A[^\"']*", 0).alias("prefix"), "target", "url")
    return linked.unionByName(quoted)


def referenced_aliases(texts: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``__pairs``: of the aliases of its document, those whose prefix a row of texts refers to.

    ``texts`` has the keys (document_id among them) and ``content``, an array of texts. Only
    aliases that a text may mean are gathered, so their number follows the text.
    """

    @F.pandas_udf("array<struct<folded:boolean,prefix:string>>")
    def prefixes(column: pd.Series) -> pd.Series:
        found = ({key for t in (texts if texts is not None else ()) if t for key in reference_prefixes(t)} for texts in column)
        return pd.Series([[{"folded": f, "prefix": p} for f, p in sorted(keys)] for keys in found], dtype=object)

    used = texts.select(*keys, F.explode(prefixes(F.col("content"))).alias("r")).select(*keys, "r.*")
    meant = used.join(alias_keys(aliases), ["document_id", "folded", "prefix"])
    return meant.groupBy(*keys).agg(F.collect_set(F.struct("folded", "target", "url")).alias("__pairs"))


def rewrite_texts(texts: Column, pairs: Column) -> Column:
    """An array of texts with the references of ``pairs`` (null: none) replaced by their URLs."""

    @F.pandas_udf("array<string>")
    def run(columns: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for own, found in zip(columns, known):
            if own is None or found is None or not len(found):
                out.append(own)
                continue
            table = {(p["folded"], p["target"]): p["url"] for p in found}
            parens = max(target.count(")") for _, target in table)
            quotes = max(target.count("'") + target.count('"') for _, target in table)
            out.append([t if t is None else rewritten(t, table, parens, quotes) for t in own])
        return pd.Series(out, dtype=object)

    # Kept in a projection of its own, so that it runs once.
    return run.asNondeterministic()(texts, pairs)


def rewrite_asset_refs(blocks: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace alias targets of Markdown links and quoted src/href values by asset URLs.

    ``aliases`` has document_id, alias, url and asset_index; of several assets
    with one alias the last wins.
    """
    keys = ["document_id", "block_index"]
    pairs = referenced_aliases(blocks.select(*keys, F.array("content").alias("content")), aliases, keys)
    joined = blocks.join(pairs, keys, "left").withColumn("__texts", rewrite_texts(F.array("content"), F.col("__pairs")))
    return joined.withColumn("content", F.get("__texts", F.lit(0))).select(*blocks.columns)
