"""Secret scans (operator 5).

Three base patterns find assignments, access keys and hexadecimal strings. Beyond them,
candidate strings are judged by Shannon entropy: a window of fixed width slides over each
candidate, the counts of its characters are kept incrementally, and windows whose entropy
reaches the threshold of the candidate's character class are joined into a span. Parts of a
candidate that hold a placeholder word are left out, the rest is judged. Spans on an allow list, and spans that lie wholly inside a base span, are not added.

Positions count code points; ends are exclusive. A null text counts as empty and has no
spans. Very long texts are read whole; the window state is a table of counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Kinds in the order that breaks ties between spans with one start.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HEX_ONLY = re.compile(r"[0-9a-fA-F]+").fullmatch


class EntropyRule(NamedTuple):
    """Window width and least entropy, in bits per character, of each class."""

    width: int = 20
    hex_bits: float = 3.0
    base64_bits: float = 3.9


#: Strings that look random and are not secret: UUIDs, digits only, repeated filler, placeholders, paths of words.
ALLOW = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[0-9+=_-]+",
    r"[a-z]+([/_-][a-z]+)*=*",
    r"[A-Z]+([/_-][A-Z]+)*=*",
)
#: Words that mark the part of a candidate between separators that holds them as a placeholder; the other parts are judged.
PLACEHOLDER = re.compile(r"example|placeholder|changeme|dummy|xxxxx|abcdefghijklm|0123456789", re.IGNORECASE)
PART = re.compile(r"[^/=_+-]+")

SPAN = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind; those that are too short are dropped."""
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def dense_windows(value: str, width: int, bits: float) -> Iterator[tuple[int, int]]:
    """Ranges of ``value`` covered by windows of at least ``bits`` entropy.

    With counts c and width w, entropy is log2(w) - sum(c * log2(c)) / w. The sum
    changes by two terms when the window moves by one character.
    """
    term = [0.0] + [c * math.log2(c) for c in range(1, width + 2)]
    limit = width * (math.log2(width) - bits) + 1e-9
    counts: dict[str, int] = {}
    total, begin, until = 0.0, -1, -1
    for i, ch in enumerate(value):
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c]
        counts[ch] = c + 1
        if i >= width:
            out = value[i - width]
            c = counts[out]
            total += term[c - 1] - term[c]
            counts[out] = c - 1
        if i >= width - 1 and total <= limit:
            if i - width + 1 > until:
                if begin >= 0:
                    yield begin, until
                begin = i - width + 1
            until = i + 1
    if begin >= 0:
        yield begin, until


def unmarked(value: str) -> Iterator[tuple[int, int]]:
    """Ranges of ``value`` between the parts that hold a placeholder word."""
    at = 0
    if PLACEHOLDER.search(value):
        for m in PART.finditer(value):
            if PLACEHOLDER.search(m[0]):
                yield at, m.start()
                at = m.end()
    yield at, len(value)


def entropy_spans(text: str, rule: EntropyRule, allowed) -> list[tuple[str, int, int]]:
    found = []
    for m in CANDIDATE.finditer(text):
        value = m[0]
        if allowed(value):
            continue
        kind, bits = ("entropy_hex", rule.hex_bits) if HEX_ONLY(value) else ("entropy_base64", rule.base64_bits)
        for lo, hi in unmarked(value):
            found += [(kind, m.start() + lo + a, m.start() + lo + b) for a, b in dense_windows(value[lo:hi], rule.width, bits) if not allowed(value[lo + a : lo + b])]
    return found


def all_spans(text: str, rule: EntropyRule = EntropyRule(), allow: tuple[str, ...] = ALLOW) -> list[tuple[str, int, int]]:
    """Base spans and added spans by start, then kind."""
    base = base_spans(text)
    allowed = re.compile("|".join(f"(?:{x})" for x in allow)).fullmatch
    added = [s for s in entropy_spans(text, rule, allowed) if not any(b[1] <= s[1] and s[2] <= b[2] for b in base)]
    return sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(df: DataFrame, text: str = "text", out: str = "spans", rule: EntropyRule = EntropyRule(), allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``df`` with ``out``: array<struct<kind, start, end>> of all spans of each whole text.

    Every row is judged alone, so repeated rows get repeated answers. A column named
    ``out`` is replaced; all other columns stay.
    """
    cells = F.udf(lambda t: all_spans(t, rule, allow) if t else [], T.ArrayType(SPAN, False), useArrow=True)
    return df.withColumn(out, cells(df[text].cast("string")))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each run of touching spans replaced by ``[SECRET]``; the name before an assigned value goes too."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text", rule: EntropyRule = EntropyRule(), allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``df`` with the spans of ``text`` replaced; a null stays null, a text without spans is unchanged."""
    clean = F.udf(lambda t: redacted(t, all_spans(t, rule, allow)) if t else t, T.StringType(), useArrow=True)
    return df.withColumn(text, clean(df[text].cast("string")))
