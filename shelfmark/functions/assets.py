"""Asset URLs, names and image types as column expressions."""

from __future__ import annotations

import mimetypes
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import let, strip

# Shape of an asset URL.
_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
ASSET_URL = rf"/api/v1/documents/({_UUID})/assets/({_UUID})"
# Image types an image encoder accepts.
VISUAL_CONTENT_TYPES = [
    "image/bmp",
    "image/gif",
    "image/jpeg",
    "image/png",
    "image/tiff",
    "image/webp",
]
# References that are never rewritten.
EXTERNAL_PREFIXES = ["http://", "https://", "data:", "/api/"]


def asset_url(document_id: Column, asset_id: Column) -> Column:
    return F.concat(F.lit("/api/v1/documents/"), document_id, F.lit("/assets/"), asset_id)


def _uuid_shape(digest: Column) -> Column:
    parts, at = [], 1
    for n in (8, 4, 4, 4, 12):
        parts.append(F.substring(digest, at, n))
        at += n
    return F.concat_ws("-", *parts)


def asset_id(document_id: Column, asset_index: Column) -> Column:
    """Stable id of a document's asset, shaped as asset URLs want it."""
    return _uuid_shape(F.sha2(F.concat_ws(":", F.lit("asset"), document_id, asset_index), 256))


def url_id(document_id: Column) -> Column:
    """A document id as asset URLs hold it: itself if it has the shape, else derived from it."""
    text = document_id.cast("string")
    return F.when(text.rlike(rf"\A{_UUID}\z"), F.lower(text)).otherwise(_uuid_shape(F.sha2(text, 256)))


def asset_keys(content: Column) -> Column:
    """array<struct(document_id, asset_id)> of the URLs in a text, first use first."""
    urls = F.regexp_extract_all(content, F.lit(ASSET_URL), F.lit(0))
    keys = F.transform(
        urls,
        lambda u: F.struct(
            F.lower(F.regexp_extract(u, ASSET_URL, 1)).alias("document_id"),
            F.lower(F.regexp_extract(u, ASSET_URL, 2)).alias("asset_id"),
        ),
    )
    return F.array_distinct(keys)


def is_image(content_type: Column) -> Column:
    return F.lower(content_type).startswith("image/")


def is_visual_type(content_type: Column) -> Column:
    return F.lower(strip(F.substring_index(content_type, ";", 1))).isin(VISUAL_CONTENT_TYPES)


def is_external(reference: Column) -> Column:
    lowered = F.lower(reference)
    test = F.lit(False)
    for prefix in EXTERNAL_PREFIXES:
        test = test | lowered.startswith(prefix)
    return test


def normalize_reference(reference: Column) -> Column:
    return F.replace(strip(reference), F.lit("\\"), F.lit("/"))


def file_extension(content_type: Column) -> Column:
    """Extension for a MIME type, from the standard library's own table."""
    known = sorted(set(mimetypes.types_map.values()) | set(mimetypes.common_types.values()))
    pairs = [(t, mimetypes.guess_extension(t, strict=True)) for t in known]
    literals = chain.from_iterable((F.lit(t), F.lit(e)) for t, e in pairs if e)
    return F.coalesce(F.try_element_at(F.create_map(*literals), content_type), F.lit(".bin"))


def safe_asset_name(source_path: Column, content_type: Column, asset_index: Column) -> Column:
    """Base name of a path with an extension and only safe characters."""
    path = F.regexp_replace(F.replace(source_path, F.lit("\\"), F.lit("/")), r"(?:/+\.?)+\z", "")
    base = F.regexp_replace(F.substring_index(path, "/", -1), r"\A\.\z", "")
    named = F.when(base == "", F.concat(F.lit("asset-"), asset_index + 1)).otherwise(base)
    full = F.when(named.contains("."), named).otherwise(
        F.concat(named, file_extension(content_type))
    )
    return F.regexp_replace(full, "[^A-Za-z0-9._-]", "_")


def source_stem(source_name: Column) -> Column:
    """File-system safe stem of a document name, ``document`` when nothing is left."""
    base = F.substring_index(F.coalesce(source_name, F.lit("document")), "/", -1)

    def clean(name: Column) -> Column:
        stem = F.regexp_replace(name, r"(?<=.)\.[^.]+\z", "")
        safe = F.regexp_replace(strip(stem), "[^A-Za-z0-9._-]+", "_")
        return F.regexp_replace(safe, r"\A[._-]+|[._-]+\z", "")

    return let(clean(base), lambda s: F.when(s == "", F.lit("document")).otherwise(s))
