"""Column layouts of the corpus tables."""

from __future__ import annotations

from pyspark.sql import types as T

REVIEW_STATUSES = ["draft", "reviewed", "published", "deprecated"]
KB_STATUSES = ["active", "archived", "disabled"]
DOCUMENT_STATUSES = ["pending", "processing", "completed", "failed"]

# Columns every document version and audit snapshot carries, in this order.
SNAPSHOT_FIELDS = [
    "document_id",
    "kb_id",
    "name",
    "file_type",
    "file_size",
    "minio_path",
    "file_hash",
    "source_type",
    "source_url",
    "governance_source_type",
    "authority_level",
    "review_status",
    "current_version",
    "status",
    "chunk_count",
]
# Columns copied into a version row.
VERSION_FIELDS = [f for f in SNAPSHOT_FIELDS if f not in ("current_version", "status", "chunk_count")]
# Governance columns a search point shows next to its vectors.
PAYLOAD_FIELDS = ["governance_source_type", "authority_level", "review_status", "document_version"]

BLOCK_TYPE = T.StructType(
    [
        T.StructField("block_index", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("page_num", T.IntegerType()),
        T.StructField("bbox", T.StringType()),
        T.StructField("heading_level", T.IntegerType()),
        T.StructField("title_path", T.ArrayType(T.StringType())),
        T.StructField("block_type", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Layouts of the shared input tables. Reading with a schema skips inference and
# keeps column pruning exact.
INPUT_SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
}
