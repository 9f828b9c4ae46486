"""Headline timings on one machine; prints one JSON line.

Index tables are written once, as a corpus keeps them, and the searches read
them back. Every other entry is a registered query run over its whole tables.
Each timing covers building the plan and running it to the last row.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from shelfmark import checks  # noqa: E402
from shelfmark import fixtures as X  # noqa: E402
from shelfmark.checks.retrieval import fixture_scores, vector_requests  # noqa: E402
from shelfmark.operators.vectors import sparse_vectors  # noqa: E402
from shelfmark.plans.search import Corpus, SearchOptions, advanced_search, search  # noqa: E402
from shelfmark.session import local_session  # noqa: E402

REGISTERED = [
    "dense_search",
    "merge_blocks",
    "markdown_blocks",
    "html_blocks",
    "content_list_blocks",
    "build_chunks",
    "build_structured_chunks",
    "ingest_outcomes",
    "ingest_mixed",
    "sheet_chunks",
    "merge_overlaps",
    "title_path",
    "register_documents",
    "update_governance",
    "next_version",
    "kb_counts",
    "rate_limit",
    "reuse_results",
    "validate_documents",
    "facet_search",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "12g"))
    checks.load()
    store = tempfile.mkdtemp(prefix="shelfmark-bench-")
    timings: dict[str, float] = {}

    def timed(name: str, action) -> None:
        start = time.perf_counter()
        action()
        timings[name] = round(time.perf_counter() - start, 3)

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    spark.range(1000).selectExpr("sum(id)").collect()

    def keep(name: str, df) -> None:
        df.write.parquet(f"{store}/{name}")

    timed("ingest_documents", lambda: keep("chunks", sparse_vectors(X.chunks(spark, sf_dir))))
    keep("documents", X.documents(spark, sf_dir).drop("content"))
    keep("kbs", X.knowledge_bases(spark, sf_dir))
    keep("dense", X.dense_index(spark, sf_dir))
    keep("visual", X.visual_index(spark, sf_dir))
    keep("requests", vector_requests(spark, sf_dir))
    table = lambda name: spark.read.parquet(f"{store}/{name}")
    chunks = table("chunks")
    corpus = Corpus(
        table("kbs"),
        table("documents"),
        chunks.select("chunk_id", "document_id", "kb_id", "chunk_index", "content"),
        sparse_index=chunks.select("chunk_id", "document_id", "kb_id", "chunk_type", "tags", "sparse"),
        dense_index=table("dense"),
        visual_index=table("visual"),
    )
    requests = table("requests")

    timed("hybrid_search", lambda: drain(search(requests, corpus, SearchOptions(), fixture_scores()).results))
    one = requests.where(F.col("request_id") == 0)
    timed("hybrid_search_one_query", lambda: drain(search(one, corpus, SearchOptions(), fixture_scores()).results))
    texts = requests.select("request_id", "query", "kb_ids")
    timed(
        "advanced_search",
        lambda: drain(advanced_search(texts, corpus, rewrite=True, hyde=True, decompose=True)),
    )
    for name in REGISTERED:
        timed(name, lambda: drain(checks.QUERIES[name](spark, sf_dir)))

    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
