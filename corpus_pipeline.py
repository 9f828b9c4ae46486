"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before
it kept. All but the last return the columns of ``documents``; where a stage changes a
text, ``n_chars`` follows. An empty table stays empty through all stages.

1. The quality classifier learns from all labels of documents that are not held out;
   documents that it scores below 0.5 go.
2. Lines with a near copy earlier in the corpus go; a document that had words and loses
   all of its lines goes with them.
3. Of each group of near copies the document with the smallest doc_id stays.
4. Secrets are replaced by ``[SECRET]``.
5. What is left is tokenised and packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import fuzzy_lines, ngram_join, packing, quality_classifier, secret_scan
from shelfmark.llm.scratch import written
from shelfmark.session import configure

#: The classifier and the fuzzy stages have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = labels.where(~quality_classifier.held_out("doc_id")).select("doc_id", F.col("quality").alias("label"))
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, seen), out="__score")
    return scored.where("__score >= 0.5").select(*docs.columns)


def counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``n_chars`` of its present texts."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    kept = fuzzy_lines.dedup(docs)
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("")) == ""
    return counted(kept.where(~(blank & (F.col("n_removed") > 0))), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    groups = ngram_join.similar(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return counted(secret_scan.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(written(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("ngram_join", near_copies),
    ("secret_scan", secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents in ``sf_dir``."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
