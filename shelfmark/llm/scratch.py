"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from shelfmark.session import private_folder


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only a local master may do without the setting; it then gets a private folder
    once per application.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        context.setCheckpointDir(private_folder(context.master))
        named = context.getCheckpointDir()
    return named.rstrip("/")


#: Whether shuffle files go when the query that made them ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go at its end: the plan of a write is not run again."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``written``, in buckets by ``key``: a later join or grouping by it moves only the other side."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with tidy(spark):
        df.write.format("parquet").bucketBy(buckets, key).option("path", f"{folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def discard(df: DataFrame) -> None:
    """Delete the table that ``written`` or ``dealt`` made, once what was made from it is written itself."""
    spark = df.sparkSession
    for place in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        name = place.rsplit("/", 1)[1]
        if not re.fullmatch(r"[\w-]+[_-][0-9a-f]{32}", name):
            raise ValueError(f"{place} is no intermediate table")
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
