"""Session settings this package relies on, and the folder for cut points."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that change results or plans. Everything else is left to the cluster.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Bytes of an Arrow batch: 10,000 rows of texts or blocks would be hundreds of megabytes in every Python worker.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
    # Streams with list, map and timer state need this store.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Functions that run inside tasks import it there, whatever folder the driver
    was started in.
    """
    context = spark.sparkContext
    if getattr(context, "_shelfmark_shipped", None):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='shelfmark-package-')}/{package.name}", "zip", package.parent, package.name
    )
    context.addPyFile(archive)
    context._shelfmark_shipped = True


def configure(spark: SparkSession) -> SparkSession:
    """Ship the package and apply the settings above to an existing session."""
    ship_package(spark)
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfmark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "65536")
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def private_folder(master: str) -> str:
    """A new folder on this machine; an error on a cluster."""
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="shelfmark-checkpoint-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    Used by the iterative operators only. The folder comes from
    ``spark.checkpoint.dir``. Only a local master may do without: a folder of one
    machine is of no use to the others.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or private_folder(context.master))
    return df.checkpoint(eager=True)
