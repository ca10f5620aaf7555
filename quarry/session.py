"""Sessions, tables and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster, use the session that is there."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarry")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def wide_table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """As :func:`table`, for work that costs far more than reading.

    A scan of so few parts that half the cores would be idle is spread over all of them. Such a scan is small, as a part
    is at most ``spark.sql.files.maxPartitionBytes``; a larger one is read as it lies, without a shuffle.
    """
    rows = table(spark, directory, name)
    rows = rows.select(*columns) if columns else rows
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows._jdf.queryExecution().toRdd().getNumPartitions() <= cores else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local one, but only if all executors are in this process (tests); on a cluster that is an error.
    """
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if known is None and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(known or os.path.join(tempfile.gettempdir(), "quarry-checkpoints"))
    return known or context.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the application ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid4()}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives executors this package, once for each application, for those that can't import it themselves."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="quarry-")
    path = os.path.join(folder, "quarry_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(application)
