"""Session helpers: default settings, and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffles are deleted at its end instead of when the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of tables written by ``settle`` that are still there.
_written: list[str] = []


def local_session(cores: int = 8, app: str = "attesta") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where none is named a session on this machine alone gets a temporary one; on a cluster
    that is an error, as no machine-local folder would do.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="attesta-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def settle(df: DataFrame, tidy: bool = False) -> DataFrame:
    """``df`` written as a table in the shared folder and read again, which cuts its lineage.

    With ``tidy`` the shuffles that the writing needed leave the disk as soon as the table is there.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/attesta-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true" if tidy else before)
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    _written.append(folder)
    settled = df.sparkSession.read.schema(df.schema).parquet(folder)
    settled._folder = folder
    return settled


def forget(*settled: DataFrame) -> None:
    """Delete tables of ``settle`` that no later step reads."""
    for df in settled:
        _delete(df.sparkSession, df._folder)


def release(spark: SparkSession) -> None:
    """Delete what ``settle`` wrote and drop what is kept in memory; results not yet used can't be read afterwards."""
    for folder in list(_written):
        _delete(spark, folder)
    spark.catalog.clearCache()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _written:
        _written.remove(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as a shuffle has, however few bytes it is: for rows that take much work each."""
    return df.repartition(shuffle_partitions(df.sparkSession))


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster whose machines don't share that folder, pass it with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parent.parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
