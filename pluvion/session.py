"""Session helpers: lineage cuts in the shared checkpoint folder, table reading."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and everything runs on this machine (tests) a temporary one is chosen; on a cluster a folder
    of the driver's machine would lose data, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the application ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back, so that it is computed once and survives lost executors.

    Spark removes the files when the result is no longer used, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def private_prefix(df: DataFrame) -> str:
    """Start for the names of helper columns that none of ``df``'s own columns has."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def configured(spark: SparkSession) -> SparkSession:
    """What an application sets once, before it runs queries; operators and ``table`` change nothing in a session.

    Stamps without zone count as UTC throughout, so the session's zone is set to it.  Fused stages whose code passes the
    JVM's 8000-byte limit for compilation run operator by operator instead: the JVM never compiles larger methods, and the
    stamp expressions are three times as fast this way.  Batches sent to Python hold 8 MB, since texts may be
    long.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, in case they don't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_pluvion_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), package.name), "zip", package.parent, package.name)
    sc.addPyFile(archive)
    sc._pluvion_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer partitions than there are cores (one small file) is dealt out, so that costly
    expressions run side by side; others are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
