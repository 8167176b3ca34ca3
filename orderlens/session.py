"""Session settings the plans of this package rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

def build_session(cpus: int | str = "*", memory: str = "8g", app: str = "orderlens",
                  **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        # Call-site tracking costs several round trips to the JVM per expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(
            spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix=f"{app}-"))
    return tune(spark)


def tune(spark: SparkSession, initial_partitions: int | None = None) -> SparkSession:
    """Runtime settings: adaptive plans, and hot join keys split even where the
    split costs one more shuffle (an order or product may hold a third of all lines).

    ``initial_partitions`` is for the owner of the session: how many partitions a shuffle
    starts from before adaptive execution merges small ones, about the bytes a shuffle moves
    over 256 MB. No query changes it, and nothing clamps it.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    if initial_partitions is not None:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                       str(initial_partitions))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as set through the context or as
    ``spark.checkpoint.dir`` of the session. There is no default.
    """
    folder = set_folder(spark)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder


def set_folder(spark: SparkSession) -> str | None:
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for a table written by this run; what is written
    there goes when the session ends.
    """
    path = f"{shared_folder(spark)}/{name}-{os.urandom(6).hex()}"
    where, fs = hadoop_path(spark, path)
    fs.deleteOnExit(where)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """A path as Hadoop's file systems take it, and the file system it lies in."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(sc._jsc.hadoopConfiguration())
