"""Session settings and durable cuts of the lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "colloquy", cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the one that is there."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Only a session on one machine (tests) may do without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="colloquy-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_written: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted by release()."""
    path = os.path.join(checkpoint_folder(spark), f"{name}-{uuid.uuid4().hex}")
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def durable(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back.

    The result does not depend on any executor: one that is lost takes nothing
    with it. Parquet keeps the copy compressed and lets later reads prune columns.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what durable() has written in this application; call it when the results that rest on it are stored. How many were deleted."""
    n = 0
    jvm = spark.sparkContext._jvm
    for path in _written.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        n += bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))
    return n


def small(df: DataFrame, most: int = 50_000) -> DataFrame:
    """df, to be broadcast if it has been counted to hold no more than so many rows; else Spark chooses the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
