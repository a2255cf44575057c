"""Named Parquet tables of one folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Bytes from which a local session spreads a table of one file over its cores.
SPREAD_FROM = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as it is stored.

    Only a session on one machine (master local[n]) spreads a single file, which Spark
    may not be able to split, over its cores; on a cluster no table is ever moved.
    """
    path = f"{folder}/{name}.parquet"
    df = spark.read.parquet(path)
    if spark.sparkContext.master.startswith("local[") and os.path.isfile(path) and os.path.getsize(path) >= SPREAD_FROM:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df
