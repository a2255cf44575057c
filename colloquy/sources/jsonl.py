"""JSON sources with declared schemas, and the sinks that write them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_documents(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """One document per file: its fields, file (the name) and split (the last folder)."""
    df = spark.read.schema(schema).json(folder, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    path = F.col("_metadata.file_path")
    return df.select("*", F.col("_metadata.file_name").alias("_file"), F.element_at(F.split(path, "/"), -2).alias("_split")).withColumns({"file": F.col("_file"), "split": F.col("_split")}).drop("_file", "_split")


def json_lines(spark: SparkSession, path: str | list[str], schema: str | StructType, tolerant: bool = False) -> DataFrame:
    """One object per line. Tolerant: malformed lines are skipped; else they fail."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED" if tolerant else "FAILFAST")


def write_lines(df: DataFrame, path: str, mode: str = "overwrite", by: str | None = None) -> None:
    """JSON lines; mode "ignore" writes only where nothing is yet, "append" adds. by: one folder per value."""
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    (w.partitionBy(by) if by else w).json(path)


def write_counted(df: DataFrame, path: str, mode: str = "overwrite", utterances: str = "utterances") -> tuple[int, int]:
    """write_lines(), and how many rows and utterances were written: counted while the rows pass, not by another scan."""
    seen = Observation(f"written-{uuid.uuid4().hex}")
    write_lines(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.greatest(F.size(utterances), F.lit(0)).cast("long")), F.lit(0)).alias("utterances")), path, mode)
    got = seen.get
    return got["rows"], got["utterances"]


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per split; unknown splits go to train."""
    from colloquy.operators.curate import route

    write_lines(df.withColumn("split", route()), path, mode, "split")


def overlaid(defaults: dict, *more: dict) -> dict:
    """Settings, later ones over earlier ones."""
    out = dict(defaults)
    for m in more:
        out.update(m)
    return out
