"""Sinks: what the jobs leave behind for other programs. All are written by the executors in parallel."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Where jobs keep tables between rounds: spark.checkpoint.dir, which driver and executors share. A session without it
    gets a temporary folder if it runs in one process, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = tempfile.mkdtemp(prefix="spark-")
    return folder


def json_lines(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One JSON object per row; a folder per value of ``by``. A run replaces only the folders it writes."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false")
    (writer.partitionBy(*by) if by else writer).json(path)


def tables(rows: DataFrame, path: str, by: list[str], rows_per_file: int = 1_000_000) -> None:
    """Parquet with a folder per value of ``by``; a large folder is several files, so no task holds all of it."""
    writer = rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*by).parquet(path)


def csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; arrays as JSON."""
    nested = {f.name for f in rows.schema if f.dataType.typeName() in ("array", "map", "struct")}
    rows.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns)).write.mode("overwrite").option("header", True).csv(path)


def append_records(rows: DataFrame, path: str, key: str) -> None:
    """Adds versions to a record store; the newest version of a key wins when it is read (rules.latest)."""
    rows.where(F.col(key).isNotNull()).write.mode("append").parquet(path)
