"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch. Texts are long, so batches are kept small to bound worker memory.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary one if all run on this machine."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rulewright-"))
        known = context.getCheckpointDir()
    return known.rstrip("/")


#: Whether an execution's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor costs a reread, not a rerun.

    ``keep`` writes a table, deletes the shuffle files it took and reads it back; ``drop`` deletes the ones that no later step needs.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/rulewright-{name}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        before = self.spark.conf.get(SHUFFLES_GO)
        self.spark.conf.set(SHUFFLES_GO, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(SHUFFLES_GO, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            path = getattr(df, "scratch_path", None)
            if path:
                jvm = self.spark.sparkContext._jvm
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Ids up to this count (8 bytes each) are sent to every executor; more are joined by shuffling.
BROADCAST_IDS = 1_000_000


def few_broadcast(df: DataFrame) -> DataFrame:
    """df (written, a few numbers a row) marked for sending to every executor, if a count says that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def with_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is in ids (written, column key), without shuffling long texts for few ids."""
    return df.join(few_broadcast(ids), key, "left_semi")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use reads it (also inside of its lambdas)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
