"""Cutting a plan's lineage in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where the session names no shared folder, on a single machine only (tests).
LOCAL_FOLDER = "file:///tmp/checkpoints"
#: Rows of a table that counts as a small dimension, at most.
SMALL_ROWS = 100_000
#: Rows of a part of a table that is passed over again and again.
PART_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (base or LOCAL_FOLDER).rstrip("/")


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, removed when the JVM ends."""
    path = f"{shared_folder(spark)}/granary-{name}-{uuid.uuid4().hex}"
    fs, at = _place(spark, path)
    fs.deleteOnExit(at)
    return path


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/granary-cut-{uuid.uuid4().hex}"
    fs, at = _place(spark, path)
    fs.deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """The rows, written as a table and read again; survives lost executors, removed when the JVM ends.

    Unlike checkpoint() this computes the rows once, and what reads them takes only its columns.
    """
    return _written(df)[0]


class Latest:
    """A table that is written anew now and then; the one before goes, as does the last with `drop`."""

    def __init__(self, df: DataFrame):
        self.frame, self.path = _written(df)

    def put(self, df: DataFrame) -> None:
        """df may read the table itself."""
        new, path = _written(df)
        self.drop()
        self.frame, self.path = new, path

    def drop(self) -> None:
        fs, at = _place(self.frame.sparkSession, self.path)
        fs.delete(at, True)


def spread(spark: SparkSession, rows: int | None = None) -> int:
    """Partitions of a table that is passed over again and again: enough for all cores, however small it is.

    Beyond that they follow its own rows where these are counted; the setting of shuffles follows
    larger inputs, and each pass would start as many tasks.
    """
    cores = spark.sparkContext.defaultParallelism
    return max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")) if rows is None else -(-rows // PART_ROWS))


def small(df: DataFrame) -> DataFrame:
    """A dimension, broadcast if it has SMALL_ROWS rows at most (counted, and no further)."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df
