"""The daily table as a stream: raw rows in, one row for each item, branch and day out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming import DataStreamWriter

from ..operators.panel import CARRY, PAIR, daily


def daily_stream(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """Tumbling daily sums of a stream (item, branch, ts, qty); rows later than `late` are dropped."""
    keyed = rows.where("item is not null and branch is not null").withWatermark("ts", late)
    sums = keyed.groupBy(F.window("ts", "1 day"), "item", "branch").agg(F.coalesce(F.sum("qty"), F.lit(0.0)).alias("qty"))
    return sums.select("item", "branch", F.to_date("window.start").alias("dt"), "qty")


def newest(rows: DataFrame) -> DataFrame:
    """Of the rows alike in (row_id, item, branch, dt), the one of the greatest version.

    Equal versions are told apart by the other columns' values, so the order of arrival never
    matters. A null version is the least. Rows without an id are all kept: they can't be
    corrected, and a repeat of one counts twice.
    """
    keys = ["row_id", *PAIR, "dt"]
    rest = ["version", "removed", *sorted(c for c in rows.columns if c not in (*keys, "version", "removed"))]
    named = rows.where("row_id is not null").groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__row"))
    named = named.select(*keys, "__row.*")
    return named.unionByName(rows.where("row_id is null").select(named.columns))


def latest(rows: DataFrame) -> DataFrame:
    """The newest rows, without those that are removals."""
    return newest(rows).where("not coalesce(removed, false)")


class DailyTable:
    """A stored daily table that a stream of rows keeps equal to `daily` over all rows given so far.

    rows: row_id, version, removed, item, branch, dt, qty, the order column and the carried
    ones. A row of a greater version corrects the one with its id, item, branch and day; one
    that is `removed` takes it away. A row that moves to another day is a removal there and a
    new row here. Rows with a null item, branch or day are left out.

    The rows are the state: they lie in `folder`/rows by batch and day, and a batch works out
    anew the days that it touches from all their rows. So no row is ever too late, a correction
    may take away the first known value of a carried column, and nothing is held in memory;
    a batch that is run again after a failure writes the same files. What a batch costs follows
    from the rows of its days, which the folders' names find without reading others; a day's
    rows are summed before they are exchanged, however many one pair has. Stored rows are kept:
    each batch adds a folder for each of its days, until `compact` puts them together.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str | S.StructType, order: str | None = None, carry: list[str] = CARRY):
        self.spark, self.folder, self.order = spark, folder.rstrip("/"), order
        given = spark.createDataFrame([], schema).schema
        self.columns = [f for f in given.fields if f.name != "dt"]
        self.carry = [c for c in carry if c in given.names]
        self.schema = S.StructType([*self.columns, S.StructField("batch", S.LongType()), S.StructField("dt", S.DateType())])
        kept = {f.name: f.dataType for f in self.columns}
        self.day = S.StructType([S.StructField(c, t) for c, t in [*((c, kept[c]) for c in PAIR), ("qty", S.DoubleType()), *((c, kept[c]) for c in self.carry), ("dt", S.DateType())]])

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).option("basePath", f"{self.folder}/rows").parquet(f"{self.folder}/rows")

    def merge(self, batch: DataFrame, number: int) -> None:
        """Add the rows of one batch; the same number again replaces what it added."""
        spark = batch.sparkSession
        rows = batch.where("item is not null and branch is not null and dt is not null").select(*[f.name for f in self.columns], "dt")
        # files by day, of even sizes: a day of many rows is cut, small ones share a task
        rows.hint("rebalance", "dt").write.partitionBy("dt").mode("overwrite").parquet(f"{self.folder}/rows/batch={number}")
        stored = self._stored(spark).where(F.col("batch") <= number)
        days = [r.dt for r in stored.where(F.col("batch") == number).select("dt").distinct().collect()]
        if not days:
            return
        # the days' rows are read by their folders' names
        table = daily(latest(stored.where(F.col("dt").isin(days)).drop("batch")), self.order, self.carry)
        table = table.select(*[F.col(f.name).cast(f.dataType) for f in self.day])
        # a row without an item for each day, so that a day whose last row was removed is written too
        marks = spark.createDataFrame([(d,) for d in days], "dt date")
        table = table.unionByName(marks, allowMissingColumns=True)
        table.hint("rebalance", "dt").write.partitionBy("dt").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/days")

    def follow(self, rows: DataFrame, checkpoint: str) -> DataStreamWriter:
        """The stream's writer; the caller sets its trigger and starts it."""
        return rows.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint)

    def compact(self, number: int) -> None:
        """Put the newest rows of the batches up to `number` into one folder.

        To be run while no stream writes, with the number of a batch before the last; a run that
        failed is finished by the next one.
        """
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

        def finish() -> None:
            for at in [s.getPath() for s in fs.listStatus(path(self.folder))]:
                if at.getName().startswith("compacted-") and fs.exists(path(at, "_SUCCESS")):
                    for old in [s.getPath() for s in fs.listStatus(path(f"{self.folder}/rows"))]:
                        if old.getName().startswith("batch=") and int(old.getName()[6:]) <= int(at.getName()[10:]):
                            fs.delete(old, True)
                    fs.rename(at, path(f"{self.folder}/rows/batch=-1"))

        finish()
        rows = newest(self._stored(self.spark).where(F.col("batch") <= number).drop("batch"))
        rows.hint("rebalance", "dt").write.partitionBy("dt").mode("overwrite").parquet(f"{self.folder}/compacted-{number}")
        finish()

    def read(self) -> DataFrame:
        """The daily table as it stands."""
        rows = self.spark.read.schema(self.day).parquet(f"{self.folder}/days")
        return rows.where("item is not null").select(*PAIR, "dt", "qty", *self.carry)
