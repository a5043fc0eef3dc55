"""Running sums over a whole table without sorting it in one task.

Rows are dealt into ranges of their order, each range is summed alone, and the ranges' totals
(one small row each) say with what each begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.lineage import cut, small


def running_sums(rows: DataFrame, order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """`rows` with, for each name in `sums`, the sum of its values up to and with the row, in `order`, which must be unique."""
    held = {f"__{k}": v for k, v in sums.items()}
    rows = cut(rows.withColumns(held))  # dealing by range reads the rows twice
    dealt = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy("__range").agg(*[F.sum(c).alias(c) for c in held])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = cut(totals.select("__range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_begin") for c in held]))  # a row for each range
    upto = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.join(small(begins), "__range").withColumns({k: F.col(f"__{k}_begin") + F.sum(f"__{k}").over(upto) for k in sums})
    return summed.drop("__range", *held, *[f"{c}_begin" for c in held])


def ordinals(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`rows` with their number from 0 in the order of `keys`, which must be unique."""
    return running_sums(rows, keys, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)
