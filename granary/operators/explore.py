"""Aggregates for exploring a demand table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.lineage import cut
from .panel import PAIR, by_segment
from .quantiles import counted, exact_quantiles, with_groups


def dedup_sum(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of rows alike in all keys, rounded half-even to one decimal."""
    return rows.groupBy(*keys).agg(F.bround(F.sum("qty"), 1).alias("qty"))


def completeness(days: DataFrame) -> DataFrame:
    """Observed and expected days of each branch over its own range."""
    out = days.groupBy("branch").agg(F.count_distinct("dt").alias("n_days"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
    expected = F.datediff("last_dt", "first_dt") + 1
    return out.withColumns({"expected": expected, "pct": 100.0 * F.col("n_days") / expected})


def missing_dates(days: DataFrame) -> DataFrame:
    """Days of a branch's range on which it has no row."""
    seen = days.select("branch", "dt").distinct()
    span = seen.groupBy("branch").agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    span = span.select("branch", F.explode(F.sequence("a", "b")).alias("dt"))
    return span.join(seen, ["branch", "dt"], "left_anti")


def consistency(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Distinct values of each column by key."""
    return rows.groupBy(key).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def event_days(days: DataFrame, least: int = 2) -> DataFrame:
    """Branch days with at least `least` items."""
    out = days.groupBy("dt", "branch").agg(F.count_distinct("item").alias("n_items"), F.sum("qty").alias("qty"))
    return out.where(F.col("n_items") >= least)


def weekday_profile(days: DataFrame) -> DataFrame:
    """Mean daily total of each branch by weekday."""
    totals = days.groupBy("branch", "dt").agg(F.sum("qty").alias("total"))
    return totals.groupBy("branch", F.weekday("dt").alias("dow")).agg(F.avg("total").alias("mean_qty"))


def weekday_pivot(days: DataFrame) -> DataFrame:
    """The weekday profile as a row for each branch, in percent off the branch's mean of weekdays."""
    wide = weekday_profile(days).groupBy("branch").pivot("dow", list(range(7))).agg(F.first("mean_qty"))
    mean = sum((F.coalesce(F.col(str(d)), F.lit(0.0)) for d in range(7)), F.lit(0.0)) / sum((F.col(str(d)).isNotNull().cast("int") for d in range(7)), F.lit(0))
    return wide.select("branch", *[(100 * (F.col(str(d)) / mean - 1)).alias(f"dow_{d}") for d in range(7)])


def weekday_correlation(days: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Correlation of two years' weekday shapes, of branches that have all seven weekdays in both, and pooled ('all')."""
    totals = days.groupBy("branch", "dt").agg(F.sum("qty").alias("total")).where(F.year("dt").isin(*years))
    mean = totals.groupBy("branch", F.year("dt").alias("y"), F.weekday("dt").alias("dow")).agg(F.avg("total").alias("m"))
    w = Window.partitionBy("branch", "y")
    shape = mean.withColumns({"n": F.count("*").over(w), "dev": 100 * (F.col("m") / F.avg("m").over(w) - 1)}).where("n = 7")
    a = shape.where(F.col("y") == years[0]).select("branch", "dow", F.col("dev").alias("a"))
    pairs = a.join(shape.where(F.col("y") == years[1]).select("branch", "dow", F.col("dev").alias("b")), ["branch", "dow"])
    each = pairs.groupBy("branch").agg(F.corr("a", "b").alias("r"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb")).where("sa > 0 and sb > 0")
    return each.select("branch", "r").unionByName(pairs.agg(F.corr("a", "b").alias("r")).select(F.lit("all").alias("branch"), "r"))


def zero_share(panel: DataFrame) -> DataFrame:
    """Percent of a pair's panel days without demand."""
    return panel.groupBy(*PAIR).agg((100 * F.avg((F.col("qty") == 0).cast("double"))).alias("zero_pct"), F.count("*").alias("n_days"))


def rolling_variation(panel: DataFrame, size: int = 3) -> DataFrame:
    """Coefficient of variation of a pair's trailing sums."""
    total = F.when(F.count("qty").over(by_segment().rowsBetween(-(size - 1), 0)) == size, F.sum("qty").over(by_segment().rowsBetween(-(size - 1), 0)))
    sums = panel.select(*PAIR, total.alias("s")).where("s is not null")
    return sums.groupBy(*PAIR).agg(F.try_divide(F.stddev_samp("s"), F.avg("s")).alias("cv"))


def null_profile(rows: DataFrame) -> DataFrame:
    """(column, n_null, n_distinct) of every column, in one pass."""
    cols = rows.columns
    stats = rows.agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("n_null"), F.count_distinct(c).alias("n_distinct")).alias(c) for c in cols])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.n_null").alias("n_null"), F.col(f"{c}.n_distinct").alias("n_distinct")) for c in cols]))
    return stats.select(each.alias("s")).select("s.*")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of keys that occur more than once."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("n", n).where("n > 1")


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts by bin of log1p values; bin 0 lies below, bins + 1 above."""
    return rows.groupBy(F.width_bucket(F.log1p(column), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def largest(rows: DataFrame, column: str, n: int, ties: list[str]) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(column), *ties).limit(n)


def month_profile(days: DataFrame) -> DataFrame:
    """Mean daily total of each branch by month of the year."""
    totals = days.groupBy("branch", "dt").agg(F.sum("qty").alias("total"))
    return totals.groupBy("branch", F.month("dt").alias("month")).agg(F.avg("total").alias("mean_qty"))


def category_profile(days: DataFrame) -> DataFrame:
    """Mean daily total of each category by weekday."""
    totals = days.groupBy("category", "dt").agg(F.sum("qty").alias("total"))
    return totals.groupBy("category", F.weekday("dt").alias("dow")).agg(F.avg("total").alias("mean_qty"))


def describe(rows: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, least, exact quartiles and largest of a column."""
    if not by:
        return describe(rows.withColumn("__all", F.lit(True)), column, ["__all"]).drop("__all")
    by = list(by)
    stats = rows.groupBy(*by).agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    quartiles = exact_quantiles(counted(rows, column, by), by)
    return with_groups(stats, quartiles, by, "left").select(*by, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def box_stats(rows: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles and whiskers of each group: the farthest values within 1.5 times the quartiles' distance.

    `rows` are read once: whiskers come from the counted values.
    """
    counts = cut(counted(rows, column, [by]))
    q = cut(exact_quantiles(counts, [by]))
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = with_groups(counts, q, [by]).where(F.col("v").between(F.col("q25") - reach, F.col("q75") + reach))
    return inside.groupBy(by).agg(*[F.max(c).alias(c) for c in ("q25", "q50", "q75")], F.min("v").alias("low"), F.max("v").alias("high"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows of each value, null among them."""
    return rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def sample_rows(rows: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """`n` rows, the same for a seed however the rows are dealt: those whose keys hash lowest with it."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *keys).limit(n)


def spikes(days: DataFrame, ratio: float = 5.0, prefix: str | None = None) -> DataFrame:
    """Days of at least `ratio` times the pair's median of positive days, over its whole history; `prefix` keeps items that start with it."""
    x = days.where(F.col("item").startswith(prefix)) if prefix else days
    median = F.median(F.when(F.col("qty") > 0, F.col("qty"))).over(Window.partitionBy(*PAIR))
    x = x.withColumn("median_qty", median).withColumn("ratio", F.when(F.col("median_qty") > 0, F.col("qty") / F.col("median_qty")))
    return x.where(F.col("ratio") >= ratio)


def failing_pairs(panel: DataFrame, cutoff: str, least: int) -> DataFrame:
    """Pairs with fewer than `least` days before the cutoff, and why: no other pair of the item, or of the branch, has enough."""
    n = panel.groupBy(*PAIR).agg(F.count_if(F.col("dt") < F.lit(cutoff).cast("date")).alias("n"))
    flagged = n.withColumns({f"__{c}": F.max((F.col("n") >= least).cast("int")).over(Window.partitionBy(c)) for c in PAIR})
    reason = F.when(F.col("__item") == 0, "new item").when(F.col("__branch") == 0, "new branch").otherwise("other")
    return flagged.where(F.col("n") < least).select(*PAIR, "n", reason.alias("reason"))


def group_values(rows: DataFrame, keys: list[str], aggregates: dict) -> DataFrame:
    """Aggregates of each row's group as columns beside it."""
    return rows.withColumns({k: a.over(Window.partitionBy(*keys)) for k, a in aggregates.items()})
