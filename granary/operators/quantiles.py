"""Exact quantiles of groups of any size, without a task that holds a group's values.

Equal values are counted before anything moves. The counted values are dealt into ranges of
group and value, so a large group lies in many ranges; running counts say which value has which rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import cut, small
from .prefix import running_sums


def counted(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by, v, n): the known values of each group with how often they come."""
    return rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("v")).agg(F.count("*").alias("n"))


def with_groups(rows: DataFrame, groups: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """`rows` with the columns of their group; a null in `by`, which has a column at least, is a value like others."""
    named = groups.select(*[F.col(c).alias(f"__by_{c}") for c in by], *[c for c in groups.columns if c not in by])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return rows.join(small(named), same, how).drop(*[f"__by_{c}" for c in by])


def exact_quantiles(counts: DataFrame, by: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(by, q25 ...): the quantiles of `counted` values, between neighbours in proportion."""
    summed = cut(running_sums(counts, [*by, "v"], {"upto": F.col("n")}))
    groups = cut(summed.groupBy(*by).agg(F.sum("n").alias("__size"), F.min(F.col("upto") - F.col("n")).alias("__begin")))
    x = with_groups(summed, groups, by).withColumn("__upto", F.col("upto") - F.col("__begin"))
    spot = lambda p: F.lit(p) * (F.col("__size") - 1)
    value = lambda rank: F.max(F.when((rank >= F.col("__upto") - F.col("n")) & (rank < F.col("__upto")), F.col("v")))
    ends = [f(spot(p)) for p in shares for f in (F.floor, F.ceil)]
    out = x.groupBy(*by).agg(F.max("__size").alias("__size"), *[value(r).alias(f"__v{i}") for i, r in enumerate(ends)])
    between = lambda i, p: F.col(f"__v{2 * i}") + (F.col(f"__v{2 * i + 1}") - F.col(f"__v{2 * i}")) * (spot(p) - F.floor(spot(p)))
    return out.select(*by, *[between(i, p).alias(f"q{round(100 * p)}") for i, p in enumerate(shares)])
