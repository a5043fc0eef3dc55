"""Dense daily panels of (item, branch) pairs.

Every function takes and returns lazy frames. Window specifications are shared, so that one
exchange by pair serves the panel and all features built on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

PAIR = ["item", "branch"]
SEGMENT = [*PAIR, "segment_id"]
CARRY = ["category", "item_name", "unit"]


def by_pair() -> WindowSpec:
    return Window.partitionBy(*PAIR).orderBy("dt")


def by_segment() -> WindowSpec:
    return Window.partitionBy(*SEGMENT).orderBy("dt")


def daily(rows: DataFrame, order: str | None = None, carry: list[str] = CARRY) -> DataFrame:
    """One row for each item, branch and day: the sum, and each carried column's first known value.

    order: column of the row order; without one the least value is taken. Rows with a null
    key are dropped; a day of null quantities only sums to 0.
    """
    first = [(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order else F.min(c)).alias(c) for c in carry if c in rows.columns]
    keyed = rows.where("item is not null and branch is not null and dt is not null")
    return keyed.groupBy(*PAIR, "dt").agg(F.coalesce(F.sum("qty"), F.lit(0.0)).alias("qty"), *first)


def inside_closure(closures: DataFrame) -> Column:
    return (F.col("dt") >= F.col("start_dt")) & (F.col("end_dt").isNull() | (F.col("dt") < F.col("end_dt")))


def drop_closed(df: DataFrame, closures: DataFrame | None) -> DataFrame:
    """Rows outside their branch's closures [start_dt, end_dt); an open end never ends."""
    if closures is None:
        return df
    c = closures.select(F.col("branch").alias("__b"), "start_dt", "end_dt")
    return df.join(c, (df["branch"] == c["__b"]) & inside_closure(c), "left_anti")


def segments(df: DataFrame, breakpoints: DataFrame | None = None) -> DataFrame:
    """segment_id, from 1 in each pair: a new one after a missing day, or on a breakpoint that is not the first day."""
    if breakpoints is not None:
        marks = breakpoints.select("branch", "dt").distinct().withColumn("__break", F.lit(True))
        df = df.join(marks, ["branch", "dt"], "left")
    else:
        df = df.withColumn("__break", F.lit(None).cast("boolean"))
    before = F.lag("dt").over(by_pair())
    new = F.coalesce(before.isNotNull() & ((F.datediff("dt", before) > 1) | F.coalesce("__break", F.lit(False))), F.lit(False))
    number = F.sum("__new").over(by_pair().rowsBetween(Window.unboundedPreceding, 0)) + 1
    return df.withColumn("__new", new.cast("int")).withColumn("segment_id", number.cast("int")).drop("__new", "__break")


def fill_carry(df: DataFrame, carry: list[str] = CARRY) -> DataFrame:
    """Fill carried columns forward, then backward, within the pair and across segments."""
    # backwards by the reverse order: a frame that only grows costs one pass, one that shrinks a pass for each row
    upto = (Window.unboundedPreceding, 0)
    past, ahead = by_pair().rowsBetween(*upto), Window.partitionBy(*PAIR).orderBy(F.desc("dt")).rowsBetween(*upto)
    filled = {c: F.coalesce(F.last(c, True).over(past), F.last(c, True).over(ahead)) for c in carry if c in df.columns}
    return df.withColumns(filled) if filled else df


def dense_panel(days: DataFrame, closures: DataFrame | None = None, breakpoints: DataFrame | None = None) -> DataFrame:
    """A row for each day from a pair's first to its last observation, 0 where nothing was observed.

    Days inside a closure go, with what was observed on them; the range still counts them.
    Each observation is exploded up to the day before the next, so the pair's exchange is
    the only one and nothing is joined.
    """
    carry = [c for c in CARRY if c in days.columns]
    coming = F.lead("dt").over(by_pair())
    last = F.coalesce(F.date_sub(coming, 1), F.col("dt"))
    spread = days.select(*PAIR, F.col("dt").alias("seen"), "qty", *carry, last.alias("last"))
    spread = spread.withColumn("dt", F.explode(F.sequence("seen", "last")))
    on_day = F.col("dt") == F.col("seen")
    panel = spread.select(*PAIR, "dt", F.when(on_day, F.coalesce("qty", F.lit(0.0))).otherwise(0.0).alias("qty"), *[F.when(on_day, F.col(c)).alias(c) for c in carry])
    return fill_carry(segments(drop_closed(panel, closures), breakpoints), carry)


def enough_history(panel: DataFrame, cutoff: str, days: int = 60) -> DataFrame:
    """Rows of pairs with at least `days` panel days before the cutoff; counted in the pair's own partition."""
    before = F.count_if(F.col("dt") < F.lit(cutoff).cast("date")).over(Window.partitionBy(*PAIR))
    return panel.withColumn("__before", before).where(F.col("__before") >= days).drop("__before")


def without_warmup(panel: DataFrame, lookback: int = 28, keys: list[str] | None = None) -> DataFrame:
    """Rows that have `lookback` earlier rows in their segment (their pair, without segments)."""
    keys = keys or (SEGMENT if "segment_id" in panel.columns else PAIR)
    position = F.row_number().over(Window.partitionBy(*keys).orderBy("dt"))
    return panel.withColumn("__n", position).where(F.col("__n") > lookback).drop("__n")


def branch_matrix(days: DataFrame) -> DataFrame:
    """Total of each branch on every day of the whole range, 0 where it had none."""
    totals = days.groupBy("branch", "dt").agg(F.sum("qty").alias("qty"))
    first = days.agg(F.min("dt").alias("a"), F.max("dt").alias("b")).first()
    calendar = F.sequence(F.lit(first.a), F.lit(first.b)) if first.a else F.array().cast("array<date>")
    grid = days.select("branch").distinct().select("branch", F.explode(calendar).alias("dt"))
    return grid.join(totals, ["branch", "dt"], "left").select("branch", "dt", F.coalesce("qty", F.lit(0.0)).alias("qty"))


def unrecorded_gaps(days: DataFrame, closures: DataFrame, least: int = 14) -> DataFrame:
    """Runs of at least `least` days without any row of a branch that no closure wholly covers."""
    dates = days.select("branch", "dt").distinct()
    before = F.lag("dt").over(Window.partitionBy("branch").orderBy("dt"))
    gaps = dates.select("branch", F.date_add(before, 1).alias("gap_start"), F.date_sub("dt", 1).alias("gap_end"), (F.datediff("dt", before) - 1).alias("days"))
    gaps = gaps.where(F.col("days") >= least)
    c = closures.select(F.col("branch").alias("__b"), "start_dt", "end_dt")
    covers = (gaps["branch"] == c["__b"]) & (c["start_dt"] <= gaps["gap_start"]) & (c["end_dt"].isNull() | (gaps["gap_end"] < c["end_dt"]))
    return gaps.join(c, covers, "left_anti")
