"""Contract checks of a featured panel: one row for each check with its violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .panel import PAIR, by_segment, inside_closure


def qa_checks(panel: DataFrame, closures: DataFrame, required: list[str]) -> DataFrame:
    """(check, violations); columns that the panel lacks count under required_columns, and their checks pass."""
    cols = set(panel.columns)
    flags = {"qty_not_negative": ("qty", F.col("qty") < 0)}
    if "qty_capped" in cols:
        flags["capped_within_raw"] = ("qty_capped", F.col("qty_capped") > F.col("qty"))
    if {"target_lead_time_cumulative", "target_lead_time_cumulative_capped"} <= cols:
        flags["capped_target_within_raw"] = ("", F.col("target_lead_time_cumulative_capped") > F.col("target_lead_time_cumulative") + 1e-9)
    if "city" in cols:
        flags["city_known"] = ("city", F.col("city") == "Unknown")
    if "region" in cols:
        flags["region_known"] = ("region", F.col("region").isNull())
    step = F.datediff("dt", F.lag("dt").over(by_segment()))
    rows = panel.withColumn("__step", step).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, (_, c) in flags.items()], F.count_if(F.col("__step") != 1).alias("step_is_one_day"))
    keys = panel.groupBy(*PAIR, "dt").count().agg(F.count_if(F.col("count") > 1).alias("unique_keys"))
    pairs = panel.groupBy(*PAIR).agg(F.min("segment_id").alias("lo"), F.max("segment_id").alias("hi"), F.count_distinct("segment_id").alias("n"))
    pairs = pairs.agg(F.count_if(F.col("lo") != 1).alias("segments_from_one"), F.count_if(F.col("n") != F.col("hi")).alias("segments_gapless"))
    c = closures.select(F.col("branch").alias("__b"), "start_dt", "end_dt")
    closed = panel.join(c, (panel["branch"] == c["__b"]) & inside_closure(c), "left_semi").agg(F.count("*").alias("outside_closures"))
    tables = [rows, keys, pairs, closed]
    if "city" in cols:
        tables.append(panel.groupBy("branch").agg(F.count_distinct("city").alias("n")).agg(F.count_if(F.col("n") > 1).alias("one_city_a_branch")))
    spark = panel.sparkSession
    out = spark.createDataFrame([("required_columns", len(set(required) - cols))], "check string, violations long")
    for t in tables:
        out = out.unionByName(t.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, t.columns)), F.array(*t.columns))).alias("check", "violations")))
    return out


def assert_qa(checks: DataFrame) -> None:
    bad = checks.where("violations > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r.check}: {r.violations}" for r in bad))


def assert_no_nulls(rows: DataFrame, columns: list[str]) -> None:
    """Raise, naming the columns that hold null or NaN; one pass."""
    kinds = dict(rows.dtypes)
    missing = {c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False)) for c in columns}
    bad = rows.agg(*[F.count_if(v).alias(c) for c, v in missing.items()]).first().asDict()
    if bad := {c: n for c, n in bad.items() if n}:
        raise ValueError(f"null values: {bad}")
