"""Forecast metrics and naive baselines. Rows without a target don't count; a missing prediction is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA = 0.9
NAMES = ["mae", "pinball", "coverage", "fill_rate", "shortfall_units", "overstock_units"]


def naive(lead: str = "lead_time_days") -> dict[str, Column]:
    """Zero, yesterday and last week's mean over the lead time; null counts as 0."""
    days = F.coalesce(F.col(lead), F.lit(0))
    scaled = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.col(c) * days, F.lit(0.0)))
    return {"naive_zero": F.lit(0.0), "naive_lag_1": scaled("lag_1"), "naive_roll_mean_7": scaled("roll_mean_7")}


def stacked(rows: DataFrame, target: str, predictions: dict[str, Column], keep: list[str] = ()) -> DataFrame:
    """(model, target, prediction) for each model, on the same rows."""
    models = F.array(*[F.struct(F.lit(k).alias("model"), v.cast("double").alias("prediction")) for k, v in predictions.items()])
    out = rows.where(F.col(target).isNotNull()).select(*keep, F.col(target).cast("double").alias("target"), F.explode(models).alias("m"))
    return out.select(*keep, "target", F.col("m.model").alias("model"), F.coalesce("m.prediction", F.lit(0.0)).alias("prediction"))


def aggregates(alpha: float = ALPHA, y: str = "target", p: str = "prediction") -> dict[str, Column]:
    y, p = F.col(y), F.coalesce(F.col(p), F.lit(0.0))
    d = y - p
    short = F.sum(F.greatest(F.lit(0.0), d))
    fill = F.when(F.sum(y) == 0, 1.0).otherwise(1 - F.try_divide(short, F.sum(y)))
    return {
        "n": F.count("*"),
        "mae": F.avg(F.abs(d)),
        "pinball": F.avg(F.when(d >= 0, alpha * d).otherwise((alpha - 1) * d)),
        "coverage": F.avg((y <= p).cast("double")),
        "fill_rate": fill,
        "shortfall_units": short,
        "overstock_units": F.sum(F.greatest(F.lit(0.0), -d)),
    }


def score(rows: DataFrame, by: list[str] = ("model",), alpha: float = ALPHA) -> DataFrame:
    return rows.groupBy(*by).agg(*[v.alias(k) for k, v in aggregates(alpha).items()])


def score_groups(rows: DataFrame, groups: list[str], by: list[str] = ("model", "fold_id"), alpha: float = ALPHA) -> DataFrame:
    """Scores overall and for each value of each group column, in one grouping-sets pass."""
    by = list(by)
    x = rows.select(*by, *[F.col(g).cast("string").alias(g) for g in groups], "target", "prediction")
    sets = [[F.col(c) for c in by]] + [[F.col(c) for c in (*by, g)] for g in groups]
    named = F.lit("overall")
    value = F.lit("all")
    out = x.groupingSets(sets, *by, *groups).agg(*[F.grouping(g).alias(f"__{g}") for g in groups], *[v.alias(k) for k, v in aggregates(alpha).items()])
    for g in groups:
        named = F.when(F.col(f"__{g}") == 0, g).otherwise(named)
        value = F.when(F.col(f"__{g}") == 0, F.col(g)).otherwise(value)
    return out.select(*by, named.alias("group_col"), value.alias("group_value"), "n", *NAMES)


def pooled(results: DataFrame, metric: str = "pinball", by: str = "model") -> DataFrame:
    """Mean of a metric over folds' overall rows, weighted by their rows."""
    rows = results.where("group_col = 'overall'")
    return rows.groupBy(by).agg((F.sum(F.col(metric) * F.col("n")) / F.sum("n")).alias(metric))
