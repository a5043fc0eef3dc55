"""End-to-end plans: raw rows to a clean daily table, a featured panel, and a model's input."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import Calendar, weekend_days_ahead
from ..operators import canon, demand, panel, windows
from ..sources import files
from ..sources.lineage import cut, small

TARGET = "target_lead_time_cumulative"
PROXIMITY = ["days_into_ramadan", "days_until_ramadan", *[f"days_{w}_{e}" for e in ("eid_al_fitr", "eid_al_adha", "independence_day", "new_year") for w in ("since", "until")]]
HISTORY = [*[f"lag_{k}" for k in windows.LAGS], *[f"roll_{s}_{w}" for w in windows.WINDOWS for s in ("mean", "std")]]
CATEGORICAL = ["item", "branch", "category", "city", "region", "branch_volume_tier", "demand_segment"]
FLAGS = ["is_weekend", "is_national_holiday", "is_ramadan", "is_eid_al_fitr", "is_eid_al_adha", "is_independence_day", "is_new_year"]
FEATURES = [
    *HISTORY, "missing_history_count", "has_full_history",
    "day_of_week", "day_of_month", "month", *FLAGS, *PROXIMITY,
    "lead_time_days", "is_delivery_day", "target_window_weekend_days", "days_since_relocation",
    "was_relocated", "branch_avg_daily_qty", "branch_demand_cv", "branch_age_days", "has_shopee", "has_gofood", "has_grabfood", "can_order_online", "has_baseline",
    "is_event_driven", *[f"{c}_idx" for c in CATEGORICAL],
]


@dataclass
class Dimensions:
    """The small tables that features are joined from."""

    regions: DataFrame
    closures: DataFrame
    breakpoints: DataFrame
    relocations: DataFrame
    outlet_features: DataFrame | None = None
    calendar: Calendar = field(default_factory=Calendar)


def load_raw(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw rows of transaction files and folders with `ord`, their order over all of them, which first values go by."""
    return files.transactions(spark, paths).withColumnRenamed("at", "ord").drop("file_no", "dt_text", "qty_text")


def load_dimensions(spark: SparkSession, regions: str, closures: str, breakpoints: DataFrame | None = None, relocations: DataFrame | None = None, **more) -> Dimensions:
    """The dimensions that are files (an absent closures file is empty), and (branch, dt) tables where there are any."""
    none = spark.createDataFrame([], "branch string, dt date")
    shut = files.closures(spark, closures).select("branch", "start_dt", "end_dt")
    return Dimensions(files.regions(spark, regions), shut, none if breakpoints is None else breakpoints, none if relocations is None else relocations, **more)


def clean(raw: DataFrame, excluded_branches: list[str] = (), excluded_items: list[str] = (), renames: DataFrame | None = None, order: str | None = "ord") -> DataFrame:
    """Daily rows from raw ones. Exclusions and renames use raw codes, so the order of steps matters."""
    x = canon.exclude(raw, "branch", list(excluded_branches)) if excluded_branches else raw
    x = canon.rename_items(x, renames) if renames is not None else x
    x = canon.grams_to_portions(x)
    x = canon.exclude(x, "item", list(excluded_items)) if excluded_items else x
    x = canon.apply_codes(x, canon.code_map(x))
    x = canon.canonical_categories(canon.canonical_names(x, order))
    return panel.daily(x, order)


def featured(days: DataFrame, dims: Dimensions, cutoff: str, min_history: int = 60, min_pair: int = 30, ratio: float = 5.0, check_calendar: bool = True) -> DataFrame:
    """The dense panel with all features, targets and demand classes.

    The panel is made once, in the exchange by pair that its history, baseline, caps and
    classes need too, and written; branch facts and windows read it from there. Dimensions are broadcast
    if their counted size allows it.
    """
    x = panel.dense_panel(days, small(dims.closures), small(dims.breakpoints))
    x = panel.enough_history(x, cutoff, min_history)
    columns = x.columns
    x = demand.cap_outliers(demand.add_baseline(dims.calendar.add(x, check=False), cutoff, min_pair), None, ratio)
    x = cut(demand.classify(x, cutoff).select(*columns, "baseline_ratio", "is_spike", "qty_capped", "demand_segment"))
    if check_calendar:
        dims.calendar.check_years(x)
    facts = cut(demand.branch_facts(x, cutoff))
    stats = demand.volume_tier(facts.where("n > 0").drop("first_dt", "n"))
    x = demand.region_features(dims.calendar.add(x, check=False), small(dims.regions))
    if dims.outlet_features is not None:
        x = canon.add_outlet_features(x, small(dims.outlet_features))
    x = demand.days_since_relocation(x, small(dims.relocations))
    x = x.withColumn("target_window_weekend_days", weekend_days_ahead(F.col("dt"), F.col("lead_time_days")))
    x = x.withColumns(
        windows.target_columns() | windows.lag_columns() | windows.rolling_columns() | {TARGET: windows.lead_target("qty"), f"{TARGET}_capped": windows.lead_target("qty_capped")}
    )
    branches = facts.select("branch", "first_dt").join(stats, "branch", "left")
    x = x.join(small(cut(branches)), "branch", "left")
    return x.withColumn("branch_age_days", F.datediff("dt", "first_dt")).drop("first_dt")


def model_input(x: DataFrame, event_items: DataFrame, cutoff: str, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, mapping): event flag, demand class, folds, imputed features and category indices.

    The mapping is written once; each column looks its values up there.
    """
    x = demand.event_flag(x, small(event_items))
    x = demand.assign_folds(x if "demand_segment" in x.columns else demand.classify(x, cutoff), cutoff)
    x = demand.impute(x, [c for c in PROXIMITY if c in x.columns], [c for c in HISTORY if c in x.columns])
    columns = [c for c in CATEGORICAL if c in x.columns]
    mapping = cut(demand.category_mapping(x, columns, cutoff, existing))
    return demand.encode(x, small(mapping), columns), mapping


def vanished_branches(days: DataFrame, x: DataFrame) -> DataFrame:
    """Branches with rows but no panel left after closures and the history filter."""
    return days.select("branch").distinct().join(x.select("branch").distinct(), "branch", "left_anti")


def stored_in(folder: str) -> Callable[[DataFrame, str], None]:
    """A writer of `refresh`: Parquet tables by month in a folder."""
    return lambda rows, name: files.write_monthly(rows, f"{folder}/{name}")


def refresh_files(spark: SparkSession, transactions: list[str], regions: str, closures: str, event_items: str, cutoff: str, folder: str, mapping: str | None = None, **options) -> dict[str, DataFrame]:
    """The whole refresh, from files to the stored panel and input: days, featured, model_input and vanished branches.

    What is written is read back, so the input is made of the stored panel. mapping: a JSON file
    of category indices; those that it has stay, new ones are added to it.
    """
    dims = load_dimensions(spark, regions, closures)
    days = cut(clean(load_raw(spark, transactions), **options))
    write = stored_in(folder)
    write(featured(days, dims, cutoff), "featured")
    x = spark.read.parquet(f"{folder}/featured").drop("ym")
    existing = files.mapping_from_json(spark, mapping) if mapping else None
    rows, found = model_input(x, files.event_items(spark, event_items), cutoff, existing)
    write(rows, "model_input")
    if mapping:
        files.mapping_to_json(found, mapping)
    return {"days": days, "featured": x, "model_input": spark.read.parquet(f"{folder}/model_input").drop("ym"), "vanished": vanished_branches(days, x)}


def refresh(raw: DataFrame, dims: Dimensions, event_items: DataFrame, cutoff: str, write: Callable[[DataFrame, str], None], **options) -> DataFrame:
    """Clean, feature and prepare in one run, so no stage is left stale; `write` stores the featured panel and the input."""
    days = clean(raw, **options)
    x = featured(days, dims, cutoff)
    write(x, "featured")
    rows, _ = model_input(x, event_items, cutoff)
    write(rows, "model_input")
    return rows
