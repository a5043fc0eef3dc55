"""Demand statistics, outlier caps, classes, splits, encodings and model inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar as K
from .panel import PAIR, without_warmup
from .prefix import running_sums

EVENT_FLAGS = ["is_ramadan", "is_eid_al_fitr", "is_eid_al_adha", "is_independence_day", "is_new_year"]
TIERS = ["small", "medium", "large", "flagship"]
ADI_LIMIT, CV2_LIMIT = 1.32, 0.49
UNKNOWN, UNKNOWN_NAME, SENTINEL = 0, "<UNKNOWN>", 99.0


def before(cutoff: str) -> Column:
    return F.col("dt") < F.lit(cutoff).cast("date")


# --- outliers ----------------------------------------------------------------------------


def _baseline(cutoff: str) -> dict[str, Column]:
    """Aggregates over a pair's positive days before the cutoff."""
    qty = F.when(before(cutoff) & (F.col("qty") > 0), F.col("qty"))
    return {"n": F.count(qty), "median_qty": F.median(qty), "all_whole": F.bool_and(qty % 1 == 0)}


def pair_baseline(panel: DataFrame, cutoff: str, least: int = 30) -> DataFrame:
    """Of each pair's positive days before the cutoff: count, exact median, whether all are whole, whether it can be capped."""
    out = panel.groupBy(*PAIR).agg(*[v.alias(k) for k, v in _baseline(cutoff).items()]).where("n > 0")
    return out.withColumn("eligible", (F.col("n") >= least) & (F.col("median_qty") > 0))


def add_baseline(panel: DataFrame, cutoff: str, least: int = 30) -> DataFrame:
    """The same as columns median_qty, all_whole and eligible of the pair's rows, in the pair's own partition."""
    x = panel.withColumns({k: v.over(Window.partitionBy(*PAIR)) for k, v in _baseline(cutoff).items()})
    return x.withColumn("eligible", (F.col("n") >= least) & (F.col("median_qty") > 0)).drop("n")


def cap_outliers(panel: DataFrame, baseline: DataFrame | None = None, ratio: float = 5.0, events: list[str] = EVENT_FLAGS) -> DataFrame:
    """baseline_ratio, is_spike and qty_capped; spikes on event days stay. Integer pairs are capped at a whole number.

    baseline: pair_baseline's, or None where the panel has add_baseline's columns.
    """
    x = panel if baseline is None else panel.join(baseline.select(*PAIR, "median_qty", "all_whole", "eligible"), PAIR, "left")
    x = x.withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    x = x.withColumn("baseline_ratio", F.when(F.col("eligible"), F.col("qty") / F.col("median_qty")))
    x = x.withColumn("is_spike", F.coalesce(F.col("baseline_ratio") >= ratio, F.lit(False)))
    event = F.lit(False)
    for e in events:
        event = event | F.coalesce(F.col(e), F.lit(False))
    cap = F.col("median_qty") * ratio
    cap = F.when(F.col("all_whole"), F.least(F.ceil(cap).cast("double"), F.col("qty"))).otherwise(cap)
    x = x.withColumn("qty_capped", F.when(F.col("is_spike") & ~event, cap).otherwise(F.col("qty")))
    return x.drop("median_qty", "all_whole", "eligible")


# --- branch and pair statistics -----------------------------------------------------------


def branch_facts(panel: DataFrame, cutoff: str, qty: str = "qty_capped") -> DataFrame:
    """Of each branch: first day, mean and variation of its daily totals before the cutoff, zeros included.

    The facts are summed by branch and day first, so the second step sees a row for each day.
    """
    totals = panel.groupBy("branch", "dt").agg(F.sum(qty).alias("total"))
    early = F.when(before(cutoff), F.col("total"))
    out = totals.groupBy("branch").agg(F.min("dt").alias("first_dt"), F.count(F.when(before(cutoff), 1)).alias("n"), F.avg(early).alias("branch_avg_daily_qty"), F.stddev_samp(early).alias("sd"))
    return out.select("branch", "first_dt", "n", "branch_avg_daily_qty", F.try_divide("sd", "branch_avg_daily_qty").alias("branch_demand_cv"))


def branch_stats(panel: DataFrame, cutoff: str, qty: str = "qty_capped") -> DataFrame:
    """Mean and variation of daily totals before the cutoff, and the volume tier, of branches that have such days."""
    return volume_tier(branch_facts(panel, cutoff, qty).where("n > 0").drop("first_dt", "n"))


def volume_tier(stats: DataFrame) -> DataFrame:
    """Quartile tier by first rank: ceil((r - 1) * q / (n - 1)), at least 1, with q = min(4, branches)."""
    ranked = running_sums(stats, ["branch_avg_daily_qty", "branch"], {"__r": F.lit(1)})
    x = ranked.withColumn("__n", F.lit(ranked.count()))
    tier = F.when(F.col("__n") < 2, 1).otherwise(F.greatest(F.lit(1), F.ceil((F.col("__r") - 1) * F.least(F.lit(4), F.col("__n")) / (F.col("__n") - 1))))
    return x.withColumn("branch_volume_tier", F.element_at(F.array(*map(F.lit, TIERS)), tier.cast("int"))).drop("__r", "__n")


def branch_age(panel: DataFrame) -> DataFrame:
    first = panel.groupBy("branch").agg(F.min("dt").alias("__first"))
    return panel.join(first, "branch", "left").withColumn("branch_age_days", F.datediff("dt", "__first")).drop("__first")


def days_since_relocation(rows: DataFrame, relocations: DataFrame) -> DataFrame:
    """relocations: (branch, dt), one for each branch; negative before, null without one."""
    r = relocations.select("branch", F.col("dt").alias("__moved"))
    return rows.join(r, "branch", "left").withColumn("days_since_relocation", F.datediff("dt", "__moved")).drop("__moved")


def _demand(cutoff: str) -> dict[str, Column]:
    positive = F.when(before(cutoff) & (F.col("qty") > 0), F.col("qty"))
    return {"n_days": F.count_if(before(cutoff)), "n_nonzero": F.count(positive), "mean_qty": F.avg(positive), "sd_qty": F.stddev_pop(positive)}


def _adi_cv2() -> tuple[Column, Column]:
    cv = F.try_divide("sd_qty", "mean_qty")
    adi = F.try_divide(F.col("n_days"), F.when(F.col("n_nonzero") > 0, F.col("n_nonzero")))
    return adi, F.coalesce(cv * cv, F.lit(0.0))


def demand_stats(panel: DataFrame, cutoff: str) -> DataFrame:
    """ADI (days for each day with demand) and CV2 (population deviation over mean, squared) before the cutoff."""
    out = panel.groupBy(*PAIR).agg(*[v.alias(k) for k, v in _demand(cutoff).items()]).where("n_days > 0")
    adi, cv2 = _adi_cv2()
    return out.select(*PAIR, "n_days", "n_nonzero", adi.alias("adi"), cv2.alias("cv2"))


def demand_class(adi: Column, cv2: Column) -> Column:
    regular = F.when(cv2 < CV2_LIMIT, "smooth").otherwise("erratic")
    rare = F.when(cv2 < CV2_LIMIT, "intermittent").otherwise("lumpy")
    return F.when(adi.isNull(), "lumpy").when(adi < ADI_LIMIT, regular).otherwise(rare)


def classify(panel: DataFrame, cutoff: str) -> DataFrame:
    """demand_segment of each row's pair, in the pair's own partition; pairs without rows before the cutoff are lumpy."""
    x = panel.withColumns({f"__{k}": v.over(Window.partitionBy(*PAIR)) for k, v in _demand(cutoff).items()})
    names = {f"__{k}": k for k in _demand(cutoff)}
    adi, cv2 = _adi_cv2()
    x = x.withColumnsRenamed(names).withColumn("demand_segment", F.when(F.col("n_days") > 0, demand_class(adi, cv2)).otherwise("lumpy"))
    return x.drop(*names.values())


def event_flag(rows: DataFrame, items: DataFrame) -> DataFrame:
    """is_event_driven of each item; an item that the list misses raises."""
    i = items.select("item", F.col("is_event_driven").alias("__e"))
    known = F.coalesce(F.col("__e"), F.raise_error(F.concat(F.lit("no event flag for "), F.col("item"))).cast("boolean"))
    return rows.join(i, "item", "left").withColumn("is_event_driven", known).drop("__e")


# --- lead time ---------------------------------------------------------------------------


def region_features(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """region, ship_days, lead_time_days and is_delivery_day by branch; null (false) without a schedule."""
    r = regions.select("branch", "region", "ship_days")
    out = rows.join(r, "branch", "left")
    return out.withColumns({"lead_time_days": K.lead_time(F.col("dt"), F.col("ship_days")), "is_delivery_day": K.is_delivery_day(F.col("dt"), F.col("ship_days"))})


# --- splits ------------------------------------------------------------------------------


def looks_ahead_safely(boundary: str | Column, lead: str = "lead_time_days") -> Column:
    """Whether the row's target window ends before the boundary; no lead time counts as none."""
    b = F.lit(boundary).cast("date") if isinstance(boundary, str) else boundary
    return F.date_add("dt", F.coalesce(F.col(lead), F.lit(0)).cast("int")) < b


def split_train_test(rows: DataFrame, cutoff: str, purge: bool = True) -> tuple[DataFrame, DataFrame]:
    train = rows.where(before(cutoff))
    if purge and "lead_time_days" in rows.columns:
        train = train.where(looks_ahead_safely(cutoff))
    return train, rows.where(~before(cutoff))


def fold_starts(cutoff: str, folds: int = 5) -> list[str]:
    """First days of the `folds` months before the cutoff's month: one date rules all splits."""
    year, month = int(cutoff[:4]), int(cutoff[5:7])
    return [f"{(year * 12 + month - 1 - k) // 12:04d}-{(year * 12 + month - 1 - k) % 12 + 1:02d}-01" for k in range(folds, 0, -1)]


def assign_folds(rows: DataFrame, cutoff: str, folds: int = 5) -> DataFrame:
    starts = [*fold_starts(cutoff, folds), cutoff[:8] + "01"]
    fold = F.lit(None).cast("int")
    for k in range(folds):
        fold = F.when((F.col("dt") >= F.lit(starts[k]).cast("date")) & (F.col("dt") < F.lit(starts[k + 1]).cast("date")), k + 1).otherwise(fold)
    return rows.withColumn("fold_id", fold)


def fold_train(rows: DataFrame, fold: int, cutoff: str, folds: int = 5, purge: bool = True) -> DataFrame:
    """Rows before the fold's month, purged at its start."""
    if not 1 <= fold <= folds:
        raise ValueError(f"fold {fold} is not in 1..{folds}")
    start = fold_starts(cutoff, folds)[fold - 1]
    out = rows.where(before(start))
    return out.where(looks_ahead_safely(start)) if purge else out


def eligible_rows(rows: DataFrame, cutoff: str, target: str, lookback: int = 28) -> DataFrame:
    return without_warmup(rows.where(before(cutoff)), lookback).where(F.col(target).isNotNull())


def early_stopping(train: DataFrame, tail_days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(fit, tail): the last `tail_days` days, and the rows before them, purged there."""
    last = train.agg(F.max("dt")).first()[0]
    if last is None:
        raise ValueError("no rows to split")
    start = F.date_sub(F.lit(last), tail_days - 1)
    return train.where((F.col("dt") < start) & looks_ahead_safely(start)), train.where(F.col("dt") >= start)


# --- encoding ----------------------------------------------------------------------------


def category_mapping(rows: DataFrame, columns: list[str], cutoff: str | None = None, existing: DataFrame | None = None) -> DataFrame:
    """(col, value, idx): sorted distinct values before the cutoff; known ones keep their index, new ones are appended."""
    train = rows.where(before(cutoff)) if cutoff else rows
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns]))
    values = train.select(pairs.alias("p")).select("p.*").where("value is not null").distinct()
    if existing is None:
        start = values.select("col", "value", F.lit(0).alias("base"))
        kept = None
    else:
        top = existing.groupBy("col").agg(F.max("idx").alias("base"))
        start = values.join(existing.select("col", "value"), ["col", "value"], "left_anti").join(top, "col", "left").withColumn("base", F.coalesce("base", F.lit(0)))
        kept = existing.where(F.col("value") != UNKNOWN_NAME).select("col", "value", F.col("idx").cast("int").alias("idx"))
    number = F.row_number().over(Window.partitionBy("col").orderBy("value"))
    new = start.select("col", "value", (F.col("base") + number).cast("int").alias("idx"))
    return new if kept is None else kept.unionByName(new)


def encode(rows: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """<column>_idx of each column; unseen values and null are 0."""
    for c in columns:
        m = mapping.where(F.col("col") == c).select(F.col("value").alias(f"__{c}"), F.col("idx").alias(f"{c}_idx"))
        rows = rows.join(m, rows[c].cast("string") == m[f"__{c}"], "left").drop(f"__{c}").withColumn(f"{c}_idx", F.coalesce(f"{c}_idx", F.lit(UNKNOWN)))
    return rows


def one_hot(rows: DataFrame, column: str, levels: list[int]) -> DataFrame:
    """A 0/1 column for each level of the training rows; other levels are all 0."""
    return rows.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in levels}).drop(column)


def training_levels(train: DataFrame, columns: list[str]) -> DataFrame:
    """(col, level, code): the sorted distinct levels of each column in training, coded from 0 in their order."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("int").alias("level")) for c in columns]))
    levels = train.select(pairs.alias("p")).select("p.*").where("level is not null").distinct()
    return levels.withColumn("code", F.row_number().over(Window.partitionBy("col").orderBy("level")) - 1)


def native_codes(rows: DataFrame, levels: DataFrame, columns: list[str]) -> DataFrame:
    """<column>_code of each column by the training levels; a level that training lacks is null, not another's code."""
    for c in columns:
        m = levels.where(F.col("col") == c).select(F.col("level").alias(c), F.col("code").alias(f"{c}_code"))
        rows = rows.join(m, c, "left")
    return rows


def impute(rows: DataFrame, proximity: list[str], history: list[str]) -> DataFrame:
    """Indicators first, then fills: far-away sentinel for event distances, 0 for history and relocation, 1 for the ratio."""
    x = {}
    if "days_since_relocation" in rows.columns:
        x |= {"was_relocated": F.col("days_since_relocation").isNotNull(), "days_since_relocation": F.coalesce(F.col("days_since_relocation").cast("double"), F.lit(0.0))}
    if "baseline_ratio" in rows.columns:
        x |= {"has_baseline": F.col("baseline_ratio").isNotNull(), "baseline_ratio": F.coalesce("baseline_ratio", F.lit(1.0))}
    missing = F.lit(0)
    for c in history:
        missing = missing + F.col(c).isNull().cast("int")
    x |= {"missing_history_count": missing, "has_full_history": missing == 0}
    x |= {c: F.coalesce(F.col(c), F.lit(0.0)) for c in history}
    x |= {c: F.coalesce(F.col(c).cast("double"), F.lit(SENTINEL)) for c in proximity}
    return rows.withColumns(x)


def fit_scaler(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(col, mean, sd): population deviation, 1 where it is 0."""
    stats = rows.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.sd").alias("sd")) for c in columns]))
    out = stats.select(each.alias("s")).select("s.*")
    return out.withColumn("sd", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))


def apply_scaler(rows: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    s = {r.col: (r.mean, r.sd) for r in scaler.collect()}
    return rows.withColumns({c: (F.col(c) - s[c][0]) / s[c][1] for c in columns})


def tabular(rows: DataFrame, target: str, lookback: int = 28, log_target: bool = False) -> DataFrame:
    out = without_warmup(rows, lookback).where(F.col(target).isNotNull())
    return out.withColumn(target, F.log1p(target)) if log_target else out


def untransformed(column: str, log_target: bool) -> Column:
    """Predictions on the target's own scale; never negative."""
    return F.greatest(F.lit(0.0), F.expm1(column) if log_target else F.col(column))


#: Parts that the keys of two tables are compared by.
PARTS = 4096


def contract_violations(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(check, violations): keys of one side only, values that differ, nulls. Keys must be unique on each side.

    Both sides are summed up to fingerprints of PARTS parts of their keys (rows, sum and
    exclusive or of row hashes, whose order does not matter); only rows of parts that differ,
    or that have a null key, are joined.
    """
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    part = F.when(null_key, -1).otherwise(F.pmod(F.xxhash64(*keys), F.lit(PARTS)))
    whole = F.xxhash64(*keys, *values, *[F.col(v).isNull() for v in values])

    def parts(side: DataFrame, name: str) -> DataFrame:
        print_ = F.struct(F.count("*"), F.bit_xor("h"), F.sum(F.pmod("h", F.lit(1 << 32))))
        return side.select(part.alias("part"), whole.alias("h")).groupBy("part").agg(print_.alias(name))

    # PARTS + 1 rows at most
    differ = parts(a, "p").join(parts(b, "q"), "part", "full").where((F.col("part") == -1) | ~F.col("p").eqNullSafe(F.col("q"))).select(F.col("part").alias("__part"))
    differ = F.broadcast(differ)
    nulls = a.agg(*[F.count_if(F.col(v).isNull()).alias(f"null_{v}") for v in values])
    a, b = (side.withColumn("__part", part).join(differ, "__part", "left_semi") for side in (a, b))
    x = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("in_a"))
    y = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("in_b"))
    both = x.join(y, keys, "full")
    checks = {"only_first": F.col("in_b").isNull(), "only_second": F.col("in_a").isNull()}
    for v in values:
        checks |= {f"differs_{v}": F.col("in_a") & F.col("in_b") & ~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}"))}
    one = both.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    listed = lambda x: x.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, x.columns)), F.array(*x.columns))).alias("check", "violations"))
    return listed(one).unionByName(listed(nulls))

