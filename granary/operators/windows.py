"""Window features over segments. Row frames equal day frames because segments are dense."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType
from pyspark.sql.window import Window

from ..sources.lineage import cut
from .panel import SEGMENT, by_segment
from .prefix import running_sums

HORIZONS = range(1, 8)
LAGS = [1, 2, 3, 7, 14, 21, 28]
WINDOWS = [7, 14, 28]
MAX_LEAD = 7


def full(agg: Column, column: str, frame, size: int) -> Column:
    """The aggregate over the frame, null unless all `size` values are there."""
    return F.when(F.count(column).over(frame) == size, agg.over(frame))


def target_columns(qty: str = "qty", horizons=HORIZONS) -> dict[str, Column]:
    return {f"target_h{h}": F.lead(qty, h).over(by_segment()) for h in horizons}


def lag_columns(qty: str = "qty_capped", lags=LAGS) -> dict[str, Column]:
    return {f"lag_{k}": F.lag(qty, k).over(by_segment()) for k in lags}


def rolling_columns(qty: str = "qty_capped", windows=WINDOWS) -> dict[str, Column]:
    """Mean and sample deviation of the w days before each day, null while there are fewer."""
    out = {}
    for w in windows:
        frame = by_segment().rowsBetween(-w, -1)
        out[f"roll_mean_{w}"] = full(F.avg(qty), qty, frame, w)
        out[f"roll_std_{w}"] = full(F.stddev_samp(qty), qty, frame, w)
    return out


def lead_target(qty: str = "qty", lead: str = "lead_time_days") -> Column:
    """Sum of the next L days, L of the row; null if the segment ends before, or L is null."""
    out = F.lit(None).cast("double")
    for w in range(1, MAX_LEAD + 1):
        out = F.when(F.col(lead) == w, full(F.sum(qty), qty, by_segment().rowsBetween(1, w), w)).otherwise(out)
    return out


def trailing_sums(qty: str = "qty", sizes=(3, 4)) -> dict[str, Column]:
    return {f"sum_{n}": full(F.sum(qty), qty, by_segment().rowsBetween(-(n - 1), 0), n) for n in sizes}


def partial_mean(qty: str = "qty", size: int = 7) -> Column:
    return F.avg(qty).over(by_segment().rowsBetween(-(size - 1), 0))


def pareto(totals: DataFrame, key: str, value: str = "qty", share: float = 0.8) -> DataFrame:
    """Keys by falling value with rank, cumulative share, and whether they lie within the leading `share`.

    Ranks and shares are running sums by range; only the total and the last leading rank come to the driver.
    """
    x = cut(running_sums(totals.select(key, value), [F.desc(value), F.col(key)], {"rank": F.lit(1), "upto": F.col(value)}))
    whole = x.agg(F.sum(value)).first()[0]
    x = x.select(key, value, F.col("rank").cast("int").alias("rank"), (F.col("upto") / F.lit(whole)).alias("cum_share"))
    first = x.agg(F.min(F.when(F.col("cum_share") >= share, F.col("rank")))).first()[0]
    return x.withColumn("is_head", F.col("rank") <= F.lit(first))


def sequences(panel: DataFrame, features: list[str], target: str, lookback: int = 28) -> DataFrame:
    """Windows of the last `lookback` days for each row past the warm-up with a target.

    Column window: an array of `lookback` arrays of features; windows never cross segments. The
    panel moves once; windows are made of it as they are handed on, in the order of Arrow batches.
    """
    from . import sequences as S

    rest = [c for c in panel.columns if c not in (*SEGMENT, "dt")]
    x = panel.withColumns({f"__{c}": F.col(c).cast("float") for c in features} | {"__on": (F.row_number().over(by_segment()) > lookback) & F.col(target).isNotNull()})
    packed = S.pack_segments(x, [*rest, *[f"__{c}" for c in features], "__on"])
    out = StructType([*[panel.schema[c] for c in (*SEGMENT, "dt", *rest)], StructField("window", ArrayType(ArrayType(FloatType())))])

    def make(keys, rows, x, ends):
        names = [f.name for f in rows.type]
        on = rows.field(names.index("__on")).to_numpy(zero_copy_only=False).astype(bool)
        at = pa.array(np.flatnonzero(on))
        cube = S.window_views(x, ends[on], lookback)
        inner = pa.ListArray.from_arrays(pa.array(np.arange(0, cube.size + 1, max(1, len(features)), dtype=np.int32)), pa.array(cube.reshape(-1)))
        window = pa.ListArray.from_arrays(pa.array(np.arange(0, len(inner) + 1, lookback, dtype=np.int32)), inner)
        return {k: v.take(at) for k, v in keys.items()} | {c: rows.field(names.index(c)).take(at) for c in ("dt", *rest)} | {"window": window}

    return S.map_windows(packed, [f"__{c}" for c in features], lookback, make, out).select(*panel.columns, "window")
