"""Positions of windows in a sorted panel: segment codes, row numbers, window ends and their proofs.

Numbers over the whole panel come from running sums by range (`prefix`), not from a sort in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.lineage import cut, spread
from .demand import fit_scaler
from .panel import PAIR, SEGMENT
from .prefix import running_sums


def split_columns(features: list[str]) -> tuple[list[str], list[str]]:
    """(dynamic, categorical) features: indices of categories end in _idx."""
    return [c for c in features if not c.endswith("_idx")], [c for c in features if c.endswith("_idx")]


def pair_columns(panel: DataFrame) -> list[str]:
    return SEGMENT if "segment_id" in panel.columns else PAIR


def build_index(panel: DataFrame, features: list[str], target: str | None = None, lookback: int = 28, check: bool = True) -> DataFrame:
    """The panel with segment_code (its segment's number in key order), position (in the segment, from 0) and row (in the panel, from 0).

    Raises if the target is among the features, or if rows that follow each other in a segment
    are not days that do, as windows by position would span other days then.
    """
    if target in features:
        raise ValueError(f"{target} can't be a feature")
    keys = pair_columns(panel)
    position = F.row_number().over(Window.partitionBy(*keys).orderBy("dt")) - 1
    x = panel.withColumn("position", position)
    if check:
        assert_dense(x, lookback)
    sizes = x.groupBy(*keys).agg(F.count("*").alias("size"))
    codes = running_sums(sizes, keys, {"segment_code": F.lit(1), "start": F.col("size")})
    codes = cut(codes.select(*keys, (F.col("segment_code") - 1).alias("segment_code"), (F.col("start") - F.col("size")).alias("start")))
    return x.join(codes, keys).withColumn("row", F.col("start") + F.col("position")).drop("start")


def window_proof(indexed: DataFrame, lookback: int = 28) -> DataFrame:
    """(check, violations): steps of other than a day in a segment, and windows that don't span `lookback` days of one segment."""
    w = Window.partitionBy(*pair_columns(indexed)).orderBy("dt")
    step, span = F.datediff("dt", F.lag("dt").over(w)), F.datediff("dt", F.lag("dt", lookback - 1).over(w))
    usable = F.col("position") >= lookback
    flags = indexed.select((F.col("position") > 0).alias("inside"), step.alias("step"), usable.alias("usable"), span.alias("span"))
    one = flags.agg(F.count_if(F.col("inside") & (F.col("step") != 1)).alias("a"), F.count_if(F.col("usable") & ((F.col("span") != lookback - 1) | F.col("span").isNull())).alias("b"))
    return one.select(F.explode(F.map_from_arrays(F.array(F.lit("step_is_one_day"), F.lit("windows_fit")), F.array("a", "b"))).alias("check", "violations"))


def assert_dense(indexed: DataFrame, lookback: int = 28) -> None:
    if bad := [f"{r.check}: {r.violations}" for r in window_proof(indexed, lookback).collect() if r.violations]:
        raise ValueError("; ".join(bad))


def window_ends(index: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` with `window_end`, the row of the index with their keys; a row that the index lacks raises."""
    keys = [*pair_columns(index), "dt"]
    ends = index.select(*keys, F.col("row").alias("__end"))
    known = F.coalesce(F.col("__end"), F.raise_error(F.lit("a row is not in the panel of the index")).cast("long"))
    return rows.join(ends, keys, "left").withColumn("window_end", known).drop("__end")


# --- windows as views ------------------------------------------------------------------------


def pack_segments(panel: DataFrame, columns: list[str], rows: int | None = None) -> DataFrame:
    """A row for each segment, with `days`: its rows' dt and `columns` as an array by date.

    Every value is held once; windows are made of it where they are used (`flat_windows`). A
    segment's days are bounded, so a row is too. rows: the panel's, if they are counted.
    """
    keys = pair_columns(panel)
    return panel.repartition(spread(panel.sparkSession, rows), *keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("dt", *columns))).alias("days"))


def flat_windows(batch: pa.RecordBatch, dynamic: list[str], lookback: int) -> tuple[np.ndarray, np.ndarray, pa.StructArray, np.ndarray]:
    """(x, ends, rows, segment) of a batch of packed segments.

    x: all segments' dynamic features, end to end (days x features); ends: the numbers of the
    days at which whole windows end, which never cross segments; rows: those days' fields;
    segment: the number of their segment in the batch.
    """
    days = batch.column("days").cast(pa.large_list(batch.column("days").type.value_type))
    off = days.offsets.to_numpy()
    inner = days.values.slice(off[0], off[-1] - off[0])
    names = [f.name for f in inner.type]
    x = np.stack([inner.field(names.index(c)).to_numpy(zero_copy_only=False).astype(np.float32) for c in dynamic], axis=1) if dynamic else np.zeros((len(inner), 0), np.float32)
    size = np.diff(off)
    position = np.arange(len(inner)) - np.repeat(off[:-1] - off[0], size)
    ends = np.flatnonzero(position >= lookback - 1)
    return x, ends, inner.take(pa.array(ends)), np.repeat(np.arange(len(size)), size)[ends]


def window_views(x: np.ndarray, ends: np.ndarray, lookback: int) -> np.ndarray:
    """Windows (ends x lookback x features) that end at `ends`; a copy of these alone is made."""
    if len(x) < lookback:
        return np.zeros((0, lookback, x.shape[1]), x.dtype)
    views = np.lib.stride_tricks.sliding_window_view(x, lookback, axis=0)  # no copy
    return views[ends - lookback + 1].transpose(0, 2, 1)


def map_windows(packed: DataFrame, dynamic: list[str], lookback: int, make, schema: str) -> DataFrame:
    """What `make` gives of each batch's windows: from (keys of their segments, rows, x, ends) to a dict of columns."""
    keys = [c for c in packed.columns if c != "days"]

    def run(batches):
        for b in batches:
            x, ends, rows, segment = flat_windows(b, dynamic, lookback)
            if len(ends):
                yield pa.RecordBatch.from_pydict(make({k: b.column(k).take(pa.array(segment)) for k in keys}, rows, x, ends))

    return packed.mapInArrow(run, schema)


def bind_panel(panel: DataFrame, features: list[str], target: str, make, lookback: int = 28):
    """A forecaster over windows of the whole panel: training and prediction rows get the window that ends at them.

    A window may reach back over rows that neither frame holds; it ends at its own row, so no
    target enters it. make: from the names of the window's and of the categorical features to a
    function of (packed training segments, packed segments to predict, scale); the days of the
    former have y and lead (y null where the day is no training row), those of the latter
    `wanted`; scale: the mean and deviation of each dynamic feature over training rows.
    """
    dynamic, categorical = split_columns(features)
    keys, segment = [*PAIR, "dt"], pair_columns(panel)
    known = cut(panel.select(*segment, "dt", *[F.col(c).cast("float").alias(c) for c in dynamic], *[F.col(c).cast("int").alias(c) for c in categorical], (F.row_number().over(Window.partitionBy(*segment).orderBy("dt")) >= lookback).alias("whole")))
    forecast, n = make(dynamic, categorical), known.count()

    def bound(train: DataFrame, valid: DataFrame) -> DataFrame:
        asked = valid.select(*keys).join(known.select(*keys, "whole"), keys, "left")
        if asked.where(~F.coalesce("whole", F.lit(False))).limit(1).count():
            raise ValueError("a row has no whole window in the panel")
        answers = train.select(*keys, F.col(target).cast("double").alias("y"), F.coalesce("lead_time_days", F.lit(0)).cast("int").alias("lead"))
        labelled = known.join(answers, keys, "left").withColumn("y", F.when(F.col("whole"), F.col("y")))
        scaler = {r.col: (r.mean, r.sd) for r in fit_scaler(labelled.where("y is not null"), dynamic).collect()}
        scale = np.array([scaler[c][0] or 0.0 for c in dynamic]), np.array([scaler[c][1] or 1.0 for c in dynamic])
        wanted = known.join(valid.select(*keys, F.lit(True).alias("wanted")), keys, "left")
        columns = [*dynamic, *categorical]
        return forecast(cut(pack_segments(labelled, [*columns, "y", "lead"], n)), cut(pack_segments(wanted, [*columns, "wanted"], n)), scale)

    return bound
