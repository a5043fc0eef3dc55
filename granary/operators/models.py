"""Model layer: forecasters, walk-forward evaluation, search with checkpoints, final bundles.

A forecaster is a callable (train, valid) -> frame of the keys and `prediction`. Trees are
fitted by Spark ML on all executors; quantiles are read off their leaves.
"""

from __future__ import annotations

import json
import random
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.lineage import cut
from . import boosting, demand, metrics

KEYS = ["item", "branch", "dt"]
QUANTILE = 0.9
MEMORY_BUDGET = 3 << 30
#: Bytes of leaves' samples that are sent to every task, at most; and values that a task gathers at once.
LOOKUP_BYTES, GATHERED = 256 << 20, 1 << 20
Forecaster = Callable[[DataFrame, DataFrame], DataFrame]

#: Defaults and search spaces, by the names that the learners here take.
FOREST_DEFAULTS = {"n_trees": 200, "max_depth": 16, "min_leaf": 50, "leaf_samples": 20, "subset": "sqrt", "rows_share": None, "log_target": False, "encoding": "ordinal"}
FOREST_SPACE = {
    "max_depth": [12, 16, 20],
    "min_leaf": [20, 50, 100, 200],
    "leaf_samples": [1, 20, 50],
    "subset": ["sqrt", "0.3", "0.5", "all"],
    "rows_share": [None, 0.5],
    "log_target": [False, True],
    "encoding": ["ordinal", "one_hot"],
}
BOOST_DEFAULTS = {"depth": 6, "rate": 0.05, "min_leaf": 10, "rows_share": 1.0, "columns_share": 1.0, "l2": 1.0, "encoding": "ordinal", "log_target": False}
BOOST_SPACE = {
    "depth": [4, 6, 8, 10],
    "rate": [0.03, 0.05, 0.1],
    "min_leaf": [1, 10, 50],
    "rows_share": [0.7, 1.0],
    "columns_share": [0.5, 0.7, 1.0],
    "l2": [1.0, 10.0],
    "encoding": ["ordinal", "native", "one_hot"],
    "log_target": [False, True],
}
BOOST_ROUNDS, BOOST_PATIENCE = 2000, 50


def vectors(rows: DataFrame, features: list[str]) -> DataFrame:
    doubles = rows.withColumns({f"__{c}": F.col(c).cast("double") for c in features})
    return VectorAssembler(inputCols=[f"__{c}" for c in features], outputCol="features", handleInvalid="error").transform(doubles).drop(*[f"__{c}" for c in features])


def leaf_bytes(n_trees: int, max_depth: int, min_leaf: int, n_train: int, samples: int = 1) -> int:
    """Bytes that the leaves' samples take at most."""
    return n_trees * min(2 ** (max_depth + 1), 2 * n_train // min_leaf) * samples * 8


def embedding_sizes(mapping: DataFrame) -> list[tuple[str, int, int]]:
    """(column, levels, width) for each mapped column, the unknown level included."""
    top = mapping.groupBy("col").agg(F.max("idx").alias("n")).orderBy("col").collect()
    return [(r.col, r.n + 1, min(16, (r.n + 2) // 2)) for r in top]


def _indexed(features: list[str]) -> list[str]:
    return [c for c in features if c.endswith("_idx")]


def encoded(train: DataFrame, other: DataFrame, features: list[str], encoding: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(train, other, features) with category indices as they are, as codes of the training levels, or as 0/1 columns."""
    if encoding == "ordinal":
        return train, other, features
    cats = _indexed(features)
    levels = demand.training_levels(train, cats)
    if encoding == "native":
        coded = [demand.native_codes(x, levels, cats).fillna(-1, [f"{c}_code" for c in cats]) for x in (train, other)]
        return coded[0], coded[1], [f"{c}_code" if c in cats else c for c in features]
    if encoding == "one_hot":
        by_column: dict[str, list[int]] = {}
        for r in levels.orderBy("col", "level").collect():
            by_column.setdefault(r.col, []).append(r.level)
        for c, values in by_column.items():
            train, other = demand.one_hot(train, c, values), demand.one_hot(other, c, values)
        return train, other, [c for c in features if c not in cats] + [f"{c}_{v}" for c, values in by_column.items() for v in values]
    raise ValueError(f"unknown encoding {encoding!r}")


class LeafQuantiles:
    """Quantiles of the training targets that share a prediction row's leaves; each tree weighs alike.

    Of each leaf at most `samples` targets are kept, those of the least hashes of their rows.
    """

    def __init__(self, model: RandomForestRegressionModel, train: DataFrame, target: str, samples: int = 20):
        from pyspark.sql.window import Window

        self.model = model
        rows = train.select(F.col(target).cast("double").alias("y"), F.xxhash64(*[c for c in KEYS if c in train.columns], target).alias("h"), "features")
        leaves = self._leaves(rows)
        kept = leaves.withColumn("r", F.row_number().over(Window.partitionBy("tree", "leaf").orderBy(F.xxhash64("h", "tree"), "h"))).where(F.col("r") <= samples)
        values = kept.groupBy("tree", "leaf").agg(F.collect_list("y").alias("ys"))
        self.values = values.withColumn("ys", F.transform("ys", lambda y: F.struct(y.alias("y"), (F.lit(1.0) / F.size("ys")).alias("w"))))

    def _leaves(self, rows: DataFrame) -> DataFrame:
        scored = self.model.setLeafCol("__leaves").transform(rows)
        keep = [c for c in rows.columns if c != "features"]
        each = F.posexplode(F.transform(F.col("__vec"), lambda x: x.cast("long")))
        from pyspark.ml.functions import vector_to_array

        return scored.withColumn("__vec", vector_to_array("__leaves")).select(*keep, each.alias("tree", "leaf"))

    def predict(self, rows: DataFrame, keys: list[str] = KEYS, quantile: float = QUANTILE, lookup_bytes: int = LOOKUP_BYTES) -> DataFrame:
        """Leaves' samples of `lookup_bytes` at most (counted) go to the rows; beyond that, rows go to the leaves."""
        n, leaves = self.values.agg(F.sum(F.size("ys")), F.count("*")).first()
        if 8 * (n or 0) + 16 * leaves <= lookup_bytes:
            return self._looked_up(rows, keys, quantile)
        return self._joined(rows, keys, quantile)

    def _looked_up(self, rows: DataFrame, keys: list[str], quantile: float) -> DataFrame:
        """An Arrow pass over the rows' leaves; all samples are one array by tree and leaf, which the tasks share."""
        from pyspark.ml.functions import vector_to_array

        table = self.values.select("tree", "leaf", F.transform("ys", lambda v: v["y"]).alias("ys")).toArrow()
        code = table.column("tree").to_numpy().astype(np.int64) << 32 | table.column("leaf").to_numpy().astype(np.int64)
        order = np.argsort(code)
        lists = table.column("ys").combine_chunks().take(pa.array(order))
        off = lists.offsets.to_numpy()
        most = int(np.diff(off).max(initial=1))
        shared = rows.sparkSession.sparkContext.broadcast((code[order], off, lists.values.to_numpy(zero_copy_only=False)))
        scored = self.model.setLeafCol("__leaves").transform(rows.select(*keys, "features")).select(*keys, vector_to_array("__leaves").alias("__leaves"))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code, off, ys = shared.value
            for b in batches:
                leaf = b.column("__leaves").flatten().to_numpy().astype(np.int64).reshape(b.num_rows, -1)
                trees = leaf.shape[1]
                step, out = max(1, GATHERED // (trees * most)), np.empty(b.num_rows)
                for s in range(0, b.num_rows, step):
                    wanted = leaf[s : s + step] | np.arange(trees) << 32
                    at = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
                    size = np.where(code[at] == wanted, off[at + 1] - off[at], 0)[..., None]
                    nth = np.arange(most)
                    held = nth < size
                    y = np.where(held, ys[np.minimum(off[at][..., None] + nth, len(ys) - 1)], np.inf).reshape(len(wanted), -1)
                    w = np.where(held, 1 / np.maximum(size, 1), 0.0).reshape(len(wanted), -1)
                    by_value = np.argsort(y, axis=1, kind="stable")
                    reach = np.cumsum(np.take_along_axis(w, by_value, axis=1), axis=1)
                    first = (reach >= reach[:, -1:] * quantile - 1e-9).argmax(axis=1)
                    out[s : s + step] = np.take_along_axis(y, np.take_along_axis(by_value, first[:, None], axis=1), axis=1)[:, 0]
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(np.maximum(0.0, out))], names=[*keys, "prediction"])

        return scored.mapInArrow(run, ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", prediction double")

    def _joined(self, rows: DataFrame, keys: list[str], quantile: float) -> DataFrame:
        """A row gathers trees x samples values at most, in one array."""
        hits = self._leaves(rows.select(*keys, "features")).join(self.values, ["tree", "leaf"])
        drawn = hits.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("ys"))).alias("ys"))
        need = F.aggregate("ys", F.lit(0.0), lambda a, v: a + v["w"]) * quantile - 1e-9
        start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("y"))
        drawn = drawn.withColumn("need", need)
        reach = F.aggregate("ys", start, lambda a, v: F.struct((a["w"] + v["w"]).alias("w"), F.coalesce(a["y"], F.when(a["w"] + v["w"] >= F.col("need"), v["y"])).alias("y")))["y"]
        return drawn.select(*keys, F.greatest(F.lit(0.0), reach).alias("prediction"))


def _forest(train: DataFrame, features: list[str], target: str, n_trees: int, max_depth: int, min_leaf: int, subset: str, rows_share: float | None, seed: int) -> tuple[RandomForestRegressionModel, DataFrame]:
    x = vectors(train.withColumn(target, F.col(target).cast("double")), features)
    rf = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=n_trees, maxDepth=max_depth, minInstancesPerNode=min_leaf, featureSubsetStrategy=subset, subsamplingRate=rows_share or 1.0, seed=seed)
    return rf.fit(x.select("features", target)), x


def quantile_forest(
    features: list[str], target: str, n_trees: int = 200, max_depth: int = 16, min_leaf: int = 50, leaf_samples: int = 20, subset: str = "sqrt", rows_share: float | None = None,
    encoding: str = "ordinal", quantile: float = QUANTILE, budget: int = MEMORY_BUDGET, log_target: bool = False, seed: int = 42,
) -> Forecaster:
    def forecast(train: DataFrame, valid: DataFrame) -> DataFrame:
        if (need := leaf_bytes(n_trees, max_depth, min_leaf, train.count(), leaf_samples)) > budget:
            raise MemoryError(f"leaves may need {need} bytes; the budget is {budget}")
        train, valid, names = encoded(train, valid, features, encoding)
        train = train.withColumn(target, F.log1p(target)) if log_target else train
        model, x = _forest(train, names, target, n_trees, max_depth, min_leaf, subset, rows_share, seed)
        out = LeafQuantiles(model, x, target, leaf_samples).predict(vectors(valid, names), quantile=quantile)
        return out.withColumn("prediction", F.greatest(F.lit(0.0), F.expm1("prediction"))) if log_target else out

    return forecast


def boosted_quantiles(
    features: list[str], target: str, rounds: int = BOOST_ROUNDS, depth: int = 6, rate: float = 0.05, min_leaf: int = 10, rows_share: float = 1.0, columns_share: float = 1.0, l2: float = 1.0,
    encoding: str = "ordinal", log_target: bool = False, patience: int = BOOST_PATIENCE, tail_days: int = 30, quantile: float = QUANTILE, seed: int = 42,
) -> Forecaster:
    """Boosted quantile trees; rounds are chosen on the last `tail_days` days, then all rows are fitted with that many."""
    settings = boosting.Settings(rounds, depth, rate, min_leaf, rows_share, columns_share, l2, patience, quantile, seed)

    def forecast(train: DataFrame, valid: DataFrame) -> DataFrame:
        train, valid, names = encoded(train, valid, features, encoding)
        out = _boosted(train, names, target, log_target, tail_days, settings).predict(valid, KEYS)
        return out.select(*KEYS, demand.untransformed("f", log_target).alias("prediction"))

    return forecast


def _boosted(train: DataFrame, names: list[str], target: str, log_target: bool, tail_days: int, settings: boosting.Settings) -> boosting.Boosted:
    """The trees of all rows, as many as did best on the last days.

    Both fits run beside each other; trees of all rows beyond those chosen are dropped, `patience`
    and a few at most.
    """
    y, key = F.log1p(target) if log_target else F.col(target), F.xxhash64(*KEYS)
    fit, tail = demand.early_stopping(train, tail_days)
    pace = boosting.Pace()

    def choose() -> int:
        chosen = 0
        try:
            chosen = max(1, len(boosting.boost(fit, tail, names, y, key, settings, reached=pace.reached).trees))
        finally:
            pace.choose(chosen)
        return chosen

    with ThreadPoolExecutor(1) as pool:
        first = pool.submit(inheritable_thread_target(train.sparkSession)(choose))
        try:
            model = boosting.boost(train, None, names, y, key, settings, rounds=pace.rounds())
        except BaseException:
            pace.ended = True
            raise
        chosen = first.result()
    del model.trees[chosen:]
    return model


# --- evaluation ------------------------------------------------------------------------------


def run_fold(eligible: DataFrame, fold: int, forecast: Forecaster, cutoff: str, target: str, name: str = "model", groups: list[str] = (), alpha: float = QUANTILE) -> DataFrame:
    """Scores of a model and the naive baselines on one fold's rows, overall and by group."""
    train, valid = demand.fold_train(eligible, fold, cutoff), eligible.where(F.col("fold_id") == fold)
    assert_no_leak(train, valid, cutoff)
    predicted = forecast(train, valid)
    rows = valid.join(predicted.select(*KEYS, "prediction"), KEYS, "left")
    if bad := rows.where("prediction is null").limit(1).count():
        raise ValueError(f"{bad} or more rows of fold {fold} have no prediction")
    stacked = metrics.stacked(rows, target, {name: F.col("prediction")} | metrics.naive(), ["fold_id", *groups])
    return metrics.score_groups(stacked, list(groups), alpha=alpha) if groups else metrics.score(stacked, ["model", "fold_id"], alpha).withColumns({"group_col": F.lit("overall"), "group_value": F.lit("all")})


def run_walk_forward(eligible: DataFrame, forecast: Forecaster, cutoff: str, target: str, folds: Iterable[int] = (1, 2, 3, 4, 5), **options) -> DataFrame:
    out = None
    for k in folds:
        x = run_fold(eligible, k, forecast, cutoff, target, **options)
        out = x if out is None else out.unionByName(x)
    return out


def assert_no_leak(train: DataFrame, valid: DataFrame, cutoff: str) -> None:
    a, b = train.agg(F.max("dt")).first()[0], valid.agg(F.min("dt"), F.max("dt")).first()
    if a is not None and b[0] is not None and (a >= b[0] or str(b[1]) >= cutoff):
        raise ValueError(f"training ends {a}, validation runs {b[0]} to {b[1]}, the test starts {cutoff}")


# --- search ----------------------------------------------------------------------------------


def sample_space(space: dict[str, list], defaults: dict, n: int, seed: int = 42, screen: Callable[[dict], bool] | None = None) -> list[dict]:
    """`n` distinct candidates: the defaults, then random draws over sorted names that pass the screen."""
    rng, out = random.Random(seed), [dict(defaults)] if screen is None or screen(defaults) else []
    for _ in range(200 * n):
        if len(out) >= n:
            return out[:n]
        c = {k: rng.choice(space[k]) for k in sorted(space)}
        if c not in out and (screen is None or screen(c)):
            out.append(c)
    if len(out) < n:
        raise ValueError(f"only {len(out)} of {n} candidates pass")
    return out[:n]


def space_size(space: dict[str, list]) -> int:
    return len(list(product(*space.values())))


def candidate_budget(sec_per_epoch: float, best_epoch: int, seconds: float = 28_800, patience: int = 5, least: int = 6, most: int = 20) -> int:
    """Candidates that fit into the time, two folds and two fits each; too few raises."""
    n = int(seconds // (2 * sec_per_epoch * (2 * best_epoch + patience)))
    if n < least:
        raise ValueError(f"time for {n} candidates; {least} are needed")
    return min(n, most)


def run_search(eligible: DataFrame, candidates: list[dict], make: Callable[..., Forecaster], cutoff: str, target: str, folds: tuple[int, ...] = (3, 5), checkpoint: str | None = None, name: str = "model", beside: int = 1, weigh: Callable[[dict], int] | None = None, budget: int = MEMORY_BUDGET) -> list[dict]:
    """A row for each candidate: its pooled pinball loss, or None and the error where it failed.

    Each is written to the checkpoint as it ends; a checkpoint of other candidates raises.
    beside: candidates that run at a time, each in a scheduler pool of its own (which share
    evenly under spark.scheduler.mode=FAIR); weigh: the bytes that one may take, which are kept
    within `budget` together (a candidate that takes more runs alone).
    """
    done: list[dict] = []
    spark = eligible.sparkSession
    if checkpoint and files.exists(spark, checkpoint):
        done = json.loads(files.read_text(spark, checkpoint))
        if any(r["candidate"] >= len(candidates) or r["params"] != candidates[r["candidate"]] for r in done):
            raise ValueError(f"{checkpoint} belongs to other candidates")
    turn, used = threading.Condition(), [0]

    def run(i: int) -> None:
        params = candidates[i]
        need = min(budget, weigh(params)) if weigh else 0
        with turn:
            turn.wait_for(lambda: used[0] + need <= budget)
            used[0] += need
        try:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"candidate{i}" if beside > 1 else None)
            score(i, params)
        finally:
            with turn:
                used[0] -= need
                turn.notify_all()

    def score(i: int, params: dict) -> None:
        began, pinball, error = time.time(), None, ""
        try:
            results = run_walk_forward(eligible, make(**params), cutoff, target, folds, name=name)
            pinball = metrics.pooled(results).where(F.col("model") == name).first()["pinball"]
        except (MemoryError, ValueError) as e:
            error = str(e)
        with turn:  # one writer at a time
            done.append({"candidate": i, "params": params, "pinball": pinball, "error": error, "seconds": time.time() - began})
            if checkpoint:
                files.write_text(spark, json.dumps(done, sort_keys=True), checkpoint)

    ended = {r["candidate"] for r in done}
    todo = [i for i in range(len(candidates)) if i not in ended]
    if beside > 1:
        with ThreadPoolExecutor(beside) as pool:
            list(pool.map(run, todo))
    else:
        for i in todo:
            run(i)
    return sorted(done, key=lambda r: r["candidate"])


def select_best(results: list[dict]) -> dict:
    scored = [r for r in results if r["pinball"] is not None]
    if not scored:
        raise ValueError("no candidate was scored")
    return min(scored, key=lambda r: (r["pinball"], r["candidate"]))["params"]


def _save_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def fit_final(rows: DataFrame, features: list[str], target: str, cutoff: str, path: str, kind: str = "forest", quantile: float = QUANTILE, seed: int = 42, **params) -> None:
    """Fit a forest or boosted trees on all rows before the cutoff, purged there, and save the bundle below `path`.

    The bundle holds the features' order, the category levels' encoding is ordinal, and the
    target's scale; a reloaded model reads no order from what it is given.
    """
    train = rows.where(demand.before(cutoff) & demand.looks_ahead_safely(cutoff))
    spark, log = rows.sparkSession, bool(params.pop("log_target", False))
    y = (F.log1p(target) if log else F.col(target)).cast("double")
    meta = {"kind": kind, "features": features, "target": target, "cutoff": cutoff, "log_target": log, "quantile": quantile, "params": params, "n_train": train.count()}
    if kind == "forest":
        p = {k: v for k, v in FOREST_DEFAULTS.items() if k not in ("log_target", "encoding")} | params
        samples = p.pop("leaf_samples")
        model, x = _forest(train.withColumn(target, y), features, target, seed=seed, **p)
        model.write().overwrite().save(f"{path}/model")
        LeafQuantiles(model, x, target, samples).values.write.mode("overwrite").parquet(f"{path}/leaves")
    elif kind == "boost":
        p = {k: v for k, v in BOOST_DEFAULTS.items() if k not in ("log_target", "encoding")} | {"rounds": BOOST_ROUNDS, "patience": BOOST_PATIENCE, "tail_days": 30} | params
        settings = boosting.Settings(p["rounds"], p["depth"], p["rate"], p["min_leaf"], p["rows_share"], p["columns_share"], p["l2"], p["patience"], quantile, seed)
        meta |= {"model": _boosted(train, features, target, log, p["tail_days"], settings).to_dict()}
    else:
        raise ValueError(f"unknown kind {kind!r}")
    _save_meta(spark, path, meta)


def predict_bundle(path: str, rows: DataFrame, quantile: float | None = None) -> DataFrame:
    """Predictions of a saved bundle; its own feature order and target scale are used."""
    spark = rows.sparkSession
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta["kind"] == "forest":
        x = vectors(rows, meta["features"])
        q = LeafQuantiles.__new__(LeafQuantiles)
        q.model, q.values = RandomForestRegressionModel.load(f"{path}/model"), spark.read.parquet(f"{path}/leaves")
        out = q.predict(x, quantile=quantile or meta["quantile"])
    else:
        out = boosting.Boosted.from_dict(meta["model"]).predict(rows, KEYS).select(*KEYS, F.col("f").alias("prediction"))
    value = F.expm1("prediction") if meta["log_target"] else F.col("prediction")
    return out.select(*KEYS, F.greatest(F.lit(0.0), value).alias("prediction"))
