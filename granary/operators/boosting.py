"""Boosting of the pinball loss on binned features.

Features are binned once, at the quantiles of mergeable sketches, and stored as a byte each; the
executors keep them as arrays. A tree grows level by level, a job each: a task counts its rows by
node, feature, bin and side of the prediction. The counts of all tasks are added up on the driver
if they are few bytes, by features beyond that; both find the same best cuts. Leaves are set to
the quantile of their residuals. What moves does not depend on the number of rows.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import Latest, spread

#: Bins of a feature; bin 0 is for missing values.
BINS = 256
#: Centroids of a quantile sketch: its memory, and the inverse of its error in rank.
SKETCH = 10_000
#: Rounds after which the rows' predictions are written down, so that a pass runs only the trees since.
WRITE_EVERY = 10
#: Rows of an array; and bytes of a level's counts, of all tasks, that the driver adds up.
BLOCK_ROWS, COUNTED_BYTES = 1 << 16, 64 << 20
#: Standard deviations of a leaf's quantile in a part that the values sent for it reach to either side.
REACH = 5


@dataclass
class Settings:
    """How trees are grown. rows and columns: the shares that each tree sees; l2: added to the rows of a node or a leaf."""

    rounds: int = 2000
    depth: int = 6
    rate: float = 0.05
    min_leaf: int = 10
    rows: float = 1.0
    columns: float = 1.0
    l2: float = 1.0
    patience: int = 50
    quantile: float = 0.9
    seed: int = 42


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has feature -1. A row goes left if its bin is `cut` at most."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> None:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for _ in range(2):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(0.0)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row of `bins` (features x rows) falls to."""
        at = np.zeros(bins.shape[1], np.int32)
        falls = {0: slice(None)}
        for node, feature in enumerate(self.feature):  # a node comes after its parent
            rows = falls.pop(node)
            if feature >= 0:
                right = bins[feature][rows] > self.cut[node]
                at[rows] = self.left[node] + right
                here = np.arange(bins.shape[1]) if node == 0 else rows
                falls |= {self.left[node]: here[~right], self.left[node] + 1: here[right]}
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Boosted:
    """A base value, the features' cuts, and trees whose values are added up."""

    base: float
    features: list[str]
    cuts: list[list[float]]
    trees: list[Tree] = field(default_factory=list)

    def predict(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """`keys` of `rows` with f."""
        kept = rows.select(*keys, *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(self.features)])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins = _binned(b, len(self.features), self.cuts)
                f = _added(np.full(b.num_rows, self.base), self.trees, bins)
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(f, pa.float64())], names=[*keys, "f"])

        return kept.mapInArrow(run, ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", f double")

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Boosted:
        return cls(d["base"], d["features"], d["cuts"], [Tree(**t) for t in d["trees"]])


def _added(f: np.ndarray, trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    """f with the trees' values, added in their order, so that it is the same however often f is written down."""
    for t in trees:
        f = f + t.values(bins)
    return f


def find_cuts(rows: DataFrame, features: list[str]) -> list[list[float]]:
    """Of each feature, the values that end its bins; BINS - 2 at most."""
    shares = [i / (BINS - 1) for i in range(1, BINS - 1)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, SKETCH).alias(f"c{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(x or [])) for x in found]


def _binned(b: pa.RecordBatch, n: int, cuts: list[list[float]]) -> np.ndarray:
    out = np.zeros((n, b.num_rows), np.uint8)
    for i in range(n):
        x = b.column(f"__{i}").to_numpy(zero_copy_only=False).astype(float)  # null is NaN
        out[i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(cuts[i], x))
    return out


def bin_rows(rows: DataFrame, features: list[str], cuts: list[list[float]], y: Column, key: Column) -> DataFrame:
    """(h, y, bins): a hash of the row's key, the target, and a byte for each feature."""
    kept = rows.select(key.cast("long").alias("h"), y.cast("double").alias("y"), *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(features)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = _binned(b, len(features), cuts)
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), _bytes(bins)], names=["h", "y", "bins"])

    return kept.mapInArrow(run, "h long, y double, bins binary")


def _bytes(bins: np.ndarray) -> pa.Array:
    off = np.arange(bins.shape[1] + 1, dtype=np.int32) * len(bins)
    return pa.Array.from_buffers(pa.binary(), bins.shape[1], [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(bins.T))])


def _bins(b: pa.RecordBatch, n: int) -> np.ndarray:
    column = b.column("bins").cast(pa.binary())
    _, off, data = column.buffers()
    start = np.frombuffer(off, np.int32)[column.offset]
    return np.ascontiguousarray(np.frombuffer(data, np.uint8)[start : start + b.num_rows * n].reshape(b.num_rows, n).T)


def drawn(h: np.ndarray, share: float, seed: int) -> np.ndarray:
    """Whether each row is in the sample, by its key and the seed alone."""
    x = h.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(share * (1 << 53)))


class Rows:
    """Stored rows (h, y, bins, f), kept as arrays by the executors, and the trees that f does not hold yet."""

    def __init__(self, rows: DataFrame, base: float, n_features: int, n_rows: int):
        self.n, self.trees, self.parts = n_features, [], spread(rows.sparkSession, n_rows)
        self.stored = Latest(rows.repartition(self.parts, "h").withColumn("f", F.lit(float(base))))
        self.arrays = self._kept()

    def _kept(self):
        n = self.n

        def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for b in batches:
                held.append(b)
                if sum(x.num_rows for x in held) >= BLOCK_ROWS:
                    yield one(held)
                    held = []
            if held:
                yield one(held)

        def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            h, y, f = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("h", "y", "f"))
            bins = np.concatenate([_bins(b, n) for b in held], axis=1)
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (h, y, bins, f)], names=["h", "y", "bins", "f"])

        def arrays(r) -> tuple:
            y = np.frombuffer(r.y)
            return np.frombuffer(r.h, np.int64), y, np.frombuffer(r.bins, np.uint8).reshape(n, len(y)), np.frombuffer(r.f)

        kept = self.stored.frame.mapInArrow(blocks, "h binary, y binary, bins binary, f binary")
        return kept.rdd.coalesce(self.parts).map(arrays).persist(StorageLevel.MEMORY_AND_DISK)

    def passed(self, make: Callable):
        """What `make` yields for each task's (h, y, bins, f)."""
        trees = list(self.trees)
        return self.arrays.mapPartitions(lambda blocks: make((h, y, bins, _added(f, trees, bins)) for h, y, bins, f in blocks))

    def add(self, tree: Tree) -> None:
        self.trees.append(tree)
        if len(self.trees) < WRITE_EVERY:
            return
        n, trees = self.n, list(self.trees)

        def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                f = pa.array(_added(b.column("f").to_numpy(zero_copy_only=False), trees, _bins(b, n)))
                yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), b.column("bins"), f], names=["h", "y", "bins", "f"])

        self.stored.put(self.stored.frame.mapInArrow(make, "h long, y double, bins binary, f double"))
        self.trees = []
        self.arrays.unpersist()
        self.arrays = self._kept()

    def losses(self, trees: list[Tree], quantile: float) -> list[float]:
        """The mean loss after each of `trees`."""

        def make(blocks: Iterable[tuple]) -> Iterator[np.ndarray]:
            for _, y, bins, f in blocks:
                out = []
                for t in trees:
                    f = _added(f, [t], bins)
                    out.append(np.maximum(quantile * (y - f), (quantile - 1) * (y - f)).sum())
                yield np.array([*out, len(y)])

        *sums, n = sum(self.passed(make).collect())
        return [x / n for x in sums]

    def drop(self) -> None:
        self.arrays.unpersist()
        self.stored.drop()


def _best(counts: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(gain, cut) of each node by one feature; counts: rows by node, side of the prediction and bin."""
    n = counts.sum(axis=1)
    left = np.cumsum(np.stack([s.quantile * n - counts[:, 1], n]), axis=2)  # the gradients' sum, the rows
    whole = left[:, :, -1:]
    right = whole - left
    score = lambda x: x[0] ** 2 / np.maximum(x[1] + s.l2, 1e-12)
    gain = np.where((left[1] >= s.min_leaf) & (right[1] >= s.min_leaf), score(left) + score(right) - score(whole), -1.0)
    at = gain.argmax(axis=1)
    return np.take_along_axis(gain, at[:, None], axis=1)[:, 0], at


def _level(rows: Rows, tree: Tree, open_: list[int], features: list[int], widths: list[int], s: Settings, seed: int) -> dict[int, tuple]:
    """The best cuts of the open nodes by each feature: their gains and bins."""

    def counts(blocks: Iterable[tuple]) -> Iterator[tuple]:
        total = {c: np.zeros(len(open_) * 2 * widths[c], np.int32) for c in features}  # whole numbers, so sums are exact in any order
        number = np.full(len(tree.feature), -1)
        number[open_] = np.arange(len(open_))
        for h, y, bins, f in blocks:
            use = number[tree.nodes(bins)]
            use = np.where(drawn(h, s.rows, seed), use, -1) if s.rows < 1 else use
            on = slice(None) if use.min(initial=0) == 0 else np.flatnonzero(use >= 0)
            cell = use[on] * 2 + (y < f)[on]
            for c in features:
                total[c] += np.bincount(cell * widths[c] + bins[c][on], minlength=len(total[c]))
        yield from ((c, x.reshape(len(open_), 2, widths[c])) for c, x in total.items())

    found = rows.passed(counts)
    if rows.parts * len(open_) * 8 * sum(widths[c] for c in features) > COUNTED_BYTES:
        merged = found.combineByKey(lambda x: x.astype(np.int64), np.add, np.add, min(spread(rows.stored.frame.sparkSession, 0), len(features)))
        return dict(merged.mapValues(lambda x: _best(x, s)).collect())
    total: dict[int, np.ndarray] = {}
    for c, x in found.collect():
        total[c] = total[c] + x if c in total else x.astype(np.int64)
    return {c: _best(x, s) for c, x in total.items()}


def _steps(rows: Rows, tree: Tree, quantile: float) -> list[tuple]:
    """(leaf, quantile of the residuals, rows).

    A part sends of a leaf the values about its own quantile. As rows are dealt to parts by their
    hash, the whole's quantile is among them; leaves where that fails are left to a mergeable sketch.
    """

    def middle(blocks: Iterable[tuple]) -> Iterator[tuple]:
        got = [(tree.nodes(bins), y - f) for _, y, bins, f in blocks]
        if not got:
            return
        leaf, r = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((r, leaf))
        leaf, r = leaf[order], r[order]
        start = np.flatnonzero(np.diff(leaf, prepend=-1))
        for a, b in zip(start, [*start[1:], len(r)]):
            n, spare = b - a, 8 + REACH * np.sqrt(quantile * (1 - quantile) * (b - a))
            i, j = max(0, int(quantile * n - spare)), min(n, int(quantile * n + spare) + 1)
            yield int(leaf[a]), (n, i, j, r[a + i : a + j])

    by_leaf: dict[int, list] = {}
    for leaf, x in rows.passed(middle).collect():
        by_leaf.setdefault(leaf, []).append(x)
    out, missed = [], []
    for leaf, parts in by_leaf.items():
        n = sum(x[0] for x in parts)
        nth = int(np.ceil(quantile * n)) - 1 - sum(x[1] for x in parts)
        near = np.concatenate([x[3] for x in parts])
        v = float(np.partition(near, nth)[nth]) if 0 <= nth < len(near) else np.nan
        if all((i == 0 or y[0] <= v) and (j == m or y[-1] >= v) for m, i, j, y in parts):
            out.append((leaf, v, n))
        else:
            missed.append(leaf)
    if missed:

        def left_over(blocks: Iterable[tuple]) -> Iterator[tuple]:
            for _, y, bins, f in blocks:
                at = tree.nodes(bins)
                on = np.isin(at, missed)
                yield from zip(at[on].tolist(), (y - f)[on].tolist())

        rest = rows.stored.frame.sparkSession.createDataFrame(rows.passed(left_over), "leaf long, r double")
        out += [tuple(x) for x in rest.groupBy("leaf").agg(F.percentile_approx("r", quantile, SKETCH), F.count("*")).collect()]
    return out


def grow(rows: Rows, s: Settings, k: int, widths: list[int]) -> Tree:
    """The tree of round k, with its leaves' steps; widths: the features' bins."""
    rng = np.random.default_rng((s.seed, k))
    tree, open_ = Tree(), [0]
    n = max(1, round(s.columns * rows.n))
    features = sorted(rng.choice(rows.n, n, replace=False).tolist()) if n < rows.n else list(range(rows.n))
    for _ in range(s.depth):
        found = _level(rows, tree, open_, features, widths, s, s.seed + 1_000_003 * k)
        gains = np.stack([found[c][0] for c in features])
        first, nodes, open_ = gains.argmax(axis=0), open_, []
        for i, node in enumerate(nodes):
            if gains[first[i], i] > 1e-9:
                tree.split(node, features[first[i]], int(found[features[first[i]]][1][i]))
                open_ += [len(tree.feature) - 2, len(tree.feature) - 1]
        if not open_:
            break
    for leaf, step, n in _steps(rows, tree, s.quantile):  # 2 ** depth at most
        tree.value[leaf] = float(s.rate * step * n / (n + s.l2))
    return tree


class Pace:
    """The rounds of a fit that runs beside another one, whose rounds it follows and whose choice ends it."""

    def __init__(self):
        self.turn, self.run, self.chosen, self.ended = threading.Condition(), 0, None, False

    def reached(self, run: int) -> None:
        with self.turn:
            if self.ended:
                raise RuntimeError("the fit beside this one has failed")
            self.run = run
            self.turn.notify_all()

    def choose(self, rounds: int) -> None:
        with self.turn:
            self.chosen = rounds
            self.turn.notify_all()

    def rounds(self) -> Iterator[int]:
        k = 0
        while True:
            with self.turn:
                self.turn.wait_for(lambda: self.chosen is not None or k < self.run)
                if self.chosen is not None and k >= self.chosen:
                    return
            yield k
            k += 1


def boost(
    train: DataFrame, tail: DataFrame | None, features: list[str], y: Column, key: Column, s: Settings, rounds: Iterable[int] | None = None, reached: Callable[[int], None] = lambda run: None
) -> Boosted:
    """Boosted trees on `train`; with `tail`, those up to the round that was best there, and no more than `patience` after it.

    rounds: other ones than those of the settings, from 0 on; reached: called with the number of rounds run.
    The tail's losses are taken WRITE_EVERY rounds at a time; what they choose does not hang on that.
    """
    cuts = find_cuts(train, features)
    base, n = train.agg(F.percentile_approx(y.cast("double"), s.quantile, SKETCH), F.count("*")).first()
    base = float(base)
    model, widths = Boosted(base, features, cuts), [len(c) + 2 for c in cuts]
    fit = Rows(bin_rows(train, features, cuts, y, key), base, len(features), n)
    held = Rows(bin_rows(tail, features, cuts, y, key), base, len(features), tail.count()) if tail is not None else None
    best, best_at, seen = float("inf"), 0, 0
    for k in range(s.rounds) if rounds is None else rounds:
        tree = grow(fit, s, k, widths)
        model.trees.append(tree)
        fit.add(tree)
        reached(k + 1)
        if held is None or len(model.trees) - seen < WRITE_EVERY and k + 1 < s.rounds:
            continue
        for loss in held.losses(model.trees[seen:], s.quantile):
            held.add(model.trees[seen])
            seen += 1
            if loss < best - 1e-12:
                best, best_at = loss, seen
            elif seen - best_at >= s.patience:
                break
        if seen - best_at >= s.patience:
            break
    if held is not None:
        del model.trees[best_at:]
        held.drop()
    fit.drop()
    return model
