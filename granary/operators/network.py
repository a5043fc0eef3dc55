"""A recurrent quantile network in numpy: LSTM over a window, embeddings of categories, a two-layer head.

It is fitted where the windows lie, on all of them: in an epoch each task runs Adam on the pinball
loss over its own segments, and the tasks' weights are averaged; the driver holds the weights alone.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import cut
from . import sequences

KEYS = ["item", "branch", "dt"]
#: Defaults and search space.
DEFAULTS = {"hidden_size": 128, "num_layers": 1, "dropout": 0.2, "learning_rate": 1e-3, "batch_size": 1024, "log_target": False, "grad_clip": 1.0, "random_state": 42}
SPACE = {"hidden_size": [64, 128], "num_layers": [1], "dropout": [0.0, 0.2, 0.3], "learning_rate": [3e-4, 1e-3], "batch_size": [1024, 2048], "log_target": [False, True]}
PATIENCE, MAX_EPOCHS, TAIL_DAYS = 5, 100, 30


def pinball_loss(prediction: np.ndarray, target: np.ndarray, quantile: float = 0.9) -> float:
    """What is trained is what is scored."""
    d = target - prediction
    return float(np.maximum(quantile * d, (quantile - 1) * d).mean())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Network:
    """The weights `w` by name, and passes over batches (windows, days, features) with category indices."""

    def __init__(self, n_dynamic: int, sizes: list[tuple[int, int]], hidden_size: int, num_layers: int = 1, dropout: float = 0.0, seed: int = 42):
        r = np.random.default_rng(seed)
        self.hidden, self.layers, self.dropout, self.sizes = hidden_size, num_layers, dropout, sizes
        u = lambda *shape: r.uniform(-(hidden_size**-0.5), hidden_size**-0.5, shape)
        self.w: dict[str, np.ndarray] = {f"e{i}": r.normal(0, 1, s) for i, s in enumerate(sizes)}
        for k in range(num_layers):
            self.w |= {f"x{k}": u(hidden_size if k else n_dynamic, 4 * hidden_size), f"h{k}": u(hidden_size, 4 * hidden_size), f"b{k}": np.zeros(4 * hidden_size)}
        width = hidden_size + sum(d for _, d in sizes)
        self.w |= {"head1": u(width, hidden_size), "bias1": np.zeros(hidden_size), "head2": u(hidden_size), "bias2": np.zeros(1)}

    def _lstm(self, k: int, x: np.ndarray) -> tuple[np.ndarray, list]:
        n, days, _ = x.shape
        h, c, steps, out = np.zeros((n, self.hidden)), np.zeros((n, self.hidden)), [], np.empty((n, days, self.hidden))
        driven = x @ self.w[f"x{k}"] + self.w[f"b{k}"]
        for t in range(days):
            i, f, o, g = np.split(driven[:, t] + h @ self.w[f"h{k}"], 4, axis=1)
            i, f, o, g = _sigmoid(i), _sigmoid(f), _sigmoid(o), np.tanh(g)
            before, was = c, h
            c = f * c + i * g
            h = o * np.tanh(c)
            out[:, t] = h
            steps.append((i, f, o, g, before, c, was))
        return out, steps

    def forward(self, x: np.ndarray, cats: np.ndarray, r: np.random.Generator | None = None) -> tuple[np.ndarray, tuple]:
        """Predictions, and what the backward pass needs; with a generator, under dropout."""
        memory, inputs = [], []
        for k in range(self.layers):
            inputs.append(x)
            x, steps = self._lstm(k, x)
            memory.append(steps)
        z = np.concatenate([x[:, -1], *[self.w[f"e{i}"][cats[:, i]] for i in range(len(self.sizes))]], axis=1)
        a = np.maximum(z @ self.w["head1"] + self.w["bias1"], 0)
        mask = (r.random(a.shape) >= self.dropout) / (1 - self.dropout) if r is not None and self.dropout else 1.0
        return (a * mask) @ self.w["head2"] + self.w["bias2"][0], (inputs, memory, z, a, mask, cats)

    def backward(self, d: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        """Gradients of all weights from that of the predictions."""
        inputs, memory, z, a, mask, cats = kept
        g = {"head2": (a * mask).T @ d, "bias2": np.array([d.sum()])}
        back = np.outer(d, self.w["head2"]) * mask * (a > 0)
        g |= {"head1": z.T @ back, "bias1": back.sum(axis=0)}
        dz = back @ self.w["head1"].T
        at = self.hidden
        for i, (_, width) in enumerate(self.sizes):
            g[f"e{i}"] = np.zeros_like(self.w[f"e{i}"])
            np.add.at(g[f"e{i}"], cats[:, i], dz[:, at : at + width])
            at += width
        dout = np.zeros((len(d), inputs[0].shape[1], self.hidden))
        dout[:, -1] = dz[:, : self.hidden]
        for k in reversed(range(self.layers)):
            x = inputs[k]
            dx, dh, dc = np.zeros_like(x, dtype=float), np.zeros((len(d), self.hidden)), np.zeros((len(d), self.hidden))
            g |= {f"x{k}": np.zeros_like(self.w[f"x{k}"]), f"h{k}": np.zeros_like(self.w[f"h{k}"]), f"b{k}": np.zeros_like(self.w[f"b{k}"])}
            for t in reversed(range(x.shape[1])):
                i, f, o, c_in, before, c, was = memory[k][t]
                dh = dh + dout[:, t]
                th = np.tanh(c)
                dc = dc + dh * o * (1 - th * th)
                gates = np.concatenate((dc * c_in * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - c_in * c_in)), axis=1)
                g[f"x{k}"] += x[:, t].T @ gates
                g[f"h{k}"] += was.T @ gates
                g[f"b{k}"] += gates.sum(axis=0)
                dx[:, t] = gates @ self.w[f"x{k}"].T
                dh, dc = gates @ self.w[f"h{k}"].T, dc * f
            dout = dx
        return g

    def predict(self, windows: Callable[[np.ndarray], np.ndarray], cats: np.ndarray, batch: int = 4096) -> np.ndarray:
        """windows: from numbers of windows to an array of them, so that no more than a batch is held."""
        numbers = np.arange(len(cats))
        return np.concatenate([self.forward(windows(numbers[s : s + batch]), cats[s : s + batch])[0] for s in range(0, len(cats), batch)]) if len(cats) else np.zeros(0)


class Adam:
    def __init__(self, w: dict[str, np.ndarray], rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def step(self, w: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, x in g.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.999 * self.v[k] + 0.001 * x * x
            w[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def run_epoch(net: Network, adam: Adam, windows: Callable[[np.ndarray], np.ndarray], cats, y, batch_size: int, grad_clip: float, quantile: float, r: np.random.Generator) -> float:
    """One pass over shuffled windows; the mean loss. A loss that is not finite raises."""
    total = 0.0
    order = r.permutation(len(y))
    for s in range(0, len(order), batch_size):
        b = order[s : s + batch_size]
        out, kept = net.forward(windows(b), cats[b], r)
        loss = pinball_loss(out, y[b], quantile)
        if not np.isfinite(loss):
            raise ValueError("the loss is not finite")
        g = net.backward(np.where(y[b] >= out, -quantile, 1 - quantile) / len(b), kept)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        if norm > grad_clip:
            g = {k: v * (grad_clip / norm) for k, v in g.items()}
        adam.step(net.w, g)
        total += loss * len(b)
    return total / max(1, len(y))


# --- fitted where the windows lie ------------------------------------------------------------

#: Weights that one row carries when tasks' networks are averaged.
PIECE = 4096


def _pieces(w: dict[str, np.ndarray]) -> Iterator[tuple[str, int, np.ndarray]]:
    for name, x in w.items():
        flat = x.reshape(-1)
        for k in range(0, len(flat), PIECE):
            yield name, k, flat[k : k + PIECE]


def _batch(b: pa.RecordBatch, dynamic: list[str], categorical: list[str], lookback: int, scale: tuple, on: Callable) -> tuple:
    """(windows' maker, categories, rows' fields) of the windows in a batch of packed segments that `on` keeps."""
    x, ends, rows, segment = sequences.flat_windows(b, dynamic, lookback)
    x = (x - scale[0]) / scale[1]
    field = {f.name: rows.field(i) for i, f in enumerate(rows.type)}
    at = np.flatnonzero(on(field)) if len(ends) else np.zeros(0, np.int64)
    field = {k: v.take(pa.array(at)) for k, v in field.items()}
    cats = np.stack([field[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in categorical], axis=1) if categorical else np.zeros((len(at), 0), np.int64)
    ends = ends[at]
    return (lambda i: sequences.window_views(x, ends[i], lookback)), cats, field, segment[at] if len(segment) else segment


class Spread:
    """A network whose windows stay on the executors: each task trains on its own, then the weights are averaged by windows.

    Packed segments (days with y and part) are stored, so a task that is run again sees the same
    windows; its order of batches follows from the seed, the epoch and its first segment.
    """

    def __init__(self, packed: DataFrame, dynamic: list[str], categorical: list[str], sizes: list[tuple[int, int]], lookback: int, scale: tuple, p: dict, quantile: float):
        self.packed, self.dynamic, self.categorical, self.lookback, self.scale, self.p, self.quantile = packed, dynamic, categorical, lookback, scale, p, quantile
        self.net = Network(len(dynamic), sizes, p["hidden_size"], p["num_layers"], p["dropout"], p["random_state"])

    def _parts(self, parts: tuple[int, ...]) -> Callable:
        return lambda field: np.isin(field["part"].to_numpy(zero_copy_only=False), parts)

    def epoch(self, parts: tuple[int, ...], k: int) -> None:
        """One pass over the windows of `parts`. A loss that is not finite raises."""
        net, p, q, on = self.net, self.p, self.quantile, self._parts(parts)
        dynamic, categorical, lookback, scale = self.dynamic, self.categorical, self.lookback, self.scale

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, n, adam, r = copy.deepcopy(net), 0, None, None
            for b in batches:
                windows, cats, field, _ = _batch(b, dynamic, categorical, lookback, scale, on)
                if not len(cats):
                    continue
                if adam is None:
                    seed = zlib.crc32(repr([b.column(i)[0].as_py() for i in range(b.num_columns - 1)]).encode())
                    adam, r = Adam(own.w, p["learning_rate"]), np.random.default_rng((p["random_state"], k, seed))
                y = field["y"].to_numpy(zero_copy_only=False)
                run_epoch(own, adam, windows, cats, np.log1p(y) if p["log_target"] else y, p["batch_size"], p["grad_clip"], q, r)
                n += len(y)
            found = [(name, at, (x * n).tobytes()) for name, at, x in _pieces(own.w)] if n else []
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.binary()), pa.array([n] * len(found), pa.int64())], names=["name", "at", "piece", "n"])

        def add(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer()) for x in t.column("piece"))
            return pa.table({"name": t.column("name")[:1], "at": t.column("at")[:1], "piece": [total.tobytes()], "n": [pa.compute.sum(t.column("n")).as_py()]})

        schema = "name string, at long, piece binary, n long"
        for r in self.packed.mapInArrow(train, schema).groupBy("name", "at").applyInArrow(add, schema).collect():  # the weights, once
            piece = np.frombuffer(bytes(r.piece)) / r.n
            self.net.w[r.name].reshape(-1)[r.at : r.at + len(piece)] = piece

    def loss(self, parts: tuple[int, ...]) -> float:
        net, p, q, on = self.net, self.p, self.quantile, self._parts(parts)
        dynamic, categorical, lookback, scale = self.dynamic, self.categorical, self.lookback, self.scale

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                windows, cats, field, _ = _batch(b, dynamic, categorical, lookback, scale, on)
                y = field["y"].to_numpy(zero_copy_only=False) if len(cats) else np.zeros(0)
                y = np.log1p(y) if p["log_target"] else y
                total = pinball_loss(net.predict(windows, cats), y, q) * len(y) if len(y) else 0.0
                yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([len(y)])], names=["loss", "n"])

        return self.packed.mapInArrow(score, "loss double, n long").agg(F.try_divide(F.sum("loss"), F.sum("n"))).first()[0]

    def fit(self, parts: tuple[int, ...], epochs: int, stop: tuple[int, ...] = (), patience: int = PATIENCE) -> int:
        """Epochs that did best: `epochs` passes, or until `patience` passes don't lower the loss on the parts `stop`."""
        best, best_at = float("inf"), 1
        for k in range(1, epochs + 1):
            self.epoch(parts, k)
            if not stop:
                best_at = k
                continue
            loss = self.loss(stop)
            if loss < best:
                best, best_at = loss, k
            elif k - best_at >= patience:
                break
        return best_at


#: Parts of the training days: neither, before the tail, in the tail.
REST, EARLY, TAIL = 0, 1, 2


def _parted(packed: DataFrame, tail_days: int) -> tuple[DataFrame, set[int]]:
    """Packed segments whose days have a part (null without y), and the parts that there are."""
    last = packed.select(F.array_max(F.transform(F.filter("days", lambda d: d["y"].isNotNull()), lambda d: d["dt"])).alias("dt")).agg(F.max("dt")).first()[0]
    if last is None:
        raise ValueError("no rows to fit")
    start = F.date_sub(F.lit(last), tail_days - 1)
    part = lambda d: F.when(d["y"].isNull(), None).when(d["dt"] >= start, TAIL).when(F.date_add(d["dt"], d["lead"]) < start, EARLY).otherwise(REST)
    out = packed.withColumn("days", F.transform("days", lambda d: d.withField("part", F.coalesce(part(d), F.lit(-1)))))
    there = out.select(F.explode(F.array_distinct(F.transform("days", lambda d: d["part"]))).alias("part")).distinct().collect()
    return out, {r.part for r in there}


def recurrent_quantiles(
    dynamic: list[str], categorical: list[str], sizes: list[tuple[int, int]], lookback: int, quantile: float = 0.9, epochs: int = MAX_EPOCHS, patience: int = PATIENCE, tail_days: int = TAIL_DAYS, **params
) -> Callable[[DataFrame, DataFrame, tuple], DataFrame]:
    """A forecaster over packed segments (see `sequences.bind_panel`) with `categorical` indices (sizes: levels, width).

    Two fits: one stops early on the last `tail_days` days, the other takes all rows for as
    many epochs. Windows are scaled by the training rows' means and deviations.
    """
    p = DEFAULTS | params

    def forecast(train: DataFrame, valid: DataFrame, scale: tuple) -> DataFrame:
        packed, parts = _parted(train, tail_days)
        packed = cut(packed)
        spread = lambda: Spread(packed, dynamic, categorical, sizes, lookback, scale, p, quantile)
        best = epochs
        if {EARLY, TAIL} <= parts:
            best = spread().fit((EARLY,), epochs, (TAIL,), patience)
        whole = spread()
        whole.fit((REST, EARLY, TAIL), best)
        net = whole.net
        wanted = lambda field: field["wanted"].fill_null(False).to_numpy(zero_copy_only=False).astype(bool)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                windows, cats, field, segment = _batch(b, dynamic, categorical, lookback, scale, wanted)
                if len(cats):
                    out = net.predict(windows, cats)
                    out = np.maximum(0.0, np.expm1(out) if p["log_target"] else out)
                    yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(segment)), b.column("branch").take(pa.array(segment)), field["dt"], pa.array(out)], names=[*KEYS, "prediction"])

        return valid.mapInArrow(run, "item string, branch string, dt date, prediction double")

    return forecast
