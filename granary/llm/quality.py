"""Quality classifier: random-indexing word vectors, pooled, and a small network.

Each token has a fixed sparse random index vector. A token's word vector is the sum of the
index vectors of its neighbours over the whole corpus, in a table of fixed size into which
tokens are hashed. A document is the mean of its tokens' normalised word vectors; a two-layer
network in numpy, fitted on a bounded sample of labelled documents, scores it, and a
temperature fitted on a part of the sample that the network has not seen calibrates it.

Tokens are words (A-Z lower-cased) and, beside each word, its shape: its last byte where this
is no letter or digit, and whether it is in capitals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .language_id import held_out

#: Dimensions of a vector, entries of an index vector, neighbours on each side, table size (bits).
DIM, NONZERO, REACH, BITS = 32, 2, 2, 14
SHAPES = 1 << 10
#: Labelled documents that the network is fitted on, at most (those of the least hashes).
SAMPLE = 20_000
HIDDEN, ROUNDS, BATCH, RATE, DECAY = 32, 40, 256, 0.003, 1e-4
FEATURES = 2 * DIM + 2


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table slots of words and of their shapes, in two halves of the table, and first words of texts."""
    starts, ends, first = C.words(data, off)
    if not len(starts):
        return starts, starts, first
    sums, down = C.prefix_sums(data, True)
    word = (C.span_hash(sums, down, starts, ends) >> np.uint64(65 - BITS)).astype(np.int64)
    last = data[ends - 1].astype(np.int64)
    plain = ((last >= 48) & (last < 58)) | ((last >= 65) & (last < 91)) | ((last >= 97) & (last < 123)) | (last >= 128)
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data < 91))))
    lower = np.concatenate(([0], np.cumsum((data >= 97) & (data < 123))))
    capitals = (upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])
    shape = np.where(plain, 0, last) + 256 * capitals
    return word, (1 << BITS - 1) + shape, first


_DIMS = np.random.default_rng(21).integers(0, DIM, (1 << BITS, NONZERO))
_SIGNS = np.random.default_rng(22).choice([-1.0, 1.0], (1 << BITS, NONZERO))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the neighbours' index vectors by slot, over the partition."""
    total = np.zeros(DIM << BITS)
    for b in batches:
        for _, data, off in C.parts(b.column(0)):
            word, shape, first = tokens(data, off)
            doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
            for step in range(1, REACH + 1):
                if len(word) <= step:
                    break
                same = np.flatnonzero(doc[step:] == doc[:-step])
                for of, at in ((same, same + step), (same + step, same)):
                    for token in (word, shape):
                        for j in range(NONZERO):
                            for near in (word, shape):
                                total += np.bincount(token[of] * DIM + _DIMS[near[at], j], _SIGNS[near[at], j], minlength=DIM << BITS)
    table = total.reshape(-1, DIM)
    some = np.flatnonzero(np.abs(table).sum(axis=1))
    for s in range(0, len(some), 4096):
        part = some[s : s + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(part)] + [pa.array(table[part, j]) for j in range(DIM)], names=["slot"] + [f"v{j}" for j in range(DIM)])


def _pool(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vectors.value
        for b in batches:
            out, total = np.zeros((b.num_rows, FEATURES), dtype=np.float32), np.zeros(b.num_rows, dtype=np.int64)
            for at, data, off in C.parts(b.column(2), C.SLICE_BYTES // 2):
                word, shape, first = tokens(data, off)
                n = np.diff(first)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                total[at + some] += n[some]
                for k, token in enumerate((word, shape)):
                    out[at + some, k * DIM : (k + 1) * DIM] += np.add.reduceat(table[token], first[:-1][some], axis=0)
            out[:, : 2 * DIM] /= np.maximum(total, 1)[:, None]
            out[:, 2 * DIM] = (out[:, :DIM] ** 2).sum(axis=1)
            out[:, 2 * DIM + 1] = np.log1p(total)
            raw = pa.array([x.tobytes() for x in out], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), raw, b.column(3)], names=["doc_id", "held_out", "vector", "text_hash"])

    return run


class Network:
    """Two layers, fitted by Adam on the log-loss; `temperature` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        r = np.random.default_rng(23)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.base, self.temperature = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 1.0
        self.w = [r.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        check = np.arange(len(y)) % 5 == 4
        if 0 < y[~check].sum() < (~check).sum():
            self._fit(x[~check], y[~check], r)
            if check.any():
                z = self.logit(x[check])
                grid = np.exp(np.linspace(-2, 3, 101))
                loss = [np.logaddexp(0, np.where(y[check] > 0, -z, z) / t).mean() for t in grid]
                self.temperature = float(grid[int(np.argmin(loss))])
        else:
            self.w[0][:], self.w[2][:], self.w[3][:] = 0, 0, self.base

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        return h, h @ self.w[2] + self.w[3][0]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale)[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))

    def _fit(self, x: np.ndarray, y: np.ndarray, r: np.random.Generator) -> None:
        x = (x - self.mean) / self.scale
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(ROUNDS):
            order = r.permutation(len(y))
            for s in range(0, len(y), BATCH):
                a = order[s : s + BATCH]
                h, z = self._forward(x[a])
                d = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[a]) / len(a)
                back = np.outer(d, self.w[2]) * (h > 0)
                grads = [x[a].T @ back + DECAY * self.w[0], back.sum(axis=0), h.T @ d + DECAY * self.w[2], np.array([d.sum()])]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=np.float32).reshape(-1, FEATURES).astype(np.float64)


def _score(network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = network.value.score(_matrix(b.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), b.column(3)], names=["doc_id", "held_out", "score", "text_hash"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher for label 1), predicted (1 from `threshold` on) and text_hash of each row.

    Only labelled rows that are not held out are learnt from, `sample` of them at most, those
    whose ids hash lowest; word vectors come from all texts, without labels.

    A null or empty text pools to zeros and gets the score of that. A null id is held out. Ids
    may repeat: each row is scored alone. Null labels are not used; of several labels of an id
    each is learnt. Texts of any length are pooled whole, a part at a time; neighbours across
    the borders of parts are not counted. Without labels of both kinds the score is the
    smoothed share of label 1. An empty table gives an empty table; other columns are not read
    and may have any names.
    """
    spark = docs.sparkSession
    C.tune(spark)
    scratch = C.Scratch(spark, "quality")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"), C.identity(id_col, text_col)[1].alias("text_hash"))
    fields = [f"v{j}" for j in range(DIM)]
    sums = rows.select("text").mapInArrow(_contexts, "slot long, " + ", ".join(f"{f} double" for f in fields))
    found = sums.groupBy("slot").agg(*[F.sum(f).alias(f) for f in fields]).toArrow()
    table = np.zeros((1 << BITS, DIM), dtype=np.float32)
    if len(found):
        v = np.stack([found[f].to_numpy() for f in fields], axis=1)
        table[found["slot"].to_numpy()] = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)
    pooled = scratch.store(rows.mapInArrow(_pool(spark.sparkContext.broadcast(table)), "doc_id long, held_out boolean, vector binary, text_hash long"), "pooled")
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label is not null")
    learn = pooled.where("not held_out").join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    learnt = learn.select("vector", "label").toArrow()
    x = _matrix(learnt["vector"].to_pylist())
    network = Network(x if len(x) else np.zeros((1, FEATURES)), learnt["label"].to_numpy().astype(float) if len(x) else np.zeros(1))
    out = pooled.mapInArrow(_score(spark.sparkContext.broadcast(network)), "doc_id long, held_out boolean, score double, text_hash long")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
