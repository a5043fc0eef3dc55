"""What the text operators share: folders, text hashing in numpy, connected components."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where the session names no shared folder, on a single machine only (tests).
LOCAL_FOLDER = "file:///tmp/checkpoints"
#: Bytes of text hashed at once; bounds the working arrays (about 40 bytes for each).
SLICE_BYTES = 1 << 20
#: Words of at least so many bytes are hashed by blake2b; unlike ones can be crafted to have equal sums of powers.
LONG_WORD = 128


def _ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context: their Python may not find it."""
    sc = spark.sparkContext
    if getattr(sc, "_granary_sent", False):
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="granary-")
    with zipfile.ZipFile(path := f"{folder}/granary.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    sc._granary_sent = True


def tune(spark: SparkSession) -> None:
    """Send the package, and keep Arrow batches small: a batch may hold very long texts."""
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "true")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The id that stands for null; it sorts first.
NO_ID = -(1 << 63)


def identity(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What tells a row's document from others: its id (NO_ID for null) and a hash of its text.

    Rows alike in both are one document. Both follow from the row alone, so they are the same
    in every scan and after lost tasks; rows that repeat an id with other texts stay apart.
    """
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(F.col(text_col).cast("string"), F.octet_length(F.col(text_col).cast("string")))


class Scratch:
    """Tables in the folder that driver and executors share; removed by `release` or when the JVM ends.

    A written table cuts lineage and survives lost executors.
    """

    live: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        self.spark, self.base = spark, f"{(base or LOCAL_FOLDER).rstrip('/')}/granary-{name}-{uuid.uuid4().hex}"
        Scratch.live.append(self)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.base))

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def store(self, df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
        """The rows as a table here; the exchanges that made them are given back.

        narrow: write from fewer tasks, for rows that are few next to the input: two for each
        core, or a sixteenth of the exchange's partitions where that is more. Each task makes a
        file, and each file costs the executor requests to the file system.
        """
        if narrow:
            part = int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 16
            df = df.coalesce(max(2 * self.spark.sparkContext.defaultParallelism, part))
        clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(clean, "false")
        self.spark.conf.set(clean, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(clean, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(self.path(name)), True)

    @classmethod
    def release(cls, since: int) -> None:
        """Remove the tables of all scratch folders but the first `since`; no result that reads them may be open."""
        for s in cls.live[since:]:
            s._fs.delete(s._path(s.base), True)
        del cls.live[since:]


#: Rows of a key from which it counts as hot, at least, and hot keys at most.
HOT_ROWS, HOT_KEYS = 200_000, 100_000


def hot_keys(keyed: DataFrame, n_rows: int) -> DataFrame | None:
    """Rows of `keyed` whose key has more than HOT_ROWS of the rows and more than n_rows / HOT_KEYS, so at most HOT_KEYS; None without any."""
    hot = keyed.where(F.col("n") > max(HOT_ROWS, n_rows // HOT_KEYS))
    return None if hot.isEmpty() else hot


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, n_rows: int) -> DataFrame:
    """Inner join of `rows` with `keyed`, which has a row for each key and the number `n` of its rows.

    Keys with more than HOT_ROWS rows and more than n_rows / HOT_KEYS are at most HOT_KEYS:
    that many are broadcast, so their rows stay where they are and no task gets them all.
    """
    hot = hot_keys(keyed, n_rows)
    if hot is None:
        return rows.join(keyed.drop("n"), key)
    hot = F.broadcast(hot.drop("n"))
    return rows.join(hot.select(key), key, "left_anti").join(keyed.drop("n"), key).unionByName(rows.join(hot, key))


# --- text as numpy -----------------------------------------------------------------------

_RNG = np.random.default_rng(20240517)
#: Random 64-bit value of each byte, and of each after lower-casing A-Z.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOW = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for k, b in (("up", _BASE), ("down", _BASE_INV)):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums over prefixes from which the hash of any span follows, and the inverse powers."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_BYTE_LOW if lower else _BYTE)[data] * up[:-1], out=sums[1:])
    return sums, down


def span_hash(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _whole_hash(word: np.ndarray) -> np.uint64:
    h = hashlib.blake2b(digest_size=8)
    for s in range(0, len(word), SLICE_BYTES):
        h.update(_LOWER[word[s : s + SLICE_BYTES]])
    return np.uint64(int.from_bytes(h.digest(), "little"))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, A-Z lower-cased, by their bytes alone."""
    out = span_hash(*prefix_sums(data, True), starts, ends)
    for i in np.flatnonzero(ends - starts >= LONG_WORD):
        out[i] = _whole_hash(data[starts[i] : ends[i]])
    return out


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of texts with about `limit` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield at, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def portions(column: pa.Array | pa.ChunkedArray, overlap: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As `slices`, but texts over `limit` bytes are cut: (index of the first text, start in it, bytes, offsets).

    A cut text's portions hold `limit` bytes and the `overlap` bytes that follow them.
    """
    for at, data, off in slices(column, limit):
        if len(off) > 2 or len(data) <= limit + overlap:
            yield at, 0, data, off
            continue
        for start in range(0, max(1, len(data) - overlap), limit):
            part = data[start : start + limit + overlap]
            yield at, start, part, np.array([0, len(part)])


def parts(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As `slices`, but a text over `limit` bytes comes in several parts with the same index, cut after white space.

    A word of more than `limit` bytes is cut too.
    """
    for at, data, off in slices(column, limit):
        start = 0
        while len(off) == 2 and len(data) - start > limit:
            space = np.flatnonzero(_SPACE[data[start + limit : start + 2 * limit]])
            end = start + limit + (int(space[0]) + 1 if len(space) else 0)
            yield at, data[start:end], np.array([0, end - start])
            start = end
        if start < len(data) or not start:
            yield at, data[start:], off if not start else np.array([0, len(data) - start])


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and, per text, the index of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = _SPACE[data]
    cut = np.empty(len(data), dtype=bool)
    cut[0], cut[1:] = True, space[:-1]
    full = off[1:] > off[:-1]
    cut[off[:-1][full]] = True
    starts = np.flatnonzero(cut & ~space)
    cut[-1], cut[:-1] = True, space[1:]
    cut[off[1:][full] - 1] = True
    ends = np.flatnonzero(cut & ~space) + 1
    return starts, ends, np.searchsorted(starts, off)


def _long_word_hashes(data: np.ndarray, limit: int = SLICE_BYTES) -> np.ndarray:
    """Hashes of one long text's words, as word_hashes gives them, a portion of `limit` bytes at a time."""
    out: list[np.ndarray] = []
    begun = None  # where a word starts that goes on beyond its portion
    for s in range(0, len(data), limit):
        part, last = data[s : s + limit], s + limit >= len(data)
        starts, ends, _ = words(part, np.array([0, len(part)]))
        h = word_hashes(part, starts, ends)
        if begun is not None:
            goes_on = len(starts) > 0 and starts[0] == 0
            if goes_on and ends[0] == len(part) and not last:
                continue
            word = data[begun : s + (int(ends[0]) if goes_on else 0)]
            one = _whole_hash(word) if len(word) >= LONG_WORD else word_hashes(word, np.array([0]), np.array([len(word)]))[0]
            h, begun = np.concatenate((np.array([one], np.uint64), h[1:] if goes_on else h)), None
        if len(ends) and ends[-1] == len(part) and not last:
            begun, h = s + int(starts[-1]), h[:-1]
        out.append(h)
    return np.concatenate(out)


def shingles(data: np.ndarray, off: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct 64-bit hashes of its shingles of `width` words, A-Z lower-cased.

    A text with fewer words has one shingle, the whole sequence; without words it has none.
    """
    if len(data) > SLICE_BYTES and len(off) == 2:
        w = _long_word_hashes(data)
        first = np.array([0, len(w)])
    else:
        starts, ends, first = words(data, off)
        w = word_hashes(data, starts, ends)
    if len(w) >= width:
        s = np.zeros(len(w) - width + 1, dtype=np.uint64)
        for j in range(width):
            s += w[j : len(w) - width + 1 + j] * _STEP[j]
        s = mix(s + np.uint64(width))
    for i in range(len(off) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            x = np.sort(s[a : b - width + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            yield mix(np.array([(w[a:b] * _STEP[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)


def long_array(x) -> pa.Array:
    return pa.array(np.asarray(x, dtype=np.uint64).view(np.int64))


# --- graphs ------------------------------------------------------------------------------


def components(edges: DataFrame, scratch: Scratch, name: str = "graph") -> DataFrame:
    """(node, root) of every node of `edges` (a, b long): root is the smallest node reachable.

    Alternates large-star and small-star steps, whose minima Spark combines before the
    exchange; each step's edges go to the shared folder. Loops and repeats are allowed.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    before, k = None, 0
    while True:
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.store(large, f"{name}-large{k}", narrow=True)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        k, before = k + 1, state
        e = scratch.store(small, f"{name}-edges{k}", narrow=True)
        scratch.drop(f"{name}-edges{k - 1}")
        scratch.drop(f"{name}-large{k - 1}")
