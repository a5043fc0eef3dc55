"""Exact medians, and medians of deviations from them, of each series' trailing window.

Time is cut into spans as long as the window, so a window lies in its own span and the one
before: a cell is a series' span with the points of both. Points alike in time and value are one
with a weight. A cell of up to SHARD_ROWS points is answered by the task that holds it. A hot
one is cut into shards by value, and answered in rounds: every shard reports how many points
each window has in it; the combined counts say in which shard the middle ranks lie, and that
shard answers them exactly. For the deviations, the shards' least and largest values are
distances from the median at which the points in reach are counted; bisecting over these leaves a
stretch that at most one shard on each side has points strictly within, and a task with these
two bisects the rest.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

MINUTE = 60_000_000
#: Points of a cell that one task answers, and of a shard, about: their tables take some 20 MB.
SHARD_ROWS = 65_536
#: Windows that are combined by one task.
CHUNK = 8_192
#: Windows with fewer values have no median.
LEAST = 5
#: Values of more cents, either way, are none: a double does not tell them apart.
MOST_CENTS = 1 << 52
CELL = ["series", "cell"]


class Runs:
    """Weighted values in a fixed order: counts and ranks in any of its runs [left, right), all runs at once.

    One table a bit of the values' ranks: how many of the first i have a 0 there, and their
    weight, after a stable sort by the bits above.
    """

    def __init__(self, values: np.ndarray, weights: np.ndarray):
        self.values, rank = np.unique(values, return_inverse=True)
        self.levels = []
        self.sums = np.concatenate(([0], np.cumsum(weights)))
        for bit in reversed(range(max(1, (len(self.values) - 1).bit_length()))):
            one = (rank >> bit & 1).astype(bool)
            zeros = np.concatenate(([0], np.cumsum(~one)))
            self.levels.append((bit, zeros, np.concatenate(([0], np.cumsum(np.where(one, 0, weights))))))
            order = np.concatenate((np.flatnonzero(~one), np.flatnonzero(one)))
            rank, weights = rank[order], weights[order]

    def count(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.sums[right] - self.sums[left]

    def ranked(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k, from 0, in each run; any value where the run has no such rank."""
        if not len(self.values):
            return np.zeros(len(left), np.int64)
        out = np.zeros(len(left), np.int64)
        for bit, zeros, weight in self.levels:
            less = weight[right] - weight[left]
            up = k >= less
            k = np.where(up, k - less, k)
            a, b = zeros[left], zeros[right]
            left, right = np.where(up, left - a + zeros[-1], a), np.where(up, right - b + zeros[-1], b)
            out |= up.astype(np.int64) << bit
        return self.values[np.minimum(out, len(self.values) - 1)]

    def below(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The weight of values under `value` in each run."""
        rank = np.searchsorted(self.values, value)
        everything, out = rank == len(self.values), np.zeros(len(left), np.int64)
        whole = self.count(left, right)
        for bit, zeros, weight in self.levels:
            up = (rank >> bit & 1).astype(bool)
            out += np.where(up, weight[right] - weight[left], 0)
            a, b = zeros[left], zeros[right]
            left, right = np.where(up, left - a + zeros[-1], a), np.where(up, right - b + zeros[-1], b)
        return np.where(everything, whole, out)


def two_sided(up: Callable, down: Callable, n_up: np.ndarray, n_down: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of ranks k and k + 1 of two rising sequences taken together.

    up(i) and down(i) give the i-th of each; i is bounded to what there is. A rank that the two
    don't reach gives the largest number.
    """
    none = np.iinfo(np.int64).max
    at = lambda f, i, n: np.where((i >= 0) & (i < n), f(np.clip(i, 0, np.maximum(n - 1, 0))), np.where(i < 0, -1, none))
    lo, hi = np.maximum(0, k + 1 - n_down), np.minimum(k + 1, n_up)
    while (lo < hi).any():
        i = lo + hi >> 1
        more = (lo < hi) & (at(up, i, n_up) < at(down, k - i, n_down))
        lo, hi = np.where(more, i + 1, lo), np.where(more | (lo >= hi), hi, i)
    first = np.maximum(at(up, lo - 1, n_up), at(down, k - lo, n_down))
    return np.where(k < n_up + n_down, first, none), np.minimum(at(up, lo, n_up), at(down, k + 1 - lo, n_down))


def ceil_half(x: np.ndarray) -> np.ndarray:
    return -(-x // 2)


def answer(runs: Runs, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of values, doubled median, doubled median of |2 * value - doubled median|) of each run; the last two are 0 for short runs."""
    n = runs.count(left, right)
    median2, mad4 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    on = np.flatnonzero(n >= LEAST)
    if len(on):
        left, right, m = left[on], right[on], n[on]
        k = (m - 1) // 2
        middle = runs.ranked(left, right, k) + runs.ranked(left, right, m // 2)
        under = runs.below(left, right, ceil_half(middle))
        up = lambda i: 2 * runs.ranked(left, right, under + i) - middle
        down = lambda i: middle - 2 * runs.ranked(left, right, under - 1 - i)
        one, two = two_sided(up, down, m - under, under, k)
        median2[on], mad4[on] = middle, one + np.where(m % 2 == 0, two, one)
    return n, median2, mad4


# --- rows and cells ------------------------------------------------------------------------


def _micros(ts: str) -> Column:
    """Exact microseconds since 1970 by the clock that the time shows."""
    return F.expr(f"datediff({ts}, date'1970-01-01') * 86400000000L + hour({ts}) * 3600000000L + minute({ts}) * 60000000L + cast(extract(second from {ts}) * 1000000 as bigint)")


def _once(clicks: DataFrame) -> DataFrame:
    """A row for each click_id: the one with the least time, kind and value (null last, null first, null first)."""
    order = Window.partitionBy("click_id").orderBy(F.col("t").asc_nulls_last(), "kind", "cents")
    cents = F.floor(F.col("value") * 100 + F.lit(0.5))
    sound = F.when(F.abs("value") * 100 < MOST_CENTS, cents)  # null for NaN, too, which is larger than any
    x = clicks.select("click_id", "kind", _micros("ts").alias("t"), sound.cast("long").alias("cents"))
    return x.withColumn("nth", F.row_number().over(order)).where("nth = 1 and t is not null").drop("nth")


def _small(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the least wide type."""
    fits = lambda kind: not x.size or (np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max)
    return x.astype(next(kind for kind in (np.int8, np.int16, np.int32, np.int64) if fits(kind)))


def pack(values: dict) -> bytes:
    """Names with arrays of whole numbers, or anything else; rising arrays go as steps."""
    out = {}
    for k, v in values.items():
        rises = isinstance(v, np.ndarray) and v.ndim == 1 and v.size > 1 and (v[1:] >= v[:-1]).all()
        out[k] = (int(v[0]), _small(np.diff(v))) if rises else _small(v) if isinstance(v, np.ndarray) else v
    return pickle.dumps(out, protocol=5)


def unpack(data: bytes) -> dict:
    out = {}
    for k, v in pickle.loads(data).items():
        wide = v.astype(np.int64) if isinstance(v, np.ndarray) else v
        out[k] = np.concatenate(([v[0]], v[0] + np.cumsum(v[1], dtype=np.int64))) if isinstance(v, tuple) else wide
    return out


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets and fields of a column of lists of structs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(column.type.value_type))
    off = column.offsets.to_numpy()
    inner = column.values
    fields = {f.name: inner.field(i).slice(off[0], off[-1] - off[0]) for i, f in enumerate(inner.type)}
    return off - off[0], fields


def _answer_cells(window: int) -> Callable:
    """Answers of whole cells; those of a batch are laid end to end and answered together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, f = _lists(b.column("points"))
            if not len(off) or off[-1] == 0:
                continue
            t, w = f["t"].to_numpy(), f["w"].to_numpy()
            cents, known = f["cents"].fill_null(0).to_numpy(zero_copy_only=False), f["cents"].is_valid().to_numpy(zero_copy_only=False)
            cell = b.column("cell").to_numpy()
            nth = np.repeat(np.arange(len(cell)), np.diff(off))
            own = t >= cell[nth] * window
            line = nth * (4 * window) + (t - cell[nth] * window)  # time, with the cells far apart
            order = np.argsort(line, kind="stable")
            e = order[known[order]]
            runs, at = Runs(cents[e], w[e]), line[e]
            q = np.unique(line[own])
            n, median2, mad4 = answer(runs, np.searchsorted(at, q - window), np.searchsorted(at, q, side="right"))
            of = (q + window) // (4 * window)
            yield _results(b.column("series").take(pa.array(of)), q - of * (4 * window) + cell[of] * window, n, median2, mad4)

    return run


def _results(series: pa.Array, t: np.ndarray, n: np.ndarray, median2: np.ndarray, mad4: np.ndarray) -> pa.RecordBatch:
    short = n < LEAST
    return pa.RecordBatch.from_arrays([series, pa.array(t), pa.array(n), pa.array(median2, mask=short), pa.array(mad4, mask=short)], names=["series", "t", "n", "median2", "mad4"])


RESULT = "series string, t long, n long, median2 long, mad4 long"


def medians(points: DataFrame, scratch: C.Scratch, window: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(series, t, n, median2, mad4) for each series and time of `points` (series, t, cents, w)."""
    span = F.expr(f"(t - pmod(t, {window})) div {window}")
    both = points.select("*", F.explode(F.array(span, span + 1)).alias("cell"))
    # a cell without times of its own has nothing to answer
    sizes = both.groupBy(*CELL).agg(F.count("*").alias("size"), F.max(F.col("cell") == span).alias("asked")).where("asked").drop("asked")
    sizes = scratch.store(sizes, "sizes", narrow=True)
    cold = both.join(sizes.where(F.col("size") <= shard_rows).select(*CELL), CELL)
    cold = cold.groupBy(*CELL).agg(F.collect_list(F.struct("t", "cents", "w")).alias("points"))
    out = cold.mapInArrow(_answer_cells(window), RESULT)
    hot = sizes.where(F.col("size") > shard_rows)
    if hot.isEmpty():
        return out
    return out.unionByName(hot_medians(both.join(hot, CELL), scratch, window, shard_rows))


# --- hot cells -----------------------------------------------------------------------------


def value_shards(known: DataFrame, shard_rows: int) -> DataFrame:
    """(series, cell, shard, points, lo, hi): each cell's points in ranges of their cents, about `shard_rows` in each.

    Ranges touch at most: a later shard has no lower value. Of a crowded value every shard
    between its cuts gets a part, so no shard is large for its sake.
    """
    most = known.groupBy(*CELL).count().agg(F.max("count")).first()[0] or 0
    grid = 1 << max(1, -(-most // shard_rows) - 1).bit_length() + 2
    spots = F.percentile_approx("cents", [i / grid for i in range(1, grid)], 20 * grid)
    cuts = known.groupBy(*CELL).agg(spots.alias("spots"), F.ceil(F.count("*") / shard_rows).alias("parts"))
    cuts = cuts.select(*CELL, F.expr(f"transform(sequence(1, cast(parts as int)), i -> case when i < parts then spots[cast(round(i * {grid} / parts) as int) - 1] end)").alias("cuts"))
    cuts = cuts.withColumn("cuts", F.expr("filter(cuts, x -> x is not null)"))
    # a value that several cuts hit is spread over the shards between them
    low, high = F.expr("size(filter(cuts, x -> x < cents))"), F.expr("size(filter(cuts, x -> x <= cents))")
    shards = known.join(cuts, CELL).withColumn("shard", low + F.pmod(F.xxhash64("t"), high - low + 1).cast("int")).drop("cuts")
    return shards.groupBy(*CELL, "shard").agg(F.collect_list(F.struct("t", "cents", "w")).alias("points"), F.min("cents").alias("lo"), F.max("cents").alias("hi"))


def hot_medians(rows: DataFrame, scratch: C.Scratch, window: int, shard_rows: int) -> DataFrame:
    """The same for cells cut into shards. rows: series, cell, size, t, cents, w.

    A state is one chunk of a cell's windows; a request goes to a shard, or to two of them, and
    its answer comes back to the chunk. State, requests and answers are numpy arrays as bytes.
    """
    rows = scratch.store(rows.drop("size"), "hot")
    known = rows.where("cents is not null")
    shards = scratch.store(value_shards(known, shard_rows), "shards")
    ranges = shards.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("shard", "lo", "hi"))).alias("ranges"))
    ranges = scratch.store(ranges, "ranges", narrow=True)

    asked = rows.where(F.col("t") >= F.col("cell") * window).select(*CELL, "t").distinct()
    chunks = asked.groupBy(*CELL).agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    asked = asked.join(chunks, CELL).withColumn("chunk", F.pmod(F.xxhash64("t"), F.col("chunks")).cast("int"))
    asked = asked.groupBy(*CELL, "chunk").agg(F.sort_array(F.collect_list("t")).alias("t"))
    state = asked.join(ranges, CELL, "left").mapInArrow(_begin, STATE)
    done, k = [], 0
    while True:
        state = scratch.store(state, f"state{k}")
        open_ = {r.open: r.n for r in state.groupBy((F.size("requests") > 0).alias("open")).agg(F.count("*").alias("n")).collect()}
        if False in open_:
            done.append(scratch.store(state.where("size(requests) = 0").select("series", "state").mapInArrow(_finish, RESULT), f"done{k}"))
        if True not in open_:
            break
        answers = scratch.store(_ask(state, shards, window), f"answers{k}")
        answers = answers.groupBy(*CELL, "chunk").agg(F.collect_list("body").alias("answers"))
        state = state.where("size(requests) > 0").drop("requests").join(answers, [*CELL, "chunk"]).mapInArrow(_step, STATE)
        k += 1
        if k > 1:
            scratch.drop(f"state{k - 2}")
            scratch.drop(f"answers{k - 2}")
    for name in ("hot", "shards"):
        scratch.drop(name)
    return reduce(DataFrame.unionByName, done)


STATE = "series string, cell long, chunk int, state binary, requests array<struct<shard: int, other: int, body: binary>>"
_STATE = pa.schema([("series", pa.string()), ("cell", pa.int64()), ("chunk", pa.int32()), ("state", pa.binary()), ("requests", pa.list_(pa.struct([("shard", pa.int32()), ("other", pa.int32()), ("body", pa.binary())])))])
#: In place of a second shard, or of none.
NO_SHARD = -1


def _ask(state: DataFrame, shards: DataFrame, window: int) -> DataFrame:
    """Each request with the points of its shards, answered."""
    each = state.select(*CELL, "chunk", F.explode("requests").alias("r")).select(*CELL, "chunk", "r.*")
    each = each.groupBy(*CELL, "shard", "other").agg(F.collect_list(F.struct("chunk", "body")).alias("asked"))
    points = shards.select(*CELL, "shard", "points")
    each = each.join(points, [*CELL, "shard"])
    points = points.select(*CELL, F.col("shard").alias("other"), F.col("points").alias("more"))
    each = each.join(points, [*CELL, "other"], "left")
    return each.select(*CELL, "shard", "other", "points", "more", "asked").mapInArrow(_reply(window), "series string, cell long, chunk int, body binary")


def _reply(window: int) -> Callable:
    def table(row: pa.RecordBatch, name: str, i: int) -> tuple[np.ndarray, Runs]:
        off, f = _lists(row.column(name).slice(i, 1))
        t, cents, w = (f[c].to_numpy() for c in ("t", "cents", "w"))
        order = np.argsort(t, kind="stable")
        return t[order], Runs(cents[order], w[order])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t, one = table(b, "points", i)
                u, two = table(b, "more", i) if b.column("other")[i].as_py() != NO_SHARD else (t, one)
                shard = b.column("shard")[i].as_py()
                chunks, bodies = [], []
                for x in b.column("asked")[i].as_py():
                    q = unpack(x["body"])
                    a = np.searchsorted(t, q["t"] - window), np.searchsorted(t, q["t"], side="right")
                    if q["what"] == "nearest":
                        c = np.searchsorted(u, q["t"] - window), np.searchsorted(u, q["t"], side="right")
                        value = _nearest(one, a, two, c, q)
                    else:
                        value = one.count(*a) if q["what"] == "count" else one.below(*a, q["arg"]) if q["what"] == "below" else one.ranked(*a, q["arg"])
                    chunks.append(x["chunk"])
                    bodies.append(pack({"shard": shard, "what": q["what"], "slot": q["slot"], "i": q["i"], "value": value}))
                n = len(chunks)
                yield pa.RecordBatch.from_arrays([pa.array([b.column("series")[i].as_py()] * n, pa.string()), pa.array([b.column("cell")[i].as_py()] * n, pa.int64()), pa.array(chunks, pa.int32()), pa.array(bodies, pa.binary())], names=["series", "cell", "chunk", "body"])

    return run


def _nearest(low: Runs, a: tuple, high: Runs, c: tuple, q: dict) -> np.ndarray:
    """The distance of rank k strictly between `near` and `far` from the median, `far` where there are fewer.

    Points under the median come from `low`, the others from `high`; q["sides"] has bit 0 where
    `low` counts and bit 1 where `high` does.
    """
    m, near, far = q["middle"], q["near"], q["far"]
    first = high.below(*c, (m + near) // 2 + 1)
    n_up = np.where(q["sides"] & 2, np.maximum(0, high.below(*c, ceil_half(m + far)) - first), 0)
    last = low.below(*a, ceil_half(m - np.maximum(near, 0)))
    n_down = np.where(q["sides"] & 1, np.maximum(0, last - low.below(*a, (m - far) // 2 + 1)), 0)
    up = lambda i: 2 * high.ranked(*c, first + i) - m
    down = lambda i: m - 2 * low.ranked(*a, last - 1 - i)
    value, _ = two_sided(up, down, n_up, n_down, q["k"])
    return np.where(q["k"] < n_up + n_down, value, far)


# What a chunk knows: t, and of each shard id, lo and hi; then counts (shard x window), n, on (the
# windows with enough values), middle; for the two middle ranks (2 x on): rank, L, H (bracketing
# distances by number), reach (values within the distance L), and at last mad (2 x on).


def _rows(batches: Iterable[pa.RecordBatch], make: Callable) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            state, requests = make(r)
            yield pa.RecordBatch.from_pylist([{"series": r["series"], "cell": r["cell"], "chunk": r["chunk"], "state": pack(state), "requests": requests}], schema=_STATE)


def _request(s: dict, what: str, shard: int, i: np.ndarray, other: int = NO_SHARD, slot: str = "", **more) -> dict:
    """i: numbers of windows that have enough values, or of all windows (count)."""
    t = s["t"] if what == "count" else s["t"][s["on"]][i % max(1, len(s["on"]))]
    return {"shard": int(shard), "other": int(other), "body": pack({"what": what, "slot": slot, "i": i, "t": t} | more)}


def _begin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def make(r: dict) -> tuple[dict, list]:
        ranges = r["ranges"] or []
        s = {"t": np.array(r["t"], np.int64), "n": np.zeros(len(r["t"]), np.int64), "on": np.zeros(0, np.int64)} | {k: np.array([x[k] for x in ranges], np.int64) for k in ("shard", "lo", "hi")}
        return s, [_request(s, "count", k, np.arange(len(s["t"]))) for k in s["shard"]]

    return _rows(batches, make)


def _ranks(s: dict) -> list[dict]:
    """Asks the shards of the two middle ranks for their values."""
    cum = np.cumsum(s["counts"][:, s["on"]], axis=0)
    out, n = [], s["n"][s["on"]]
    for slot, k, wanted in (("0", (n - 1) // 2, n > 0), ("1", n // 2, n % 2 == 0)):
        of = (cum <= k).sum(axis=0)
        before = np.where(of > 0, np.take_along_axis(cum, np.maximum(of - 1, 0)[None], axis=0)[0], 0)
        out += [_request(s, "ranked", s["shard"][j], i, slot=slot, arg=(k - before)[i]) for j in np.unique(of) if len(i := np.flatnonzero(wanted & (of == j)))]
    return out


def _distances(s: dict) -> np.ndarray:
    """Sorted distances (place x window) of the shards' least and largest values from the doubled median."""
    ends = np.unique(np.concatenate((s["lo"], s["hi"])))
    return np.sort(np.abs(2 * ends[:, None] - s["middle"][None, :]), axis=0)


def _known_below(s: dict, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values under `value` (rank x window): the number in shards that lie below as a whole, and the shard with some more or NO_SHARD."""
    counts = s["counts"][:, s["on"]]
    cum = np.concatenate((np.zeros((1, counts.shape[1]), np.int64), np.cumsum(counts, axis=0)))
    whole = np.searchsorted(s["hi"], value)  # shards whose largest value is less
    sure = np.take_along_axis(cum, whole, axis=0)
    part = np.minimum(whole, len(s["hi"]) - 1)
    return sure, np.where((whole < len(s["hi"])) & (s["lo"][part] < value), part, NO_SHARD)


def _reach(s: dict) -> list[dict]:
    """Asks how many values lie within the middle distance of each bracket; what shards report as a whole is noted."""
    d = _distances(s)
    mid = s["L"] + s["H"] >> 1
    x = np.take_along_axis(d, np.maximum(mid, 0), axis=0)
    s["within"], out = np.zeros_like(mid), []
    for sign, bound in ((1, (s["middle"] + x) // 2 + 1), (-1, ceil_half(s["middle"] - x))):
        sure, part = _known_below(s, bound)
        s["within"] += sign * sure
        part = np.where(s["H"] - s["L"] > 1, part, NO_SHARD).ravel()
        out += [_request(s, "below", s["shard"][j], i, slot="+" if sign > 0 else "-", arg=bound.ravel()[i]) for j in np.unique(part) if j != NO_SHARD and len(i := np.flatnonzero(part == j))]
    return out


def _narrow(s: dict) -> None:
    mid = s["L"] + s["H"] >> 1
    open_ = s["H"] - s["L"] > 1
    less = open_ & (s["within"] <= s["rank"])
    s["reach"] = np.where(less, s["within"], s["reach"])
    s["L"], s["H"] = np.where(less, mid, s["L"]), np.where(open_ & ~less, mid, s["H"])


def _last(s: dict) -> list[dict]:
    """Asks for the distances strictly within the brackets; two shards at most have any."""
    d, lo, hi, m = _distances(s), 2 * s["lo"], 2 * s["hi"], s["middle"]
    near = np.where(s["L"] >= 0, np.take_along_axis(d, np.maximum(s["L"], 0), axis=0), -1)
    far = np.take_along_axis(d, s["H"], axis=0)
    s["mad"] = far
    up = np.searchsorted(lo, m + near, side="right") - 1
    up = np.where((up >= 0) & (hi[np.maximum(up, 0)] >= m + far), up, NO_SHARD)
    down = np.searchsorted(hi, m - np.maximum(near, 0))
    down = np.where((down < len(hi)) & (lo[np.minimum(down, len(hi) - 1)] <= m - far), down, NO_SHARD)
    empty = far - near <= 1
    empty[1, s["n"][s["on"]] % 2 == 1] = True
    up, down = (np.where(empty, NO_SHARD, x).ravel() for x in (up, down))
    pair, out = (down + 1) * (len(lo) + 1) + up + 1, []
    middle = np.broadcast_to(m, far.shape).ravel()
    for p in np.unique(pair[pair > 0]):
        i = np.flatnonzero(pair == p)
        a, c = int(p) // (len(lo) + 1) - 1, int(p) % (len(lo) + 1) - 1
        sides = (a != NO_SHARD) + 2 * (c != NO_SHARD)
        a, c = a if a != NO_SHARD else c, c if c != NO_SHARD else a
        more = {"middle": middle[i], "near": near.ravel()[i], "far": far.ravel()[i], "k": (s["rank"] - s["reach"]).ravel()[i], "sides": sides}
        out.append(_request(s, "nearest", s["shard"][a], i, other=s["shard"][c] if c != a else NO_SHARD, **more))
    return out


def _step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def make(r: dict) -> tuple[dict, list]:
        s, got = unpack(r["state"]), [unpack(x) for x in r["answers"]]
        what = got[0]["what"]
        if what == "count":
            s["counts"] = np.zeros((len(s["shard"]), len(s["t"])), np.int64)
            for x in got:
                s["counts"][np.searchsorted(s["shard"], x["shard"])] = x["value"]
            s["n"] = s["counts"].sum(axis=0)
            s["on"] = np.flatnonzero(s["n"] >= LEAST)
            return s, _ranks(s)
        if what == "ranked":
            s["middle"] = np.zeros(len(s["on"]), np.int64)
            n = s["n"][s["on"]]
            for x in got:
                s["middle"][x["i"]] += x["value"] * np.where(n[x["i"]] % 2, 2, 1)
            s["rank"] = np.stack(((n - 1) // 2, n // 2))
            s["L"], s["reach"] = np.full_like(s["rank"], -1), np.zeros_like(s["rank"])
            s["H"] = np.full_like(s["rank"], len(_distances(s)) - 1)
            s["H"][1, n % 2 == 1] = 0  # one middle rank, not two
        elif what == "below":
            flat = s["within"].ravel()
            for x in got:
                flat[x["i"]] += x["value"] if x["slot"] == "+" else -x["value"]
            s["within"] = flat.reshape(s["L"].shape)
            _narrow(s)
        elif what == "nearest":
            flat = s["mad"].ravel()
            for x in got:
                flat[x["i"]] = x["value"]
            s["mad"] = flat.reshape(s["L"].shape)
            return s, []
        while (s["H"] - s["L"] > 1).any():
            if asked := _reach(s):
                return s, asked
            _narrow(s)  # whole shards said it all
        return s, _last(s)

    return _rows(batches, make)


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            s = unpack(r["state"])
            median2, mad4 = np.zeros(len(s["t"]), np.int64), np.zeros(len(s["t"]), np.int64)
            if len(s["on"]):
                one, two = s["mad"]
                median2[s["on"]], mad4[s["on"]] = s["middle"], one + np.where(s["n"][s["on"]] % 2, one, two)
            yield _results(pa.array([r["series"]] * len(s["t"]), pa.string()), s["t"], s["n"], median2, mad4)


# --- the operator --------------------------------------------------------------------------


def rolling_medians(clicks: DataFrame, minutes: int = 360, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each click_id with a time: click_id, kind, t (microseconds), cents, n, median2, mad4, far.

    clicks: click_id, ts, kind, value. A click's window holds the cents of its kind's clicks from
    `minutes` before it up to it, both ends included. n counts them; median2 is the sum of the
    two middle ones, or twice the middle one; mad4 the same of |2 * cents - median2|; far says
    whether the click's own cents lie further than 2.5 such deviations from the median. The last
    three are null under LEAST values, far also without own cents.

    A click_id that repeats counts once, with the row of the least time, kind and value, a null
    time last; null is one click_id and one kind. A null value has no cents, nor has one that is
    not finite or has MOST_CENTS or more. Ties in time share a window. An empty table gives an
    empty table. Other columns are not read.
    """
    spark = clicks.sparkSession
    C.tune(spark)
    scratch = C.Scratch(spark, "medians")
    key = F.coalesce(F.concat(F.lit("a"), "kind"), F.lit("z")).alias("series")
    x = scratch.store(_once(clicks).select("click_id", "kind", key, "t", "cents"), "clicks")
    points = scratch.store(x.groupBy("series", "t", "cents").agg(F.count("*").alias("w")), "points")
    found = scratch.store(medians(points, scratch, minutes * MINUTE, shard_rows), "medians")
    scratch.drop("points")
    off = F.abs(2 * F.col("cents") - F.col("median2"))
    return x.join(found, ["series", "t"]).select("click_id", "kind", "t", "cents", "n", "median2", "mad4", (2 * off > 5 * F.col("mad4")).alias("far"))


def oracle(minutes: int = 360) -> str:
    """DuckDB SQL of the same, a list a window."""
    middle = lambda v: f"{v}[(len({v}) + 1) // 2] + {v}[len({v}) // 2 + 1]"
    return f"""WITH c AS (SELECT click_id, kind, epoch_us(ts) t, CASE WHEN abs(value) * 100 < {MOST_CENTS} THEN CAST(floor(100 * value + 0.5) AS BIGINT) END cents FROM clicks),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY t NULLS LAST, kind NULLS FIRST, cents NULLS FIRST) = 1 AND t IS NOT NULL),
w AS (SELECT *, list_sort(coalesce(list(cents) FILTER (WHERE cents IS NOT NULL) OVER (PARTITION BY kind ORDER BY t RANGE BETWEEN {minutes * MINUTE} PRECEDING AND CURRENT ROW), [])) v FROM d),
m AS (SELECT *, CAST(len(v) AS BIGINT) n, CASE WHEN len(v) >= {LEAST} THEN {middle('v')} END median2 FROM w),
a AS (SELECT *, list_sort(list_transform(v, lambda x: abs(2 * x - median2))) s FROM m)
SELECT click_id, kind, n, median2, mad4, 2 * abs(2 * cents - median2) > 5 * mad4 AS far FROM (SELECT *, CASE WHEN n >= {LEAST} THEN {middle('s')} END mad4 FROM a)"""
