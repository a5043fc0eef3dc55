"""op12 against sorted lists of each window, and awkward rows."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import rolling_median as R

START = datetime(2024, 3, 31, 0, 30)


def middle2(v):
    v = sorted(v)
    return v[(len(v) - 1) // 2] + v[len(v) // 2]


def plain(rows, minutes=360):
    """click_id -> (kind, n, median2, mad4, far) of (click_id, ts, kind, value) rows without repeats."""
    cents = lambda v: None if v is None or not math.isfinite(v) or abs(v) * 100 >= R.MOST_CENTS else math.floor(100 * v + 0.5)
    out = {}
    for i, ts, kind, value in rows:
        if ts is None:
            continue
        window = [c for _, t, k, v in rows if t is not None and k == kind and ts - timedelta(minutes=minutes) <= t <= ts and (c := cents(v)) is not None]
        if len(window) < 5:
            out[i] = (kind, len(window), None, None, None)
            continue
        m = middle2(window)
        mad, c = middle2([abs(2 * x - m) for x in window]), cents(value)
        out[i] = (kind, len(window), m, mad, None if c is None else 2 * abs(2 * c - m) > 5 * mad)
    return out


def made(seed, n, values, kinds=("view", "click", None, "")):
    rng, rows = random.Random(seed), []
    for i in range(n):
        ts = START + timedelta(microseconds=rng.choice([rng.randrange(2 * 86_400_000_000), 360 * 60_000_000 * rng.randrange(8), 77]))
        rows.append((i, None if rng.random() < 0.03 else ts, rng.choices(kinds, [8, 2, 1, 1])[0], None if rng.random() < 0.1 else values(rng)))
    return rows


SPREADS = {
    "even": lambda r: r.randrange(-5000, 50_000) / 100,
    "hot": lambda r: r.choice([9.99, 9.99, 9.99, 10.0, r.random() * 20]),
    "alike": lambda r: 5.0,
    "heavy": lambda r: (1 if r.random() < 0.5 else -1) * math.exp(r.random() * 20),
    "odd": lambda r: r.choice([float("nan"), float("inf"), -float("inf"), 1e300, -0.005, 0.005, 1.005]),
}


@pytest.mark.parametrize("shard_rows", [R.SHARD_ROWS, 12])
def test_medians(spark, shard_rows):
    rows = [(1000 * k + i, ts, None if kind is None else f"{kind}{name}", v) for k, name in enumerate(SPREADS) for i, ts, kind, v in made(k, 130, SPREADS[name], kinds=(name, "view", "", name))]
    rows += [(9000 + i, ts, None, v) for i, ts, _, v in made(7, 100, SPREADS["hot"])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "click_id long, ts timestamp_ntz, kind string, value double, n int").repartition(3)
    got = {r.click_id: (r.kind, r.n, r.median2, r.mad4, r.far) for r in R.rolling_medians(frame, shard_rows=shard_rows).collect()}
    assert got == plain(rows)


def test_repeats_nulls_and_empty_tables(spark):
    rows = made(1, 60, SPREADS["even"], kinds=("view",) * 4)
    schema = "click_id long, ts timestamp_ntz, kind string, value double"
    late = [(*r[:1], r[1] and r[1] + timedelta(hours=1), *r[2:]) for r in rows[:10] if r[1]]
    frame = spark.createDataFrame([*rows, *rows[:20], *late, (None, START, "view", 3.0), (None, START, "view", 3.0)], schema)
    expected = plain([*rows, (None, START, "view", 3.0)])
    found = R.rolling_medians(frame).collect()
    assert {r.click_id: (r.kind, r.n, r.median2, r.mad4, r.far) for r in found} == expected and len(found) == len(expected)
    assert R.rolling_medians(frame.limit(0)).count() == 0
    assert R.rolling_medians(frame.where("value is null")).where("n <> 0 or median2 is not null or far is not null").count() == 0


def test_hot_cell_without_any_value(spark):
    rows = [(i, START + timedelta(seconds=i), "view", None) for i in range(60)]
    frame = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, kind string, value double")
    found = R.rolling_medians(frame, shard_rows=8).collect()
    assert len(found) == 60 and all(r.n == 0 and r.median2 is None for r in found)


def test_one_hot_value_is_spread_over_shards(spark):
    rows = [("aview", 1, i, 999 if i % 3 else i, 1) for i in range(3000)]
    points = spark.createDataFrame(rows, "series string, cell long, t long, cents long, w long")
    shards = sorted(R.value_shards(points, 200).collect(), key=lambda r: r.shard)
    assert sum(len(r.points) for r in shards) == 3000 and max(len(r.points) for r in shards) <= 400
    assert all(a.hi <= b.lo for a, b in zip(shards, shards[1:], strict=False))
    assert sum(r.lo == r.hi == 999 for r in shards) > 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(1 << 54), 1 << 54), max_size=9))
def test_packed_arrays_come_back(values):
    x = np.array(values, np.int64)
    y = R.unpack(R.pack({"x": x, "sorted": np.sort(x), "grid": np.stack((x, x)), "name": "n"}))
    assert (y["x"] == x).all() and (y["sorted"] == np.sort(x)).all() and (y["grid"] == x).all() and y["name"] == "n"
    assert y["x"].dtype == y["sorted"].dtype == np.int64


runs = st.lists(st.tuples(st.integers(-50, 50), st.integers(1, 4)), min_size=1, max_size=40)


@settings(max_examples=60, deadline=None)
@given(runs, st.data())
def test_runs(pairs, data):
    values, weights = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    table = R.Runs(values, weights)
    a = data.draw(st.integers(0, len(values)))
    b = data.draw(st.integers(a, len(values)))
    flat = sorted(np.repeat(values[a:b], weights[a:b]).tolist())
    left, right = np.array([a]), np.array([b])
    assert table.count(left, right)[0] == len(flat)
    for v in (-51, -3, 0, 7, 51):
        assert table.below(left, right, np.array([v]))[0] == sum(x < v for x in flat)
    for k in range(len(flat)):
        assert table.ranked(left, right, np.array([k]))[0] == flat[k]
    if len(flat) >= R.LEAST:
        n, median2, mad4 = R.answer(table, left, right)
        assert (n[0], median2[0], mad4[0]) == (len(flat), middle2(flat), middle2([abs(2 * x - median2[0]) for x in flat]))
