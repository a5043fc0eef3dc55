"""The maintained daily table against `daily` over the rows that hold in the end."""

import datetime as dt
import random

import pytest

from granary.operators.panel import daily
from granary.streaming.daily import DailyTable

SCHEMA = "row_id long, version long, removed boolean, item string, branch string, dt date, qty double, ord long, category string"


def feed(seed=5, n=400):
    """Rows, their corrections, removals and repeats, in any order."""
    r, out = random.Random(seed), []
    for i in range(n):
        key = (r.choice(["a", "b", None, "c"]), r.choice(["x", "y"]), dt.date(2024, 1, r.randint(1, 9)) if r.random() < 0.97 else None)
        for v in range(r.choice((1, 1, 1, 2, 3))):
            value = (r.choice((None, 1.0, 2.5, 7.0)), r.choice((i, -i)), r.choice((None, "k1", "k2")))
            out.append((i, v, r.choice((False, False, None, True)) if v else False, *key, *value))
    out += r.choices(out, k=60) + [(None, None, None, "a", "x", dt.date(2024, 1, 3), 1.0, 10**6, "k3")] * 2
    r.shuffle(out)
    return out


def plain(rows):
    """(item, branch, day): sum and first category by ord, of the rows that hold."""
    held = {}
    for n, (i, v, gone, *key, q, o, c) in enumerate(rows):
        if None not in key:
            k = (i if i is not None else f"row {n}", *key)
            rank = (-1 if v is None else v, gone is not None, bool(gone), c is not None, c or "", o, q is not None, q or 0)
            if k not in held or rank > held[k][0]:
                held[k] = (rank, gone, q, o, c)
    out = {}
    for (_, *key), (_, gone, q, o, c) in held.items():
        if not gone:
            out.setdefault(tuple(key), []).append((q, o, c))
    return {k: (sum(q or 0 for q, _, _ in x), min(((o, c) for _, o, c in x if c is not None), default=(0, None))[1]) for k, x in out.items()}


def found(table):
    rows = table.read().collect()
    assert len({(r.item, r.branch, r.dt) for r in rows}) == len(rows)
    return {(r.item, r.branch, r.dt): (r.qty, r.category) for r in rows}


@pytest.fixture
def table(spark, tmp_path):
    return DailyTable(spark, f"file://{tmp_path}/table", SCHEMA, order="ord")


def test_stream_ends_as_the_batch_does(spark, tmp_path, table):
    rows = feed()
    for k in range(5):  # five files, the last two after a restart
        if k == 3:
            follow(spark, tmp_path, table)
            assert found(table) == plain(rows[:240])
        spark.createDataFrame(rows[80 * k : 80 * k + 80] if k < 4 else rows[320:], SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    follow(spark, tmp_path, table)
    want = plain(rows)
    assert found(table) == want
    # and as the operator over the rows that hold
    from granary.streaming.daily import latest

    batch = daily(latest(spark.createDataFrame(rows, SCHEMA)), "ord").collect()
    assert {(r.item, r.branch, r.dt): (r.qty, r.category) for r in batch} == want
    follow(spark, tmp_path, table)  # nothing new
    assert found(table) == want


def follow(spark, tmp_path, table):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    table.follow(stream, f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def test_batches_again_and_compacted(spark, table):
    rows = feed(6, 200)
    parts = [rows[k::3] for k in range(3)]
    for k, part in enumerate(parts):
        table.merge(spark.createDataFrame(part, SCHEMA), k)
        table.merge(spark.createDataFrame(part, SCHEMA), k)  # the run that failed before it was noted
        if k == 1:
            table.compact(0)
            assert found(table) == plain(parts[0] + parts[1])
    assert found(table) == plain(rows)
    table.compact(1)
    table.compact(1)
    # a row that holds is still corrected after that
    more = [(i, 9, True, *key, None, 0, None) for i, _, _, *key, _, _, _ in parts[0] if i is not None and None not in key]
    table.merge(spark.createDataFrame(more, SCHEMA), 3)
    assert found(table) == plain(rows + more)


def test_a_day_loses_its_last_row_and_moves(spark, table):
    day = lambda k: dt.date(2024, 2, k)
    table.merge(spark.createDataFrame([(1, 0, False, "i", "b", day(1), 5.0, 1, "c")], SCHEMA), 0)
    table.merge(spark.createDataFrame([(1, 1, True, "i", "b", day(1), None, 1, None), (1, 1, False, "i", "b", day(4), 5.0, 1, "c")], SCHEMA), 1)
    assert found(table) == {("i", "b", day(4)): (5.0, "c")}
    table.merge(spark.createDataFrame([(1, 2, True, "i", "b", day(4), None, 1, None)], SCHEMA), 2)
    assert found(table) == {}


def test_batches_without_rows(spark, table):
    table.merge(spark.createDataFrame([], SCHEMA), 0)
    table.merge(spark.createDataFrame([(1, 0, False, None, "b", dt.date(2024, 1, 1), 1.0, 1, None)], SCHEMA), 1)
    table.merge(spark.createDataFrame([(2, 0, False, "i", "b", dt.date(2024, 1, 1), 1.0, 1, None)], SCHEMA), 2)
    assert found(table) == {("i", "b", dt.date(2024, 1, 1)): (1.0, None)}
