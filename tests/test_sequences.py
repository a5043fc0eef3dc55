"""Window positions, the recurrent network, encodings, and the plan of the end-to-end queries."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.operators import demand, models, network, sequences
from granary.plans import catalogue, forecast

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, b, s, DAY + dt.timedelta(days=k), float(k)) for i, b, s, k in rows], "item string, branch string, segment_id int, dt date, qty double")


def test_index_and_ends(spark):
    rows = [(i, b, s, 20 * s + k) for i in "zab" for b in "yx" for s in (2, 1) for k in range(9)]
    index = sequences.build_index(frame(spark, rows).repartition(5), ["qty"], "target", 4)
    got = sorted((r.row, r.item, r.branch, r.segment_id, r.dt, r.segment_code, r.position) for r in index.collect())
    want = sorted((i, b, s, DAY + dt.timedelta(days=k)) for i, b, s, k in rows)
    codes = {k: n for n, k in enumerate(sorted({w[:3] for w in want}))}
    assert [g[0] for g in got] == list(range(len(want))) and [g[1:5] for g in got] == want
    assert all(g[5] == codes[g[1:4]] and g[6] == n % 9 for n, g in enumerate(got))
    some = index.where("item = 'a'").select("item", "branch", "segment_id", "dt")
    assert {r.window_end for r in sequences.window_ends(index, some).collect()} == {g[0] for g in got if g[1] == "a"}
    with pytest.raises(Exception, match="not in the panel"):
        sequences.window_ends(index, frame(spark, [("q", "y", 1, 3)]).drop("qty")).collect()
    with pytest.raises(ValueError, match="step_is_one_day"):
        sequences.build_index(frame(spark, [("a", "y", 1, 0), ("a", "y", 1, 2)]), ["qty"])
    with pytest.raises(ValueError, match="feature"):
        sequences.build_index(frame(spark, rows), ["qty", "target"], "target")
    assert sequences.split_columns(["a", "b_idx", "c"]) == (["a", "c"], ["b_idx"])


def test_gradients_of_the_network():
    r = np.random.default_rng(0)
    x, cats, y = r.normal(size=(6, 4, 3)), r.integers(0, 3, (6, 1)), r.normal(size=6) * 3
    for layers in (1, 2):
        net = network.Network(3, [(3, 2)], 5, layers)
        out, kept = net.forward(x, cats)
        g = net.backward(np.where(y >= out, -0.9, 0.1) / 6, kept)
        for name, w in net.w.items():
            for at in list(np.ndindex(w.shape))[:: max(1, w.size // 7)]:
                old, losses = w[at], []
                for e in (1e-6, -1e-6):
                    w[at] = old + e
                    losses.append(network.pinball_loss(net.forward(x, cats)[0], y))
                w[at] = old
                assert abs((losses[0] - losses[1]) / 2e-6 - g[name][at]) < 1e-5, (layers, name)


def test_loss_falls_and_early_stopping_counts_epochs():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 6, 2))
    cats, y = r.integers(0, 2, (600, 1)), 3 * x[:, -1, 0] + r.normal(size=600)
    p = {"hidden_size": 8, "learning_rate": 0.01, "batch_size": 64, "dropout": 0.0}
    net = network.Network(2, [(2, 1)], 8)
    first, adam = network.pinball_loss(net.predict(lambda i: x[i], cats), y), network.Adam(net.w, 0.01)
    for _ in range(30):
        network.run_epoch(net, adam, lambda i: x[i], cats, y, p["batch_size"], 1.0, 0.9, r)
    assert network.pinball_loss(net.predict(lambda i: x[i], cats), y) < 0.6 * first
    with pytest.raises(ValueError, match="finite"):
        network.run_epoch(net, adam, lambda i: x[i], cats, np.full(600, np.inf), 64, 1.0, 0.9, r)


def moving(spark, pairs=6, days=70):
    r = np.random.default_rng(5)
    rows = [(f"i{k}", "b", 1, DAY + dt.timedelta(days=d), float(r.integers(0, 9)), k % 3) for k in range(pairs) for d in range(days)]
    return spark.createDataFrame(rows, "item string, branch string, segment_id int, dt date, qty double, b_idx int")


def test_fitted_where_the_windows_lie(spark):
    x = moving(spark).withColumns({"y": F.col("qty") * 3 + 1, "lead": F.lit(1)})
    packed, parts = network._parted(sequences.pack_segments(x, ["qty", "b_idx", "y", "lead"]).repartition(3, "item"), 10)
    assert parts == {network.REST, network.EARLY, network.TAIL}
    packed = catalogue.cut(packed)
    p = network.DEFAULTS | {"hidden_size": 8, "learning_rate": 0.02, "batch_size": 32, "dropout": 0.0}
    make = lambda: network.Spread(packed, ["qty"], ["b_idx"], [(3, 2)], 5, (np.array([4.0]), np.array([2.6])), p, 0.9)
    one, two = make(), make()
    before = one.loss((network.TAIL,))
    best = one.fit((network.EARLY,), 12, (network.TAIL,), 3)
    assert 1 <= best <= 12 and one.loss((network.TAIL,)) < 0.5 * before
    two.fit((network.EARLY,), 2)
    again = make()
    again.fit((network.EARLY,), 2)
    assert all(np.array_equal(two.net.w[k], again.net.w[k]) for k in two.net.w)


def test_averaged_weights_are_those_of_the_tasks(spark):
    x = moving(spark, 4, 40).withColumns({"y": F.col("qty"), "lead": F.lit(0)})
    packed = catalogue.cut(network._parted(sequences.pack_segments(x, ["qty", "b_idx", "y", "lead"]), 5)[0].coalesce(1))
    p = network.DEFAULTS | {"hidden_size": 4, "batch_size": 16, "dropout": 0.0}
    whole = network.Spread(packed, ["qty"], ["b_idx"], [(3, 2)], 5, (np.zeros(1), np.ones(1)), p, 0.9)
    whole.epoch((0, 1, 2), 1)
    halves = [packed.where("item < 'i2'"), packed.where("item >= 'i2'")]
    own = [network.Spread(h, ["qty"], ["b_idx"], [(3, 2)], 5, (np.zeros(1), np.ones(1)), p, 0.9) for h in halves]
    both = network.Spread(catalogue.cut(halves[0]).union(catalogue.cut(halves[1])), ["qty"], ["b_idx"], [(3, 2)], 5, (np.zeros(1), np.ones(1)), p, 0.9)
    for s in (*own, both):
        s.epoch((0, 1, 2), 1)
    assert all(np.allclose(both.net.w[k], (own[0].net.w[k] + own[1].net.w[k]) / 2) for k in both.net.w)
    assert any(not np.allclose(both.net.w[k], whole.net.w[k]) for k in both.net.w)


def test_windows_are_views_of_a_table_stored_once(spark, tmp_path):
    x = moving(spark, 9, 200).withColumns({f"f{k}": F.col("qty") * k + F.rand(k) for k in range(20)})
    features = [f"f{k}" for k in range(20)]
    x.write.parquet(str(tmp_path / "panel"))
    sequences.pack_segments(x, features).write.parquet(str(tmp_path / "packed"))
    size = lambda name: sum(p.stat().st_size for p in (tmp_path / name).glob("*.parquet"))
    assert size("packed") < 2 * size("panel")
    batch = pa.RecordBatch.from_pydict({"days": [[{"dt": d, "q": float(10 * s + d)} for d in range(4 - s)] for s in range(4)]})
    flat, ends, rows, segment = sequences.flat_windows(batch, ["q"], 3)
    assert segment.tolist() == [0, 0, 1] and rows.field(0).to_pylist() == [2, 3, 2]
    assert sequences.window_views(flat, ends, 3)[..., 0].tolist() == [[0, 1, 2], [1, 2, 3], [10, 11, 12]]
    sliced = batch.slice(1, 2)
    flat, ends, _, segment = sequences.flat_windows(sliced, ["q"], 3)
    assert segment.tolist() == [0] and sequences.window_views(flat, ends, 3)[..., 0].tolist() == [[10, 11, 12]]


def test_bound_windows_reach_over_the_panel(spark):
    p = frame(spark, [("a", "x", 1, k) for k in range(60)]).withColumns({"branch_idx": F.lit(1), "target": F.col("qty") % 5, "lead_time_days": F.lit(1)})
    make = lambda dynamic, cats: network.recurrent_quantiles(dynamic, cats, [(2, 1)], 7, epochs=2, hidden_size=4, tail_days=5)
    bound = sequences.bind_panel(p, ["qty", "branch_idx"], "target", make, lookback=7)
    assert bound(p.where("qty >= 10 and qty < 50"), p.where("qty >= 50")).where("prediction >= 0").count() == 10
    with pytest.raises(ValueError, match="window"):
        bound(p.where("qty >= 10"), p.where("qty < 3"))


def test_encodings_follow_training(spark):
    train = spark.createDataFrame([(1, 3), (2, 1), (3, 3)], "k int, c_idx int")
    other = spark.createDataFrame([(4, 3), (5, 0), (6, 1), (7, 9)], "k int, c_idx int")
    _, b, names = models.encoded(train, other, ["k", "c_idx"], "native")
    assert names == ["k", "c_idx_code"] and {r.k: r.c_idx_code for r in b.collect()} == {4: 1, 5: -1, 6: 0, 7: -1}
    _, b, names = models.encoded(train, other, ["k", "c_idx"], "one_hot")
    assert names == ["k", "c_idx_1", "c_idx_3"] and {r.k: (r.c_idx_1, r.c_idx_3) for r in b.collect()} == {4: (0, 1), 5: (0, 0), 6: (1, 0), 7: (0, 0)}
    assert models.encoded(train, other, ["c_idx"], "ordinal")[2] == ["c_idx"]
    with pytest.raises(ValueError):
        models.encoded(train, other, ["c_idx"], "hashed")
    assert demand.training_levels(train, ["c_idx"]).count() == 2


@pytest.mark.parametrize("name", ["e1_featured", "e2_model_input"])
def test_plans_read_the_panel_once(spark, name):
    query = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution()
    assert query.sparkPlan().toString().count("lineitem") == 0  # the panel is a written table
    plan = query.executedPlan().toString()
    assert plan.count("SortMergeJoin") == 0 and plan.count("Exchange hashpartitioning") <= 12


def test_clean_runs_in_row_order(spark):
    rows = [(0, "xxx.FGS-1", "xxx. Teh", "Minuman", "B1", 2.0), (1, "FGS-1", "Teh", "Minuman - FG", "B1", 3.0), (2, "FGS.2", "Kopi", "Z", "B2", 1.0), (3, "FGS-2", "Kopi", "A", "B2", 1.0), (4, "FGS-3", "Gone", "A", "B3", 1.0)]
    raw = spark.createDataFrame(rows, "ord int, item string, item_name string, category string, branch string, qty double").withColumns({"unit": F.lit("Porsi"), "dt": F.lit("2024-01-01").cast("date")})
    got = {(r.item, r.branch): (r.qty, r.item_name, r.category) for r in forecast.clean(raw, excluded_branches=["B3"]).collect()}
    assert got == {("FGS-1", "B1"): (5.0, "Teh", "Minuman - FG"), ("FGS-2", "B2"): (2.0, "Kopi", "Z")}
