"""Boosting on binned features: sampling, cuts, growth against a plain search, early stopping, stored copies."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import boosting as B
from granary.operators import models
from granary.plans import catalogue, forecast
from granary.sources import lineage


def frame(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a, b, c = rng.randrange(20), rng.random(), rng.choice([0.0, 1.0])
        rows.append((k, float(a), b if k % 50 else None, c, 10 * (a > 7) * (1 + c) + b))
    return spark.createDataFrame(rows, "k long, a double, b double, c double, y double")


def fitted(spark, x, s, features=("a", "b", "c")):
    return B.boost(x, None, list(features), F.col("y"), F.xxhash64("k"), s)


@pytest.mark.parametrize("share", [0.3, 0.7, 0.95])
def test_shares_of_rows_do_not_hang_on_their_values(spark, share):
    h = spark.range(40_000).select(F.xxhash64("id").alias("h")).toPandas()["h"].to_numpy()
    for seed in (0, 7, 2**40):
        assert abs(B.drawn(h, share, seed).mean() - share) < 0.01
    assert abs((B.drawn(h, share, 1) & B.drawn(h, share, 2)).mean() - share**2) < 0.015
    assert B.drawn(h, 1.0, 5).all()


def test_all_candidates_can_be_drawn():
    assert models.space_size(models.BOOST_SPACE) == 2_592 and set(models.BOOST_DEFAULTS) == set(models.BOOST_SPACE)


def plain_first_cut(rows, base, s):
    """(feature, threshold's left values, gain) of the root by trying all cuts."""
    best = (-1.0,)
    g = np.array([s.quantile - (r["y"] < base) for r in rows])
    score = lambda m: g[m].sum() ** 2 / (m.sum() + s.l2)
    for i, c in enumerate("abc"):
        v = np.array([-np.inf if r[c] is None else r[c] for r in rows])
        for t in sorted(set(v)):
            left = v <= t
            if min(left.sum(), (~left).sum()) >= s.min_leaf:
                gain = score(left) + score(~left) - score(np.ones(len(v), bool))
                if gain > best[0] + 1e-9:
                    best = (gain, i, left)
    return best


@pytest.mark.parametrize("l2,min_leaf", [(0.0, 5), (25.0, 40)])
def test_a_tree_is_what_trying_all_cuts_gives(spark, l2, min_leaf):
    x = frame(spark, 240).where("b is null or k % 3 > 0").repartition(4)
    s = B.Settings(rounds=1, depth=1, rate=0.5, min_leaf=min_leaf, l2=l2)
    model = fitted(spark, x, s)
    rows = x.collect()
    _, feature, left = plain_first_cut(rows, model.base, s)
    tree = model.trees[0]
    assert tree.feature[0] == feature
    got = {r.k: r.f for r in model.predict(x, ["k"]).collect()}
    for side in (left, ~left):
        r = np.sort([rows[i]["y"] - model.base for i in np.flatnonzero(side)])
        want = r[int(np.ceil(s.quantile * len(r))) - 1] * len(r) / (len(r) + l2)
        assert {round(got[rows[i]["k"]], 9) for i in np.flatnonzero(side)} == {round(model.base + 0.5 * want, 9)}


def test_loss_falls_and_reload_predicts_alike(spark):
    x = frame(spark).repartition(3)
    s = B.Settings(rounds=14, depth=3, rate=0.4, min_leaf=5, rows=0.7, columns=0.7)
    model = fitted(spark, x, s)
    loss = lambda m: m.predict(x, ["k", "y"]).agg(F.avg(F.greatest(0.9 * (F.col("y") - F.col("f")), -0.1 * (F.col("y") - F.col("f"))))).first()[0]
    assert loss(model) < 0.35 * loss(B.Boosted(model.base, model.features, model.cuts))
    again = fitted(spark, x.repartition(7), s)
    assert again.to_dict() == model.to_dict() == B.Boosted.from_dict(model.to_dict()).to_dict()
    assert any(0 not in t.feature or 1 not in t.feature or 2 not in t.feature for t in model.trees)


def test_rounds_written_down_change_nothing_and_copies_go(spark, monkeypatch):
    x = frame(spark, 300)
    s = B.Settings(rounds=7, depth=2, rate=0.4, min_leaf=5)
    folder = lineage.LOCAL_FOLDER.removeprefix("file://")
    whole = fitted(spark, x, s).to_dict()
    before = set(os.listdir(folder))
    monkeypatch.setattr(B, "WRITE_EVERY", 2)
    assert fitted(spark, x, s).to_dict() == whole
    assert set(os.listdir(folder)) <= before


def test_parts_follow_rows_and_not_the_setting_of_shuffles(spark, monkeypatch):
    x = frame(spark, 600)
    s = B.Settings(rounds=2, depth=2, rate=0.4, min_leaf=5)
    plain, parts, add = fitted(spark, x, s).to_dict(), [], B.Rows.add

    def counted(rows, tree):
        parts.append(len(rows.stored.frame.inputFiles()))
        add(rows, tree)

    monkeypatch.setattr(B.Rows, "add", counted)
    cores, before = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 5 * cores)
    try:
        assert fitted(spark, x, s).to_dict() == plain
        assert max(parts) <= cores
        monkeypatch.setattr(lineage, "PART_ROWS", 200 // cores)
        assert fitted(spark, x, s).to_dict() == plain
        assert cores < parts[-1] <= 600 // (200 // cores) + 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_patience_ends_the_rounds(spark):
    rng = random.Random(4)
    days = [("i", f"b{k % 9}", dt.date(2024, 1, 1) + dt.timedelta(days=k // 9), rng.random(), rng.random(), 1) for k in range(900)]
    x = spark.createDataFrame(days, "item string, branch string, dt date, a double, y double, lead_time_days int")
    s = B.Settings(rounds=60, depth=3, rate=0.8, min_leaf=2, l2=0.0, patience=3)
    fit, tail = x.where("dt < '2024-03-01'"), x.where("dt >= '2024-03-01'")
    model = B.boost(fit, tail, ["a"], F.col("y"), F.xxhash64("item", "branch", "dt"), s)
    assert len(model.trees) < 57


def test_empty_level_and_constant_target(spark):
    x = frame(spark, 60).withColumn("y", F.lit(3.0))
    model = fitted(spark, x, B.Settings(rounds=2, depth=3))
    assert {r.f for r in model.predict(x, ["k"]).collect()} == {3.0}
    few = fitted(spark, frame(spark, 8), B.Settings(rounds=1, depth=3, min_leaf=100))
    assert few.trees[0].feature == [-1]


def test_counts_of_many_bytes_are_added_up_by_features(spark, monkeypatch):
    x = frame(spark, 500).repartition(5)
    s = B.Settings(rounds=3, depth=3, rate=0.4, min_leaf=5, columns=0.7)
    plain = fitted(spark, x, s).to_dict()
    monkeypatch.setattr(B, "COUNTED_BYTES", 0)
    monkeypatch.setattr(B, "BLOCK_ROWS", 7)
    assert fitted(spark, x, s).to_dict() == plain


def test_leaves_whose_parts_differ_get_their_quantile_too(spark, monkeypatch):
    x = frame(spark, 3000)
    s = B.Settings(rounds=1, depth=1, rate=0.4, min_leaf=5)
    plain = fitted(spark, x, s).to_dict()
    sketched, sketch = [], F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, *more: sketched.append(str(c)) or sketch(c, *more))
    by_value = B.boost(x, None, ["a", "b", "c"], F.col("y"), F.floor(F.col("y")), s).to_dict()  # a part has a few values only
    assert "r" in sketched and by_value == plain


def days_of(spark, n=900):
    rng = random.Random(4)
    days = [("i", f"b{k % 9}", dt.date(2024, 1, 1) + dt.timedelta(days=k // 9), rng.random(), 1) for k in range(n)]
    return spark.createDataFrame([(*r, r[3] * 5 + rng.random()) for r in days], "item string, branch string, dt date, a double, lead_time_days int, y double")


@pytest.mark.parametrize("every", [4, 10])
def test_fits_beside_each_other_are_those_after_each_other(spark, monkeypatch, every):
    x = days_of(spark)
    s = B.Settings(rounds=40, depth=2, rate=0.3, min_leaf=2, patience=3)
    fit, tail = models.demand.early_stopping(x, 20)
    key = F.xxhash64("item", "branch", "dt")
    chosen = len(B.boost(fit, tail, ["a"], F.col("y"), key, s).trees)
    monkeypatch.setattr(B, "WRITE_EVERY", every)
    model = models._boosted(x, ["a"], "y", False, 20, s)
    assert 0 < chosen < 37 and len(model.trees) == chosen
    assert model.to_dict() == B.boost(x, None, ["a"], F.col("y"), key, B.Settings(**{**vars(s), "rounds": chosen})).to_dict()


@pytest.mark.parametrize("broken", ["fit", "all"])
def test_a_fit_that_fails_ends_the_one_beside_it(spark, monkeypatch, broken):
    grow = B.grow

    def failing(rows, s, k, widths):
        if k == 2 and broken == rows.of:
            raise ValueError("broken")
        return grow(rows, s, k, widths)

    init = B.Rows.__init__

    def named(rows, x, base, n, n_rows):
        init(rows, x, base, n, n_rows)
        rows.of = "all" if n_rows == 900 else "fit"

    monkeypatch.setattr(B, "grow", failing)
    monkeypatch.setattr(B.Rows, "__init__", named)
    with pytest.raises(ValueError, match="broken"):
        models._boosted(days_of(spark), ["a"], "y", False, 20, B.Settings(rounds=2000, depth=1, rate=0.01, min_leaf=2, patience=2000))


def test_the_query_boosts_all_features_by_the_operators_own_settings(spark, monkeypatch):
    seen = []

    def boosted(train, names, target, log_target, tail_days, settings):
        seen.append((names, tail_days, settings))
        return B.Boosted(1.0, names, [[] for _ in names])

    monkeypatch.setattr(models, "_boosted", boosted)
    got = catalogue.QUERIES["ml_treeboost"](spark, "/root/testdata/sf0.001")
    rows = catalogue._learnable(spark, "/root/testdata/sf0.001").where("fold_id = 5").select("item", "branch", "dt")
    assert got.count() == rows.count() == got.join(rows, ["item", "branch", "dt"]).count() > 0
    assert seen == [(forecast.FEATURES, 30, B.Settings())] and len(set(forecast.FEATURES)) == 56
    assert (B.Settings().rounds, B.Settings().patience) == (models.BOOST_ROUNDS, models.BOOST_PATIENCE) == (2000, 50)
