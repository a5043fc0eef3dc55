"""Candidates beside each other, fingerprints of two tables, and the index of names."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from granary.operators import canon, demand, models


def panel(spark):
    rows = [("i", b, dt.date(2024, 1, 1) + dt.timedelta(days=k), float(k % 7), 1) for b in "bc" for k in range(330)]
    x = spark.createDataFrame(rows, "item string, branch string, dt date, target double, lead_time_days int").withColumn("qty", F.col("target"))
    return demand.assign_folds(x, "2024-11-01").withColumns({"lag_1": F.col("target"), "roll_mean_7": F.col("target")})


def test_candidates_beside_each_other_score_as_in_turn(spark, tmp_path):
    x, now, most, lock = panel(spark), [0], [0], threading.Lock()

    def make(shift):
        def forecast(train, valid):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            valid.count()
            with lock:
                now[0] -= 1
            if shift == 2:
                raise ValueError("two fails")
            return valid.select("item", "branch", "dt", (F.col("target") + shift).alias("prediction"))

        return forecast

    found = [{"shift": k} for k in (1, 2, 0, 3)]
    plain = lambda rows: [(r["candidate"], r["params"], r["pinball"], r["error"]) for r in rows]
    in_turn = models.run_search(x, found, make, "2024-11-01", "target")
    at = str(tmp_path / "s.json")
    models.run_search(x, found[:1], make, "2024-11-01", "target", checkpoint=at)
    beside = models.run_search(x, found, make, "2024-11-01", "target", checkpoint=at, beside=3)
    assert plain(beside) == plain(in_turn) and plain(models.run_search(x, found, make, "2024-11-01", "target", checkpoint=at)) == plain(in_turn)
    most[0] = 0
    models.run_search(x, found, make, "2024-11-01", "target", beside=3, weigh=lambda p: 60, budget=100)
    assert most[0] == 1
    with pytest.raises(RuntimeError):
        models.run_search(x, found, lambda shift: (_ for _ in ()).throw(RuntimeError("not a candidate's fault")), "2024-11-01", "target", beside=2)


def violations(a, b):
    return {r.check: r.violations for r in demand.contract_violations(a, b, ["k", "m"], ["v", "w"]).collect()}


def test_fingerprints_find_every_difference(spark):
    rows = [(k, f"m{k % 3}", float(k % 5) if k % 50 else None, "w") for k in range(2000)]
    schema = "k long, m string, v double, w string"
    a = spark.createDataFrame(rows, schema)
    none = {"only_first": 0, "only_second": 0, "differs_v": 0, "differs_w": 0, "null_v": 40, "null_w": 0}
    assert violations(a, a.orderBy(F.desc("k")).repartition(5)) == none
    b = a.where("k <> 7").withColumn("v", F.when(F.col("k").isin(10, 11), -1.0).when(F.col("k") == 50, 0.0).when(F.col("k") == 12, None).otherwise(F.col("v")))
    b = b.unionByName(spark.createDataFrame([(9999, "m", 1.0, None)], schema)).withColumn("w", F.when(F.col("k") == 3, "x").otherwise(F.col("w")))
    assert violations(a, b) == none | {"only_first": 1, "only_second": 1, "differs_v": 4, "differs_w": 1}
    swapped = a.withColumn("v", F.when(F.col("k") == 1, 2.0).when(F.col("k") == 2, 1.0).otherwise(F.col("v")))
    assert violations(a, swapped)["differs_v"] == 2
    unkeyed = a.unionByName(spark.createDataFrame([(None, "m", 1.0, "w")], schema))
    assert violations(unkeyed, unkeyed) == none | {"only_first": 1, "only_second": 1}
    assert violations(a, a.limit(0))["only_first"] == 2000


def test_needles_are_looked_up_by_their_rarest_piece(spark):
    texts = ["central park", "park", "", "a", "parka parka", "säntis", "ab"]
    needles = ["park", "a", "", "ka p", "xyz", "ark ", "ab", "än", "central park", "central parks"]
    n, t = spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x, x) for x in texts], "outlet string, text string")
    got = sorted((r.needle, r.outlet) for r in canon.containing(n, t).collect())
    assert got == sorted((x, y) for x in needles for y in texts if x in y)
    plan = canon.containing(n, t)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_exact_quantiles_of_groups_of_any_size(spark):
    import random

    from granary.operators import explore, quantiles

    rng = random.Random(2)
    rows = [(rng.choice("aaaaaaab"), rng.choice([None, 5.0, 5.0, rng.random() * 9])) for _ in range(900)]
    rows += [(None, 3.0), (None, 8.0), ("one", 1.5), ("none", None)]
    x = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: tuple(r)[1:] for r in explore.describe(x, "v", ["g"]).collect()}
    want = {r.g: tuple(r)[1:] for r in x.groupBy("g").agg(F.count("v"), F.avg("v"), F.stddev_samp("v"), F.min("v"), *[F.percentile("v", F.lit(p)) for p in (0.25, 0.5, 0.75)], F.max("v")).collect()}
    assert set(got) == set(want)
    for g, w in want.items():
        assert all((a is None and b is None) or a == pytest.approx(b) for a, b in zip(got[g], w, strict=True)), g
    assert tuple(explore.describe(x, "v").first())[0] == sum(v is not None for _, v in rows)
    box = {r.g: (r.low, r.high) for r in explore.box_stats(x, "v", "g").collect()}
    for g, w in want.items():
        inside = [v for k, v in rows if k == g and v is not None and w[4] - 1.5 * (w[6] - w[4]) <= v <= w[6] + 1.5 * (w[6] - w[4])]
        assert not inside or box[g] == (min(inside), max(inside))
    plan = quantiles.exact_quantiles(quantiles.counted(x, "v", ["g"]), ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan
