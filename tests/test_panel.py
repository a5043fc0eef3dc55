"""Panels, segments, windows and lead times on small frames, against plain definitions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from granary.functions import calendar as K
from granary.functions import text as T
from granary.operators import canon, demand, metrics, panel, windows

D0 = dt.date(2024, 1, 1)


def day(k):
    return D0 + dt.timedelta(days=k)


def days(spark, seen, item="a", branch="x"):
    rows = [(item, branch, day(k), float(q)) for k, q in seen]
    return spark.createDataFrame(rows, "item string, branch string, dt date, qty double")


def closures(spark, *rows):
    return spark.createDataFrame([(b, s, e) for b, s, e in rows], "branch string, start_dt date, end_dt date")


def collect(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("item", "branch", "dt").collect()]


def test_gap_is_filled_and_leap_day_kept(spark):
    assert [q for _, q in collect(panel.dense_panel(days(spark, [(0, 5), (4, 9)])), "dt", "qty")] == [5, 0, 0, 0, 9]
    spread = panel.dense_panel(days(spark, [(58, 1), (60, 1)]))
    assert dt.date(2024, 2, 29) in {r.dt for r in spread.collect()}


@pytest.mark.parametrize("end, rows, segments", [(day(60), 6, [1, 1, 1, 2, 2, 2]), (None, 3, [1, 1, 1])])
def test_closure_splits_segments(spark, end, rows, segments):
    x = panel.dense_panel(days(spark, [(k, 1) for k in (0, 1, 2, 60, 61, 62)]), closures(spark, ("x", day(3), end)))
    assert [s for (s,) in collect(x, "segment_id")] == segments and x.count() == rows


def test_breakpoint(spark):
    x = days(spark, [(k, 1) for k in range(10)])
    marks = lambda k: spark.createDataFrame([("x", day(k))], "branch string, dt date")
    assert [s for (s,) in collect(panel.dense_panel(x, breakpoints=marks(4)), "segment_id")] == [1] * 4 + [2] * 6
    assert {s for (s,) in collect(panel.dense_panel(x, breakpoints=marks(0)), "segment_id")} == {1}


def test_random_panels_match_a_plain_definition(spark):
    r = random.Random(4)
    rows, want = [], {}
    shut = {"b1": (day(20), day(30)), "b2": (day(40), None)}
    for item in "ij":
        for branch in ("b0", "b1", "b2"):
            seen = {k: float(r.randrange(0, 9)) for k in r.sample(range(70), 18)}
            rows += [(item, branch, day(k), q) for k, q in seen.items()]
            seg, before = 1, None
            for k in range(min(seen), max(seen) + 1):
                a, b = shut.get(branch, (None, None))
                if a and a <= day(k) and (b is None or day(k) < b):
                    continue
                seg += before is not None and k - before > 1
                before = k
                want[item, branch, day(k)] = (seen.get(k, 0.0), seg)
    df = spark.createDataFrame(rows, "item string, branch string, dt date, qty double")
    got = panel.dense_panel(df, closures(spark, *[(b, *v) for b, v in shut.items()]))
    assert {(x.item, x.branch, x.dt): (x.qty, x.segment_id) for x in got.collect()} == want


def test_carry_crosses_segments(spark):
    rows = [("a", "x", day(0), 1.0, None), ("a", "x", day(2), 1.0, "c1"), ("a", "x", day(6), 1.0, "c2")]
    x = panel.dense_panel(spark.createDataFrame(rows, "item string, branch string, dt date, qty double, category string"), closures(spark, ("x", day(3), day(5))))
    assert collect(x, "dt", "category", "segment_id") == [(day(0), "c1", 1), (day(1), "c1", 1), (day(2), "c1", 1), (day(5), "c1", 2), (day(6), "c2", 2)]


def test_history_filter_counts_dense_days_before_the_cutoff(spark):
    x = panel.dense_panel(days(spark, [(0, 1), (59, 1)]).unionByName(days(spark, [(10, 1), (90, 1)], branch="y")))
    assert {r.branch for r in panel.enough_history(x, str(day(60)), 60).collect()} == {"x"}


def test_windows(spark):
    x = panel.dense_panel(days(spark, [(k, k + 1) for k in range(30)]))
    x = x.withColumns(windows.target_columns() | windows.lag_columns("qty") | windows.rolling_columns("qty"))
    rows = x.orderBy("dt").collect()
    assert rows[0].target_h3 == 4 and rows[29].target_h1 is None
    assert rows[6].roll_mean_7 is None and rows[7].roll_mean_7 == 4.0
    assert (rows[28].lag_1, rows[28].lag_7, rows[28].lag_28) == (28, 22, 1)


def test_lead_target_stops_at_segment_ends(spark):
    x = panel.dense_panel(days(spark, [(k, k + 1) for k in range(10)]))
    lead = lambda v: [r.t for r in x.withColumn("lead_time_days", F.lit(v).cast("int")).withColumn("t", windows.lead_target()).orderBy("dt").collect()]
    assert lead(3)[0] == 9 and lead(4)[0] == 14 and lead(3)[7:] == [None] * 3 and lead(None) == [None] * 10


def test_lead_times_and_delivery_days(spark):
    one = spark.createDataFrame([(dt.date(2025, 6, 2) + dt.timedelta(days=k), s) for k in range(7) for s in ("Senin dan Kamis", "Selasa, Jumat", None)], "dt date, s string")
    x = one.withColumn("d", F.when(F.col("s").isNotNull(), T.delivery_days(F.col("s"))))
    x = x.select("dt", "s", K.lead_time(F.col("dt"), F.col("d")).alias("l"), K.is_delivery_day(F.col("dt"), F.col("d")).alias("f")).orderBy("dt").collect()
    assert [r.l for r in x if r.s == "Senin dan Kamis"] == [3, 2, 1, 4, 3, 2, 1]
    assert [r.l for r in x if r.s == "Selasa, Jumat"] == [1, 3, 2, 1, 4, 3, 2]
    assert [r.f for r in x if r.s == "Senin dan Kamis"] == [True, False, False, True, False, False, False]
    assert {(r.l, r.f) for r in x if r.s is None} == {(None, False)}


def test_unknown_weekday_raises(spark):
    with pytest.raises(Exception, match="unknown weekday"):
        spark.createDataFrame([("Senin dan Foo",)], "s string").select(T.delivery_days(F.col("s"))).collect()


def test_weekend_days_ahead(spark):
    rows = [("2025-06-02", 3, 0), ("2025-06-05", 4, 2), ("2025-06-06", 1, 1), ("2025-06-08", 1, 0), ("2025-06-02", None, None)]
    df = spark.createDataFrame(rows, "s string, l int, want int").withColumn("dt", F.to_date("s"))
    assert all(r.got == r.want for r in df.withColumn("got", K.weekend_days_ahead(F.col("dt"), F.col("l"))).collect())


def test_calendar(spark):
    x = spark.createDataFrame([(s,) for s in ("2024-03-11", "2024-03-12", "2024-04-09", "2024-04-10", "2024-04-17", "2024-05-01", "2024-12-30", "2024-01-01")], "s string")
    rows = {r.s: r for r in K.Calendar().add(x.withColumn("dt", F.to_date("s"))).collect()}
    assert [rows[s].days_into_ramadan for s in ("2024-03-11", "2024-03-12", "2024-04-09", "2024-04-10")] == [0, 1, 29, None]
    assert rows["2024-04-09"].days_until_eid_al_fitr == 1 and rows["2024-04-17"].days_since_eid_al_fitr == 7 and rows["2024-05-01"].days_since_eid_al_fitr is None
    assert rows["2024-12-30"].days_until_new_year == 2 and rows["2024-01-01"].is_new_year and rows["2024-01-01"].days_until_ramadan == 70
    with pytest.raises(ValueError, match="2030"):
        K.Calendar().check_years(spark.sql("select date'2030-01-01' as dt"))


def test_gaps(spark):
    x = days(spark, [(k, 1) for k in (*range(5), *range(31, 36))])
    found = panel.unrecorded_gaps(x, closures(spark, ("x", day(6), day(20)))).collect()
    assert [(r.gap_start, r.gap_end, r.days) for r in found] == [(day(5), day(30), 26)]
    assert panel.unrecorded_gaps(x, closures(spark, ("x", day(5), day(31)))).count() == 0


def test_code_map(spark):
    rows = [("FGS-00003", "N3"), ("xxx.FGS-00003", "xxx.N3"), ("FGS.00047", "A"), ("FGS-00047", "B"), ("FGS.00069", "C"), ("xxx.FGS.00069", "D"), ("FGS.00053", "E"), ("FGS-00053", "F")]
    got = {r.code: r.mapped for r in canon.code_map(spark.createDataFrame(rows, "item string, item_name string")).collect()}
    assert got == {"FGS-00003": "FGS-00003", "xxx.FGS-00003": "FGS-00003", "FGS.00047": "FGS.00047", "FGS-00047": "FGS-00047", "FGS.00069": "FGS-00069", "xxx.FGS.00069": "xxx.FGS-00069", "FGS.00053": "FGS.00053", "FGS-00053": "FGS-00053"}


def test_names(spark):
    df = spark.createDataFrame([("xxx.Iga Sapi",), ("Gula  Asam   250ml",), ("Gula Asam 250 ml (Promo)",), ("Gula Asam 250ml ",)], "n string")
    assert [r[0] for r in df.select(T.comparable_name(F.col("n"))).collect()] == ["Iga Sapi", *["Gula Asam 250 ml"] * 3]


def test_branch_matching(spark):
    outlets = spark.createDataFrame([("Resto Kota Tua",), ("Resto Kota",), ("Other Place",)], "outlet string")
    overrides = spark.createDataFrame([("KY1 - Odd", "Other Place", None), ("KY2 - Kota Tua", "Gone", None)], "branch string, outlet string, city_override string")
    names = spark.createDataFrame([("KY1 - Odd",), ("KY2 - Kota Tua",), ("KY3 - kota tua (x)",), ("KY4 - Kota",), ("KY5 - None",)], "branch string")
    assert {(r.branch, r.outlet) for r in canon.match_branches(names, outlets, overrides).collect()} == {("KY1 - Odd", "Other Place"), ("KY3 - kota tua (x)", "Resto Kota Tua")}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 10, 15])
def test_tiers_are_quartiles_of_first_ranks(spark, n):
    pd = pytest.importorskip("pandas")
    stats = spark.createDataFrame([(f"b{i:02d}", float(i)) for i in range(n)], "branch string, branch_avg_daily_qty double")
    got = [r.branch_volume_tier for r in demand.volume_tier(stats).orderBy("branch").collect()]
    q = min(4, n)
    want = pd.qcut(pd.Series(range(1, n + 1)), q, labels=demand.TIERS[:q]).tolist() if n > 1 else ["small"]
    assert got == want


def test_capping(spark):
    x = panel.dense_panel(days(spark, [(k, 10) for k in range(40)] + [(40, 100), (41, 100)]))
    x = x.withColumns({e: F.lit(False) for e in demand.EVENT_FLAGS}).withColumn("is_new_year", F.col("dt") == F.lit(day(41)))
    got = demand.cap_outliers(x, demand.pair_baseline(x, str(day(40)))).where(F.col("dt") >= F.lit(day(40))).orderBy("dt").collect()
    assert [(r.is_spike, r.qty_capped) for r in got] == [(True, 50.0), (True, 100.0)]


def test_purging_and_folds(spark):
    x = spark.createDataFrame([(dt.date(2025, 11, k), v) for k, v in ((26, 4), (27, 4), (29, None), (30, 1))], "dt date, lead_time_days int")
    train, test = demand.split_train_test(x, "2025-12-01")
    assert {r.dt.day for r in train.collect()} == {26, 29} and test.count() == 0
    assert demand.fold_starts("2025-12-01") == [f"2025-{m:02d}-01" for m in (7, 8, 9, 10, 11)]
    with pytest.raises(ValueError):
        demand.fold_train(x, 6, "2025-12-01")


def test_metrics(spark):
    df = spark.createDataFrame([("m", 100.0, 90.0), ("m", 100.0, 110.0), ("z", 0.0, 0.0)], "model string, target double, prediction double")
    r = {x.model: x for x in metrics.score(df).collect()}
    assert (r["m"].pinball, r["m"].mae, r["m"].coverage, r["m"].fill_rate) == (5.0, 10.0, 0.5, 0.95) and r["z"].fill_rate == 1.0


def test_perturbing_the_test_period_leaves_train_statistics(spark):
    a = panel.dense_panel(days(spark, [(k, k % 7) for k in range(80)]))
    b = a.withColumn("qty", F.when(F.col("dt") >= F.lit(day(60)), F.col("qty") * 100).otherwise(F.col("qty")))
    for f in (demand.pair_baseline, demand.demand_stats, lambda x, c: demand.branch_stats(x, c, "qty")):
        assert f(a, str(day(60))).collect() == f(b, str(day(60))).collect()


def test_mapping_keeps_and_appends(spark):
    rows = spark.createDataFrame([("b",), ("c",), (None,)], "col1 string")
    known = spark.createDataFrame([("col1", "b", 1), ("col1", "old", 2)], "col string, value string, idx int")
    got = demand.category_mapping(rows, ["col1"], existing=known)
    assert {(r.value, r.idx) for r in got.collect()} == {("b", 1), ("old", 2), ("c", 3)}
    assert [r.col1_idx for r in demand.encode(rows, got, ["col1"]).orderBy("col1").collect()] == [0, 1, 3]
