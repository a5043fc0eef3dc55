"""Sources and sinks on small files; the stream; QA; search helpers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from granary.operators import models, panel, qa
from granary.sources import files
from granary.streaming.daily import daily_stream

HEAD = "﻿Tanggal;Kategori Barang;Kode Barang;Nama Barang;Nama Cabang;Satuan;Kuantitas\n"


def write(tmp_path, name, *lines, head=HEAD):
    p = tmp_path / name
    p.write_text(head + "".join(f"{x}\n" for x in lines), encoding="utf-8")
    return str(p)


def test_transactions(spark, tmp_path):
    a = write(tmp_path, "a.csv", "01 Jan 2024;C;I;N;B;Porsi;5,8", ";;;;;;", "2 Jan 2024;C;I;N;B;Porsi;3;;")
    b = write(tmp_path, "b.csv", "01 Jan 2024;C;I;N;B;Porsi;1.2")
    rows = files.transactions(spark, [a, b]).orderBy("dt", "file_no", "at").collect()
    assert [(r.dt.day, r.qty) for r in rows] == [(1, 5.8), (1, 1.2), (2, 3.0)]


@pytest.mark.parametrize("line", ["01 Jan 2024;C;I;N;B;Porsi", "01 Jan 2024;C;I;N;B;Porsi;5;extra", "2024-01-01;C;I;N;B;Porsi;5"])
def test_bad_lines_raise(spark, tmp_path, line):
    with pytest.raises(Exception, match="bad (line|date)"):
        files.transactions(spark, [write(tmp_path, "c.csv", line)]).collect()


def test_closures(spark, tmp_path):
    head = "Nama Outlet;tanggal_tutup;tanggal_buka;alasan\n"
    good = write(tmp_path, "g.csv", "A;2024-01-01;2024-02-01;x", "A;2024-02-01;;y", head=head)
    assert [(r.start_dt.month, r.end_dt and r.end_dt.month) for r in files.closures(spark, good).orderBy("start_dt").collect()] == [(1, 2), (2, None)]
    for bad in (["A;2024-02-30;;x"], ["A;2024-02-01;2024-01-01;x"], ["A;2024-01-01;;x", "A;2024-03-01;;y"], ["A;2024-01-01;soon;x"]):
        with pytest.raises(ValueError, match="bad closures"):
            files.closures(spark, write(tmp_path, "b.csv", *bad, head=head))
    assert files.closures(spark, str(tmp_path / "none.csv")).count() == 0


def test_json_and_mapping_round_trip(spark, tmp_path):
    (tmp_path / "o.json").write_text('[{"Nama Outlet": "A", "Alamat": "x", "Kecamatan": "k", "Kota": "c", "has_shopee": "Yes", "has_gofood": "No", "has_grabfood": "Yes"}]')
    assert files.outlets_json(spark, str(tmp_path / "o.json")).first().outlet == "A"
    (tmp_path / "p.json").write_text('[{"Nama Outlet": "A", "more": 1}]')
    with pytest.raises(ValueError, match="more"):
        files.outlets_json(spark, str(tmp_path / "p.json"))
    m = spark.createDataFrame([("c", "v", 1)], "col string, value string, idx int")
    files.mapping_to_json(m, str(tmp_path / "m.json"))
    assert files.mapping_from_json(spark, str(tmp_path / "m.json")).collect() == m.collect()
    assert files.mapping_from_json(spark, str(tmp_path / "none.json")) is None


def test_stream(spark, tmp_path):
    rows = [("i", "b", dt.datetime(2024, 1, k, h), float(h)) for k in (1, 2, 9) for h in (1, 5)]
    spark.createDataFrame(rows, "item string, branch string, ts timestamp, qty double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("item string, branch string, ts timestamp, qty double").parquet(str(tmp_path / "in"))
    q = daily_stream(stream).writeStream.outputMode("append").format("memory").queryName("daily_out").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.dt.day, r.qty) for r in spark.sql("select * from daily_out").collect()} == {(1, 6.0), (2, 6.0)}


def test_qa(spark):
    rows = [("a", "x", dt.date(2024, 1, k), float(q), 1) for k, q in ((1, 1), (2, -1), (4, 1), (4, 1))]
    x = spark.createDataFrame(rows, "item string, branch string, dt date, qty double, segment_id int")
    shut = spark.createDataFrame([("x", dt.date(2024, 1, 4), None)], "branch string, start_dt date, end_dt date")
    checks = qa.qa_checks(x, shut, ["qty", "absent"])
    got = {r.check: r.violations for r in checks.collect()}
    assert (got["qty_not_negative"], got["unique_keys"], got["step_is_one_day"], got["outside_closures"], got["required_columns"]) == (1, 1, 2, 2, 1)
    with pytest.raises(ValueError, match="unique_keys"):
        qa.assert_qa(checks)
    with pytest.raises(ValueError, match="qty"):
        qa.assert_no_nulls(x.withColumn("qty", F.lit(float("nan"))), ["qty"])


@pytest.mark.parametrize("split", ["128m", "1k"])
def test_lines_of_a_folder_keep_their_order(spark, tmp_path, split):
    (tmp_path / "d").mkdir()
    n, want = 0, []
    for k, size in enumerate((1, 50, 5, 120)):
        lines = [f"{1 + (i * 7) % 3:02d} Jan 2024;C;I{(n + i) % 9};N{n + i};B;Porsi;1" for i in range(size)]
        write(tmp_path / "d", f"part-{k}.csv", *lines)
        want += [int(x.split(";")[3][1:]) for x in lines]
        n += size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if split == "1k" else "4m")
    try:
        rows = files.transactions(spark, [str(tmp_path / "d"), str(tmp_path / "d")]).orderBy("at").collect()
        assert [int(r.item_name[1:]) for r in rows] == want * 2 and [r.file_no for r in rows] == [0] * n + [1] * n
        assert [r.at for r in rows] == list(range(2 * n))
        assert [int(r.item_name[1:]) for r in files.merge_and_sort(spark, [str(tmp_path / "d")]).collect()] == sorted(want, key=lambda i: next(r.dt for r in rows if r.item_name == f"N{i}"))
        files.merge_files(spark, [str(tmp_path / "d")], str(tmp_path / "m"))
        files.aggregate_files(spark, str(tmp_path / "m"), str(tmp_path / "g"))
        merged = [r.item_name for r in files.transactions(spark, [str(tmp_path / "m")]).orderBy("at").collect()]
        assert [r.item_name for r in files.transactions(spark, [str(tmp_path / "g")]).orderBy("at").collect()] == merged
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_headers_are_checked_by_name(spark, tmp_path):
    swapped = HEAD.replace("Kode Barang;Nama Barang", "Nama Barang;Kode Barang")
    with pytest.raises(ValueError, match="must begin"):
        files.transactions(spark, [write(tmp_path, "s.csv", "01 Jan 2024;C;I;N;B;Porsi;5", head=swapped)])
    (tmp_path / "d").mkdir()
    write(tmp_path / "d", "1.csv", "01 Jan 2024;C;I;N;B;Porsi;5")
    write(tmp_path / "d", "2.csv", "01 Jan 2024;C;I;N;B;Porsi;5", head=swapped)
    with pytest.raises(Exception, match="header|HEADER|MALFORMED|CSV"):
        files.transactions(spark, [str(tmp_path / "d")]).collect()
    o = write(tmp_path, "o.csv", "B1;O1;", "B2;O2;Bogor", head="Nama Cabang;Nama Outlet;Kota Override\n")
    assert [tuple(r) for r in files.overrides(spark, o).orderBy("branch").collect()] == [("B1", "O1", None), ("B2", "O2", "Bogor")]
    turned = write(tmp_path, "t.csv", "O1;Depok;B1", head="Nama Outlet;Kota Override;Nama Cabang\n")
    assert tuple(files.overrides(spark, turned).first()) == ("B1", "O1", "Depok")
    with pytest.raises(ValueError, match="Kota Override"):
        files.overrides(spark, write(tmp_path, "w.csv", "B1;O1", head="Nama Cabang;Nama Outlet\n"))


def test_regions_and_event_items(spark, tmp_path):
    head = "old_name;new_name;Alamat;Kecamatan;Kota;has_shopee;has_gofood;has_grabfood;kawasan;hari_pengiriman\n"
    r = files.regions(spark, write(tmp_path, "r.csv", "A;B;x;k;Bogor;Yes;No;Yes;2;Senin, Kamis", head=head)).first()
    assert (r.branch, r.region, r.ship_days) == ("B", 2, [0, 3])
    head = "prioritas_cek;Kode Barang;Nama Barang;Kategori Barang;is_event_driven;catatan;pct_hari_nol;adi_rata2;rata2_saat_bergerak;jml_cabang;total_kuantitas\n"
    rows = files.event_items(spark, write(tmp_path, "e.csv", "1;FGS-1;N;C;TRUE;x;1;2;3;4;5", "2;FGS-2;N;C;false;;1;2;3;4;5", head=head)).orderBy("item").collect()
    assert [(r.item, r.is_event_driven) for r in rows] == [("FGS-1", True), ("FGS-2", False)]


def test_leaks_raise(spark):
    day = lambda *ds: spark.createDataFrame([(dt.date(2024, 1, d),) for d in ds], "dt date")
    models.assert_no_leak(day(1, 2), day(3, 4), "2024-02-01")
    for train, valid, cutoff in ((day(1, 3), day(3, 4), "2024-02-01"), (day(1), day(3, 31), "2024-01-31")):
        with pytest.raises(ValueError, match="training ends"):
            models.assert_no_leak(train, valid, cutoff)


def test_search_helpers():
    space = {"a": [1, 2, 3], "b": [1, 2]}
    found = models.sample_space(space, {"a": 1, "b": 1}, 6)
    assert len({tuple(sorted(c.items())) for c in found}) == 6 and found == models.sample_space(space, {"a": 1, "b": 1}, 6)
    with pytest.raises(ValueError):
        models.sample_space(space, {"a": 1, "b": 1}, 7)
    assert models.candidate_budget(100, 8) == 6 and models.leaf_bytes(10, 3, 5, 100) == 10 * 16 * 8
    with pytest.raises(ValueError):
        models.candidate_budget(1000, 8)
    assert models.select_best([{"candidate": 0, "params": {"p": 0}, "pinball": None}, {"candidate": 1, "params": {"p": 1}, "pinball": 2.0}]) == {"p": 1}


def test_forest_quantiles_and_bundle(spark, tmp_path):
    rows = [("i", "b", dt.date(2024, 1, 1) + dt.timedelta(days=k), float(k % 2), float(k % 10 + 100 * (k % 2)), 1) for k in range(200)]
    x = spark.createDataFrame(rows, "item string, branch string, dt date, f double, target double, lead_time_days int")
    models.fit_final(x, ["f"], "target", "2024-07-01", str(tmp_path / "m"), n_trees=3, max_depth=2, min_leaf=5, subset="all", leaf_samples=200)
    got = models.predict_bundle(str(tmp_path / "m"), x.where(F.col("dt") >= "2024-07-01"))
    low, high = (got.join(x, ["item", "branch", "dt"]).where(f"f = {v}").agg(F.min("prediction"), F.max("prediction")).first() for v in (0, 1))
    assert 6 <= low[0] and low[1] <= 8 and 107 <= high[0] and high[1] <= 109


def test_leaves_are_looked_up_as_they_are_joined(spark):
    rows = [("i", f"b{k % 5}", dt.date(2024, 1, 1) + dt.timedelta(days=k), float(k % 11), float((k * 7) % 23), float((k * k) % 37)) for k in range(400)]
    x = spark.createDataFrame(rows, "item string, branch string, dt date, f double, g double, target double")
    model, held = models._forest(x, ["f", "g"], "target", 7, 5, 3, "all", None, 1)
    q = models.LeafQuantiles(model, held, "target", 4)
    for quantile in (0.1, 0.5, 0.9):
        one = {tuple(r)[:3]: r.prediction for r in q.predict(held, quantile=quantile).collect()}
        two = {tuple(r)[:3]: r.prediction for r in q.predict(held, quantile=quantile, lookup_bytes=0).collect()}
        assert one == two and len(one) == 400
    assert "Exchange" not in q.predict(held)._jdf.queryExecution().executedPlan().toString()


def test_sequences_never_cross_segments(spark):
    from granary.operators import windows

    rows = [("a", "x", dt.date(2024, 1, 1) + dt.timedelta(days=k), float(k)) for k in (*range(6), *range(8, 14))]
    shut = spark.createDataFrame([("x", dt.date(2024, 1, 7), dt.date(2024, 1, 9))], "branch string, start_dt date, end_dt date")
    p = panel.dense_panel(spark.createDataFrame(rows, "item string, branch string, dt date, qty double"), shut)
    got = windows.sequences(p, ["qty"], "qty", 3).collect()
    assert len(got) == 6 and all([w[0] for w in r.window] == [r.qty - 2, r.qty - 1, r.qty] for r in got)


def test_headers_quotes_and_folders(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k in (1, 2):
        write(tmp_path / "d", f"{k}.csv", f'0{k} Jan 2024;C;I;"N; ""x""";B;Porsi;"1,5"', ";; ;;;;", *[f"0{k} Jan 2024;C;I;N;B;Porsi;{q}" for q in range(3)])
    rows = files.merge_and_sort(spark, [str(tmp_path / "d")]).collect()
    assert [r.dt.day for r in rows] == [1] * 4 + [2] * 4 and rows[0].item_name == 'N; "x"' and rows[0].qty == 1.5
    many = write(tmp_path, "e.csv", "01 Jan 2024;C;I;N;B;Porsi;5" + ";" * 1500 + "late")
    with pytest.raises(Exception, match="bad line"):
        files.transactions(spark, [many]).collect()


def test_entry_points(spark, tmp_path):
    a = write(tmp_path, "a.csv", "03 Jan 2024;C;I;N;B;Porsi;1,5", "01 Jan 2024;C;I;N;B;Porsi;2")
    b = write(tmp_path, "b.csv", '01 Jan 2024;C;"I;2";N;B;Porsi;3', "03 Jan 2024;C;I;N;B;Porsi;0,25")
    files.merge_files(spark, [a, b], str(tmp_path / "m"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "m").glob("part-*")))
    assert text.startswith("\ufeffTanggal;Kategori Barang;Kode Barang") and '01 Jan 2024;C;"I;2";N;B;Porsi;3' in text
    rows = files.transactions(spark, [str(tmp_path / "m")]).orderBy("at").collect()
    assert [(r.dt.day, r.item, r.qty) for r in rows] == [(1, "I", 2.0), (1, "I;2", 3.0), (3, "I", 1.5), (3, "I", 0.25)]
    files.aggregate_files(spark, str(tmp_path / "m"), str(tmp_path / "g"))
    rows = files.transactions(spark, [str(tmp_path / "g")]).orderBy("at").collect()
    assert [(r.dt.day, r.item, r.qty) for r in rows] == [(1, "I", 2.0), (1, "I;2", 3.0), (3, "I", 1.8)]
    with pytest.raises(ValueError):
        files.aggregate_files(spark, a, a)
    (tmp_path / "o.json").write_text('[{"Nama Outlet": "A;x", "Alamat": "x", "Kecamatan": "k", "Kota": "c", "has_shopee": "Yes", "has_gofood": "No", "has_grabfood": null}]')
    files.sync_outlets(spark, str(tmp_path / "o.json"), str(tmp_path / "o"))
    got = files.outlets(spark, str(tmp_path / "o")).first()
    assert (got.outlet, got.has_shopee, got.has_grabfood) == ("A;x", "Yes", None)
    with pytest.raises(ValueError, match="city"):
        files.write_outlets(files.outlets(spark, str(tmp_path / "o")).drop("city"), str(tmp_path / "p"))


def test_boosted_bundle(spark, tmp_path):
    rows = [("i", "b", dt.date(2024, 1, 1) + dt.timedelta(days=k), float(k % 2), float(100 * (k % 2) + k % 3), 1) for k in range(160)]
    x = spark.createDataFrame(rows, "item string, branch string, dt date, f double, target double, lead_time_days int")
    for log in (False, True):
        models.fit_final(x, ["f"], "target", "2024-06-01", str(tmp_path / f"b{log}"), kind="boost", rounds=6, patience=2, rate=0.9, min_leaf=5, depth=2, log_target=log)
        got = models.predict_bundle(str(tmp_path / f"b{log}"), x).join(x, ["item", "branch", "dt"])
        low, high = (got.where(f"f = {v}").agg(F.avg("prediction")).first()[0] for v in (0, 1))
        assert low < 25 and 95 < high < 106


def test_search_resumes_from_its_checkpoint(spark, tmp_path):
    rows = [("i", b, dt.date(2024, 1, 1) + dt.timedelta(days=k), float(k % 7), 1, None) for b in "bc" for k in range(330)]
    x = spark.createDataFrame(rows, "item string, branch string, dt date, target double, lead_time_days int, naive double").withColumn("qty", F.col("target"))
    from granary.operators import demand

    x = demand.assign_folds(x, "2024-11-01").withColumns({"lag_1": F.col("target"), "roll_mean_7": F.col("target")})
    ran = []

    def make(shift):
        def forecast(train, valid):
            ran.append(shift)
            if shift == 2:
                raise ValueError("two fails")
            return valid.select("item", "branch", "dt", (F.col("target") + shift).alias("prediction"))

        return forecast

    found, at = [{"shift": 1}, {"shift": 2}, {"shift": 0}], str(tmp_path / "search.json")
    models.run_search(x, found[:2], make, "2024-11-01", "target", checkpoint=at)
    n = len(ran)
    results = models.run_search(x, found, make, "2024-11-01", "target", checkpoint=at)
    assert ran[n:] == [0, 0] and [r["error"] for r in results] == ["", "two fails", ""] and models.select_best(results) == {"shift": 0}
    with pytest.raises(ValueError, match="other candidates"):
        models.run_search(x, [{"shift": 9}], make, "2024-11-01", "target", checkpoint=at)
