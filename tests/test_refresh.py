"""The refresh from files to the stored model input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from granary.plans import forecast
from granary.sources import files
from tests.test_files import HEAD, write

CUTOFF = "2024-12-01"
REGIONS = ";".join(files.REGION_HEADER) + "\n"
CLOSURES = ";".join(files.CLOSURE_HEADER) + "\n"
EVENTS = ";".join(files.EVENT_ITEM_HEADER) + "\n"
DAYS = [dt.date(2024, 7, 1) + dt.timedelta(days=k) for k in range(170)]


def line(day, item, name, branch, qty):
    months = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    return f"{day.day:02d} {months[day.month - 1]} {day.year};Minuman;{item};{name};{branch};Porsi;{qty}"


@pytest.fixture(scope="module")
def sources(tmp_path_factory):
    top = tmp_path_factory.mktemp("refresh")
    (top / "raw").mkdir()
    lines = []
    for k, day in enumerate(DAYS):
        lines.append(line(day, "FGS-1" if k % 3 else "xxx.FGS-1", "Teh" if k % 3 else "xxx. Teh", "B1", 5 + k % 7))
        lines.append(line(day, "FGS-2", "Kopi" if k else "Kopi Susu", "B1", f"{k % 3},5"))
        if k % 2 == 0:
            lines.append(line(day, "FGS-2", "Kopi", "B2", 3))
            lines.append(line(day, "FGS-2", "Kopi", "B2", 1))
    lines += [line(d, "FGS-2", "Kopi", "New", 9) for d in DAYS[150:155]]
    for n, (a, b) in enumerate(((0, 3), (3, 200), (200, 220), (220, 10_000))):
        write(top / "raw", f"{n}.csv", *lines[a:b])
    return {
        "transactions": [str(top / "raw")],
        "regions": write(top, "regions.csv", "x;B1;a;k;Bogor;Yes;No;Yes;1;Senin, Kamis", "y;B2;a;k;Depok;No;No;No;2;Selasa, Jumat", head=REGIONS),
        "closures": write(top, "closures.csv", "B2;2024-09-02;2024-09-20;renovation", head=CLOSURES),
        "event_items": write(top, "events.csv", "1;FGS-1;Teh;Minuman;true;;;;;;", "2;FGS-2;Kopi;Minuman;false;;;;;;", head=EVENTS),
    }, top


def test_files_to_model_input(spark, sources):
    paths, top = sources
    out = forecast.refresh_files(spark, **paths, cutoff=CUTOFF, folder=str(top / "out"), mapping=str(top / "mapping.json"))
    days = {(r.item, r.branch, r.dt): r for r in out["days"].collect()}
    assert days["FGS-2", "B2", DAYS[0]].qty == 4.0 and len(days) == 170 * 2 + 85 + 5
    names = {r.item: r.item_name for r in days.values()}
    assert names["FGS-2"] == "Kopi Susu"  # the first line's, in the order of the folder's files
    assert set(names) == {"FGS-1", "FGS-2"}
    assert [r.branch for r in out["vanished"].collect()] == ["New"]
    x, rows = out["featured"], out["model_input"]
    assert x.where("branch = 'B2' and dt between '2024-09-02' and '2024-09-19'").count() == 0
    assert x.where("branch = 'B2'").select("segment_id").distinct().count() == 2
    assert x.count() == rows.count() == 2 * 170 + 169 - 18
    one = rows.where(F.col("dt") == DAYS[30]).where("item = 'FGS-1'").first()
    assert (one.lag_1, one.lag_7, one.is_event_driven, one.region) == (5 + 29 % 7, 5 + 23 % 7, True, 1)
    assert one.has_full_history and one.missing_history_count == 0 and one.branch_idx > 0
    assert set(forecast.HISTORY) <= set(rows.columns) and rows.where("fold_id is not null").count() > 0
    first = files.read_json(spark, str(top / "mapping.json"))
    again = forecast.refresh_files(spark, **paths, cutoff=CUTOFF, folder=str(top / "out2"), mapping=str(top / "mapping.json"))
    assert files.read_json(spark, str(top / "mapping.json")) == first
    keys = ["item", "branch", "dt", "lag_7", "branch_idx", "target_lead_time_cumulative"]
    assert again["model_input"].select(keys).exceptAll(rows.select(keys)).count() == 0


def test_refresh_writes_both_tables(spark, sources):
    paths, _ = sources
    wrote = []
    dims = forecast.load_dimensions(spark, paths["regions"], paths["closures"])
    rows = forecast.refresh(forecast.load_raw(spark, paths["transactions"]), dims, files.event_items(spark, paths["event_items"]), CUTOFF, lambda x, name: wrote.append((name, x.count())), excluded_branches=["New"])
    assert wrote == [("featured", 491), ("model_input", 491)] and rows.count() == 491


def test_an_item_without_an_event_flag_raises(spark, sources):
    paths, top = sources
    few = write(top, "few.csv", "1;FGS-1;Teh;Minuman;true;;;;;;", head=EVENTS)
    with pytest.raises(Exception, match="no event flag for FGS-2"):
        forecast.refresh_files(spark, **paths | {"event_items": few}, cutoff=CUTOFF, folder=str(top / "out3"))
