"""The demand model's inputs, read from the driver tables, as frames and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.calendar import Calendar

CUTOFF, EV_CUTOFF = "2001-07-01", "2024-01-25"
CLOSURES = [("NATION_1", "1998-03-01", "1998-05-01"), ("NATION_2", "2000-01-01", None), ("NATION_3", "1997-02-01", "1997-02-10")]
BREAKPOINTS = [("NATION_4", "1999-06-01"), ("NATION_6", "1996-02-29")]
RELOCATIONS = [("NATION_1", "1998-05-01"), ("NATION_5", "1999-01-15")]
FEASTS = [(y, e, f"{y}-{a}", f"{y}-{b}") for y in range(1995, 2002) for e, a, b in (("ramadan", "01-15", "02-13"), ("eid_al_fitr", "02-14", "02-14"), ("eid_al_adha", "04-22", "04-22"))]
HOLIDAYS = [f"{y}-{d}" for y in range(1995, 2002) for d in ("01-01", "08-17", "12-25")]
CALENDAR = Calendar(FEASTS, HOLIDAYS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums by part type and nation, with carried columns."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("item"), "p_brand", "p_name", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("branch"))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("dt"), "l_quantity")
    rows = rows.join(part, rows.l_partkey == part.p_partkey).join(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), rows.l_suppkey == supplier.s_suppkey)
    unit = F.when(F.col("p_size") % 2 == 0, "Gr").otherwise("Porsi")
    return rows.groupBy("item", "branch", "dt").agg(F.sum("l_quantity").alias("qty"), F.min("p_brand").alias("category"), F.min("p_name").alias("item_name"), F.min(unit).alias("unit"))


def events(spark: SparkSession, sf_dir: str, buckets: int) -> DataFrame:
    """Daily sums by event type and user bucket; exact in cents."""
    e = table(spark, sf_dir, "events")
    branch = F.concat(F.lit("u"), (F.col("user_id") % buckets).cast("string"))
    return e.groupBy(F.col("event_type").alias("item"), branch.alias("branch"), F.col("ts").cast("date").alias("dt")).agg(F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("qty"))


def dims(spark: SparkSession, rows: list[tuple], schema: str, dates: list[str]) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({d: F.col(d).cast("date") for d in dates})


def closures(spark: SparkSession) -> DataFrame:
    return dims(spark, CLOSURES, "branch string, start_dt string, end_dt string", ["start_dt", "end_dt"])


def breakpoints(spark: SparkSession) -> DataFrame:
    return dims(spark, BREAKPOINTS, "branch string, dt string", ["dt"])


def relocations(spark: SparkSession) -> DataFrame:
    return dims(spark, RELOCATIONS, "branch string, dt string", ["dt"])


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping schedules by nation; NATION_7 has none."""
    n = table(spark, sf_dir, "nation")
    text = F.when(F.col("n_name") == "NATION_7", None).when(F.col("n_nationkey") % 2 == 0, "Senin dan Kamis").otherwise("Selasa dan Jumat")
    return n.select(F.col("n_name").alias("branch"), (F.col("n_nationkey") % 2 + 1).alias("region"), F.when(text.isNotNull(), T.delivery_days(text)).alias("ship_days"))


#: Dirty codes, names, branches, dates and quantities, the same SQL on both engines.
TEXTS_SQL = """select p_partkey k,
  case p_partkey % 4 when 0 then 'xxx.FGS-' when 1 then 'FGS-' when 2 then 'FGS.' else 'XXX. FGS.' end || lpad(cast(p_partkey % 40 as string), 5, '0') item,
  case when p_partkey % 5 = 0 then 'xxx. ' else '' end || case when p_partkey % 40 < 20 then 'Nama ' || cast(p_partkey % 40 as string) else p_name end
    || case p_partkey % 3 when 0 then '  250ml' when 1 then ' 250ml' else ' 250 ml (Promo)' end item_name,
  case when p_partkey % 40 < 10 then 'Minuman' || case when p_partkey % 3 = 0 then ' - FG' else '' end when p_size % 3 = 0 then 'Snack' when p_size % 3 = 1 then 'Snack (FG)' else p_type end category,
  case p_size % 2 when 0 then 'Gr' else 'Porsi' end unit, cast(p_size as double) qty,
  'KY' || cast(p_partkey % 9 as string) || ' - NATION_' || cast(p_partkey % 30 as string) || case when p_partkey % 2 = 0 then ' (Resto)' else '' end branch,
  lpad(cast(p_partkey % 28 + 1 as string), 2, '0') || ' Jan 2024' dt_text, cast(p_size as string) || ',5' qty_text,
  case p_partkey % 4 when 0 then ' Yes ' when 1 then 'no' when 2 then 'YES' end flag_text,
  case p_partkey % 5 when 0 then 'Senin dan Kamis' when 1 then 'Selasa, Jumat' when 2 then ' Sabtu ' when 3 then 'Rabu dan Rabu' end days_text,
  case p_partkey % 3 when 0 then '  ' when 1 then ' Kota A ' end city_override, case when p_partkey % 4 > 0 then ' Kota ' || cast(p_partkey % 4 as string) end city
from part"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TEXTS_SQL.replace("from part", "from {part}"), part=table(spark, sf_dir, "part"))


def outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    flag = lambda m: F.when(k % m == 0, "Yes").when(k % m == 1, "No")
    return n.select(F.concat(F.lit("Resto "), F.initcap("n_name")).alias("outlet"), F.concat(F.lit("Kota "), (k % 5).cast("string")).alias("city"), flag(2).alias("has_shopee"), flag(3).alias("has_gofood"), flag(4).alias("has_grabfood"))


OVERRIDES = [("KY1 - NATION_1", "Resto Nation_1", "Kota X"), ("KY2 - NATION_2 (Resto)", "Resto Nation_2", " "), ("KY3 - NATION_3", "Resto Missing", None)]


def overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OVERRIDES, "branch string, outlet string, city_override string")


# --- SQL of the same views -----------------------------------------------------------------


def values(name: str, columns: str, rows: list[tuple], dates: set[int] = frozenset()) -> str:
    def one(i, v):
        text = "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
        return f"CAST({text} AS DATE)" if i in dates else text

    body = ", ".join("(" + ", ".join(one(i, v) for i, v in enumerate(r)) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


SALES = """sales AS (SELECT p_type item, n_name branch, CAST(l_shipdate AS DATE) dt, SUM(l_quantity) qty, MIN(p_brand) category, MIN(p_name) item_name,
  MIN(CASE WHEN p_size % 2 = 0 THEN 'Gr' ELSE 'Porsi' END) unit
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)"""


def events_sql(name: str, buckets: int) -> str:
    return f"""{name} AS (SELECT event_type item, 'u' || CAST(user_id % {buckets} AS VARCHAR) branch, CAST(ts AS DATE) dt,
  CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DOUBLE) qty FROM events GROUP BY 1, 2, 3)"""


CLOSURES_SQL = values("closures", "branch, start_dt, end_dt", CLOSURES, {1, 2})
BREAKS_SQL = values("breaks", "branch, dt", BREAKPOINTS, {1})
MOVES_SQL = values("moves", "branch, moved", RELOCATIONS, {1})
FEASTS_SQL = values("feasts", "y, event, a, b", FEASTS, {2, 3})
HOLIDAYS_SQL = values("holidays", "dt", [(h,) for h in HOLIDAYS], {0})
REGIONS_SQL = "regions AS (SELECT n_name branch, n_nationkey % 2 + 1 region, CASE WHEN n_name = 'NATION_7' THEN NULL WHEN n_nationkey % 2 = 0 THEN [0, 3] ELSE [1, 4] END AS days FROM nation)"


def panel_sql(days: str = "sales", name: str = "panel", closed: bool = True) -> str:
    """CTEs that end in a dense panel (item, branch, dt, qty, segment_id)."""
    shut = "WHERE NOT EXISTS (SELECT 1 FROM closures c WHERE c.branch = g.branch AND g.dt >= c.start_dt AND (c.end_dt IS NULL OR g.dt < c.end_dt))" if closed else ""
    mark = "OR EXISTS (SELECT 1 FROM breaks b WHERE b.branch = p.branch AND b.dt = p.dt)" if closed else ""
    return f"""{name}_span AS (SELECT item, branch, MIN(dt) a, MAX(dt) b FROM {days} GROUP BY 1, 2),
{name}_grid AS (SELECT item, branch, CAST(UNNEST(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) dt FROM {name}_span),
{name}_open AS (SELECT g.item, g.branch, g.dt, COALESCE(s.qty, 0) qty FROM {name}_grid g LEFT JOIN {days} s ON s.item = g.item AND s.branch = g.branch AND s.dt = g.dt {shut}),
{name}_prev AS (SELECT *, LAG(dt) OVER (PARTITION BY item, branch ORDER BY dt) before FROM {name}_open),
{name}_mark AS (SELECT item, branch, dt, qty, CASE WHEN before IS NOT NULL AND (dt - before > 1 {mark}) THEN 1 ELSE 0 END nw FROM {name}_prev p),
{name} AS (SELECT item, branch, dt, qty, CAST(1 + SUM(nw) OVER (PARTITION BY item, branch ORDER BY dt ROWS UNBOUNDED PRECEDING) AS INT) segment_id FROM {name}_mark)"""


BASE = ",\n".join([SALES, CLOSURES_SQL, BREAKS_SQL, panel_sql()])
LEAD = "list_min(list_filter([1, 2, 3, 4, 5, 6, 7], lambda x: list_contains(r.days, (isodow(p.dt) - 1 + x) % 7)))"
LEADS = f"{BASE},\n{REGIONS_SQL},\nled AS (SELECT p.*, r.region, r.days, CAST({LEAD} AS INT) lead_time_days FROM panel p LEFT JOIN regions r ON r.branch = p.branch)"
EV_BASE = events_sql("ev", 150) + ",\n" + panel_sql("ev", "panel", closed=False)
EC_BASE = events_sql("ev", 10) + ",\n" + panel_sql("ev", "panel", closed=False)
W = "PARTITION BY item, branch, segment_id ORDER BY dt"
