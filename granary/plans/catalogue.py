"""Registry of the demand-panel queries and their SQL oracles.

Each query applies one operator to a view of the driver tables; its oracle is an independent
DuckDB query. Columns are cast and rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as K
from ..functions import text as T
from ..operators import canon, demand, explore, metrics, panel, qa, sequences, windows
from ..sources.lineage import cut, scratch_folder
from ..streaming.daily import DailyTable
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CUT = f"DATE '{V.CUTOFF}'"
EV_CUT = f"DATE '{V.EV_CUTOFF}'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _texts(sql: str) -> str:
    return f"WITH t AS ({V.TEXTS_SQL}) {sql}"


def _panel(spark, d) -> DataFrame:
    return panel.dense_panel(V.sales(spark, d), V.closures(spark), V.breakpoints(spark))


def _bare(spark, d) -> DataFrame:
    """The panel without carried columns."""
    return panel.dense_panel(V.sales(spark, d).drop(*panel.CARRY), V.closures(spark), V.breakpoints(spark))


def _led(spark, d) -> DataFrame:
    return demand.region_features(_bare(spark, d), V.regions(spark, d))


def _ev(spark, d, buckets=150) -> DataFrame:
    return panel.dense_panel(V.events(spark, d, buckets))


# --- text --------------------------------------------------------------------------------

STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
NAME = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(item_name, '^xxx\\.\\s*', '', 'i'), '\\s*\\([^)]*\\)\\s*$', ''),"
    " '([0-9])([a-z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))"
)
NEEDLE = "trim(regexp_replace(regexp_replace(branch, '^KY\\d+\\s*-\\s*', '', 'i'), '\\s*\\([^)]*\\)\\s*$', ''))"
PREFIX = "regexp_replace({}, '^xxx\\.\\s*', '', 'i')"
DASH = "regexp_replace({}, '([A-Za-z])\\.([0-9])', '\\1-\\2', 'g')"


@query(_texts(f"SELECT k, {PREFIX.format('item')} AS out FROM t"))
def txt_strip_prefix(spark, d):
    return V.texts(spark, d).select("k", T.strip_prefix(F.col("item")).alias("out"))


@query(_texts(f"SELECT k, {DASH.format('item')} AS out FROM t"))
def txt_separator(spark, d):
    return V.texts(spark, d).select("k", T.unify_separator(F.col("item")).alias("out"))


@query(_texts(f"SELECT k, {NAME} AS out FROM t"))
def txt_name_norm(spark, d):
    return V.texts(spark, d).select("k", T.comparable_name(F.col("item_name")).alias("out"))


@query(_texts(f"SELECT k, {NEEDLE} AS out FROM t"))
def txt_branch_strip(spark, d):
    return V.texts(spark, d).select("k", T.branch_needle(F.col("branch")).alias("out"))


@query(_texts("SELECT k, CASE k % 5 WHEN 0 THEN '0,3' WHEN 1 THEN '1,4' WHEN 2 THEN '5' WHEN 3 THEN '2' END AS out FROM t"))
def txt_delivery_days(spark, d):
    return V.texts(spark, d).select("k", F.array_join(T.delivery_days(F.col("days_text")).cast("array<string>"), ",").alias("out"))


@query(_texts("SELECT k, COALESCE(NULLIF(trim(city_override), ''), trim(city), 'Unknown') AS out FROM t"))
def txt_city(spark, d):
    return V.texts(spark, d).select("k", T.city(F.col("city_override"), F.col("city")).alias("out"))


@query(_texts("SELECT k, lower(trim(flag_text)) = 'yes' AS out FROM t"))
def txt_yes_bool(spark, d):
    return V.texts(spark, d).select("k", T.yes(F.col("flag_text")).alias("out"))


@query(_texts("SELECT k, CAST(strptime(dt_text, '%d %b %Y') AS DATE) AS dt, CAST(replace(qty_text, ',', '.') AS DOUBLE) AS qty FROM t"))
def txt_parse_date_qty(spark, d):
    return V.texts(spark, d).select("k", T.parse_date(F.col("dt_text")).alias("dt"), T.parse_quantity(F.col("qty_text")).alias("qty"))


# --- canonical items and branches ----------------------------------------------------------

PASS1 = f"""c AS (SELECT DISTINCT item code, {NAME} nm, {PREFIX.format('item')} tc FROM t),
g AS (SELECT tc, COUNT(DISTINCT nm) n FROM c GROUP BY 1),
m1 AS (SELECT DISTINCT c.code, CASE WHEN g.n = 1 THEN c.tc ELSE c.code END mapped FROM c JOIN g USING (tc))"""
PASS2 = f"""{PASS1},
d AS (SELECT DISTINCT m1.mapped code, {NAME} nm, {DASH.format('m1.mapped')} tc FROM t JOIN m1 ON m1.code = t.item),
h AS (SELECT tc, COUNT(DISTINCT nm) n FROM d GROUP BY 1),
m2 AS (SELECT DISTINCT d.code, CASE WHEN h.n = 1 THEN d.tc ELSE d.code END final FROM d JOIN h USING (tc)),
m AS (SELECT m1.code, m2.final mapped FROM m1 JOIN m2 ON m2.code = m1.mapped)"""


@query(f"WITH t AS ({V.TEXTS_SQL}), {PASS1} SELECT * FROM m1")
def can_code_map_pass1(spark, d):
    return canon.conditional_map(V.texts(spark, d), T.strip_prefix)


@query(f"WITH t AS ({V.TEXTS_SQL}), {PASS2} SELECT * FROM m")
def can_code_map(spark, d):
    return canon.code_map(V.texts(spark, d))


@query(f"WITH t AS ({V.TEXTS_SQL}), {PASS2} SELECT k, COALESCE(m.mapped, item) AS item FROM t LEFT JOIN m ON m.code = t.item")
def can_apply_codes(spark, d):
    t = V.texts(spark, d)
    return canon.apply_codes(t, canon.code_map(t)).select("k", "item")


@query(_texts("SELECT k, item, COALESCE(MIN(CASE WHEN NOT starts_with(lower(item_name), 'xxx.') THEN item_name END) OVER (PARTITION BY item), item_name) AS item_name FROM t"))
def can_names(spark, d):
    return canon.canonical_names(V.texts(spark, d)).select("k", "item", "item_name")


SYN = "CASE category WHEN 'Minuman' THEN 'Minuman - FG' WHEN 'Snack' THEN 'Snack (FG)' ELSE category END"


@query(_texts(f", g AS (SELECT item, COUNT(DISTINCT {SYN}) n, MIN({SYN}) one FROM t GROUP BY 1) SELECT k, t.item, CASE WHEN t.item = 'FGS-00014' THEN 'Minuman - FG' WHEN n = 1 THEN COALESCE(one, category) ELSE category END AS category FROM t JOIN g USING (item)"))
def can_categories(spark, d):
    return canon.canonical_categories(V.texts(spark, d)).select("k", "item", "category")


@query(_texts("SELECT k, CASE WHEN unit = 'Gr' AND item = 'FGS-00005' THEN qty / 40 WHEN unit = 'Gr' AND item = 'FGS-00009' THEN qty / 30 ELSE qty END AS qty, CASE WHEN unit = 'Gr' AND item IN ('FGS-00005', 'FGS-00009') THEN 'Porsi' ELSE unit END AS unit FROM t"))
def prj_unit_convert(spark, d):
    return canon.grams_to_portions(V.texts(spark, d), {"FGS-00005": 40.0, "FGS-00009": 30.0}).select("k", "qty", "unit")


@query(_texts("SELECT k FROM t WHERE flag_text IS NULL OR flag_text NOT IN ('no')"))
def prj_exclude(spark, d):
    return canon.exclude(V.texts(spark, d), "flag_text", ["no"]).select("k")


@query(_texts("SELECT k, CASE item WHEN 'FGS-00001' THEN 'NEW-1' WHEN 'FGS.00002' THEN 'NEW-2' ELSE item END AS item, CASE item WHEN 'FGS-00001' THEN 'New one' ELSE item_name END AS item_name FROM t"))
def prj_rename(spark, d):
    renames = spark.createDataFrame([("FGS-00001", "NEW-1", "New one"), ("FGS.00002", "NEW-2", None)], "code string, new_code string, new_name string")
    return canon.rename_items(V.texts(spark, d), renames).select("k", "item", "item_name")


OUTLETS = """o AS (SELECT 'Resto Nation_' || substr(n_name, 8) outlet, 'Kota ' || CAST(n_nationkey % 5 AS VARCHAR) city,
  CASE n_nationkey % 2 WHEN 0 THEN true WHEN 1 THEN false END has_shopee, CASE n_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END has_gofood, CASE n_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN false END has_grabfood FROM nation)"""
MATCH = f"""{OUTLETS}, {V.values('v', 'branch, outlet, city_override', V.OVERRIDES)}, b AS (SELECT DISTINCT branch FROM t),
free AS (SELECT b.branch, o.outlet FROM b JOIN o ON contains(lower(o.outlet), lower({NEEDLE.replace('branch', 'b.branch')})) WHERE b.branch NOT IN (SELECT branch FROM v)),
matched AS (SELECT b.branch, v.outlet, v.city_override FROM b JOIN v USING (branch) WHERE v.outlet IN (SELECT outlet FROM o)
  UNION ALL SELECT branch, MIN(outlet), NULL FROM free GROUP BY 1 HAVING COUNT(*) = 1)"""


def _matches(spark, d):
    return canon.match_branches(V.texts(spark, d), V.outlets(spark, d), V.overrides(spark))


@query(f"WITH t AS ({V.TEXTS_SQL}), {MATCH} SELECT * FROM matched")
def jn_branch_match(spark, d):
    return _matches(spark, d)


@query(f"WITH t AS ({V.TEXTS_SQL}), {MATCH} SELECT k FROM t WHERE branch IN (SELECT branch FROM matched)")
def jn_matched_semi(spark, d):
    return canon.keep_matched(V.texts(spark, d), _matches(spark, d)).select("k")


@query(f"WITH t AS ({V.TEXTS_SQL}), {MATCH} SELECT k, COALESCE(m.outlet, t.branch) AS branch FROM t LEFT JOIN matched m ON m.branch = t.branch")
def jn_canonical_branch(spark, d):
    return canon.canonical_branches(V.texts(spark, d), _matches(spark, d)).select("k", "branch")


@query(
    f"""WITH t AS ({V.TEXTS_SQL}), {MATCH} SELECT k, COALESCE(NULLIF(trim(m.city_override), ''), o.city, 'Unknown') AS city, has_shopee, has_gofood, has_grabfood,
    CASE WHEN has_shopee IS NOT NULL AND has_gofood IS NOT NULL AND has_grabfood IS NOT NULL THEN has_shopee OR has_gofood OR has_grabfood END AS can_order_online
    FROM t LEFT JOIN matched m ON m.branch = t.branch LEFT JOIN o ON o.outlet = m.outlet"""
)
def jn_outlet_features(spark, d):
    features = canon.outlet_features(_matches(spark, d), V.outlets(spark, d))
    return canon.add_outlet_features(V.texts(spark, d).drop("city"), features).select("k", "city", "has_shopee", "has_gofood", "has_grabfood", "can_order_online")


# --- joins on the panel --------------------------------------------------------------------


@query(f"WITH {V.LEADS} SELECT item, branch, dt, region, lead_time_days, COALESCE(list_contains(days, isodow(dt) - 1), false) AS is_delivery_day FROM led")
def jn_region(spark, d):
    return _led(spark, d).select("item", "branch", "dt", "region", "lead_time_days", "is_delivery_day")


@query(f"WITH {V.SALES}, {V.CLOSURES_SQL} SELECT item, branch, dt, qty FROM sales s WHERE NOT EXISTS (SELECT 1 FROM closures c WHERE c.branch = s.branch AND s.dt >= c.start_dt AND (c.end_dt IS NULL OR s.dt < c.end_dt))")
def jn_closure_anti(spark, d):
    return panel.drop_closed(V.sales(spark, d), V.closures(spark)).select("item", "branch", "dt", "qty")


GAPS = """g AS (SELECT branch, dt, LAG(dt) OVER (PARTITION BY branch ORDER BY dt) b FROM (SELECT DISTINCT branch, dt FROM ev)),
gaps AS (SELECT branch, b + 1 gap_start, dt - 1 gap_end, dt - b - 1 AS days FROM g WHERE dt - b - 1 >= 2)"""
EV_SHUT = [("u3", "2024-01-01", "2024-01-16"), ("u5", "2024-01-10", None)]


@query(f"WITH {V.events_sql('ev', 150)}, {V.values('shut', 'branch, a, z', EV_SHUT, {1, 2})}, {GAPS} SELECT branch, gap_start, gap_end, CAST(days AS INT) AS days FROM gaps WHERE NOT EXISTS (SELECT 1 FROM shut s WHERE s.branch = gaps.branch AND s.a <= gap_start AND (s.z IS NULL OR gap_end < s.z))")
def jn_unrecorded_gaps(spark, d):
    shut = V.dims(spark, EV_SHUT, "branch string, start_dt string, end_dt string", ["start_dt", "end_dt"])
    return panel.unrecorded_gaps(V.events(spark, d, 150), shut, 2)


@query(f"WITH {V.SALES}, {V.MOVES_SQL} SELECT item, s.branch, dt, CAST(dt - moved AS INT) AS days_since_relocation FROM sales s LEFT JOIN moves m ON m.branch = s.branch")
def jn_relocation(spark, d):
    return demand.days_since_relocation(V.sales(spark, d), V.relocations(spark)).select("item", "branch", "dt", "days_since_relocation")


@query(f"WITH {V.SALES} SELECT item, branch, dt, length(item) % 2 = 0 AS is_event_driven FROM sales")
def jn_event_flag(spark, d):
    s = V.sales(spark, d)
    return demand.event_flag(s, s.select("item", (F.length("item") % 2 == 0).alias("is_event_driven")).distinct()).select("item", "branch", "dt", "is_event_driven")


@query(
    f"""WITH {V.EV_BASE}, n AS (SELECT item, branch, COUNT(*) FILTER (WHERE dt < {EV_CUT}) n FROM panel GROUP BY 1, 2), bad AS (SELECT * FROM n WHERE n < 10),
    good AS (SELECT * FROM n WHERE n >= 10) SELECT item, branch, n, CASE WHEN item NOT IN (SELECT item FROM good) THEN 'new item' WHEN branch NOT IN (SELECT branch FROM good) THEN 'new branch' ELSE 'other' END AS reason FROM bad"""
)
def jn_failing_pairs(spark, d):
    return explore.failing_pairs(_ev(spark, d), V.EV_CUTOFF, 10)


# --- aggregates ----------------------------------------------------------------------------


@query(_texts("SELECT dt_text, item, branch, ROUND(SUM(qty), 1) AS qty FROM t GROUP BY 1, 2, 3"))
def agg_dedup_sum(spark, d):
    return explore.dedup_sum(V.texts(spark, d), ["dt_text", "item", "branch"])


@query(_texts("SELECT item, branch, CAST(strptime(dt_text, '%d %b %Y') AS DATE) dt, SUM(qty) AS qty, MIN(category) AS category, MIN(item_name) AS item_name, MIN(unit) AS unit FROM t GROUP BY 1, 2, 3"))
def agg_daily(spark, d):
    return panel.daily(V.texts(spark, d).withColumn("dt", T.parse_date(F.col("dt_text"))))


BASELINE = f"""base AS (SELECT item, branch, COUNT(*) n, median(qty) median_qty, bool_and(qty % 1 = 0) all_whole, COUNT(*) >= 5 AND median(qty) > 0 eligible
  FROM panel WHERE dt < {EV_CUT} AND qty > 0 GROUP BY 1, 2)"""


@query(f"WITH {V.EV_BASE}, {BASELINE} SELECT item, branch, n, ROUND(median_qty, 6) AS median_qty, all_whole, eligible FROM base")
def agg_pair_baseline(spark, d):
    return r6(demand.pair_baseline(_ev(spark, d), V.EV_CUTOFF, 5), "median_qty")


STATS = """stats AS (SELECT item, branch, COUNT(*) n_days, COUNT(*) FILTER (WHERE qty > 0) n_nonzero, CAST(COUNT(*) AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE qty > 0), 0) adi,
  COALESCE(POWER(stddev_pop(qty) FILTER (WHERE qty > 0) / NULLIF(AVG(qty) FILTER (WHERE qty > 0), 0), 2), 0) cv2 FROM panel WHERE dt < {} GROUP BY 1, 2)"""
LABEL = """CASE WHEN adi IS NULL THEN 'lumpy' WHEN adi < 1.32 THEN CASE WHEN cv2 < 0.49 THEN 'smooth' ELSE 'erratic' END WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END"""


def _stats(base: str) -> str:
    return f"WITH {base}, {STATS.format(EV_CUT)} SELECT item, branch, n_days, n_nonzero, ROUND(adi, 6) AS adi, ROUND(cv2, 6) AS cv2 FROM stats"


@query(_stats(V.EV_BASE))
def agg_demand_stats(spark, d):
    return r6(demand.demand_stats(_ev(spark, d), V.EV_CUTOFF), "adi", "cv2")


@query(_stats(V.EC_BASE))
def agg_demand_stats_coarse(spark, d):
    return r6(demand.demand_stats(_ev(spark, d, 10), V.EV_CUTOFF), "adi", "cv2")


def _class(base: str) -> str:
    return f"WITH {base}, {STATS.format(EV_CUT)}, pairs AS (SELECT DISTINCT item, branch FROM panel) SELECT p.item, p.branch, COALESCE({LABEL}, 'lumpy') AS demand_segment FROM pairs p LEFT JOIN stats s ON s.item = p.item AND s.branch = p.branch"


@query(_class(V.EV_BASE))
def cls_demand(spark, d):
    return demand.classify(_ev(spark, d), V.EV_CUTOFF).select("item", "branch", "demand_segment").distinct()


@query(_class(V.EC_BASE))
def cls_demand_coarse(spark, d):
    return demand.classify(_ev(spark, d, 10), V.EV_CUTOFF).select("item", "branch", "demand_segment").distinct()


BRANCH = f"""tot AS (SELECT branch, dt, SUM(qty) total FROM panel WHERE dt < {CUT} GROUP BY 1, 2),
bs AS (SELECT branch, AVG(total) a, stddev_samp(total) / NULLIF(AVG(total), 0) cv FROM tot GROUP BY 1),
tier AS (SELECT branch, a, cv, ROW_NUMBER() OVER (ORDER BY a, branch) r, COUNT(*) OVER () n FROM bs),
stats AS (SELECT branch, a, cv, CASE WHEN n < 2 THEN 'small' ELSE ['small', 'medium', 'large', 'flagship'][CAST(greatest(1, ceil((r - 1) * least(4, n) / CAST(n - 1 AS DOUBLE))) AS INT)] END tier FROM tier)"""


@query(f"WITH {V.BASE}, {BRANCH} SELECT branch, ROUND(a, 6) AS branch_avg_daily_qty, ROUND(cv, 6) AS branch_demand_cv FROM stats")
def agg_branch_stats(spark, d):
    return r6(demand.branch_stats(_bare(spark, d), V.CUTOFF, "qty").drop("branch_volume_tier"), "branch_avg_daily_qty", "branch_demand_cv")


@query(f"WITH {V.BASE}, {BRANCH} SELECT branch, tier AS branch_volume_tier FROM stats")
def bin_volume_tier(spark, d):
    return demand.branch_stats(_bare(spark, d), V.CUTOFF, "qty").select("branch", "branch_volume_tier")


@query(f"WITH {V.BASE} SELECT item, branch, dt, CAST(dt - MIN(dt) OVER (PARTITION BY branch) AS INT) AS branch_age_days FROM panel")
def agg_branch_age(spark, d):
    return demand.branch_age(_bare(spark, d)).select("item", "branch", "dt", "branch_age_days")


@query(f"WITH {V.SALES} SELECT branch, COUNT(DISTINCT dt) AS n_days, MIN(dt) AS first_dt, MAX(dt) AS last_dt, CAST(MAX(dt) - MIN(dt) + 1 AS INT) AS expected, ROUND(100.0 * COUNT(DISTINCT dt) / CAST(MAX(dt) - MIN(dt) + 1 AS DOUBLE), 6) AS pct FROM sales GROUP BY 1")
def agg_completeness(spark, d):
    return r6(explore.completeness(V.sales(spark, d)).withColumn("pct", F.col("pct").cast("double")), "pct")


@query(f"WITH {V.events_sql('ev', 150)}, s AS (SELECT branch, MIN(dt) a, MAX(dt) b FROM ev GROUP BY 1), g AS (SELECT branch, CAST(UNNEST(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) dt FROM s) SELECT branch, dt FROM g WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.branch = g.branch AND e.dt = g.dt)")
def agg_missing_dates(spark, d):
    return explore.missing_dates(V.events(spark, d, 150))


@query(_texts("SELECT item, COUNT(DISTINCT unit) AS n_unit, COUNT(DISTINCT category) AS n_category, COUNT(DISTINCT branch) AS n_branch FROM t GROUP BY 1"))
def agg_consistency(spark, d):
    return explore.consistency(V.texts(spark, d), "item", ["unit", "category", "branch"])


@query(f"WITH {V.events_sql('ev', 150)} SELECT dt, branch, COUNT(DISTINCT item) AS n_items, ROUND(SUM(qty), 6) AS qty FROM ev GROUP BY 1, 2 HAVING COUNT(DISTINCT item) >= 3")
def agg_event_days(spark, d):
    return r6(explore.event_days(V.events(spark, d, 150), 3), "qty")


DOW = "tot AS (SELECT branch, dt, SUM(qty) total FROM sales GROUP BY 1, 2), dow AS (SELECT branch, CAST(isodow(dt) - 1 AS INT) dow, AVG(total) m FROM tot GROUP BY 1, 2)"


@query(f"WITH {V.SALES}, {DOW} SELECT branch, dow, ROUND(m, 6) AS mean_qty FROM dow")
def agg_dow_profile(spark, d):
    return r6(explore.weekday_profile(V.sales(spark, d)), "mean_qty")


@query(f"WITH {V.SALES}, {DOW}, x AS (SELECT branch, dow, 100 * (m / AVG(m) OVER (PARTITION BY branch) - 1) v FROM dow) SELECT branch, " + ", ".join(f"ROUND(MAX(v) FILTER (WHERE dow = {i}), 6) AS dow_{i}" for i in range(7)) + " FROM x GROUP BY 1")
def piv_branch_dow(spark, d):
    return r6(explore.weekday_pivot(V.sales(spark, d)), *[f"dow_{i}" for i in range(7)])


@query(f"WITH {V.EV_BASE} SELECT item, branch, ROUND(100 * AVG(CASE WHEN qty = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_pct, COUNT(*) AS n_days FROM panel GROUP BY 1, 2")
def agg_zero_pct(spark, d):
    return r6(explore.zero_share(_ev(spark, d)), "zero_pct")


@query(f"WITH {V.EC_BASE}, s AS (SELECT item, branch, CASE WHEN COUNT(qty) OVER w = 3 THEN SUM(qty) OVER w END s FROM panel WINDOW w AS ({V.W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT item, branch, ROUND(stddev_samp(s) / NULLIF(AVG(s), 0), 6) AS cv FROM s WHERE s IS NOT NULL GROUP BY 1, 2")
def agg_cv_rolling(spark, d):
    return r6(explore.rolling_variation(_ev(spark, d, 10)), "cv")


_PROFILE = ["flag_text", "days_text", "city", "category", "unit"]


@query(_texts(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {c} IS NULL) AS n_null, COUNT(DISTINCT {c}) AS n_distinct FROM t" for c in _PROFILE)))
def agg_null_profile(spark, d):
    return explore.null_profile(V.texts(spark, d).select(*_PROFILE))


# --- panel ---------------------------------------------------------------------------------


@query(f"WITH {V.SALES}, {V.panel_sql(closed=False)} SELECT item, branch, dt, qty FROM panel")
def pan_dense(spark, d):
    return panel.dense_panel(V.sales(spark, d).drop(*panel.CARRY)).select("item", "branch", "dt", "qty")


@query(f"WITH {V.BASE} SELECT item, branch, dt, qty FROM panel")
def pan_closures(spark, d):
    return _bare(spark, d).select("item", "branch", "dt", "qty")


@query(f"WITH {V.BASE} SELECT item, branch, dt, segment_id FROM panel")
def pan_segments(spark, d):
    return _bare(spark, d).select("item", "branch", "dt", "segment_id")


CARRIED = ", ".join(f"COALESCE(LAST_VALUE(s.{c} IGNORE NULLS) OVER (PARTITION BY p.item, p.branch ORDER BY p.dt ROWS UNBOUNDED PRECEDING), FIRST_VALUE(s.{c} IGNORE NULLS) OVER (PARTITION BY p.item, p.branch ORDER BY p.dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}" for c in panel.CARRY)


@query(f"WITH {V.BASE} SELECT p.item, p.branch, p.dt, {CARRIED} FROM panel p LEFT JOIN sales s ON s.item = p.item AND s.branch = p.branch AND s.dt = p.dt")
def pan_carry(spark, d):
    return _panel(spark, d).select("item", "branch", "dt", *panel.CARRY)


@query(f"WITH {V.EV_BASE}, ok AS (SELECT item, branch FROM panel WHERE dt < {EV_CUT} GROUP BY 1, 2 HAVING COUNT(*) >= 15) SELECT item, branch, dt, qty FROM panel SEMI JOIN ok USING (item, branch)")
def pan_min_history(spark, d):
    return panel.enough_history(_ev(spark, d), V.EV_CUTOFF, 15).select("item", "branch", "dt", "qty")


@query(f"WITH {V.BASE}, n AS (SELECT *, ROW_NUMBER() OVER ({V.W}) n FROM panel) SELECT item, branch, dt, segment_id FROM n WHERE n > 28")
def pan_warmup(spark, d):
    return panel.without_warmup(_bare(spark, d)).select("item", "branch", "dt", "segment_id")


@query(f"WITH {V.SALES}, c AS (SELECT CAST(UNNEST(generate_series((SELECT MIN(dt) FROM sales)::TIMESTAMP, (SELECT MAX(dt) FROM sales)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) dt), b AS (SELECT DISTINCT branch FROM sales), t AS (SELECT branch, dt, SUM(qty) q FROM sales GROUP BY 1, 2) SELECT b.branch, c.dt, COALESCE(t.q, 0) AS qty FROM b CROSS JOIN c LEFT JOIN t ON t.branch = b.branch AND t.dt = c.dt")
def pan_branch_matrix(spark, d):
    return panel.branch_matrix(V.sales(spark, d))


# --- windows -------------------------------------------------------------------------------


@query(f"WITH {V.BASE} SELECT item, branch, dt, " + ", ".join(f"LEAD(qty, {h}) OVER w AS target_h{h}" for h in windows.HORIZONS) + f" FROM panel WINDOW w AS ({V.W})")
def win_targets(spark, d):
    return _bare(spark, d).select("item", "branch", "dt", *[c.alias(k) for k, c in windows.target_columns().items()])


@query(f"WITH {V.BASE} SELECT item, branch, dt, " + ", ".join(f"LAG(qty, {k}) OVER w AS lag_{k}" for k in windows.LAGS) + f" FROM panel WINDOW w AS ({V.W})")
def win_lags(spark, d):
    return _bare(spark, d).select("item", "branch", "dt", *[c.alias(k) for k, c in windows.lag_columns("qty").items()])


ROLLS = ", ".join(f"CASE WHEN COUNT(qty) OVER w{w} = {w} THEN ROUND(AVG(qty) OVER w{w}, 6) END AS roll_mean_{w}, CASE WHEN COUNT(qty) OVER w{w} = {w} THEN ROUND(stddev_samp(qty) OVER w{w}, 6) END AS roll_std_{w}" for w in windows.WINDOWS)
ROLL_WINDOWS = ", ".join(f"w{w} AS ({V.W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in windows.WINDOWS)


@query(f"WITH {V.BASE} SELECT item, branch, dt, {ROLLS} FROM panel WINDOW {ROLL_WINDOWS}")
def win_rolling(spark, d):
    return _bare(spark, d).select("item", "branch", "dt", *[F.round(c, 6).alias(k) for k, c in windows.rolling_columns("qty").items()])


LEAD_SUM = "CASE lead_time_days " + " ".join(f"WHEN {w} THEN CASE WHEN COUNT(qty) OVER a{w} = {w} THEN SUM(qty) OVER a{w} END" for w in range(1, 8)) + " END"
LEAD_WINDOWS = ", ".join(f"a{w} AS ({V.W} ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING)" for w in range(1, 8))


@query(f"WITH {V.LEADS} SELECT item, branch, dt, lead_time_days, {LEAD_SUM} AS target FROM led WINDOW {LEAD_WINDOWS}")
def win_lead_target(spark, d):
    return _led(spark, d).select("item", "branch", "dt", "lead_time_days", windows.lead_target().alias("target"))


@query(f"WITH {V.BASE} SELECT item, branch, dt, " + ", ".join(f"CASE WHEN COUNT(qty) OVER w{n} = {n} THEN SUM(qty) OVER w{n} END AS sum_{n}" for n in (3, 4)) + " FROM panel WINDOW " + ", ".join(f"w{n} AS ({V.W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, 4)))
def win_trailing_sums(spark, d):
    return _bare(spark, d).select("item", "branch", "dt", *[c.alias(k) for k, c in windows.trailing_sums().items()])


@query(f"WITH {V.BASE} SELECT item, branch, dt, ROUND(AVG(qty) OVER ({V.W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS mean_7 FROM panel")
def win_partial_mean(spark, d):
    return _bare(spark, d).select("item", "branch", "dt", F.round(windows.partial_mean(), 6).alias("mean_7"))


@query("WITH t AS (SELECT p_name || p_brand item, SUM(l_quantity) qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), c AS (SELECT *, ROW_NUMBER() OVER (ORDER BY qty DESC, item) rank, SUM(qty) OVER (ORDER BY qty DESC, item ROWS UNBOUNDED PRECEDING) / SUM(qty) OVER () s FROM t) SELECT item, qty, CAST(rank AS INT) AS rank, ROUND(s, 6) AS cum_share, rank <= MIN(CASE WHEN s >= 0.8 THEN rank END) OVER () AS is_head FROM c")
def win_pareto(spark, d):
    rows = V.table(spark, d, "lineitem").join(V.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    totals = rows.groupBy(F.concat("p_name", "p_brand").alias("item")).agg(F.sum("l_quantity").alias("qty"))
    return r6(windows.pareto(totals, "item"), "cum_share")


@query(f"WITH {V.SALES} SELECT item, branch, dt, COUNT(*) OVER (PARTITION BY item, branch) AS n, median(qty) OVER (PARTITION BY item, branch) AS median_qty FROM sales")
def win_transform(spark, d):
    return explore.group_values(V.sales(spark, d).select("item", "branch", "dt", "qty"), ["item", "branch"], {"n": F.count("*"), "median_qty": F.median("qty")}).drop("qty")


@query(f"WITH {V.EC_BASE}, n AS (SELECT item, branch, dt, ROW_NUMBER() OVER ({V.W}) n, SUM(qty) OVER w s, MIN(qty) OVER w lo, MAX(qty) OVER w hi FROM panel WINDOW w AS ({V.W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) SELECT item, branch, dt, 7 AS len, ROUND(s, 2) AS s, ROUND(lo, 2) AS lo, ROUND(hi, 2) AS hi FROM n WHERE n > 7")
def win_sequences(spark, d):
    x = windows.sequences(_ev(spark, d, 10), ["qty"], "qty", 7)  # windows are made in an Arrow pass over packed segments
    flat = F.transform("window", lambda r: F.round(r[0].cast("double"), 2))
    total = F.aggregate(flat, F.lit(0.0), lambda a, v: a + v)
    return x.select("item", "branch", "dt", F.size("window").alias("len"), F.round(total, 2).alias("s"), F.array_min(flat).alias("lo"), F.array_max(flat).alias("hi"))


# --- calendar ------------------------------------------------------------------------------

DAYS = "days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) dt FROM lineitem)"


def _days(spark, d) -> DataFrame:
    return V.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("dt")).distinct()


@query(f"WITH {DAYS} SELECT dt, CAST(isodow(dt) - 1 AS INT) AS day_of_week, CAST(day(dt) AS INT) AS day_of_month, CAST(month(dt) AS INT) AS month, isodow(dt) >= 6 AS is_weekend FROM days")
def cal_basic(spark, d):
    x = V.CALENDAR.basic(F.col("dt"))
    x.pop("is_national_holiday")
    return _days(spark, d).withColumns(x)


@query(f"WITH {DAYS}, {V.HOLIDAYS_SQL} SELECT dt, dt IN (SELECT dt FROM holidays) AS is_national_holiday FROM days")
def cal_holiday(spark, d):
    return _days(spark, d).select("dt", V.CALENDAR.basic(F.col("dt"))["is_national_holiday"].alias("is_national_holiday"))


@query(f"WITH {DAYS}, {V.FEASTS_SQL} SELECT dt, dt BETWEEN a AND b AS is_ramadan, CASE WHEN dt BETWEEN a AND b THEN CAST(dt - a AS INT) END AS days_into_ramadan, CASE WHEN dt < a THEN CAST(a - dt AS INT) END AS days_until_ramadan FROM days JOIN feasts ON y = year(dt) AND event = 'ramadan'")
def cal_ramadan(spark, d):
    return _days(spark, d).withColumns(V.CALENDAR.ramadan(F.col("dt")))


def _near(name: str, day: str, coming: str | None = None) -> str:
    coming = coming or day
    return f"dt = {day} AS is_{name}, CASE WHEN dt - {day} BETWEEN 0 AND 14 THEN CAST(dt - {day} AS INT) END AS days_since_{name}, CASE WHEN {coming} - dt BETWEEN 0 AND 14 THEN CAST({coming} - dt AS INT) END AS days_until_{name}"


@query(f"WITH {DAYS}, {V.FEASTS_SQL} SELECT dt, {_near('eid_al_fitr', 'f.a')}, {_near('eid_al_adha', 'g.a')} FROM days JOIN feasts f ON f.y = year(dt) AND f.event = 'eid_al_fitr' JOIN feasts g ON g.y = year(dt) AND g.event = 'eid_al_adha'")
def cal_eid(spark, d):
    return _days(spark, d).withColumns(V.CALENDAR.feast("eid_al_fitr", F.col("dt")) | V.CALENDAR.feast("eid_al_adha", F.col("dt")))


@query(f"WITH {DAYS} SELECT dt, {_near('independence_day', 'make_date(year(dt), 8, 17)')}, {_near('new_year', 'make_date(year(dt), 1, 1)', '(CASE WHEN month(dt) = 1 AND day(dt) = 1 THEN dt ELSE make_date(year(dt) + 1, 1, 1) END)')} FROM days")
def cal_fixed_days(spark, d):
    return _days(spark, d).withColumns(V.CALENDAR.fixed(F.col("dt")))


@query(f"WITH {V.LEADS} SELECT item, branch, dt, CASE WHEN lead_time_days IS NOT NULL THEN CAST(len(list_filter(range(1, lead_time_days + 1), lambda x: (isodow(dt) - 1 + x) % 7 >= 5)) AS INT) END AS weekend_days FROM led")
def cal_target_weekend(spark, d):
    return _led(spark, d).select("item", "branch", "dt", K.weekend_days_ahead(F.col("dt"), F.col("lead_time_days")).alias("weekend_days"))


# --- domain --------------------------------------------------------------------------------


EVERY_DAY = "days AS (SELECT CAST(UNNEST(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS DATE) dt)"


@query(f"WITH {EVERY_DAY}, {V.REGIONS_SQL} SELECT p.dt, r.branch, CAST({V.LEAD} AS INT) AS lead_time_days FROM days p CROSS JOIN regions r")
def lt_lead_time(spark, d):
    x = V.regions(spark, d).select("branch", "ship_days", F.explode(F.expr("sequence(date'1995-01-01', date'2001-12-31')")).alias("dt"))
    return x.select("dt", "branch", K.lead_time(F.col("dt"), F.col("ship_days")).alias("lead_time_days"))


@query(f"WITH {EVERY_DAY}, {V.REGIONS_SQL} SELECT dt, branch, COALESCE(list_contains(days, isodow(dt) - 1), false) AS is_delivery_day FROM days CROSS JOIN (SELECT branch, days FROM regions) r".replace("r.days", "days"))
def lt_delivery_flag(spark, d):
    x = V.regions(spark, d).select("branch", "ship_days", F.explode(F.expr("sequence(date'1995-01-01', date'2001-12-31')")).alias("dt"))
    return x.select("dt", "branch", K.is_delivery_day(F.col("dt"), F.col("ship_days")).alias("is_delivery_day"))


CAPPED = f"""{V.EV_BASE}, {BASELINE}, cap AS (SELECT p.*, CASE WHEN COALESCE(eligible, false) THEN qty / median_qty END ratio, median_qty, all_whole,
  month(dt) = 1 AND day(dt) = 1 is_new_year FROM panel p LEFT JOIN base b ON b.item = p.item AND b.branch = p.branch),
capped AS (SELECT *, COALESCE(ratio >= 2, false) is_spike, CASE WHEN COALESCE(ratio >= 2, false) AND NOT is_new_year THEN CASE WHEN all_whole THEN least(ceil(2 * median_qty), qty) ELSE 2 * median_qty END ELSE qty END qty_capped FROM cap)"""


def _capped(spark, d) -> DataFrame:
    p = _ev(spark, d)
    flags = K.Calendar().fixed(F.col("dt"))
    return demand.cap_outliers(p.withColumn("is_new_year", flags["is_new_year"]), demand.pair_baseline(p, V.EV_CUTOFF, 5), 2.0, ["is_new_year"])


@query(f"WITH {CAPPED} SELECT item, branch, dt, ROUND(ratio, 6) AS baseline_ratio, is_spike, ROUND(qty_capped, 6) AS qty_capped FROM capped")
def out_capping(spark, d):
    return r6(_capped(spark, d).select("item", "branch", "dt", "baseline_ratio", "is_spike", "qty_capped"), "baseline_ratio", "qty_capped")


@query(f"WITH {CAPPED} SELECT item, branch, dt, ROUND(ratio, 6) AS baseline_ratio FROM capped WHERE ratio IS NOT NULL ORDER BY ROUND(ratio, 6) DESC, item, branch, dt LIMIT 20")
def out_top_ratio(spark, d):
    x = r6(_capped(spark, d).where("baseline_ratio is not null").select("item", "branch", "dt", "baseline_ratio"), "baseline_ratio")
    return explore.largest(x, "baseline_ratio", 20, ["item", "branch", "dt"])


# --- splits --------------------------------------------------------------------------------

SAFE = "dt + COALESCE(lead_time_days, 0) < {}"
STARTS = demand.fold_starts(V.CUTOFF)


@query(f"WITH {V.LEADS} SELECT item, branch, dt FROM led WHERE dt < {CUT} AND {SAFE.format(CUT)}")
def spl_purged_train(spark, d):
    return demand.split_train_test(_led(spark, d), V.CUTOFF)[0].select("item", "branch", "dt")


@query(f"WITH {V.BASE} SELECT item, branch, dt FROM panel WHERE dt >= {CUT}")
def spl_test(spark, d):
    return demand.split_train_test(_bare(spark, d), V.CUTOFF)[1].select("item", "branch", "dt")


FOLD = "CASE " + " ".join(f"WHEN dt >= DATE '{a}' AND dt < DATE '{b}' THEN {k + 1}" for k, (a, b) in enumerate(zip(STARTS, [*STARTS[1:], V.CUTOFF], strict=True))) + " END"


@query(f"WITH {V.BASE} SELECT item, branch, dt, {FOLD} AS fold_id FROM panel")
def spl_folds(spark, d):
    return demand.assign_folds(_bare(spark, d), V.CUTOFF).select("item", "branch", "dt", "fold_id")


@query(f"WITH {V.LEADS} " + " UNION ALL ".join(f"SELECT {k + 1} AS fold_id, branch, COUNT(*) AS n, MAX(dt) AS last_dt FROM led WHERE dt < DATE '{s}' AND {SAFE.format(f'''DATE '{s}' ''')} GROUP BY branch" for k, s in enumerate(STARTS)))
def spl_fold_masks(spark, d):
    led = _led(spark, d)
    out = None
    for k in range(1, 6):
        x = demand.fold_train(led, k, V.CUTOFF).groupBy("branch").agg(F.count("*").alias("n"), F.max("dt").alias("last_dt")).select(F.lit(k).alias("fold_id"), "branch", "n", "last_dt")
        out = x if out is None else out.unionByName(x)
    return out


TARGETED = f"{V.LEADS}, tg AS (SELECT *, {LEAD_SUM} AS target FROM led WINDOW {LEAD_WINDOWS})"
ELIGIBLE = f"{TARGETED}, el AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER ({V.W}) rn FROM tg WHERE dt < {CUT}) WHERE rn > 28 AND target IS NOT NULL)"


def _targeted(spark, d) -> DataFrame:
    return _led(spark, d).withColumn("target", windows.lead_target())


@query(f"WITH {ELIGIBLE} SELECT item, branch, dt, target FROM el")
def spl_eligible(spark, d):
    return demand.eligible_rows(_targeted(spark, d), V.CUTOFF, "target").select("item", "branch", "dt", "target")


@query(f"WITH {ELIGIBLE}, m AS (SELECT MAX(dt) - 29 s FROM el) SELECT CASE WHEN dt >= s THEN 'tail' ELSE 'fit' END AS part, branch, COUNT(*) AS n FROM el, m WHERE dt >= s OR {SAFE.format('s')} GROUP BY 1, 2")
def spl_early_stop(spark, d):
    fit, tail = demand.early_stopping(demand.eligible_rows(_targeted(spark, d), V.CUTOFF, "target"))
    both = fit.select("branch", F.lit("fit").alias("part")).unionByName(tail.select("branch", F.lit("tail").alias("part")))
    return both.groupBy("part", "branch").agg(F.count("*").alias("n"))


# --- encoding ------------------------------------------------------------------------------

ENC_CUT = "2024-01-22"
DT = f"CAST(strptime(dt_text, '%d %b %Y') AS DATE) < DATE '{ENC_CUT}'"
MAPPING = f"""vals AS (SELECT DISTINCT 'category' col, category value FROM t WHERE {DT} AND category IS NOT NULL UNION SELECT DISTINCT 'unit', unit FROM t WHERE {DT}),
mapping AS (SELECT col, value, CAST(ROW_NUMBER() OVER (PARTITION BY col ORDER BY value) AS INT) idx FROM vals)"""


def _dated(spark, d) -> DataFrame:
    return V.texts(spark, d).withColumn("dt", T.parse_date(F.col("dt_text")))


def _mapping(spark, d) -> DataFrame:
    return demand.category_mapping(_dated(spark, d), ["category", "unit"], ENC_CUT)


@query(f"WITH t AS ({V.TEXTS_SQL}), {MAPPING} SELECT * FROM mapping")
def enc_mapping(spark, d):
    return _mapping(spark, d)


_KNOWN = [("category", "Snack (FG)", 1), ("category", "Retired", 2), ("unit", "Porsi", 1)]


@query(f"WITH t AS ({V.TEXTS_SQL}), {MAPPING}, {V.values('known', 'col, value, idx', _KNOWN)}, top AS (SELECT col, MAX(idx) b FROM known GROUP BY 1) SELECT col, value, idx FROM known UNION ALL SELECT v.col, v.value, CAST(b + ROW_NUMBER() OVER (PARTITION BY v.col ORDER BY v.value) AS INT) FROM vals v JOIN top USING (col) WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.col = v.col AND k.value = v.value)")
def enc_extend_mapping(spark, d):
    known = spark.createDataFrame(_KNOWN, "col string, value string, idx int")
    return demand.category_mapping(_dated(spark, d), ["category", "unit"], ENC_CUT, existing=known)


@query(f"WITH t AS ({V.TEXTS_SQL}), {MAPPING} SELECT k, COALESCE(c.idx, 0) AS category_idx, COALESCE(u.idx, 0) AS unit_idx FROM t LEFT JOIN mapping c ON c.col = 'category' AND c.value = category LEFT JOIN mapping u ON u.col = 'unit' AND u.value = unit")
def enc_index(spark, d):
    return demand.encode(V.texts(spark, d), _mapping(spark, d), ["category", "unit"]).select("k", "category_idx", "unit_idx")


@query(f"WITH t AS ({V.TEXTS_SQL}), {MAPPING} SELECT k, " + ", ".join(f"CASE WHEN COALESCE(u.idx, 0) = {i} THEN 1 ELSE 0 END AS unit_idx_{i}" for i in (1, 2)) + " FROM t LEFT JOIN mapping u ON u.col = 'unit' AND u.value = unit")
def enc_one_hot(spark, d):
    x = demand.encode(V.texts(spark, d), _mapping(spark, d), ["unit"]).select("k", "unit_idx")
    return demand.one_hot(x, "unit_idx", [1, 2])


HIST = "CASE WHEN LAG(qty, 1) OVER w IS NULL THEN 1 ELSE 0 END + CASE WHEN LAG(qty, 7) OVER w IS NULL THEN 1 ELSE 0 END"


@query(f"WITH {V.EV_BASE} SELECT item, branch, dt, {HIST} AS missing_history_count, ({HIST}) = 0 AS has_full_history, COALESCE(LAG(qty, 1) OVER w, 0) AS lag_1, COALESCE(LAG(qty, 7) OVER w, 0) AS lag_7, CAST(CASE WHEN day(dt) <= 15 THEN day(dt) - 1 ELSE 99 END AS DOUBLE) AS days_since_new_year FROM panel WINDOW w AS ({V.W})")
def imp_features(spark, d):
    x = _ev(spark, d)
    x = x.select("item", "branch", "dt", *[c.alias(k) for k, c in windows.lag_columns("qty", [1, 7]).items()], K.Calendar().fixed(F.col("dt"))["days_since_new_year"].alias("days_since_new_year"))
    return demand.impute(x, ["days_since_new_year"], ["lag_1", "lag_7"])


SCALE = f"s AS (SELECT AVG(qty) m, CASE WHEN stddev_pop(qty) = 0 THEN 1 ELSE stddev_pop(qty) END d FROM panel WHERE dt < {EV_CUT})"


@query(f"WITH {V.EV_BASE}, {SCALE} SELECT 'qty' AS col, ROUND(m, 6) AS mean, ROUND(d, 6) AS sd FROM s")
def agg_scaler(spark, d):
    return r6(demand.fit_scaler(_ev(spark, d).where(demand.before(V.EV_CUTOFF)), ["qty"]), "mean", "sd")


@query(f"WITH {V.EV_BASE}, {SCALE} SELECT item, branch, dt, ROUND((qty - m) / d, 6) AS qty FROM panel, s")
def scl_apply(spark, d):
    x = _ev(spark, d)
    return r6(demand.apply_scaler(x, demand.fit_scaler(x.where(demand.before(V.EV_CUTOFF)), ["qty"]), ["qty"]).select("item", "branch", "dt", "qty"), "qty")


@query(f"WITH {TARGETED}, n AS (SELECT *, ROW_NUMBER() OVER ({V.W}) n FROM tg) SELECT item, branch, dt, ROUND(ln(1 + target), 6) AS target FROM n WHERE n > 28 AND target IS NOT NULL")
def adp_tabular(spark, d):
    return r6(demand.tabular(_targeted(spark, d), "target", log_target=True).select("item", "branch", "dt", "target"), "target")


@query(f"WITH {V.EV_BASE}, a AS (SELECT * FROM panel WHERE branch <> 'u1'), b AS (SELECT item, branch, dt, CASE WHEN branch = 'u2' THEN qty + 1 ELSE qty END qty FROM panel WHERE branch <> 'u3'), f AS (SELECT a.qty aq, b.qty bq, a.dt IS NOT NULL ia, b.dt IS NOT NULL ib FROM a FULL JOIN b ON a.item = b.item AND a.branch = b.branch AND a.dt = b.dt) " + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", COUNT(*) FILTER (WHERE {c}) AS violations FROM f" for k, c in (("only_first", "NOT ib"), ("only_second", "NOT ia"), ("differs_qty", "ia AND ib AND aq IS DISTINCT FROM bq"), ("null_qty", "ia AND aq IS NULL"))))
def adp_contract(spark, d):
    p = _ev(spark, d)
    b = p.where("branch <> 'u3'").withColumn("qty", F.when(F.col("branch") == "u2", F.col("qty") + 1).otherwise(F.col("qty")))
    return demand.contract_violations(p.where("branch <> 'u1'"), b, ["item", "branch", "dt"], ["qty"])


# --- metrics -------------------------------------------------------------------------------

SCORES = """COUNT(*) AS n, ROUND(AVG(ABS(y - p)), 6) AS mae, ROUND(AVG(CASE WHEN y >= p THEN 0.9 * (y - p) ELSE -0.1 * (y - p) END), 6) AS pinball,
ROUND(AVG(CASE WHEN y <= p THEN 1.0 ELSE 0.0 END), 6) AS coverage, ROUND(CASE WHEN SUM(y) = 0 THEN 1.0 ELSE 1 - SUM(greatest(0, y - p)) / SUM(y) END, 6) AS fill_rate,
ROUND(SUM(greatest(0, y - p)), 4) AS shortfall_units, ROUND(SUM(greatest(0, p - y)), 4) AS overstock_units"""
PRED = f"""{V.LEADS}, f AS (SELECT branch, item, dt, lead_time_days, {FOLD} fold_id, {LEAD_SUM} AS y, LAG(qty) OVER (PARTITION BY item, branch, segment_id ORDER BY dt) lag_1,
  CASE WHEN COUNT(qty) OVER r7 = 7 THEN AVG(qty) OVER r7 END roll FROM led WINDOW {LEAD_WINDOWS}, r7 AS ({V.W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
preds AS (SELECT branch, fold_id, y, model, p FROM (SELECT branch, fold_id, y, UNNEST(['naive_zero', 'naive_lag_1', 'naive_roll_mean_7']) model,
  UNNEST([0.0, COALESCE(lag_1 * lead_time_days, 0), COALESCE(roll * lead_time_days, 0)]) p FROM f WHERE y IS NOT NULL))"""


def _predictions(spark, d) -> DataFrame:
    x = _targeted(spark, d).withColumns(windows.lag_columns("qty", [1]) | windows.rolling_columns("qty", [7]))
    return metrics.stacked(demand.assign_folds(x, V.CUTOFF), "target", metrics.naive(), ["branch", "fold_id"])


def _round(df: DataFrame) -> DataFrame:
    df = r6(df, "mae", "pinball", "coverage", "fill_rate")
    return df.withColumns({c: F.round(c, 4) for c in ("shortfall_units", "overstock_units")})


@query(f"WITH {PRED} SELECT model, branch, {SCORES} FROM preds GROUP BY 1, 2")
def met_naive_scores(spark, d):
    return _round(metrics.score(_predictions(spark, d), ["model", "branch"]))


@query(f"WITH {PRED}, v AS (SELECT *, CASE WHEN branch < 'NATION_2' THEN 'low' ELSE 'high' END half FROM preds WHERE fold_id IS NOT NULL) SELECT model, fold_id, 'overall' AS group_col, 'all' AS group_value, {SCORES} FROM v GROUP BY 1, 2 UNION ALL SELECT model, fold_id, 'branch', branch, {SCORES} FROM v GROUP BY 1, 2, 4 UNION ALL SELECT model, fold_id, 'half', half, {SCORES} FROM v GROUP BY 1, 2, 4")
def met_grouping_sets(spark, d):
    x = _predictions(spark, d).where("fold_id is not null").withColumn("half", F.when(F.col("branch") < "NATION_2", "low").otherwise("high"))
    return _round(metrics.score_groups(x, ["branch", "half"]))


@query(f"WITH {PRED}, s AS (SELECT model, fold_id, COUNT(*) n, AVG(CASE WHEN y >= p THEN 0.9 * (y - p) ELSE -0.1 * (y - p) END) pinball FROM preds WHERE fold_id IS NOT NULL GROUP BY 1, 2) SELECT model, ROUND(SUM(pinball * n) / SUM(n), 6) AS pinball FROM s GROUP BY 1")
def met_pooled(spark, d):
    x = _predictions(spark, d).where("fold_id is not null")
    return r6(metrics.pooled(metrics.score_groups(x, ["branch"])), "pinball")


@query(f"WITH {V.SALES}, tot AS (SELECT branch, dt, SUM(qty) total FROM sales GROUP BY 1, 2), m AS (SELECT branch, year(dt) y, isodow(dt) dow, AVG(total) m FROM tot WHERE year(dt) IN (1997, 1998) GROUP BY 1, 2, 3), s AS (SELECT *, COUNT(*) OVER w n, 100 * (m / AVG(m) OVER w - 1) dev FROM m WINDOW w AS (PARTITION BY branch, y)), p AS (SELECT a.branch, a.dev a, b.dev b FROM s a JOIN s b ON a.branch = b.branch AND a.dow = b.dow WHERE a.y = 1997 AND b.y = 1998 AND a.n = 7 AND b.n = 7) SELECT branch, ROUND(corr(a, b), 6) AS r FROM p GROUP BY 1 HAVING stddev_pop(a) > 0 AND stddev_pop(b) > 0 UNION ALL SELECT 'all', ROUND(corr(a, b), 6) FROM p")
def met_dow_corr(spark, d):
    return r6(explore.weekday_correlation(V.sales(spark, d), (1997, 1998)), "r")


# --- sets, sorts, histograms, contract -------------------------------------------------------


@query(f"WITH {V.SALES} SELECT item, branch, dt, qty FROM sales ORDER BY qty DESC, item, branch, dt LIMIT 20")
def top_nlargest(spark, d):
    return explore.largest(V.sales(spark, d).select("item", "branch", "dt", "qty"), "qty", 20, ["item", "branch", "dt"])


@query(f"WITH {V.events_sql('a', 10)}, {V.events_sql('b', 150)} SELECT * FROM a UNION ALL SELECT * FROM b")
def set_union(spark, d):
    return V.events(spark, d, 10).unionByName(V.events(spark, d, 150))


@query(f"WITH {V.SALES} SELECT dt FROM sales WHERE branch = 'NATION_1' EXCEPT SELECT dt FROM sales WHERE branch = 'NATION_2'")
def set_except_dates(spark, d):
    s = V.sales(spark, d)
    return s.where("branch = 'NATION_1'").select("dt").subtract(s.where("branch = 'NATION_2'").select("dt"))


@query(f"WITH {V.SALES} SELECT dt FROM sales WHERE branch = 'NATION_1' INTERSECT SELECT dt FROM sales WHERE branch = 'NATION_2'")
def set_intersect_dates(spark, d):
    s = V.sales(spark, d)
    return s.where("branch = 'NATION_1'").select("dt").intersect(s.where("branch = 'NATION_2'").select("dt"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, n FROM (SELECT l_orderkey, l_linenumber, l_quantity, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1")
def set_duplicates(spark, d):
    x = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return explore.duplicates(x, ["l_orderkey", "l_linenumber"])


@query(f"WITH {V.SALES} SELECT CAST(floor(ln(1 + qty) / 0.25) + 1 AS BIGINT) AS bin, COUNT(*) AS n FROM sales GROUP BY 1")
def his_log1p(spark, d):
    return explore.histogram(V.sales(spark, d), "qty", 0.0, 25.0, 100)


_CHECKS = ["required_columns", "qty_not_negative", "region_known", "step_is_one_day", "unique_keys", "segments_from_one", "segments_gapless", "outside_closures"]


@query(f"WITH {V.LEADS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"check\", CAST({'(SELECT COUNT(*) FROM led WHERE region IS NULL)' if c == 'region_known' else 0} AS BIGINT) AS violations" for c in _CHECKS))
def qa_checks(spark, d):
    return qa.qa_checks(_led(spark, d), V.closures(spark), ["item", "branch", "dt", "qty", "segment_id"])


# violations planted by rules that both engines share; each check must count its own
PLANT = f"""SELECT item, branch, CASE WHEN day(dt) = 9 AND item = m THEN qty - 1000 ELSE qty END qty, CASE WHEN day(dt) = 10 AND item = m THEN qty + 1 ELSE qty END qty_capped, qty target_lead_time_cumulative,
  CASE WHEN day(dt) = 11 AND item = m THEN qty + 1 ELSE qty END target_lead_time_cumulative_capped, CASE WHEN branch = 'u7' THEN 'Unknown' WHEN branch = 'u8' AND day(dt) > 5 THEN 'B' ELSE 'A' END city,
  CASE WHEN branch = 'u9' THEN NULL ELSE 1 END region, CASE WHEN branch = 'u3' THEN 3 WHEN branch = 'u4' AND day(dt) > 15 THEN 3 ELSE 1 END segment_id,
  CASE WHEN branch = 'u5' AND day(dt) = 12 THEN date_add(dt, {{}}) ELSE dt END dt FROM (SELECT *, min(item) OVER () m FROM panel)"""
_SHUT = [("u6", "2024-01-10", "2024-01-14")]
_SEG = "item, branch, segment_id"


@query(
    f"""WITH {V.EC_BASE}, x AS ({PLANT.format('INTERVAL 1 DAY')}), x2 AS (SELECT * REPLACE (CAST(dt AS DATE) AS dt) FROM x), st AS (SELECT *, dt - LAG(dt) OVER (PARTITION BY {_SEG} ORDER BY dt) s FROM x2), pr AS (SELECT item, branch, MIN(segment_id) lo, MAX(segment_id) hi, COUNT(DISTINCT segment_id) n FROM x2 GROUP BY 1, 2)
    SELECT 'qty_not_negative' AS "check", COUNT(*) AS violations FROM x2 WHERE qty < 0 UNION ALL SELECT 'capped_within_raw', COUNT(*) FROM x2 WHERE qty_capped > qty UNION ALL SELECT 'capped_target_within_raw', COUNT(*) FROM x2 WHERE target_lead_time_cumulative_capped > target_lead_time_cumulative + 1e-9
    UNION ALL SELECT 'city_known', COUNT(*) FROM x2 WHERE city = 'Unknown' UNION ALL SELECT 'region_known', COUNT(*) FROM x2 WHERE region IS NULL UNION ALL SELECT 'step_is_one_day', COUNT(*) FROM st WHERE s <> 1 UNION ALL SELECT 'unique_keys', COUNT(*) FROM (SELECT item FROM x2 GROUP BY item, branch, dt HAVING COUNT(*) > 1)
    UNION ALL SELECT 'segments_from_one', COUNT(*) FROM pr WHERE lo <> 1 UNION ALL SELECT 'segments_gapless', COUNT(*) FROM pr WHERE n <> hi UNION ALL SELECT 'outside_closures', COUNT(*) FROM x2 WHERE branch = 'u6' AND dt >= DATE '2024-01-10' AND dt < DATE '2024-01-14'
    UNION ALL SELECT 'one_city_a_branch', COUNT(*) FROM (SELECT branch FROM x2 GROUP BY 1 HAVING COUNT(DISTINCT city) > 1) UNION ALL SELECT 'required_columns', 1"""
)
def qa_planted(spark, d):
    x = spark.sql(PLANT.format("1").replace("FROM panel", "FROM {panel}"), panel=_ev(spark, d, 10))
    shut = V.dims(spark, _SHUT, "branch string, start_dt string, end_dt string", ["start_dt", "end_dt"])
    return qa.qa_checks(x, shut, ["item", "branch", "dt", "qty", "lost_column"])


# --- windows by position -----------------------------------------------------------------------

SEQ = f"{V.EC_BASE}, ix AS (SELECT item, branch, segment_id, dt, CAST(DENSE_RANK() OVER (ORDER BY item, branch, segment_id) - 1 AS BIGINT) segment_code, CAST(ROW_NUMBER() OVER ({V.W}) - 1 AS INT) AS \"position\", CAST(ROW_NUMBER() OVER (ORDER BY item, branch, segment_id, dt) - 1 AS BIGINT) AS \"row\" FROM panel)"


@query(f"WITH {SEQ} SELECT * FROM ix")
def seq_index(spark, d):
    x = _ev(spark, d, 10).select("item", "branch", "segment_id", "dt")
    return sequences.build_index(x, ["qty"]).select("item", "branch", "segment_id", "dt", "segment_code", "position", "row")


@query(f'WITH {SEQ} SELECT item, branch, segment_id, dt, "row" AS window_end FROM ix WHERE "position" >= 7')
def seq_window_ends(spark, d):
    index = sequences.build_index(_ev(spark, d, 10).select("item", "branch", "segment_id", "dt"), [], lookback=7)
    rows = panel.without_warmup(_ev(spark, d, 10), 7).select("item", "branch", "segment_id", "dt")
    return sequences.window_ends(index, rows)


@query(f"WITH {V.EC_BASE} SELECT 'step_is_one_day' AS \"check\", CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'windows_fit', (SELECT COUNT(*) FROM (SELECT dt - LAG(dt, 6) OVER ({V.W.replace(', segment_id', '')}) s, ROW_NUMBER() OVER ({V.W.replace(', segment_id', '')}) n FROM panel WHERE day(dt) <> 20) WHERE n > 7 AND s <> 6) UNION ALL SELECT 'step_planted', (SELECT COUNT(*) FROM (SELECT dt - LAG(dt) OVER ({V.W.replace(', segment_id', '')}) s FROM panel WHERE day(dt) <> 20) WHERE s <> 1)")
def seq_proof(spark, d):
    x = _ev(spark, d, 10).select("item", "branch", "segment_id", "dt")
    position = F.row_number().over(panel.Window.partitionBy("item", "branch", "segment_id").orderBy("dt")) - 1
    whole = sequences.window_proof(x.withColumn("position", position), 7).where("check = 'step_is_one_day'")
    torn = x.where("day(dt) <> 20").drop("segment_id")
    torn = sequences.window_proof(torn.withColumn("position", F.row_number().over(panel.Window.partitionBy("item", "branch").orderBy("dt")) - 1), 7)
    name = F.when(F.col("check") == "step_is_one_day", "step_planted").otherwise(F.col("check"))
    return whole.unionByName(torn.select(name.alias("check"), "violations"))


# --- encodings of the learners -----------------------------------------------------------------

LEVELS = f"""ix AS (SELECT k, dt_text, COALESCE(c.idx, 0) category_idx FROM t LEFT JOIN mapping c ON c.col = 'category' AND c.value = category),
lv AS (SELECT category_idx v, ROW_NUMBER() OVER (ORDER BY category_idx) - 1 code FROM (SELECT DISTINCT category_idx FROM ix WHERE {DT.replace(ENC_CUT, '2024-01-08')}))"""


def _encoded(spark, d, encoding: str) -> DataFrame:
    from ..operators import models

    x = demand.encode(_dated(spark, d), _mapping(spark, d), ["category"]).select("k", "dt", "category_idx")
    early = x.where(demand.before("2024-01-08"))
    return models.encoded(early, x, ["category_idx"], encoding)[1].drop("dt")


@query(f"WITH t AS ({V.TEXTS_SQL}), {MAPPING}, {LEVELS} SELECT k, category_idx, CAST(COALESCE(code, -1) AS INT) AS category_idx_code FROM ix LEFT JOIN lv ON v = category_idx")
def enc_native(spark, d):
    return _encoded(spark, d, "native")


@query(f"WITH t AS ({V.TEXTS_SQL}), {MAPPING}, {LEVELS} SELECT k, category_idx FROM ix")
def enc_ordinal(spark, d):
    return _encoded(spark, d, "ordinal")


# --- more exploration ----------------------------------------------------------------------------


@query(f"WITH {V.SALES}, m AS (SELECT branch, dt, SUM(qty) s FROM sales GROUP BY 1, 2) SELECT branch, CAST(month(dt) AS INT) AS month, ROUND(AVG(s), 6) AS mean_qty FROM m GROUP BY 1, 2")
def agg_month_profile(spark, d):
    return r6(explore.month_profile(V.sales(spark, d)), "mean_qty")


@query(f"WITH {V.SALES}, m AS (SELECT category, dt, SUM(qty) s FROM sales GROUP BY 1, 2) SELECT category, CAST(isodow(dt) - 1 AS INT) AS dow, ROUND(AVG(s), 6) AS mean_qty FROM m GROUP BY 1, 2")
def agg_category_profile(spark, d):
    return r6(explore.category_profile(V.sales(spark, d)), "mean_qty")


@query(f"WITH {V.SALES} SELECT branch, COUNT(qty) AS \"count\", ROUND(AVG(qty), 6) AS mean, ROUND(STDDEV_SAMP(qty), 6) AS std, MIN(qty) AS \"min\", ROUND(QUANTILE_CONT(qty, 0.25), 6) AS q25, ROUND(QUANTILE_CONT(qty, 0.5), 6) AS q50, ROUND(QUANTILE_CONT(qty, 0.75), 6) AS q75, MAX(qty) AS \"max\" FROM sales GROUP BY 1")
def agg_describe(spark, d):
    return r6(explore.describe(V.sales(spark, d), "qty", ["branch"]), "mean", "std", "q25", "q50", "q75")


@query(f"WITH {V.SALES}, q AS (SELECT category, QUANTILE_CONT(qty, 0.25) a, QUANTILE_CONT(qty, 0.5) m, QUANTILE_CONT(qty, 0.75) b FROM sales GROUP BY 1) SELECT s.category, ROUND(a, 6) AS q25, ROUND(m, 6) AS q50, ROUND(b, 6) AS q75, MIN(qty) AS low, MAX(qty) AS high FROM sales s JOIN q ON q.category = s.category AND qty >= a - 1.5 * (b - a) AND qty <= b + 1.5 * (b - a) GROUP BY 1, 2, 3, 4")
def his_box(spark, d):
    return r6(explore.box_stats(V.sales(spark, d), "qty", "category"), "q25", "q50", "q75")


@query(_texts("SELECT city AS value, COUNT(*) AS n FROM t GROUP BY 1"))
def agg_value_counts(spark, d):
    return explore.value_counts(V.texts(spark, d), "city")


@query(f"WITH {V.SALES}, m AS (SELECT *, median(CASE WHEN qty > 0 THEN qty END) OVER (PARTITION BY item, branch) md FROM sales WHERE item LIKE 'S%') SELECT item, branch, dt, qty, md AS median_qty, ROUND(qty / md, 6) AS ratio FROM m WHERE md > 0 AND qty / md >= 2")
def out_spikes(spark, d):
    return r6(explore.spikes(V.sales(spark, d).select("item", "branch", "dt", "qty"), 2.0, "S"), "ratio")


@query(f"WITH {V.SALES} SELECT item, branch, dt, qty FROM sales ORDER BY md5(concat_ws('|', '0', item, branch, CAST(dt AS VARCHAR))), item, branch, dt LIMIT 1")
def top_sample(spark, d):
    return explore.sample_rows(V.sales(spark, d).select("item", "branch", "dt", "qty"), 1, 0, ["item", "branch", "dt"])


@query(f"WITH {V.EC_BASE}, n AS (SELECT item, branch, dt, qty, ROW_NUMBER() OVER ({V.W}) n FROM panel) SELECT item, branch, dt, ROUND(ln(1 + qty), 6) AS logged, ROUND(qty, 6) AS back FROM n WHERE n > 7")
def log_round_trip(spark, d):
    x = demand.tabular(_ev(spark, d, 10), "qty", 7, log_target=True)
    return r6(x.select("item", "branch", "dt", F.col("qty").alias("logged"), demand.untransformed("qty", True).alias("back")), "logged", "back")


# --- end to end ------------------------------------------------------------------------------


def _featured(spark, d, outlets: DataFrame | None = None) -> DataFrame:
    from . import forecast

    dims = forecast.Dimensions(V.regions(spark, d), V.closures(spark), V.breakpoints(spark), V.relocations(spark), outlets, calendar=V.CALENDAR)
    return forecast.featured(V.sales(spark, d), dims, V.CUTOFF, ratio=3.0)


RAMADAN = "EXISTS (SELECT 1 FROM feasts f WHERE p.dt BETWEEN f.a AND f.b)"
E1 = f"""{V.BASE}, {V.FEASTS_SQL}, {V.REGIONS_SQL}, {V.MOVES_SQL}, ok AS (SELECT item, branch FROM panel WHERE dt < {CUT} GROUP BY 1, 2 HAVING COUNT(*) >= 60),
hp AS (SELECT p.* FROM panel p SEMI JOIN ok USING (item, branch)),
base AS (SELECT item, branch, median(qty) m, bool_and(qty % 1 = 0) whole FROM hp WHERE dt < {CUT} AND qty > 0 GROUP BY 1, 2 HAVING COUNT(*) >= 30 AND median(qty) > 0),
cp AS (SELECT p.*, COALESCE(qty / m >= 3, false) AS is_spike, CASE WHEN qty / m >= 3 AND NOT ({RAMADAN} OR (month(p.dt) = 8 AND day(p.dt) = 17) OR (month(p.dt) = 1 AND day(p.dt) = 1))
  THEN CASE WHEN whole THEN least(ceil(3 * m), qty) ELSE 3 * m END ELSE qty END AS qty_capped FROM hp p LEFT JOIN base b ON b.item = p.item AND b.branch = p.branch),
led AS (SELECT p.*, CAST({V.LEAD} AS INT) lead_time_days FROM cp p LEFT JOIN regions r ON r.branch = p.branch),
tot AS (SELECT branch, dt, SUM(qty_capped) total FROM cp WHERE dt < {CUT} GROUP BY 1, 2), bs AS (SELECT branch, AVG(total) a FROM tot GROUP BY 1),
tr AS (SELECT branch, ROUND(a, 6) a, ROW_NUMBER() OVER (ORDER BY a, branch) r, COUNT(*) OVER () n FROM bs),
e1 AS (SELECT p.item, p.branch, p.dt, p.qty, p.segment_id, p.is_spike, ROUND(p.qty_capped, 6) AS qty_capped, CAST(isodow(p.dt) - 1 AS INT) AS day_of_week, {RAMADAN.replace('p.dt BETWEEN', "f.event = 'ramadan' AND p.dt BETWEEN")} AS is_ramadan, lead_time_days,
  ROUND(LAG(p.qty_capped, 7) OVER w, 6) AS lag_7, ROUND(CASE WHEN COUNT(p.qty_capped) OVER w7 = 7 THEN AVG(p.qty_capped) OVER w7 END, 6) AS roll_mean_7,
  {LEAD_SUM.replace('qty', 'p.qty')} AS target_lead_time_cumulative, ROUND({LEAD_SUM.replace('qty', 'p.qty_capped')}, 6) AS target_lead_time_cumulative_capped,
  tr.a AS branch_avg_daily_qty, CASE WHEN n < 2 THEN 'small' ELSE ['small', 'medium', 'large', 'flagship'][CAST(greatest(1, ceil((r - 1) * least(4, n) / CAST(n - 1 AS DOUBLE))) AS INT)] END AS branch_volume_tier,
  CAST(p.dt - MIN(p.dt) OVER (PARTITION BY p.branch) AS INT) AS branch_age_days, CAST(p.dt - moved AS INT) AS days_since_relocation
  FROM led p LEFT JOIN tr ON tr.branch = p.branch LEFT JOIN moves ON moves.branch = p.branch
  WINDOW w AS (PARTITION BY p.item, p.branch, p.segment_id ORDER BY p.dt), w7 AS (PARTITION BY p.item, p.branch, p.segment_id ORDER BY p.dt ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
  {LEAD_WINDOWS.replace('item, branch, segment_id ORDER BY dt', 'p.item, p.branch, p.segment_id ORDER BY p.dt')})"""
_E1 = ["item", "branch", "dt", "qty", "segment_id", "is_spike", "qty_capped", "day_of_week", "is_ramadan", "lead_time_days", "lag_7", "roll_mean_7", "target_lead_time_cumulative", "target_lead_time_cumulative_capped", "branch_avg_daily_qty", "branch_volume_tier", "branch_age_days", "days_since_relocation"]


@query(f"WITH {E1} SELECT * FROM e1")
def e1_featured(spark, d):
    return r6(_featured(spark, d).select(*_E1), "qty_capped", "lag_7", "roll_mean_7", "target_lead_time_cumulative_capped", "branch_avg_daily_qty")


def _model_input(spark, d, outlets: DataFrame | None = None) -> DataFrame:
    from . import forecast

    x = _featured(spark, d, outlets)
    items = V.table(spark, d, "part").select(F.col("p_type").alias("item"), (F.length("p_type") % 2 == 0).alias("is_event_driven")).distinct()
    return forecast.model_input(x, items, V.CUTOFF)[0]


@query(
    f"""WITH {E1}, {STATS.format(CUT).replace('FROM panel', 'FROM e1').replace('stats AS', 'ds AS')}, vals AS (SELECT DISTINCT branch_volume_tier v FROM e1 WHERE dt < {CUT}), mp AS (SELECT v, CAST(ROW_NUMBER() OVER (ORDER BY v) AS INT) idx FROM vals)
    SELECT e.item, e.branch, e.dt, COALESCE({LABEL}, 'lumpy') AS demand_segment, {FOLD.replace('dt', 'e.dt')} AS fold_id, COALESCE(lag_7, 0) AS lag_7, COALESCE(roll_mean_7, 0) AS roll_mean_7, days_since_relocation IS NOT NULL AS was_relocated,
    CAST(COALESCE(days_since_relocation, 0) AS DOUBLE) AS days_since_relocation, COALESCE(mp.idx, 0) AS branch_volume_tier_idx, length(e.item) % 2 = 0 AS is_event_driven
    FROM e1 e LEFT JOIN ds ON ds.item = e.item AND ds.branch = e.branch LEFT JOIN mp ON mp.v = e.branch_volume_tier"""
)
def e2_model_input(spark, d):
    out = _model_input(spark, d).select("item", "branch", "dt", "demand_segment", "fold_id", "lag_7", "roll_mean_7", "was_relocated", "days_since_relocation", "branch_volume_tier_idx", "is_event_driven")
    return r6(out, "lag_7", "roll_mean_7")


# --- models (rows only) ------------------------------------------------------------------------

ML_FEATURES = ["lag_1", "lag_7", "roll_mean_7", "roll_mean_28", "lead_time_days", "dow"]


def _learnable(spark, d) -> DataFrame:
    """Eligible rows with their features, materialised once for the many passes of the learners."""
    x = demand.assign_folds(_targeted(spark, d), V.CUTOFF)
    x = x.withColumns(windows.lag_columns("qty", [1, 7]) | windows.rolling_columns("qty", [7, 28]) | {"dow": F.weekday("dt")})
    return cut(demand.eligible_rows(x, V.CUTOFF, "target").select("item", "branch", "dt", "fold_id", "target", *ML_FEATURES))


def _all_features(spark, d) -> DataFrame:
    """The rows of `_learnable` with every feature of the model's input; each branch has the outlet of its name."""
    from . import forecast

    outlets, branch = V.outlets(spark, d), F.upper(F.regexp_replace("outlet", "^Resto ", "")).alias("branch")
    matches = outlets.select(branch, "outlet", F.lit(None).cast("string").alias("city_override"))
    x = demand.eligible_rows(_model_input(spark, d, canon.outlet_features(matches, outlets)), V.CUTOFF, forecast.TARGET)
    return cut(x.select("item", "branch", "dt", "fold_id", F.col(forecast.TARGET).alias("target"), *forecast.FEATURES))


#: Settings of the forests' queries, smaller than the operators' defaults (README).
FOREST = {"n_trees": 10, "max_depth": 6, "min_leaf": 20, "subset": "onethird"}


@query()
def ml_quantile_forest(spark, d):
    from ..operators import models

    x = _learnable(spark, d)
    return models.quantile_forest(ML_FEATURES, "target", **FOREST)(demand.fold_train(x, 5, V.CUTOFF), x.where("fold_id = 5"))


@query()
def ml_treeboost(spark, d):
    """All features and the operator's own settings: rounds go on until 50 of them have not helped, 2,000 at most."""
    from ..operators import models
    from . import forecast

    x = _all_features(spark, d)
    return models.boosted_quantiles(forecast.FEATURES, "target")(demand.fold_train(x, 5, V.CUTOFF), x.where("fold_id = 5"))


@query()
def ml_walk_forward(spark, d):
    from ..operators import models

    forest = models.quantile_forest(ML_FEATURES, "target", n_trees=4, max_depth=5, min_leaf=20, subset="onethird")
    return models.run_walk_forward(_learnable(spark, d), forest, V.CUTOFF, "target", name="quantile_forest")


@query()
def ml_recurrent(spark, d):
    from ..operators import models, network

    whole = _led(spark, d)
    features = ["qty", "lead_time_days", "dow", "branch_idx"]
    whole = demand.encode(whole.withColumn("dow", F.weekday("dt")), demand.category_mapping(whole, ["branch"], V.CUTOFF), ["branch"])
    whole = whole.withColumn("lead_time_days", F.coalesce("lead_time_days", F.lit(0)))
    sizes = [(n, width) for _, n, width in models.embedding_sizes(demand.category_mapping(whole, ["branch"], V.CUTOFF))]
    make = lambda dynamic, cats: network.recurrent_quantiles(dynamic, cats, sizes, 14, epochs=3, hidden_size=16, batch_size=1024)
    bound = sequences.bind_panel(whole, features, "target", make, lookback=14)
    return models.run_walk_forward(_learnable(spark, d), bound, V.CUTOFF, "target", name="recurrent")


@query()
def ml_search(spark, d):
    from ..operators import models

    space = {**models.FOREST_SPACE, "n_trees": [3], "max_depth": [3, 5], "encoding": ["ordinal"]}
    found = models.sample_space(space, {**models.FOREST_DEFAULTS, "n_trees": 3, "max_depth": 5, "subset": "0.5"}, 2)
    results = models.run_search(_learnable(spark, d), found, lambda **p: models.quantile_forest(ML_FEATURES, "target", **p), V.CUTOFF, "target", folds=(3, 5))
    rows = [(r["candidate"], str(sorted(r["params"].items())), r["pinball"], r["error"]) for r in results]
    return spark.createDataFrame(rows, "candidate int, params string, pinball double, error string")


# --- the daily table as a stream -----------------------------------------------------------

CHANGES = "row_id long, version timestamp, removed boolean, ord long, item string, branch string, dt date, qty double, category string"


def _changes(spark, d) -> DataFrame:
    """Clicks as rows of a feed: values over 100 are corrected to 100 an hour later, errors are withdrawn then."""
    c = V.table(spark, d, "clicks").withColumn("cents", F.floor(F.col("value") * 100 + 0.5).cast("double"))
    row = ["click_id row_id", "arrived_at version", "false removed", "click_id ord", "kind item", "cast(client_id as string) branch", "cast(ts as date) dt", "cents qty"]
    row.append("case when cents > 5000 then 'high' when cents <= 5000 then 'low' end category")
    later = c.withColumn("arrived_at", F.expr("arrived_at + interval 1 hour"))
    fixed = later.where("cents > 10000").withColumn("cents", F.lit(10000.0)).selectExpr(*row)
    gone = later.where("kind = 'error'").withColumn("cents", F.lit(None).cast("double")).selectExpr(*row).withColumn("removed", F.lit(True))
    return c.selectExpr(*row).unionByName(fixed).unionByName(gone)


@query("""WITH c AS (SELECT DISTINCT click_id, kind, client_id, CAST(ts AS DATE) dt, CASE WHEN FLOOR(value * 100 + 0.5) > 10000 THEN 10000 ELSE FLOOR(value * 100 + 0.5) END cents FROM clicks
  WHERE ts IS NOT NULL AND kind <> 'error' AND client_id IS NOT NULL)
SELECT kind item, CAST(client_id AS VARCHAR) branch, dt, CAST(COALESCE(SUM(cents), 0) AS DOUBLE) qty,
  CASE WHEN ARG_MIN(cents, click_id) FILTER (WHERE cents IS NOT NULL) > 5000 THEN 'high' WHEN ARG_MIN(cents, click_id) FILTER (WHERE cents IS NOT NULL) IS NOT NULL THEN 'low' END category
FROM c GROUP BY 1, 2, 3""")
def str_daily(spark, d):
    """The clicks come as a stream of files, in order of arrival, with their corrections and repeats."""
    folder = scratch_folder(spark, "stream")
    _changes(spark, d).repartitionByRange(6, "version").write.parquet(f"{folder}/feed")
    table = DailyTable(spark, f"{folder}/table", CHANGES, order="ord", carry=["category"])
    feed = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 2).parquet(f"{folder}/feed")
    table.follow(feed, f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table.read()
