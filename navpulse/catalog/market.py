"""Investor reports on the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from navpulse.catalog import proxies as px, query
from navpulse.catalog.base_sql import (
    BRAND_FLOWS, BRAND_PRICES, EV, FUNDS, HISTORY, INDEX, RUNS, UNITS, snapshot, ticks, units_on,
)
from navpulse.functions import metrics, text
from navpulse.operators.latest import latest_version
from navpulse.plans import analytics, marts
from navpulse.sources.sinks import end_of_day

DAY = dt.date(2024, 1, 28)
EQUITY = "('equity', 'index', 'sector', 'leveraged')"


# --- latest rows --------------------------------------------------------------------


@query(
    "latest_version",
    """
SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_version_(spark, d):
    orders = px.table(spark, d, "orders")
    rows = latest_version(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return rows.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")


@query(
    "latest_per_group",
    """
SELECT event_type, user_id, event_id, ts, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_per_group(spark, d):
    ev = px.table(spark, d, "events")
    rows = latest_version(ev, ["event_type", "user_id"], ["ts", "event_id"])
    return rows.select("event_type", "user_id", "event_id", "ts", "value")


@query(
    "eod_rollup",
    f"""
WITH {ticks("event_type")}
SELECT ins_code, day AS trade_date, max(ts) AS last_ts,
       arg_max(close_price, {{'a': ts, 'b': ingested_at}}) AS close_price,
       arg_max(value, {{'a': ts, 'b': ingested_at}}) AS value,
       arg_max(nav_redemption, {{'a': ts, 'b': ingested_at}})
         FILTER (nav_redemption IS NOT NULL) AS nav_redemption,
       arg_max(ind_buy_value - ind_sell_value, {{'a': ts, 'b': ingested_at}}) AS ind_net_value
FROM raw_ticks GROUP BY 1, 2""",
)
def eod_rollup(spark, d):
    return end_of_day(px.raw_ticks(spark, d, "event_type"))


# --- snapshot and overview ----------------------------------------------------------


@query(
    "snapshot",
    f"""
WITH {snapshot()},
totals AS (SELECT trade_date, sum(aum) AS total FROM snap GROUP BY 1)
SELECT s.trade_date, ins_code, symbol, fund_type, ts, close_price, prev_close,
       round(change, 6) AS change, nav, round(premium, 6) AS premium, units, aum,
       round(CASE WHEN aum != 0 AND total != 0 THEN aum::DOUBLE / total END, 6) AS share_of_aum,
       ind_net_flow, inst_net_flow,
       round(CASE WHEN ind_buy_count > 0 AND ind_sell_count > 0 AND ind_sell_value != 0 THEN
         (ind_buy_value::DOUBLE / ind_buy_count) / (ind_sell_value::DOUBLE / ind_sell_count) END, 6)
         AS buyer_power,
       round(CASE WHEN aum != 0 THEN value::DOUBLE / aum END, 6) AS turnover,
       status_kind, CASE WHEN st.title = '' THEN st.code ELSE st.title END AS status_title,
       coalesce(st.sup != 0, false) AS under_supervision,
       concat_ws(',', CASE WHEN quality_flags & 2 != 0 THEN 'NAV_MISSING' END,
         CASE WHEN quality_flags & 8 != 0 THEN 'CLIENT_TYPE_MISSING' END,
         'FLOW_VALUE_ESTIMATED', CASE WHEN quality_flags & 32 != 0 THEN 'NO_TRADES' END)
         AS quality_flags
FROM snap s JOIN totals t ON t.trade_date = s.trade_date""",
)
def snapshot_(spark, d):
    snap = analytics.snapshot(px.market(spark, d))
    return snap.select(
        "trade_date", "ins_code", "symbol", "fund_type", "ts", "close_price", "prev_close",
        "change", "nav", "premium", "units", "aum", "share_of_aum", "ind_net_flow",
        "inst_net_flow", "buyer_power", "turnover", "status_kind", "status_title",
        "under_supervision", "quality_flags",
    )


OVERVIEW_SQL = f"""
WITH {snapshot()}, {INDEX}, {RUNS},
last_idx AS (SELECT CAST(ts AS DATE) AS trade_date, index_value,
    CASE WHEN index_value - index_change != 0
         THEN index_change / (index_value - index_change) END AS index_change
  FROM idx QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC) = 1),
compl AS (SELECT CAST(tick AS DATE) AS trade_date,
    sum(received_funds)::DOUBLE / sum(expected_funds) AS completeness FROM runs GROUP BY 1),
agg AS (
  SELECT trade_date, max(ts) AS last_update, count(*) AS funds,
    coalesce(sum(aum), 0)::BIGINT AS total_aum, sum(value)::BIGINT AS total_value,
    sum(ind_net_flow)::BIGINT AS ind_net_flow, median(premium) AS median_premium,
    sum(premium * aum) / sum(aum) FILTER (premium IS NOT NULL) AS weighted_premium,
    count(*) FILTER (premium > 0) AS at_premium, count(*) FILTER (premium < 0) AS at_discount,
    count(*) FILTER (change > 0) AS advancers, count(*) FILTER (change < 0) AS decliners,
    count(*) FILTER (coalesce(change, 0) = 0) AS unchanged,
    count(*) FILTER (status_kind NOT IN ('open', 'unknown')) AS not_trading
  FROM snap GROUP BY 1)
SELECT a.trade_date, last_update, funds, total_aum, total_value, ind_net_flow,
  round(median_premium, 6) AS median_premium, round(weighted_premium, 6) AS weighted_premium,
  at_premium, at_discount, advancers, decliners, unchanged, not_trading, index_value,
  round(index_change, 6) AS index_change, round(completeness, 6) AS completeness
FROM agg a LEFT JOIN last_idx i USING (trade_date) LEFT JOIN compl c USING (trade_date)"""


@query("overview", OVERVIEW_SQL)
def overview(spark, d):
    return analytics.overview(px.market(spark, d)).drop("session_date_fa")


@query(
    "units_asof",
    """
WITH probes AS (
  SELECT DISTINCT o_custkey AS ins_code, CAST(l_shipdate AS DATE) AS trade_date
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
facts AS (
  SELECT o_custkey AS ins_code, CAST(o_orderdate AS DATE) AS d, max(o_orderkey) AS units
  FROM orders GROUP BY 1, 2),
firsts AS (SELECT ins_code, arg_min(units, d) AS units FROM facts GROUP BY 1)
SELECT p.ins_code, p.trade_date, coalesce(f.units, g.units) AS units
FROM probes p ASOF LEFT JOIN facts f ON f.ins_code = p.ins_code AND f.d <= p.trade_date
LEFT JOIN firsts g ON g.ins_code = p.ins_code""",
)
def units_asof(spark, d):
    lines = px.table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS o_orderkey", "to_date(l_shipdate) AS trade_date"
    )
    orders = px.table(spark, d, "orders").selectExpr(
        "o_orderkey", "o_custkey AS ins_code", "to_date(o_orderdate) AS _date"
    )
    probes = lines.join(orders.drop("_date"), "o_orderkey").select("ins_code", "trade_date")
    facts = orders.select(
        "ins_code", F.col("_date").alias("trade_date"), F.col("o_orderkey").alias("units"),
        F.col("o_orderkey").alias("updated_at"),
    )
    return analytics.units_as_of(probes.distinct(), facts)


@query(
    "session_date",
    f"""
WITH {EV}, {HISTORY}
SELECT greatest((SELECT max(CAST(ts AS DATE)) FROM ev), (SELECT max(trade_date) FROM hist))
  AS session_date""",
)
def session_date(spark, d):
    return analytics.session_date(px.market(spark, d))


@query(
    "sessions",
    f"""
WITH {EV}
SELECT CAST(ts AS DATE) AS trade_date, count(DISTINCT ts) AS minutes,
       count(DISTINCT ts) > 1 AS has_intraday
FROM ev GROUP BY 1 ORDER BY 1 DESC LIMIT 90""",
)
def sessions(spark, d):
    return analytics.sessions(px.market(spark, d)).drop("day_fa")


# --- premium and flow over time -----------------------------------------------------


POINT = """median(premium) AS median,
  sum(premium * aum) / sum(aum) FILTER (premium IS NOT NULL) AS weighted,
  count(premium) AS funds"""
PREMIUM = """CASE WHEN fund_type != 'leveraged' AND nav != 0 AND close_price != 0
    THEN close_price::DOUBLE / nav - 1 END AS premium,
    CASE WHEN nav != 0 AND units != 0 THEN nav * units END AS aum"""


@query(
    "premium_daily",
    f"""
WITH {ticks("user_id")}, {FUNDS}, {UNITS},
eod AS (SELECT ins_code, day, arg_max(close_price, {{'a': ts, 'b': ingested_at}}) AS close_price,
    arg_max(nav_redemption, {{'a': ts, 'b': ingested_at}}) FILTER (nav_redemption IS NOT NULL) AS nav
  FROM raw_ticks GROUP BY 1, 2),
rows_ AS (SELECT e.*, fund_type, {units_on("e.ins_code", "e.day")} AS units
  FROM eod e JOIN funds f ON f.ins_code = e.ins_code AND fund_type IN {EQUITY}),
p AS (SELECT day, {PREMIUM} FROM rows_)
SELECT day AS trade_date, round(median, 6) AS median, round(weighted, 6) AS weighted, funds
FROM (SELECT day, {POINT} FROM p GROUP BY day)""",
)
def premium_daily(spark, d):
    return analytics.premium_daily(px.market(spark, d))


@query(
    "premium_by_time",
    f"""
WITH {ticks("user_id")}, {FUNDS}, {UNITS},
rows_ AS (SELECT t.ts, t.close_price, t.nav_redemption AS nav, fund_type,
    {units_on("t.ins_code", "t.day")} AS units
  FROM ticks t JOIN funds f ON f.ins_code = t.ins_code AND fund_type IN {EQUITY}),
p AS (SELECT ts, {PREMIUM} FROM rows_)
SELECT ts, round(median, 6) AS median, round(weighted, 6) AS weighted, funds
FROM (SELECT ts, {POINT} FROM p GROUP BY ts)""",
)
def premium_by_time(spark, d):
    return analytics.premium_intraday(px.market(spark, d))


BEST_SERIES_SQL = f"""
WITH {ticks("user_id")}, {FUNDS}, {UNITS},
rows_ AS (SELECT t.ts, t.close_price, t.nav_redemption AS nav, fund_type,
    {units_on("t.ins_code", "t.day")} AS units
  FROM ticks t JOIN funds f ON f.ins_code = t.ins_code AND fund_type IN {EQUITY}),
p AS (SELECT ts, CAST(ts AS DATE) AS day, {PREMIUM} FROM rows_),
SPARSE_DAYS
eod AS (SELECT ins_code, day, arg_max(close_price, {{'a': ts, 'b': ingested_at}}) AS close_price,
    arg_max(nav_redemption, {{'a': ts, 'b': ingested_at}}) FILTER (nav_redemption IS NOT NULL) AS nav
  FROM raw_ticks GROUP BY 1, 2),
drows AS (SELECT e.*, fund_type, {units_on("e.ins_code", "e.day")} AS units
  FROM eod e JOIN funds f ON f.ins_code = e.ins_code AND fund_type IN {EQUITY}),
dp AS (SELECT day, {PREMIUM} FROM drows),
series AS (SELECT ts AS "at", {POINT} FROM p WHERE day NOT IN (SELECT day FROM sparse) GROUP BY ts
  UNION ALL
  SELECT CAST(day AS TIMESTAMP), {POINT} FROM dp
  WHERE day NOT IN (SELECT day FROM p WHERE day NOT IN (SELECT day FROM sparse)) GROUP BY day)
SELECT "at", round(median, 6) AS median, round(weighted, 6) AS weighted, funds FROM series"""


def _best_series_sql(at_least: int) -> str:
    sparse = f"sparse AS (SELECT day FROM p GROUP BY day HAVING count(DISTINCT ts) < {at_least}),"
    return BEST_SERIES_SQL.replace("SPARSE_DAYS", sparse)


def _best_series(spark, d, at_least):
    m = px.market(spark, d)
    return analytics.best_premium_series(analytics.premium_intraday(m), analytics.premium_daily(m), at_least)


@query("premium_best_series", _best_series_sql(2))
def premium_best_series(spark, d):
    return _best_series(spark, d, 2)


@query("premium_sparse_days", _best_series_sql(100_000))
def premium_sparse_days(spark, d):
    """No day has so many minutes, so each gives its daily point."""
    return _best_series(spark, d, 100_000)


@query(
    "market_flow",
    f"""
WITH {ticks("user_id")}, {INDEX}
SELECT t.ts, ind_net_flow, value, CASE WHEN index_value != 0 THEN index_value END AS index_value
FROM (SELECT ts, sum(ind_buy_value - ind_sell_value)::BIGINT AS ind_net_flow,
             sum(value)::BIGINT AS value FROM ticks GROUP BY ts) t
LEFT JOIN idx ON idx.ts = t.ts""",
)
def market_flow(spark, d):
    return analytics.market_flow(px.market(spark, d))


FLOWS_SQL = f"""
WITH {ticks("user_id")}, {FUNDS}, {HISTORY},
official AS (
  SELECT trade_date, fund_type,
    sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN close_price
             WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN -close_price ELSE 0 END)::BIGINT
      AS ind_net_flow, sum(close_price)::BIGINT AS value, false AS estimated
  FROM hist JOIN funds USING (ins_code) WHERE fund_type IN {EQUITY} GROUP BY 1, 2),
live AS (
  SELECT day AS trade_date, fund_type, sum(ind_buy_value - ind_sell_value)::BIGINT AS ind_net_flow,
    sum(value)::BIGINT AS value, true AS estimated
  FROM (SELECT * FROM raw_ticks QUALIFY
        row_number() OVER (PARTITION BY day, ins_code ORDER BY ts DESC, ingested_at DESC) = 1) t
  JOIN funds USING (ins_code) WHERE fund_type IN {EQUITY}
    AND NOT EXISTS (SELECT 1 FROM official o WHERE o.trade_date = t.day) GROUP BY 1, 2),
flows AS (SELECT * FROM official UNION ALL SELECT * FROM live)"""


@query("daily_flows", FLOWS_SQL + " SELECT * FROM flows")
def daily_flows(spark, d):
    return analytics.daily_flows(px.market(spark, d))


@query(
    "flows_pivot",
    FLOWS_SQL
    + """
SELECT trade_date,
  coalesce(sum(ind_net_flow) FILTER (fund_type = 'equity'), 0)::BIGINT AS equity,
  coalesce(sum(ind_net_flow) FILTER (fund_type = 'index'), 0)::BIGINT AS index,
  coalesce(sum(ind_net_flow) FILTER (fund_type = 'sector'), 0)::BIGINT AS sector,
  coalesce(sum(ind_net_flow) FILTER (fund_type = 'leveraged'), 0)::BIGINT AS leveraged,
  sum(ind_net_flow)::BIGINT AS total
FROM flows GROUP BY 1""",
)
def flows_pivot(spark, d):
    return marts.flows_pivot(analytics.daily_flows(px.market(spark, d)))


# --- returns and risk ---------------------------------------------------------------


def _pct(a: str, b: str) -> str:
    return f"round(CASE WHEN {a} != 0 AND {b} != 0 THEN {a}::DOUBLE / {b} - 1 END, 6)"


# New Year's Days that occur in the brand history, for the year-to-date window.
YEAR_STARTS = """years AS (SELECT unnest([DATE '1994-03-21', DATE '1995-03-21', DATE '1996-03-20',
  DATE '1997-03-21', DATE '1998-03-21', DATE '1999-03-21', DATE '2000-03-20', DATE '2001-03-21',
  DATE '2022-03-21', DATE '2023-03-21', DATE '2024-03-20']) AS y)"""


@query(
    "returns_windows",
    f"""
WITH {BRAND_PRICES}, {YEAR_STARTS},
c AS (SELECT ins_code, trade_date AS day, close_price FROM brand_prices WHERE close_price > 0),
t AS (SELECT c.*, (SELECT max(y) FROM years WHERE y <= c.day) AS ystart FROM c),
w AS (
  SELECT t.ins_code, t.day, t.close_price AS c0,
    arg_max(h.close_price, h.day) FILTER (h.day < t.day) AS c1d,
    arg_max(h.close_price, h.day) FILTER (h.day <= t.day - 7) AS c1w,
    arg_max(h.close_price, h.day) FILTER (h.day <= t.day - 30) AS c1m,
    arg_max(h.close_price, h.day) FILTER (h.day <= t.day - 91) AS c3m,
    arg_max(h.close_price, h.day) FILTER (h.day < t.ystart) AS cy
  FROM t JOIN c h ON h.ins_code = t.ins_code AND h.day <= t.day AND h.day > t.day - 400
  GROUP BY 1, 2, 3)
SELECT ins_code, day AS trade_date, {_pct("c0", "c1d")} AS r_1d, {_pct("c0", "c1w")} AS r_1w,
  {_pct("c0", "c1m")} AS r_1m, {_pct("c0", "c3m")} AS r_3m, {_pct("c0", "cy")} AS r_ytd FROM w""",
)
def returns_windows(spark, d):
    return analytics.returns_every_day(_brand_market(spark, d))


def _brand_market(spark, d):
    rows = px.brand_prices(spark, d).withColumn("updated_at", F.lit(0))
    return analytics.Market(history=rows, calendar=px.history_calendar(spark, d))


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} != 0 AND {b} != 0 THEN {a}::DOUBLE / {b} - 1 END"


def _returns_day_sql(pct) -> str:
    return f"""
WITH {ticks("user_id")}, {FUNDS}, {HISTORY}, {YEAR_STARTS},
h AS (SELECT *, max(trade_date) OVER (PARTITION BY ins_code) AS max_d FROM hist
  WHERE trade_date <= DATE '{DAY}' AND trade_date > DATE '{DAY}' - 400 AND close_price > 0),
b AS (
  SELECT ins_code, max(trade_date) AS d0, arg_max(close_price, trade_date) AS c0,
    arg_max(close_price, trade_date) FILTER (trade_date < max_d) AS c1d,
    arg_max(close_price, trade_date) FILTER (trade_date <= DATE '{DAY}' - 7) AS c1w,
    arg_max(close_price, trade_date) FILTER (trade_date <= DATE '{DAY}' - 30) AS c1m,
    arg_max(close_price, trade_date) FILTER (trade_date <= DATE '{DAY}' - 91) AS c3m,
    arg_max(close_price, trade_date) FILTER
      (trade_date < (SELECT max(y) FROM years WHERE y <= DATE '{DAY}')) AS cy
  FROM h GROUP BY 1),
live AS (SELECT ins_code, close_price, prev_close FROM raw_ticks WHERE day = DATE '{DAY}'
  QUALIFY row_number() OVER (PARTITION BY ins_code ORDER BY ts DESC, ingested_at DESC) = 1),
m AS (SELECT b.ins_code, symbol, fund_type, c1w, c1m, c3m, cy,
    CASE WHEN l.ins_code IS NOT NULL AND d0 < DATE '{DAY}' THEN l.close_price ELSE c0 END AS c0,
    CASE WHEN l.ins_code IS NOT NULL AND d0 < DATE '{DAY}' THEN l.prev_close ELSE c1d END AS c1d
  FROM b JOIN funds f ON f.ins_code = b.ins_code AND fund_type IN {EQUITY}
  LEFT JOIN live l ON l.ins_code = b.ins_code),
r AS (SELECT ins_code, symbol, fund_type, {pct("c0", "c1d")} AS r_1d, {pct("c0", "c1w")} AS r_1w,
  {pct("c0", "c1m")} AS r_1m, {pct("c0", "c3m")} AS r_3m, {pct("c0", "cy")} AS r_ytd FROM m)"""


RETURNS_DAY_SQL = _returns_day_sql(_pct)


@query("returns_of_day", RETURNS_DAY_SQL + " SELECT * FROM r")
def returns_of_day(spark, d):
    return analytics.returns(px.market(spark, d), DAY)


@query(
    "returns_unpivot",
    RETURNS_DAY_SQL
    + """
SELECT ins_code, h.horizon, CASE h.horizon WHEN 'r_1d' THEN r_1d WHEN 'r_1w' THEN r_1w
    WHEN 'r_1m' THEN r_1m WHEN 'r_3m' THEN r_3m ELSE r_ytd END AS r
FROM r, (SELECT unnest(['r_1d', 'r_1w', 'r_1m', 'r_3m', 'r_ytd']) AS horizon) h""",
)
def returns_unpivot(spark, d):
    return marts.returns_unpivot(analytics.returns(px.market(spark, d), DAY), ["ins_code"])


@query(
    "heat_limit",
    f"""
WITH {BRAND_PRICES},
r AS (SELECT ins_code, trade_date, coalesce(abs(close_price::DOUBLE / lag(close_price)
       OVER (PARTITION BY ins_code ORDER BY trade_date) - 1), 0) AS r
  FROM brand_prices WHERE close_price > 0),
n AS (SELECT r, row_number() OVER (ORDER BY r) AS pos, count(*) OVER () AS total FROM r)
SELECT 'r_1d' AS horizon, round(greatest(0.005, r), 6) AS "limit"
FROM n WHERE pos = total * 9 // 10 + 1""",
)
def heat_limit(spark, d):
    from pyspark.sql import Window as W

    closes = px.brand_prices(spark, d).filter("close_price > 0")
    ordered = W.partitionBy("ins_code").orderBy("trade_date")
    daily = closes.select(
        F.lit("r_1d").alias("horizon"),
        (F.col("close_price").cast("double") / F.lag("close_price").over(ordered) - 1).alias("r"),
    )
    return marts.heat_limits(daily)


@query(
    "heat_cells",
    _returns_day_sql(_ratio)
    + """,
lim AS (SELECT list_transform(
    [list(abs(coalesce(r_1d, 0))), list(abs(coalesce(r_1w, 0))), list(abs(coalesce(r_1m, 0))),
     list(abs(coalesce(r_3m, 0))), list(abs(coalesce(r_ytd, 0)))],
    lambda a: greatest(0.005, list_sort(a)[len(a) * 9 // 10 + 1])) AS lims FROM r),
cells AS (SELECT ins_code, unnest(['r_1d', 'r_1w', 'r_1m', 'r_3m', 'r_ytd']) AS horizon,
    unnest([r_1d, r_1w, r_1m, r_3m, r_ytd]) AS r, unnest(lims) AS lim FROM r, lim)
SELECT ins_code, horizon, round(least(greatest(coalesce(r / lim, 0), -1), 1), 6) AS heat FROM cells""",
)
def heat_cells(spark, d):
    cells = marts.returns_unpivot(analytics.returns(px.market(spark, d), DAY), ["ins_code"])
    heat = marts.heat_cells(cells, marts.heat_limits(cells))
    return heat.select("ins_code", "horizon", "heat")


VOL_SQL = f"""
WITH {BRAND_PRICES},
c AS (SELECT ins_code, trade_date, close_price, close_price::DOUBLE / lag(close_price)
        OVER (PARTITION BY ins_code ORDER BY trade_date) - 1 AS r
  FROM brand_prices WHERE close_price > 0),
vol AS (SELECT ins_code, count(*) AS closes,
    CASE WHEN count(*) >= 5 THEN stddev_pop(r) * sqrt(252) END AS volatility,
    CASE WHEN count(*) >= 2 THEN arg_max(close_price, trade_date)::DOUBLE
         / arg_min(close_price, trade_date) - 1 END AS period_return FROM c GROUP BY 1)"""


@query(
    "volatility",
    VOL_SQL
    + " SELECT ins_code, closes, round(volatility, 6) AS volatility,"
    + " round(period_return, 6) AS period_return FROM vol",
)
def volatility(spark, d):
    return analytics.volatility(px.brand_prices(spark, d))


@query(
    "risk_quadrants",
    VOL_SQL
    + """
SELECT ins_code, (CASE WHEN volatility <= 40 THEN 'calm' ELSE 'bumpy' END)
  || (CASE WHEN period_return >= 0 THEN '_gain' ELSE '_loss' END) AS quadrant
FROM vol WHERE volatility IS NOT NULL AND period_return IS NOT NULL""",
)
def risk_quadrants(spark, d):
    risk = analytics.volatility(px.brand_prices(spark, d))
    return marts.risk_map(risk, 40.0).select("ins_code", "quadrant")


@query(
    "risk_return",
    f"""
WITH {snapshot()}, {HISTORY},
h AS (SELECT ins_code, trade_date, close_price FROM hist
  WHERE trade_date <= DATE '{DAY}' AND trade_date > DATE '{DAY}' - 400 AND close_price > 0),
s AS (SELECT * FROM snap WHERE trade_date = DATE '{DAY}' AND fund_type IN {EQUITY}),
series AS (SELECT * FROM h UNION ALL SELECT ins_code, DATE '{DAY}', close_price FROM s
  WHERE close_price != 0 AND NOT EXISTS
    (SELECT 1 FROM h WHERE h.ins_code = s.ins_code AND h.trade_date = DATE '{DAY}')),
r AS (SELECT *, close_price::DOUBLE / lag(close_price)
        OVER (PARTITION BY ins_code ORDER BY trade_date) - 1 AS r FROM series),
v AS (SELECT ins_code, CASE WHEN count(*) >= 5 THEN stddev_pop(r) * sqrt(252) END AS volatility,
    CASE WHEN count(*) >= 2 THEN arg_max(close_price, trade_date)::DOUBLE
         / arg_min(close_price, trade_date) - 1 END AS period_return FROM r GROUP BY 1)
SELECT s.ins_code, symbol, fund_type, round(volatility, 6) AS volatility,
  round(period_return, 6) AS period_return, aum
FROM s LEFT JOIN v ON v.ins_code = s.ins_code""",
)
def risk_return(spark, d):
    return analytics.risk_return(px.market(spark, d), DAY, days=400)


# --- chart tables -------------------------------------------------------------------


@query(
    "type_median",
    """
SELECT p_type AS fund_type, count(*) AS n, round(median(p_retailprice * l_quantity), 6) AS median
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def type_median(spark, d):
    lines = px.table(spark, d, "lineitem").selectExpr("l_partkey AS p_partkey", "l_quantity")
    parts = px.table(spark, d, "part").selectExpr(
        "p_partkey", "p_type AS fund_type", "p_retailprice"
    )
    rows = lines.join(parts, "p_partkey").withColumn(
        "premium", F.col("p_retailprice") * F.col("l_quantity")
    )
    return marts.type_medians(rows)


@query(
    "hierarchy",
    """
SELECT p_type AS fund_type, p_brand AS symbol,
  2 - (grouping(p_type) + grouping(p_brand)) AS depth, sum(p_size)::BIGINT AS size,
  count(*) AS members
FROM part WHERE p_size != 0 GROUP BY ROLLUP (p_type, p_brand)""",
)
def hierarchy(spark, d):
    parts = px.table(spark, d, "part").selectExpr(
        "p_type AS fund_type", "p_brand AS symbol", "p_size AS aum"
    )
    return marts.hierarchy(parts, ["fund_type"], "symbol", "aum")


@query(
    "money_map",
    f"""
WITH {snapshot()}
SELECT trade_date, ins_code, round(least(greatest(premium, -0.1), 0.1), 6) AS x,
  round(ind_net_flow::DOUBLE / aum, 6) AS y,
  CASE WHEN premium > 0 AND ind_net_flow > 0 THEN 'inflow_at_premium'
       WHEN premium < 0 AND ind_net_flow > 0 THEN 'inflow_at_discount'
       WHEN premium < 0 AND ind_net_flow < 0 THEN 'outflow_at_discount'
       WHEN premium > 0 AND ind_net_flow < 0 THEN 'outflow_at_premium' ELSE 'on_axis' END AS quadrant
FROM snap WHERE premium IS NOT NULL AND aum != 0""",
)
def money_map(spark, d):
    rows = marts.money_map(analytics.snapshot(px.market(spark, d)))
    return rows.select("trade_date", "ins_code", "x", "y", "quadrant")


@query(
    "topk_sorted_nulls_last",
    f"""
WITH {snapshot()}
SELECT trade_date, ins_code, round(premium, 6) AS premium FROM snap
ORDER BY premium DESC NULLS LAST, ins_code, trade_date LIMIT 25""",
)
def topk_sorted_nulls_last(spark, d):
    snap = analytics.snapshot(px.market(spark, d))
    ordered = snap.orderBy(F.col("premium").desc_nulls_last(), "ins_code", "trade_date").limit(25)
    return ordered.select("trade_date", "ins_code", "premium")


@query(
    "display_money",
    f"""
WITH {HISTORY}
SELECT ins_code, trade_date,
  CASE WHEN close_price >= 10000000000 THEN close_price // 10000000000
       WHEN close_price >= 10000000 THEN close_price // 10000000
       ELSE close_price // 10 END AS shown,
  CASE WHEN close_price >= 10000000000 THEN 'milliard'
       WHEN close_price >= 10000000 THEN 'million' ELSE 'toman' END AS unit
FROM hist""",
)
def display_money(spark, d):
    rows = analytics.newest(px.history(spark, d), "fund_history")
    shown = metrics.display_money("close_price")
    return rows.select(
        "ins_code", "trade_date", F.floor(shown["value"]).alias("shown"),
        shown["unit"].alias("unit"),
    )


@query(
    "flow_share_of_day",
    f"""
WITH {BRAND_PRICES}, t AS (SELECT trade_date, sum(value) AS total FROM brand_prices GROUP BY 1)
SELECT ins_code, b.trade_date, round(value::DOUBLE / total, 6) AS share
FROM brand_prices b JOIN t ON t.trade_date = b.trade_date""",
)
def flow_share_of_day(spark, d):
    prices = px.brand_prices(spark, d)
    totals = prices.groupBy("trade_date").agg(F.sum("value").alias("total"))
    return prices.join(totals, "trade_date").select(
        "ins_code", "trade_date", metrics.share_of("value", "total").alias("share")
    )


@query(
    "buyer_power",
    f"""
WITH {BRAND_FLOWS}
SELECT ins_code, trade_date, (ind_buy_value - ind_sell_value)::BIGINT AS net_flow,
  round(CASE WHEN ind_buy_count > 0 AND ind_sell_count > 0 AND ind_sell_value != 0 THEN
    (ind_buy_value::DOUBLE / ind_buy_count) / (ind_sell_value::DOUBLE / ind_sell_count) END, 6)
    AS buyer_power
FROM brand_flows""",
)
def buyer_power(spark, d):
    flows = px.brand_flows(spark, d)
    return flows.select(
        "ins_code", "trade_date",
        metrics.net_flow("ind_buy_value", "ind_sell_value").alias("net_flow"),
        metrics.buyer_power(
            "ind_buy_value", "ind_buy_count", "ind_sell_value", "ind_sell_count"
        ).alias("buyer_power"),
    )


@query(
    "halted_funds",
    f"""
WITH {snapshot()}
SELECT trade_date, ins_code, status_kind FROM snap
WHERE status_kind NOT IN ('open', 'unknown') AND fund_type IN {EQUITY}""",
)
def halted_funds(spark, d):
    snap = analytics.snapshot(px.market(spark, d))
    return snap.filter(text.is_halted("status_kind") & text.in_equity_family("fund_type")).select(
        "trade_date", "ins_code", "status_kind"
    )

