"""Common table expressions for the SQL texts: the projections of ``proxies`` in SQL."""

EV = """ev AS (
  SELECT event_id, ts AS seen, date_trunc('minute', ts) AS ts, CAST(user_id AS VARCHAR) AS user_id,
         event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS v
  FROM events)"""


def ticks(instrument: str) -> str:
    """``raw_ticks`` (every event) and ``ticks`` (newest per fund and minute)."""
    return f"""{EV},
raw_ticks AS (
  SELECT *, volume * 10000 + v AS value,
         volume * (k % 10) // 10 AS ind_buy_volume, volume // 2 AS ind_sell_volume,
         volume - volume * (k % 10) // 10 + CASE WHEN k % 9 = 0 THEN volume // 10 ELSE 0 END
           AS inst_buy_volume,
         volume - volume // 2 AS inst_sell_volume,
         nav_redemption + 100 AS nav_subscription,
         (volume * (k % 10) // 10) * close_price AS ind_buy_value,
         (volume // 2) * close_price AS ind_sell_value,
         (volume - volume * (k % 10) // 10 + CASE WHEN k % 9 = 0 THEN volume // 10 ELSE 0 END)
           * close_price AS inst_buy_value,
         (volume - volume // 2) * close_price AS inst_sell_value,
         k % 10 AS ind_buy_count, k % 6 AS ind_sell_count, k * 10000 AS block_value,
         16 + CASE WHEN k % 7 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 17 = 0 THEN 8 ELSE 0 END
           + CASE WHEN k % 13 = 0 THEN 32 ELSE 0 END AS quality_flags
  FROM (
    SELECT ts, {instrument} AS ins_code, seen AS ingested_at, k, v, CAST(ts AS DATE) AS day,
           strftime(ts, '%Y%m%d%H%M') AS run_id,
           10000 + v AS close_price, 10000 + v + k - 50 AS last_price,
           10000 + v // 2 AS open_price, 10000 + v // 2 - k AS low_price,
           10000 + v + CASE WHEN k % 5 = 0 THEN -60 ELSE 5 * k END AS high_price,
           10000 + (v * 7) % 3000 AS prev_close,
           CASE WHEN k % 7 = 0 THEN NULL ELSE 10000 + 30 * k END AS nav_redemption,
           CASE WHEN k % 7 != 0 AND k % 19 != 0 THEN ts - to_minutes(k % 30) END AS nav_at,
           hour(seen) * 3600 + minute(seen) * 60 + second(seen) + 37 * k AS volume,
           CASE WHEN k % 13 = 0 THEN 0
                ELSE (hour(seen) * 3600 + minute(seen) * 60 + second(seen)) // 60 + k % 10 END
             AS trade_count,
           CASE WHEN k % 11 != 0 THEN 9800 + 10 * hour(ts) END AS band_low,
           CASE WHEN k % 11 != 0 THEN 14000 + 100 * hour(ts) END AS band_high,
           hour(ts) * 10000 + (minute(ts) // 10) * 1000 AS feed_heven
    FROM ev)),
ticks AS (
  SELECT * FROM raw_ticks
  QUALIFY row_number() OVER (PARTITION BY ins_code, ts ORDER BY ingested_at DESC) = 1)"""


FUNDS = """funds AS (
  SELECT CAST(c_custkey AS VARCHAR) AS ins_code, c_name AS symbol,
         c_name || ' ' || c_mktsegment AS name,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'equity' WHEN 'BUILDING' THEN 'index'
           WHEN 'FURNITURE' THEN 'sector' WHEN 'HOUSEHOLD' THEN 'leveraged'
           ELSE 'fixed_income' END AS fund_type
  FROM customer)"""

UNITS = """units AS (
  SELECT user_id AS ins_code, CAST(ts AS DATE) AS trade_date, arg_max(100 + k, seen) AS units
  FROM ev WHERE event_type = 'signup' GROUP BY 1, 2)"""

STATES = """states AS (
  SELECT user_id AS ins_code, ts,
         CASE k % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'A ' WHEN 2 THEN 'AS' WHEN 3 THEN 'ar'
           WHEN 4 THEN 'IG' ELSE 'I' END AS code,
         CASE WHEN k % 4 = 0 THEN '' ELSE 'T' || k END AS title, k % 2 AS under_supervision, seen
  FROM ev WHERE event_type = 'error')"""

INDEX = """idx AS (
  SELECT ts, CAST(CASE WHEN k % 8 = 0 THEN 0 ELSE 1000 + v END AS DOUBLE) AS index_value,
         CAST(k - 50 AS DOUBLE) AS index_change, seen
  FROM ev WHERE event_type = 'purchase'
  QUALIFY row_number() OVER (PARTITION BY ts ORDER BY seen DESC) = 1)"""

RUNS = """runs AS (
  SELECT strftime(ts, '%Y%m%d%H%M') AS run_id, min(seen) AS started_at, max(seen) AS finished_at,
         ts AS tick, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failed,
         count(DISTINCT event_type) AS received_funds, 5 AS expected_funds,
         CASE WHEN count(*) FILTER (event_type = 'error') = count(*) THEN 'failed'
              WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'partial' ELSE 'ok' END AS status
  FROM ev GROUP BY ts)"""

HISTORY = """hist AS (
  SELECT CAST(o_custkey AS VARCHAR) AS ins_code, CAST(o_orderdate AS DATE) + 8214 AS trade_date,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS close_price,
         o_orderkey AS volume, o_orderpriority
  FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1)"""

BRAND_PRICES = """brand_prices AS (
  SELECT p_brand AS ins_code, CAST(l_shipdate AS DATE) AS trade_date,
         arg_max(cents // qty, {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey,
                                'd': l_suppkey, 'e': cents}) AS close_price,
         CAST(sum(qty) AS BIGINT) AS volume, CAST(sum(cents) AS BIGINT) AS value,
         count(*) AS trade_count
  FROM (SELECT *, CAST(l_quantity AS BIGINT) AS qty,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM lineitem)
  JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""

BRAND_FLOWS = """brand_flows AS (
  SELECT p_brand AS ins_code, CAST(l_shipdate AS DATE) AS trade_date,
         sum(CASE WHEN ind AND buy THEN cents ELSE 0 END) AS ind_buy_value,
         sum(CASE WHEN ind AND NOT buy THEN cents ELSE 0 END) AS ind_sell_value,
         sum(CASE WHEN NOT ind AND buy THEN cents ELSE 0 END) AS inst_buy_value,
         sum(CASE WHEN NOT ind AND NOT buy THEN cents ELSE 0 END) AS inst_sell_value,
         count(*) FILTER (ind AND buy) AS ind_buy_count,
         count(*) FILTER (ind AND NOT buy) AS ind_sell_count
  FROM (SELECT p_brand, l_shipdate, l_linestatus = 'O' AS buy,
               c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') AS ind,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey) GROUP BY 1, 2)"""


def units_on(key: str, day: str) -> str:
    """Correlated scalar: the unit count of a fund on a day, else its first one."""
    return f"""coalesce(
    (SELECT arg_max(u.units, u.trade_date) FROM units u
      WHERE u.ins_code = {key} AND u.trade_date <= {day}),
    (SELECT arg_min(u.units, u.trade_date) FROM units u WHERE u.ins_code = {key}))"""


# The last tick of each fund and day with its units, metrics and status.
SNAPSHOT = """snap0 AS (
  SELECT t.day AS trade_date, t.ins_code, t.ts, t.close_price, t.prev_close, t.last_price,
         t.nav_redemption AS nav, t.value, t.volume, t.trade_count,
         t.ind_buy_value - t.ind_sell_value AS ind_net_flow,
         t.inst_buy_value - t.inst_sell_value AS inst_net_flow,
         t.ind_buy_value, t.ind_buy_count, t.ind_sell_value, t.ind_sell_count, t.quality_flags,
         coalesce(f.symbol, t.ins_code) AS symbol, coalesce(f.fund_type, 'other') AS fund_type
  FROM (SELECT * FROM raw_ticks
        QUALIFY row_number() OVER (PARTITION BY day, ins_code ORDER BY ts DESC, ingested_at DESC) = 1) t
  LEFT JOIN funds f ON f.ins_code = t.ins_code),
snap1 AS (
  SELECT s.*, """ + units_on("s.ins_code", "s.trade_date") + """ AS units,
    (SELECT arg_max({'code': st.code, 'title': st.title, 'sup': st.under_supervision, 'ts': st.ts},
                    {'a': st.ts, 'b': st.seen})
       FROM states st WHERE st.ins_code = s.ins_code
        AND CAST(st.ts AS DATE) BETWEEN s.trade_date - 30 AND s.trade_date) AS st
  FROM snap0 s),
snap AS (
  SELECT *, CASE WHEN nav != 0 AND units != 0 THEN nav * units END AS aum,
         CASE WHEN close_price != 0 AND prev_close != 0
              THEN CAST(close_price AS DOUBLE) / prev_close - 1 END AS change,
         CASE WHEN fund_type != 'leveraged' AND nav != 0 AND close_price != 0
              THEN CAST(close_price AS DOUBLE) / nav - 1 END AS premium,
         CASE WHEN st IS NULL THEN 'unknown'
              WHEN upper(trim(st.code))[2] = 'S' THEN 'suspended'
              WHEN upper(trim(st.code))[2] = 'R' THEN 'reserved'
              WHEN upper(trim(st.code))[2] = 'G' THEN 'blocked'
              WHEN upper(trim(st.code))[1] = 'I' THEN 'forbidden'
              WHEN upper(trim(st.code)) = 'A' THEN 'open' ELSE 'unknown' END AS status_kind
  FROM snap1)"""


def snapshot() -> str:
    return ",\n".join([ticks("user_id"), FUNDS, UNITS, STATES, SNAPSHOT])
