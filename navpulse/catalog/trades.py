"""Trade tapes and rebuilt minutes: an event is a trade of its event type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from navpulse.catalog import proxies as px, query
from navpulse.catalog.base_sql import BRAND_FLOWS, BRAND_PRICES, EV, ticks
from navpulse.operators.calendar import minute_grid
from navpulse.plans import analytics, backfill
from navpulse.plans.history import FLOW_COLUMNS, history_rows, merge_history
from navpulse.session import freeze, scratch_path
from navpulse.settings import BackfillLimits

NOW = "2024-02-01 00:00:00"
OPEN, CLOSE = px.HOURS.open_second, px.HOURS.close_second


def trades(spark, d) -> DataFrame:
    return px.events(spark, d).selectExpr(
        "event_type AS ins_code", "to_date(ts) AS day", "event_id AS n",
        "hour(at) * 10000 + minute(at) * 100 + second(at) AS heven", "k AS volume",
        "10000 + v AS price", "CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS canceled",
    )


def live_rows(spark, d) -> DataFrame:
    """Hourly observations of the running volume, from the sums of whole hours.

    They start at ten (a click fund's at one); errors report a fifth too much, signups do
    so in every second hour.
    """
    hours = px.events(spark, d).groupBy(
        F.col("event_type").alias("ins_code"), F.to_date("ts").alias("day"),
        F.hour("at").alias("hh"),
    ).agg(F.sum(F.when(F.col("k") % 10 != 0, F.col("k")).otherwise(0)).alias("_v"))
    upto = W.partitionBy("ins_code", "day").orderBy("hh").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("_v").over(upto)
    wrong = (F.col("ins_code") == "error") | (
        (F.col("ins_code") == "signup") & (F.col("hh") % 2 == 1)
    )
    return hours.select(
        "ins_code", "day", ((F.col("hh") + 1) * 3600).alias("sod"), "hh",
        F.when(wrong, F.floor(total * 6 / 5)).otherwise(total).alias("volume"),
    ).filter((F.col("hh") < 23) & ((F.col("hh") >= 9) | (F.col("ins_code") == "click"))).drop("hh")


def official(spark, d) -> DataFrame:
    """Daily totals; a fifth too high for errors, absent for signups on even days."""
    factor = F.when(F.col("ins_code") == "error", 6).otherwise(5)
    totals = trades(spark, d).filter("canceled = 0").groupBy("ins_code", "day").agg(
        F.floor(F.sum("volume") * factor / 5).alias("volume"),
        F.floor(F.sum(F.col("volume") * F.col("price")) * factor / 5).alias("value"),
    )
    return totals.filter((F.col("ins_code") != "signup") | (F.dayofmonth("day") % 2 == 1))


def nothing_done(spark, d) -> DataFrame:
    return trades(spark, d).select("ins_code", "day").filter(F.lit(False))


TAPE = f"""{EV},
tr AS (SELECT event_type AS ins_code, CAST(ts AS DATE) AS day, event_id AS n,
    hour(seen) * 3600 + minute(seen) * 60 + second(seen) AS sod, k AS volume, 10000 + v AS price
  FROM ev WHERE k % 10 != 0),
tape AS (SELECT ins_code, day, sod, n, price AS last_price,
    sum(volume) OVER w AS volume, sum(volume * price) OVER w AS value, row_number() OVER w AS trade_count
  FROM tr WINDOW w AS (PARTITION BY ins_code, day ORDER BY sod, n)),
secs AS (SELECT * FROM tape
  QUALIFY row_number() OVER (PARTITION BY ins_code, day, sod ORDER BY n DESC) = 1)"""

LIVE = """live AS (
  SELECT ins_code, day, (hh + 1) * 3600 AS sod, CASE WHEN ins_code = 'error'
      OR (ins_code = 'signup' AND hh % 2 = 1) THEN total * 6 // 5 ELSE total END AS volume
  FROM (SELECT h.*, sum(v) OVER (PARTITION BY ins_code, day ORDER BY hh)::BIGINT AS total
    FROM (SELECT event_type AS ins_code, CAST(ts AS DATE) AS day, hour(seen) AS hh,
            sum(CASE WHEN k % 10 != 0 THEN k ELSE 0 END)::BIGINT AS v FROM ev GROUP BY 1, 2, 3) h)
  WHERE hh < 23 AND (hh >= 9 OR ins_code = 'click'))"""

VERDICT = """verdict AS (
  SELECT l.ins_code, l.day, count(*) AS overlap, min(sod) AS first_live,
    count(*) FILTER (volume BETWEEN lo * 0.99 - 1 AND hi * 1.01 + 1) AS matched
  FROM (SELECT live.*,
      coalesce((SELECT sum(t.volume) FROM tr t WHERE t.ins_code = live.ins_code
        AND t.day = live.day AND t.sod <= live.sod - 60), 0)::DOUBLE AS lo,
      coalesce((SELECT sum(t.volume) FROM tr t WHERE t.ins_code = live.ins_code
        AND t.day = live.day AND t.sod <= live.sod + 60), 0)::DOUBLE AS hi FROM live) l
  GROUP BY 1, 2)"""

OFFICIAL = """official AS (
  SELECT ins_code, day,
    sum(volume)::BIGINT * (CASE WHEN ins_code = 'error' THEN 6 ELSE 5 END) // 5 AS volume,
    sum(volume * price)::BIGINT * (CASE WHEN ins_code = 'error' THEN 6 ELSE 5 END) // 5 AS value
  FROM tr WHERE ins_code != 'signup' OR day(day) % 2 = 1 GROUP BY 1, 2)"""


def minutes_sql(pairs: str, first: str, last: str) -> str:
    return f"""
SELECT g.ins_code, g.day + to_seconds(g.sod) AS ts, s.last_price, s.volume::BIGINT AS volume,
  s.value::BIGINT AS value, s.trade_count
FROM (SELECT ins_code, day, unnest(range({first}, {last}, 60)) AS sod FROM {pairs}) g
ASOF JOIN secs s ON s.ins_code = g.ins_code AND s.day = g.day AND s.sod <= g.sod"""


@query(
    "tape_asof_grid",
    f"WITH {TAPE}, pairs AS (SELECT DISTINCT ins_code, day FROM tr)"
    + minutes_sql("pairs", str(OPEN), str(CLOSE + 1)),
)
def tape_asof_grid(spark, d):
    tape = backfill.tape_from_trades(trades(spark, d))
    grid = minute_grid(tape.select("ins_code", "day").distinct(), "day", OPEN, CLOSE)
    found = backfill.state_at(grid, tape).filter(F.col("last_price").isNotNull())
    return found.select("ins_code", "ts", "last_price", "volume", "value", "trade_count")


@query(
    "tape_verify",
    f"WITH {TAPE}, {LIVE}, {VERDICT} SELECT ins_code, day, overlap, matched, first_live FROM verdict",
)
def tape_verify(spark, d):
    tape = backfill.tape_from_trades(trades(spark, d))
    return backfill.verify_live(live_rows(spark, d), tape, BackfillLimits())


PASSED = f"""passed AS (SELECT *, first_live - first_live % 60 AS stop,
    matched >= 0.9 * overlap AS good FROM verdict WHERE first_live > {OPEN} + 60)"""


@query(
    "backfill_intraday",
    f"WITH {TAPE}, {LIVE}, {VERDICT}, {PASSED}, good AS (SELECT * FROM passed WHERE good)"
    + minutes_sql("good", str(OPEN), "stop"),
)
def backfill_intraday(spark, d):
    done = backfill.backfill_intraday(
        trades(spark, d), live_rows(spark, d), nothing_done(spark, d), px.HOURS, NOW
    )
    return done.minutes.drop("ingested_at")


@query(
    "backfill_log",
    f"""WITH {TAPE}, {LIVE}, {VERDICT}, {PASSED}, good AS (SELECT * FROM passed WHERE good),
made AS ({minutes_sql("good", str(OPEN), "stop")}),
n AS (SELECT ins_code, CAST(ts AS DATE) AS day, count(*) AS minutes FROM made GROUP BY 1, 2),
firsts AS (SELECT ins_code, day, min(sod) AS f FROM tr GROUP BY 1, 2)
SELECT p.day, p.ins_code, CASE WHEN f IS NULL THEN 'no_trades' WHEN good THEN 'stored'
    ELSE 'rejected' END AS status,
  CASE WHEN f IS NULL THEN 0 ELSE overlap END AS overlap,
  CASE WHEN f IS NULL THEN 0 ELSE matched END AS matched, coalesce(minutes, 0) AS minutes,
  CASE WHEN f IS NULL OR good THEN '' ELSE 'first trade ' || lpad((f // 3600)::VARCHAR, 2, '0')
    || ':' || lpad((f % 3600 // 60)::VARCHAR, 2, '0') END AS note
FROM passed p LEFT JOIN firsts USING (ins_code, day) LEFT JOIN n USING (ins_code, day)""",
)
def backfill_log(spark, d):
    done = backfill.backfill_intraday(
        trades(spark, d), live_rows(spark, d), nothing_done(spark, d), px.HOURS, NOW
    )
    return done.log.drop("recorded_at")


def _resumed(spark, d) -> str:
    """A backfill in three runs: some fund-days fail in the first, the second does the rest, the third finds nothing."""
    table = scratch_path(spark, "backfill")
    live, tape = freeze(live_rows(spark, d)), trades(spark, d)
    even = F.day("day") % 2 == 0
    failed = tape.filter(even & (F.col("ins_code") == "view")).select("ins_code", "day", F.lit("timeout").alias("error")).distinct()

    def run(rows: DataFrame, stamp: str, errors: DataFrame | None = None) -> int | None:
        return backfill.resume(
            spark, table, lambda done: backfill.backfill_intraday(tape, rows, done, px.HOURS, stamp, failed=errors)
        )

    units = [run(live.filter(even), "2024-02-01 00:00:00", failed), run(live, "2024-02-01 01:00:00"), run(live, "2024-02-01 02:00:00")]
    if units != [0, 1, None]:
        raise AssertionError(f"units written: {units}")
    return table


@query(
    "backfill_resumed",
    f"WITH {TAPE}, {LIVE}, {VERDICT}, {PASSED}, good AS (SELECT * FROM passed WHERE good)"
    + minutes_sql("good", str(OPEN), "stop"),
)
def backfill_resumed(spark, d):
    """The stored minutes of all units."""
    return backfill.stored(spark, _resumed(spark, d), "minutes").drop("ingested_at", "unit")


LOG_COLUMNS = """p.day, p.ins_code, CASE WHEN f IS NULL THEN 'no_trades' WHEN good THEN 'stored'
    ELSE 'rejected' END AS status,
  CASE WHEN f IS NULL THEN 0 ELSE overlap END AS overlap,
  CASE WHEN f IS NULL THEN 0 ELSE matched END AS matched, coalesce(minutes, 0) AS minutes,
  CASE WHEN f IS NULL OR good THEN '' ELSE 'first trade ' || lpad((f // 3600)::VARCHAR, 2, '0')
    || ':' || lpad((f % 3600 // 60)::VARCHAR, 2, '0') END AS note"""


@query(
    "backfill_units",
    f"""WITH {TAPE}, {LIVE}, {VERDICT}, {PASSED}, good AS (SELECT * FROM passed WHERE good),
made AS ({minutes_sql("good", str(OPEN), "stop")}),
n AS (SELECT ins_code, CAST(ts AS DATE) AS day, count(*) AS minutes FROM made GROUP BY 1, 2),
firsts AS (SELECT ins_code, day, min(sod) AS f FROM tr GROUP BY 1, 2),
entries AS (SELECT {LOG_COLUMNS}, day(p.day) % 2 = 0 AS early, day(p.day) % 2 = 0 AND p.ins_code = 'view' AND f IS NOT NULL AS fails
  FROM passed p LEFT JOIN firsts USING (ins_code, day) LEFT JOIN n USING (ins_code, day))
SELECT day, ins_code, status, overlap, matched, minutes, note, CASE WHEN early AND NOT fails THEN 0 ELSE 1 END AS unit FROM entries
UNION ALL SELECT day, ins_code, 'error', 0, 0, 0, 'timeout', 0 FROM entries WHERE fails""",
)
def backfill_units(spark, d):
    """The decision log with the unit each decision came in; a failed fund-day is decided in the next one."""
    return backfill.stored(spark, _resumed(spark, d), "log").drop("recorded_at")


@query(
    "official_verify",
    f"""WITH {TAPE}, {OFFICIAL},
last AS (SELECT ins_code, day, sum(volume) AS volume, sum(volume * price) AS value FROM tr GROUP BY 1, 2)
SELECT l.ins_code, l.day, CASE WHEN o.volume IS NULL THEN 0 ELSE 1 END::BIGINT AS overlap,
  CASE WHEN o.volume != 0 AND abs(l.volume - o.volume) <= 0.01 * o.volume
    AND abs(l.value - o.value) <= 0.01 * greatest(o.value, 1) THEN 1 ELSE 0 END::BIGINT AS matched
FROM last l LEFT JOIN official o ON o.ins_code = l.ins_code AND o.day = l.day""",
)
def official_verify(spark, d):
    tape = backfill.tape_from_trades(trades(spark, d))
    return backfill.verify_official(tape, official(spark, d), BackfillLimits())


def price_events(spark, d) -> DataFrame:
    """Running totals per second, as the provider serves them for a past day."""
    tape = backfill.tape_from_trades(trades(spark, d))
    h, m, s = F.floor(F.col("sod") / 3600), F.floor(F.col("sod") / 60) % 60, F.col("sod") % 60
    return tape.withColumns({"heven": h * 10000 + m * 100 + s, "position": F.col("sod")}).drop("sod")


def _sessions(spark, d):
    targets = trades(spark, d).select("ins_code", "day").distinct()
    return backfill.backfill_sessions(
        price_events(spark, d), targets, official(spark, d), nothing_done(spark, d), px.HOURS, NOW
    )


SESSION_GOOD = """good AS (
  SELECT l.ins_code, l.day FROM (SELECT ins_code, day, sum(volume) AS volume,
      sum(volume * price) AS value FROM tr GROUP BY 1, 2) l
  JOIN official o ON o.ins_code = l.ins_code AND o.day = l.day
  WHERE o.volume != 0 AND abs(l.volume - o.volume) <= 0.01 * o.volume
    AND abs(l.value - o.value) <= 0.01 * greatest(o.value, 1))"""


@query(
    "backfill_sessions",
    f"WITH {TAPE}, {OFFICIAL}, {SESSION_GOOD}" + minutes_sql("good", str(OPEN), str(CLOSE + 1)),
)
def backfill_sessions(spark, d):
    return _sessions(spark, d).minutes.drop("ingested_at")


@query(
    "backfill_report",
    f"""WITH {TAPE}, {OFFICIAL}, {SESSION_GOOD},
made AS ({minutes_sql("good", str(OPEN), str(CLOSE + 1))}),
pairs AS (SELECT event_type AS ins_code, CAST(ts AS DATE) AS day, bool_or(k % 10 != 0) AS traded
  FROM ev GROUP BY 1, 2)
SELECT p.day, count(*) AS funds, count(g.ins_code) AS stored,
  count(*) FILTER (traded AND g.ins_code IS NULL) AS rejected,
  (SELECT count(*) FROM made WHERE CAST(made.ts AS DATE) = p.day) AS minutes,
  coalesce(string_agg(p.ins_code, ',' ORDER BY p.ins_code)
    FILTER (traded AND g.ins_code IS NULL), '') AS rejected_symbols
FROM pairs p LEFT JOIN good g ON g.ins_code = p.ins_code AND g.day = p.day GROUP BY p.day""",
)
def backfill_report(spark, d):
    return backfill.report(_sessions(spark, d).log).drop("errors")


@query(
    "fund_intraday",
    f"""WITH {ticks("event_type")},
firsts AS (SELECT ins_code, day, min(ts) AS first_ts FROM raw_ticks GROUP BY 1, 2),
rebuilt AS (SELECT ins_code, day, unnest(range(day::TIMESTAMP, day + INTERVAL 24 HOUR,
    INTERVAL 1 MINUTE)) AS ts FROM firsts)
SELECT day AS trade_date, ins_code, ts, last_price, nav_redemption AS nav,
  CASE WHEN nav_redemption != 0 THEN round(close_price::DOUBLE / nav_redemption - 1, 6) END AS premium,
  ind_buy_value - ind_sell_value AS ind_net_flow, false AS backfilled FROM ticks
UNION ALL SELECT r.day, r.ins_code, r.ts, 1, NULL, NULL, NULL, true
FROM rebuilt r JOIN firsts f ON f.ins_code = r.ins_code AND f.day = r.day WHERE r.ts < f.first_ts""",
)
def fund_intraday(spark, d):
    """Live minutes, with a rebuilt row offered for every minute of the day."""
    live = px.raw_ticks(spark, d, "event_type").drop("band_low", "band_high", "feed_heven")
    pairs = live.select("ins_code", F.to_date("ts").alias("day")).distinct()
    rebuilt = minute_grid(pairs, "day", 0, 86399).select(
        "ts", "ins_code", F.lit(1).cast("long").alias("last_price"),
        F.lit(1).cast("long").alias("volume"), F.lit(1).cast("long").alias("value"),
        F.lit(1).cast("long").alias("trade_count"), F.col("ts").alias("ingested_at"),
    )
    m = analytics.Market(ticks=live, rebuilt=rebuilt, funds=px.funds(spark, d))
    return analytics.fund_intraday(m).select(
        "trade_date", "ins_code", "ts", "last_price", "nav", "premium", "ind_net_flow", "backfilled"
    )


@query(
    "first_live_points",
    f"""WITH {ticks("event_type")}
SELECT day AS trade_date, ins_code, min(ts) AS first_live FROM raw_ticks
GROUP BY 1, 2 HAVING min(ts) > day::TIMESTAMP""",
)
def first_live_points(spark, d):
    live = px.raw_ticks(spark, d, "event_type").drop("band_low", "band_high", "feed_heven")
    pairs = live.select("ins_code", F.to_date("ts").alias("day")).distinct()
    rebuilt = minute_grid(pairs, "day", 0, 86399).select(
        "ts", "ins_code", F.lit(1).cast("long").alias("last_price"),
        F.lit(1).cast("long").alias("volume"), F.col("ts").alias("ingested_at"),
    )
    m = analytics.Market(ticks=live, rebuilt=rebuilt, funds=px.funds(spark, d))
    return analytics.first_live_points(analytics.fund_intraday(m))


@query(
    "history_merge_topn",
    f"""WITH {BRAND_PRICES}, {BRAND_FLOWS},
top AS (SELECT * FROM brand_prices
  QUALIFY row_number() OVER (PARTITION BY ins_code ORDER BY trade_date DESC) <= 400)
SELECT t.ins_code, t.trade_date, t.close_price, t.volume, t.value, t.trade_count,
  coalesce(f.ind_buy_value, 0)::BIGINT AS ind_buy_value, coalesce(f.ind_sell_value, 0)::BIGINT AS ind_sell_value,
  coalesce(f.inst_buy_value, 0)::BIGINT AS inst_buy_value, coalesce(f.inst_sell_value, 0)::BIGINT AS inst_sell_value,
  coalesce(f.ind_buy_count, 0)::BIGINT AS ind_buy_count, coalesce(f.ind_sell_count, 0)::BIGINT AS ind_sell_count
FROM top t LEFT JOIN brand_flows f ON f.ins_code = t.ins_code AND f.trade_date = t.trade_date""",
)
def history_merge_topn(spark, d):
    deven = F.date_format("trade_date", "yyyyMMdd").cast("long")
    prices = px.brand_prices(spark, d).withColumns({"deven": deven, "position": F.lit(0)})
    flows = px.brand_flows(spark, d).withColumns({"deven": deven, "position": F.lit(0)})
    flows = flows.withColumns(
        {c: F.lit(0).cast("long") for c in FLOW_COLUMNS if c not in flows.columns}
    )
    merged = merge_history(prices.drop("trade_date"), flows, days=400)
    return merged.select(
        "ins_code", "trade_date", "close_price", "volume", "value", "trade_count", "ind_buy_value",
        "ind_sell_value", "inst_buy_value", "inst_sell_value", "ind_buy_count", "ind_sell_count",
    )


@query(
    "history_rows",
    f"""WITH {BRAND_PRICES}, {BRAND_FLOWS},
top AS (SELECT * FROM brand_prices
  QUALIFY row_number() OVER (PARTITION BY ins_code ORDER BY trade_date DESC) <= 30)
SELECT t.trade_date, t.ins_code, 0::BIGINT AS open_price, 0::BIGINT AS high_price, 0::BIGINT AS low_price, t.close_price,
  0::BIGINT AS last_price, 0::BIGINT AS prev_close, t.volume, t.value, t.trade_count,
  coalesce(f.ind_buy_value, 0)::BIGINT AS ind_buy_value, coalesce(f.ind_sell_value, 0)::BIGINT AS ind_sell_value,
  coalesce(f.inst_buy_value, 0)::BIGINT AS inst_buy_value, coalesce(f.inst_sell_value, 0)::BIGINT AS inst_sell_value,
  TIMESTAMP '2024-02-01 08:00:00' AS updated_at
FROM top t LEFT JOIN brand_flows f ON f.ins_code = t.ins_code AND f.trade_date = t.trade_date""",
)
def history_rows_(spark, d):
    """The stored history of one sync: the newest days of each fund, in the stored columns."""
    deven = F.date_format("trade_date", "yyyyMMdd").cast("long")
    zero = F.lit(0).cast("long")
    prices = px.brand_prices(spark, d).withColumns({"deven": deven, "position": F.lit(0)})
    prices = prices.withColumns({c: zero for c in ("open_price", "high_price", "low_price", "last_price", "prev_close")})
    flows = px.brand_flows(spark, d).withColumns({"deven": deven, "position": F.lit(0)})
    flows = flows.withColumns({c: zero for c in FLOW_COLUMNS if c not in flows.columns})
    rows = history_rows(prices.drop("trade_date"), flows, 30, "2024-02-01 08:00:00")
    unset = [c for c in FLOW_COLUMNS if c.endswith(("volume", "count"))]
    return rows.drop(*unset)
