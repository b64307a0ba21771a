"""Pipeline health on the test tables: a minute with events is a cycle."""

from __future__ import annotations

import datetime as dt
import zlib

from pyspark.sql import functions as F

from navpulse.catalog import proxies as px, query
from navpulse.catalog.base_sql import EV, FUNDS, RUNS
from navpulse.functions import text, times
from navpulse.operators import calendar
from navpulse.operators.calendar import from_jalali, jalali_to_date, require_calendar
from navpulse.operators.latest import latest_version
from navpulse.plans import ops, quality, sampling, session_day, universe
from navpulse.session import freeze
from navpulse.settings import MarketHours
from navpulse.sources import archive


@query(
    "completeness",
    f"""
WITH {EV}, {RUNS}
SELECT CAST(tick AS DATE) AS trade_date,
  round(sum(received_funds)::DOUBLE / sum(expected_funds), 6) AS completeness FROM runs GROUP BY 1""",
)
def completeness(spark, d):
    return quality.completeness_report(px.runs(spark, d))


@query(
    "runs_by_status",
    f"""
WITH {EV}, {RUNS}
SELECT CAST(tick AS DATE) AS trade_date, status, count(*) AS n, sum(received_funds)::BIGINT AS received,
  sum(expected_funds)::BIGINT AS expected FROM runs GROUP BY 1, 2""",
)
def runs_by_status(spark, d):
    return quality.runs_report(px.runs(spark, d))


@query(
    "quality_issues",
    f"""
WITH {EV}
SELECT CAST(ts AS DATE) AS trade_date, event_type AS "check",
  CASE WHEN k % 3 = 0 THEN 'warn' ELSE 'error' END AS severity,
  CASE WHEN k % 2 = 0 THEN 'kept' ELSE 'flagged' END AS action, count(*) AS n
FROM ev GROUP BY 1, 2, 3, 4""",
)
def quality_issues(spark, d):
    return quality.issues_report(_issues(spark, d))


def _issues(spark, d):
    return px.events(spark, d).selectExpr(
        "ts", "event_type AS check", "CASE WHEN k % 3 = 0 THEN 'warn' ELSE 'error' END AS severity",
        "CASE WHEN k % 2 = 0 THEN 'kept' ELSE 'flagged' END AS action",
    )


@query(
    "top_issues",
    f"""
WITH {EV}
SELECT event_type AS "check", CASE WHEN k % 3 = 0 THEN 'warn' ELSE 'error' END AS severity,
  CASE WHEN k % 2 = 0 THEN 'kept' ELSE 'flagged' END AS action, count(*) AS n
FROM ev GROUP BY 1, 2, 3 ORDER BY n DESC, 1, 2, 3 LIMIT 8""",
)
def top_issues(spark, d):
    return quality.top_issues(_issues(spark, d))


@query(
    "recent_runs",
    f"""
WITH {EV}, {RUNS}
SELECT run_id, tick, status, requests, failed,
  date_diff('microsecond', started_at, finished_at) // 1000 AS duration_ms
FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 20""",
)
def recent_runs(spark, d):
    return ops.recent_runs(px.runs(spark, d))


STREAKS = f"""
WITH {EV}, {RUNS},
marked AS (SELECT *, status = 'failed' AS bad, row_number() OVER (ORDER BY started_at, run_id)
    - row_number() OVER (PARTITION BY status = 'failed' ORDER BY started_at, run_id) AS island
  FROM runs),
counted AS (SELECT *, CASE WHEN bad THEN row_number() OVER
    (PARTITION BY bad, island ORDER BY started_at, run_id) ELSE 0 END AS streak FROM marked)"""


@query("failed_streak", STREAKS + " SELECT run_id, status, streak FROM counted")
def failed_streak(spark, d):
    return ops.failed_streaks(px.runs(spark, d)).select("run_id", "status", "streak")


@query(
    "streak_alerts",
    STREAKS
    + """,
b AS (SELECT *, lag(streak, 1, 0) OVER (ORDER BY started_at, run_id) AS before FROM counted)
SELECT run_id, started_at, 'failing' AS event, streak AS failed_cycles FROM b WHERE bad AND streak = 3
UNION ALL SELECT run_id, started_at, 'recovered', before FROM b WHERE NOT bad AND before >= 3""",
)
def streak_alerts(spark, d):
    return ops.streak_alerts(px.runs(spark, d), threshold=3)


@query(
    "collector_state",
    f"""
WITH {EV}, {RUNS},
r AS (SELECT *, row_number() OVER (ORDER BY started_at DESC, run_id DESC) AS n FROM runs
  ORDER BY started_at DESC, run_id DESC LIMIT 10)
SELECT CASE WHEN date_diff('second', arg_min(finished_at, n), TIMESTAMP '2024-02-01 00:00:00') <= 180
    THEN 'ok' ELSE 'stale' END AS state,
  arg_min(tick, n) AS last_tick, arg_min(status, n) AS last_status,
  coalesce(min(n) FILTER (status != 'failed') - 1, count(*)) AS failed_streak FROM r""",
)
def collector_state(spark, d):
    now = dt.datetime(2024, 2, 1)
    return ops.collector_state(px.runs(spark, d), now, market_open=True).drop("lag_seconds")


@query(
    "sustained_condition",
    f"""
WITH {EV}, {RUNS},
marked AS (SELECT *, received_funds < 2 AS low, row_number() OVER (ORDER BY tick)
    - row_number() OVER (PARTITION BY received_funds < 2 ORDER BY tick) AS island FROM runs),
held AS (SELECT *, date_diff('second', min(tick) OVER (PARTITION BY low, island ORDER BY tick), tick)
    AS held_seconds FROM marked)
SELECT tick, received_funds, held_seconds FROM held WHERE low AND held_seconds >= 600""",
)
def sustained_condition(spark, d):
    rows = ops.sustained(px.runs(spark, d), [], "tick", F.col("received_funds") < 2, 10)
    return rows.select("tick", "received_funds", "held_seconds")


@query(
    "alerts_inhibited",
    f"""
WITH {EV}, {RUNS},
marked AS (SELECT tick, received_funds < 2 AS low, failed > 0 AS bad,
    row_number() OVER (ORDER BY tick) - row_number() OVER (PARTITION BY received_funds < 2 ORDER BY tick)
      AS i1,
    row_number() OVER (ORDER BY tick) - row_number() OVER (PARTITION BY failed > 0 ORDER BY tick) AS i2
  FROM runs),
held AS (SELECT *, date_diff('second', min(tick) OVER (PARTITION BY low, i1 ORDER BY tick), tick) AS h1,
    date_diff('second', min(tick) OVER (PARTITION BY bad, i2 ORDER BY tick), tick) AS h2 FROM marked),
fired AS (SELECT tick, 'low_completeness' AS alert, 'warning' AS severity FROM held
    WHERE low AND h1 >= 600
  UNION ALL SELECT tick, 'collector_failing', 'critical' FROM held WHERE bad AND h2 >= 60)
SELECT tick AS "at", alert, severity FROM fired f WHERE severity = 'critical' OR NOT EXISTS
  (SELECT 1 FROM fired c WHERE c.severity = 'critical' AND c.tick = f.tick)""",
)
def alerts_inhibited(spark, d):
    samples = px.runs(spark, d).withColumn("at", F.col("tick"))
    rules = {
        "low_completeness": (F.col("received_funds") < 2, 10, "warning", "collector"),
        "collector_failing": (F.col("failed") > 0, 1, "critical", "collector"),
    }
    return ops.inhibit(ops.firing_alerts(samples, rules)).select("at", "alert", "severity")


@query(
    "operational_alerts",
    f"""
WITH {EV}, {RUNS},
s AS (SELECT *, CAST(tick AS DATE) AS day, epoch(tick)::BIGINT AS s,
    row_number() OVER (ORDER BY tick) - row_number() OVER (PARTITION BY status = 'failed' ORDER BY tick) AS island,
    date_diff('microsecond', started_at, finished_at) // 1000 / 1000.0 AS took FROM runs),
f AS (SELECT *, CASE WHEN status = 'failed' THEN row_number() OVER (PARTITION BY status = 'failed', island ORDER BY tick)
      ELSE 0 END AS streak,
    s - max(CASE WHEN status != 'failed' THEN s END) OVER (PARTITION BY day ORDER BY s) AS age,
    received_funds / nullif(expected_funds, 0)::DOUBLE AS completeness,
    sum(failed) OVER m / nullif(sum(requests) OVER m, 0)::DOUBLE AS errors,
    quantile_cont(took, 0.95) OVER q AS p95,
    isodow(day) <= 5 AND hour(tick) * 60 + minute(tick) BETWEEN 480 AND 1080 AS open_ FROM s
  WINDOW m AS (PARTITION BY day ORDER BY s RANGE BETWEEN 599 PRECEDING AND CURRENT ROW),
    q AS (PARTITION BY day ORDER BY s RANGE BETWEEN 899 PRECEDING AND CURRENT ROW)),
cond AS (SELECT tick, 'collector_failing' AS alert, 'critical' AS severity, 60 AS hold, coalesce(streak >= 3, false) AS hit FROM f
  UNION ALL SELECT tick, 'data_stale', 'critical', 120, coalesce(age > 300 AND open_, false) FROM f
  UNION ALL SELECT tick, 'low_completeness', 'warning', 600, coalesce(completeness < 0.9 AND open_, false) FROM f
  UNION ALL SELECT tick, 'source_errors', 'warning', 600, coalesce(errors > 0.2, false) FROM f
  UNION ALL SELECT tick, 'slow_cycles', 'warning', 900, coalesce(p95 > 45, false) FROM f),
isl AS (SELECT *, row_number() OVER (PARTITION BY alert ORDER BY tick)
    - row_number() OVER (PARTITION BY alert, hit ORDER BY tick) AS i FROM cond),
fired AS (SELECT tick, alert, severity FROM (SELECT *,
    date_diff('second', min(tick) OVER (PARTITION BY alert, hit, i), tick) AS held FROM isl) WHERE hit AND held >= hold)
SELECT tick AS "at", alert, severity FROM fired a
WHERE (severity = 'critical' OR NOT EXISTS (SELECT 1 FROM fired c WHERE c.severity = 'critical' AND c.tick = a.tick))
  AND NOT (alert IN ('data_stale', 'source_errors', 'low_completeness')
    AND EXISTS (SELECT 1 FROM fired c WHERE c.alert = 'collector_failing' AND c.tick = a.tick))""",
)
def operational_alerts(spark, d):
    samples = ops.rule_samples(px.runs(spark, d), px.HOURS, px.feed_calendar(spark, d))
    fired = ops.firing_alerts(samples, ops.operational_rules())
    return ops.inhibit(fired, ops.RULE_CAUSES).select("at", "alert", "severity")


def _raw(spark, d):
    """Events as archived responses of the endpoint of their type."""
    return px.events(spark, d).selectExpr(
        "event_type AS endpoint", "at AS fetched_at", "v AS latency_ms",
        "CASE WHEN k % 20 = 0 THEN 500 ELSE 200 END AS status_code",
    )


@query(
    "latency_p95",
    f"""
WITH {EV},
n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v) AS pos,
    count(*) OVER (PARTITION BY event_type) AS total FROM ev)
SELECT event_type AS endpoint, count(*) AS responses, count(*) FILTER (k % 20 = 0) AS errors,
  max(v) FILTER (pos = (total * 19 + 19) // 20) AS p95_ms
FROM n GROUP BY 1""",
)
def latency_p95(spark, d):
    return ops.latency_report(_raw(spark, d))


@query(
    "duration_by_status",
    f"""
WITH {EV}, {RUNS}
SELECT status, count(*) AS n,
  round(avg(date_diff('microsecond', started_at, finished_at) // 1000), 6) AS avg_ms
FROM runs GROUP BY 1""",
)
def duration_by_status(spark, d):
    return ops.duration_report(px.runs(spark, d))


@query(
    "error_ratio_sliding",
    f"""
WITH {EV},
m AS (SELECT ts, count(*) AS n, count(*) FILTER (k % 20 = 0) AS bad FROM ev GROUP BY ts),
w AS (SELECT unnest(range(ts - INTERVAL 9 MINUTE, ts + INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS s,
    n, bad FROM m)
SELECT s AS window_start, s + INTERVAL 10 MINUTE AS window_end, sum(n)::BIGINT AS responses,
  sum(bad)::BIGINT AS bad, round(sum(bad)::DOUBLE / sum(n), 6) AS ratio FROM w GROUP BY s""",
)
def error_ratio_sliding(spark, d):
    return ops.sliding_ratio(_raw(spark, d), "fetched_at", F.col("status_code") != 200)


@query(
    "market_day_corrections",
    f"""
WITH {EV},
days AS (SELECT CAST(ts AS DATE) AS day, bool_or(event_type = 'purchase' AND k = 50) AS shown,
    max(hour(seen) * 3600 + minute(seen) * 60 + second(seen)) AS latest FROM ev GROUP BY 1)
SELECT day, false AS trading, 'closed' AS note FROM days
WHERE isodow(day) <= 5 AND NOT shown AND latest >= 8 * 3600 + 1200""",
)
def market_day_corrections(spark, d):
    shown = F.col("event_type").eqNullSafe("purchase") & (F.col("k") == 50)
    probes = px.events(spark, d).select(
        "at", F.when(shown, F.to_date("ts")).alias("session_day")
    )
    rows = ops.market_day_corrections(
        probes, px.feed_calendar(spark, d), px.HOURS, "closed", "opened"
    )
    return rows.drop("recorded_at")


@query(
    "closing_snapshot",
    f"""
WITH {EV}
SELECT event_type AS ins_code, CAST(ts AS DATE) + INTERVAL 18 HOUR AS ts,
  arg_max(v, seen) AS last_price
FROM ev WHERE hour(ts) >= 18 GROUP BY 1, 2""",
)
def closing_snapshot(spark, d):
    rows = px.events(spark, d).selectExpr(
        "event_type AS ins_code", "ts", "v AS last_price", "at AS ingested_at"
    )
    return ops.restamp_at_close(rows, px.HOURS).drop("ingested_at")


def _session_probes(spark, d):
    """Events as probes of the feed; some days of the week's middle are listed holidays."""
    shown = F.col("event_type").eqNullSafe("purchase") & (F.col("k") % 25 == 0)
    probes = px.events(spark, d).select(
        F.col("event_id").alias("probe"), "at", F.when(shown, F.to_date("ts")).alias("session_day"), (F.col("k") % 7 == 1).alias("failed")
    )
    listed = F.col("trading") & (F.day("day") % 4 == 0)
    days = px.feed_calendar(spark, d).select(
        "day", (F.col("trading") & ~listed).alias("trading"), F.when(listed, "official").otherwise(F.col("source")).alias("source")
    )
    return probes, days


SESSION_SQL = f"""
WITH {EV},
p AS (SELECT event_id, seen, CAST(ts AS DATE) AS day, hour(seen) * 3600 + minute(seen) * 60 + second(seen) AS sod,
    k % 7 = 1 AS failed, coalesce(event_type = 'purchase' AND k % 25 = 0, false) AND k % 7 != 1 AS shown,
    CASE WHEN isodow(CAST(ts AS DATE)) > 5 THEN 'rest' WHEN day(CAST(ts AS DATE)) % 4 = 0 THEN 'holiday' ELSE 'trading' END AS kind
  FROM ev),
firsts AS (SELECT day, min((seen, event_id)) FILTER (shown) AS shown_at FROM p GROUP BY 1),
shuts AS (SELECT p.day, min((seen, event_id)) AS shut_at FROM p JOIN firsts f ON f.day = p.day
  WHERE kind = 'trading' AND sod >= 8 * 3600 + 1200 AND NOT failed AND (shown_at IS NULL OR (seen, event_id) < shown_at) GROUP BY 1),
checks AS (SELECT day, min((seen, event_id)) AS check_at FROM p
  WHERE kind = 'holiday' AND sod BETWEEN 8 * 3600 + 1200 AND 64800 GROUP BY 1),
opens AS (SELECT c.day, check_at FROM checks c JOIN p ON p.day = c.day AND (p.seen, p.event_id) = check_at WHERE shown),
decided AS (SELECT p.event_id AS probe, p.seen AS at, p.day, CASE
    WHEN kind = 'rest' THEN 'rest'
    WHEN kind = 'holiday' THEN CASE WHEN (seen, event_id) = o.check_at THEN 'opened'
      WHEN (seen, event_id) > o.check_at THEN 'collect' ELSE 'holiday' END
    WHEN (seen, event_id) = shut_at THEN 'closed' WHEN (seen, event_id) > shut_at THEN 'over'
    WHEN (seen, event_id) >= shown_at OR failed THEN 'collect' ELSE 'waiting' END AS decision
  FROM p LEFT JOIN firsts f ON f.day = p.day LEFT JOIN shuts s ON s.day = p.day LEFT JOIN opens o ON o.day = p.day)"""


@query("session_decisions", SESSION_SQL + " SELECT * FROM decided")
def session_decisions(spark, d):
    return session_day.session_decisions(*_session_probes(spark, d), px.HOURS)


@query(
    "observed_days",
    SESSION_SQL
    + """ SELECT day, decision = 'opened' AS trading, CASE decision WHEN 'opened' THEN 'list was wrong' ELSE 'no trades' END AS note,
  "at" AS recorded_at FROM decided WHERE decision IN ('opened', 'closed')""",
)
def observed_days(spark, d):
    decisions = session_day.session_decisions(*_session_probes(spark, d), px.HOURS)
    return session_day.observed_days(decisions, "no trades", "list was wrong")


def _closing_cycles(spark, d):
    """Minutes as cycles; before eight they show the session of the day before. Every third day has minutes."""
    rows = px.events(spark, d).selectExpr(
        "event_type AS ins_code", "ts", "IF(hour(ts) < 8, date_sub(to_date(ts), 1), to_date(ts)) AS session",
        "minute(ts) % 4 = 0 AS refresh", "10000 + v AS last_price", "k AS volume", "IF(k % 3 = 0, k % 10, 0) AS trade_count", "at",
    )
    fetched = latest_version(rows, ["ins_code", "ts"], ["at"]).drop("at")
    days = px.feed_calendar(spark, d)
    return fetched, days.filter(F.day("day") % 3 == 0).select(F.col("day").alias("session")), days


CLOSING_SQL = f"""
WITH {EV},
f AS (SELECT event_type AS ins_code, ts, CASE WHEN hour(ts) < 8 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS session,
    minute(ts) % 4 = 0 AS refresh, 10000 + v AS last_price, k AS volume, CASE WHEN k % 3 = 0 THEN k % 10 ELSE 0 END AS trade_count
  FROM ev QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY seen DESC) = 1),
c AS (SELECT session, ts, bool_or(trade_count > 0) AS traded, bool_or(refresh) AS refresh,
    isodow(CAST(ts AS DATE)) <= 5 AND hour(ts) * 60 + minute(ts) BETWEEN 480 AND 1080 AS is_open FROM f GROUP BY 1, 2),
n AS (SELECT *, count(*) FILTER (traded AND NOT is_open) OVER (PARTITION BY session ORDER BY ts
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM c),
decided AS (SELECT CAST(session AS DATE) AS session, ts, CASE WHEN is_open THEN 'open'
    WHEN NOT refresh AND (day(session) % 3 = 0 AND session >= (SELECT min(CAST(ts AS DATE)) FROM ev) OR earlier > 0) THEN 'stored'
    WHEN NOT traded THEN 'no_trades' ELSE 'committed' END AS decision FROM n)"""


@query("closing_decisions", CLOSING_SQL + " SELECT * FROM decided")
def closing_decisions(spark, d):
    fetched, stored, days = _closing_cycles(spark, d)
    return session_day.closing_decisions(fetched, stored, days, px.HOURS)


@query(
    "closing_commits",
    CLOSING_SQL
    + """
SELECT f.ins_code, CAST(f.session AS TIMESTAMP) + INTERVAL 18 HOUR AS ts, last_price, volume, trade_count, f.ts AS ingested_at
FROM f JOIN decided d ON d.session = f.session AND d.ts = f.ts AND decision = 'committed'
QUALIFY row_number() OVER (PARTITION BY f.ins_code, f.session ORDER BY f.ts DESC) = 1""",
)
def closing_commits(spark, d):
    """Rows stamped at the close, all columns; a refresh replaces the figures of the first snapshot."""
    fetched, stored, days = _closing_cycles(spark, d)
    fetched = freeze(fetched)
    return session_day.closing_rows(fetched, session_day.closing_decisions(fetched, stored, days, px.HOURS), px.HOURS)


SLOTS = " ".join(
    f"WHEN '{name}' THEN {zlib.crc32(name.encode()) % 5}"
    for name in ("click", "error", "purchase", "signup", "view")
)


@query(
    "status_slots",
    f"""
WITH {EV}
SELECT ts, count(*) AS asked FROM ev WHERE minute(ts) % 5 = CASE event_type {SLOTS} END
GROUP BY ts""",
)
def status_slots(spark, d):
    due = px.events(spark, d).filter(times.status_slot("event_type", "ts"))
    return due.groupBy("ts").agg(F.count("*").alias("asked"))


@query(
    "live_volumes",
    f"""
WITH {EV}, t AS (SELECT event_type AS ins_code, ts, k AS volume,
    CASE WHEN v % 4 = 0 THEN 256 + 16 ELSE 16 END AS flags FROM ev
  QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY seen DESC) = 1)
SELECT ins_code, ts, volume FROM t WHERE flags & 256 = 0""",
)
def live_volumes(spark, d):
    rows = px.events(spark, d).selectExpr(
        "event_type AS ins_code", "ts", "k AS volume",
        "CASE WHEN v % 4 = 0 THEN 272 ELSE 16 END AS quality_flags", "at AS ingested_at",
    )
    return archive.live_volumes(rows)


@query(
    "active_funds",
    f"""
WITH {EV}, {FUNDS},
u AS (SELECT user_id AS ins_code, CAST(ts AS DATE) AS d, arg_max(100 + k, seen) AS units
  FROM ev WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT f.ins_code, symbol, fund_type,
  (SELECT arg_max(units, d) FROM u WHERE u.ins_code = f.ins_code) AS units
FROM funds f JOIN customer c ON CAST(c_custkey AS VARCHAR) = f.ins_code WHERE c_acctbal >= 0""",
)
def active_funds(spark, d):
    rows = archive.active_funds(px.funds(spark, d), px.units(spark, d))
    return rows.select("ins_code", "symbol", "fund_type", "units")


@query(
    "universe_report",
    f"""
WITH {EV}, {FUNDS}, seen_ AS (SELECT DISTINCT user_id AS ins_code FROM ev),
both_ AS (SELECT f.*, s.ins_code IS NOT NULL AS active FROM funds f
  LEFT JOIN seen_ s ON s.ins_code = f.ins_code)
SELECT count(*) FILTER (active) AS funds,
  count(*) FILTER (active AND fund_type IN ('equity', 'index', 'sector', 'leveraged')) AS equity,
  count(*) FILTER (NOT active) AS deactivated, count(*) FILTER (active) AS info_failures FROM both_""",
)
def universe_report(spark, d):
    known = px.funds(spark, d)
    users = px.events(spark, d).select(F.col("user_id").alias("ins_code")).distinct()
    records = known.join(users, "ins_code", "left_semi")
    return universe.report(universe.sync(records, known, "2024-01-31 00:00:00"))


@query(
    "stratified_sample",
    f"""
WITH {EV}, c AS (SELECT user_id AS ins_code, count(*) AS trade_count FROM ev GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY trade_count DESC, ins_code) AS rank,
    count(*) OVER () AS n FROM c),
picks AS (SELECT DISTINCT 10 + 1 + round_even(i * ((SELECT max(n) FROM r) - 10 - 1)::DOUBLE / 19, 0)
    ::BIGINT AS rank FROM range(20) t(i))
SELECT ins_code, trade_count, rank FROM r
WHERE n <= 30 OR rank <= 10 OR rank IN (SELECT rank FROM picks)""",
)
def stratified_sample(spark, d):
    counts = px.events(spark, d).groupBy(F.col("user_id").alias("ins_code")).agg(
        F.count("*").alias("trade_count")
    )
    return sampling.stratified_sample(counts, size=30, busiest=10)


@query(
    "interpolate",
    """
WITH pts AS (SELECT DISTINCT p_size::DOUBLE AS x, (p_size * p_size)::DOUBLE AS y FROM part),
seg AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1
  FROM pts),
ends AS (SELECT min(x) AS lo, max(x) AS hi, arg_min(y, x) AS ylo, arg_max(y, x) AS yhi FROM pts)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_quantity + l_discount AS x,
  round(CASE WHEN l_quantity + l_discount <= lo THEN ylo WHEN l_quantity + l_discount > hi THEN yhi
    ELSE y0 + (y1 - y0) / (x1 - x0) * (l_quantity + l_discount - x0) END, 6) AS y
FROM lineitem CROSS JOIN ends
LEFT JOIN seg ON l_quantity + l_discount > x0 AND l_quantity + l_discount <= x1""",
)
def interpolate(spark, d):
    points = px.table(spark, d, "part").selectExpr(
        "CAST(p_size AS DOUBLE) AS x", "CAST(p_size * p_size AS DOUBLE) AS y"
    )
    rows = px.table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity + l_discount AS x"
    )
    return sampling.interpolate(rows, "x", points.distinct())


@query(
    "calendar_dim",
    """
WITH places AS (SELECT unnest([1, 5, 9, 13, 17, 22, 26, 30]) AS place),
years AS (SELECT y, (y // 33) * 8 + (SELECT count(*) FROM places WHERE place < y % 33) AS leaps
  FROM range(1340, 1440) t(y)),
starts AS (SELECT y, DATE '2024-03-20'
    + CAST((y - 1403) * 365 + leaps - (SELECT leaps FROM years WHERE y = 1403) AS INTEGER) AS start FROM years),
o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders GROUP BY 1),
j AS (SELECT day, any_value(orders) AS orders, max(y) AS jy, max(start) AS start
  FROM o JOIN starts ON start <= day GROUP BY day),
n AS (SELECT *, CAST(day - start AS BIGINT) AS n FROM j),
m AS (SELECT *, CASE WHEN n < 186 THEN n // 31 + 1 ELSE (n - 186) // 30 + 7 END AS jm,
    CASE WHEN n < 186 THEN n % 31 + 1 ELSE (n - 186) % 30 + 1 END AS jd FROM n)
SELECT day, orders, printf('%04d/%02d/%02d', jy, jm, jd) AS day_fa, jy AS jalali_year, jm AS jalali_month,
  jd AS jalali_day, start AS year_start, isodow(day) <= 5 AS trading,
  CASE WHEN isodow(day) <= 5 THEN 'weekday' ELSE 'weekend' END AS source FROM m""",
)
def calendar_dim(spark, d):
    """Order dates with their Jalali date and whether the market trades."""
    days = px.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    counted = days.groupBy("day").agg(F.count("*").alias("orders"))
    joined = counted.join(px.history_calendar(spark, d), "day", "left").drop("listed", "reason")
    return require_calendar(joined, "trading", "day")


@query(
    "trading_days",
    """
SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders
WHERE isodow(CAST(o_orderdate AS DATE)) <= 5 GROUP BY 1""",
)
def trading_days(spark, d):
    days = px.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    counted = days.groupBy("day").agg(F.count("*").alias("orders"))
    open_days = px.history_calendar(spark, d).filter("trading").select("day")
    return counted.join(open_days, "day", "left_semi")


@query(
    "jalali_roundtrip",
    "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) AS gregorian_day FROM orders",
)
def jalali_roundtrip(spark, d):
    """To the Jalali date and back through the dimension."""
    cal = px.history_calendar(spark, d)
    days = px.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    parts = ["jalali_year", "jalali_month", "jalali_day"]
    there = days.join(cal.select("day", *parts), "day")
    return from_jalali(there, cal, *parts).select("day", "gregorian_day")


YEARS_SQL = """
places AS (SELECT unnest([1, 5, 9, 13, 17, 22, 26, 30]) AS place),
years AS (SELECT y, (y // 33) * 8 + (SELECT count(*) FROM places WHERE place < y % 33) AS leaps FROM range(1340, 1440) t(y)),
starts AS (SELECT y, DATE '2024-03-20'
    + CAST((y - 1403) * 365 + leaps - (SELECT leaps FROM years WHERE y = 1403) AS INTEGER) AS start FROM years),
dates AS (SELECT y, CAST(start + n AS DATE) AS day, n,
    CASE WHEN n < 186 THEN n // 31 + 1 ELSE (n - 186) // 30 + 7 END AS jm,
    CASE WHEN n < 186 THEN n % 31 + 1 ELSE (n - 186) % 30 + 1 END AS jd
  FROM (SELECT y, start, unnest(range(0, CAST((SELECT min(s2.start) FROM starts s2 WHERE s2.start > s1.start) - start AS INTEGER)))::INTEGER AS n
    FROM starts s1 WHERE y < 1439))"""


@query(
    "jalali_triples",
    f"""
WITH {YEARS_SQL},
t AS (SELECT DISTINCT 1360 + o_orderkey % 70 AS y, o_custkey % 15 - 1 AS m, (o_orderkey // 7) % 34 - 1 AS d FROM orders)
SELECT t.y::BIGINT AS jalali_year, t.m::BIGINT AS jalali_month, t.d::BIGINT AS jalali_day, day AS gregorian_day
FROM t LEFT JOIN dates ON dates.y = t.y AND jm = t.m AND jd = t.d""",
)
def jalali_triples(spark, d):
    """Years, months and days as they come, most of them no date: back to Gregorian by arithmetic."""
    triples = px.table(spark, d, "orders").selectExpr(
        "CAST(1360 + o_orderkey % 70 AS BIGINT) AS jalali_year", "CAST(o_custkey % 15 - 1 AS BIGINT) AS jalali_month",
        "CAST(o_orderkey DIV 7 % 34 - 1 AS BIGINT) AS jalali_day",
    ).distinct()
    return triples.withColumn("gregorian_day", jalali_to_date("jalali_year", "jalali_month", "jalali_day"))


def _rows_sql(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


CLOSURES = {dt.date(2025, 4, 8): "announced", dt.date(2026, 11, 4): "announced", dt.date(2028, 6, 29): "announced"}


@query(
    "calendar_years",
    f"""
WITH {YEARS_SQL},
names AS (SELECT day, string_agg(name, '{calendar.NAME_GLUE}' ORDER BY place) AS name FROM (
    SELECT day, name, min(place) AS place FROM (
      SELECT day, name, place FROM dates JOIN {_rows_sql([(i, *r) for i, r in enumerate(calendar.SOLAR_HOLIDAYS)])} s(place, m, d, name)
        ON jm = m AND jd = d
      UNION ALL SELECT day, name, 100 + place FROM dates
        JOIN {_rows_sql([(i, *r) for i, r in enumerate(calendar.LUNAR_HOLIDAYS)])} l(place, ly, m, d, name) ON y = ly AND jm = m AND jd = d)
    GROUP BY day, name) GROUP BY day),
extra AS (SELECT CAST(day AS DATE) AS day, note FROM {_rows_sql([(str(k), v) for k, v in CLOSURES.items()])} e(day, note)),
seen AS (SELECT CAST(CAST(o_orderdate AS DATE) + 12000 AS DATE) AS day, count(*) % 2 = 0 AS trading, 'orders ' || count(*) AS note
  FROM orders GROUP BY 1 HAVING sum(o_orderkey) % 23 = 0),
span AS (SELECT (SELECT max(y) FROM starts WHERE start <= (SELECT min(CAST(o_orderdate AS DATE)) + 12000 FROM orders)) AS a,
    (SELECT max(y) FROM starts WHERE start <= (SELECT max(CAST(o_orderdate AS DATE)) + 12000 FROM orders)) AS b),
j AS (SELECT dates.*, names.name, extra.note AS xnote, seen.trading, seen.note,
    CASE WHEN seen.day IS NOT NULL THEN 'observed' WHEN extra.day IS NOT NULL THEN 'extra' WHEN isodow(dates.day) IN (4, 5) THEN 'weekend'
      WHEN names.name IS NOT NULL THEN 'official' END AS source
  FROM dates JOIN span ON y BETWEEN a AND b LEFT JOIN names USING (day) LEFT JOIN extra USING (day) LEFT JOIN seen USING (day))
SELECT y AS jalali_year, day, printf('%04d/%02d/%02d', y, jm, jd) AS day_fa, source = 'observed' AND trading AS trading,
  CASE source WHEN 'observed' THEN note WHEN 'extra' THEN xnote ELSE name END AS reason, source
FROM j WHERE source IN ('observed', 'extra', 'official')""",
)
def calendar_years(spark, d):
    """The calendars of all years with orders (33 years on): observed before announced before weekly rest before listed."""
    days = px.table(spark, d, "orders").select(F.date_add(F.to_date("o_orderdate"), 12_000).alias("day"), "o_orderkey")
    seen = days.groupBy("day").agg(F.count("*").alias("_n"), F.sum("o_orderkey").alias("_keys")).filter("_keys % 23 = 0")
    observed = seen.select("day", (F.col("_n") % 2 == 0).alias("trading"), F.concat(F.lit("orders "), "_n").alias("note"))
    first, last = days.agg(F.min(calendar.jalali_year("day")), F.max(calendar.jalali_year("day"))).first()
    hours = MarketHours(weekdays=(5, 6, 0, 1, 2), use_holidays=True, extra_closures=CLOSURES)
    return calendar.calendar_of_years(spark, first, last, hours, observed)


@query(
    "in_session",
    f"""
WITH {EV}
SELECT CAST(ts AS DATE) AS day, count(*) AS events, count(*) FILTER (isodow(CAST(ts AS DATE)) <= 5
  AND hour(seen) * 3600 + minute(seen) * 60 + second(seen) BETWEEN 28800 AND 64800) AS in_session
FROM ev GROUP BY 1""",
)
def in_session(spark, d):
    rows = px.events(spark, d).withColumn("day", F.to_date("ts"))
    days = px.feed_calendar(spark, d).select("day", "trading")
    rows = require_calendar(rows.join(F.broadcast(days), "day", "left"), "trading", "day")
    return rows.groupBy("day").agg(
        F.count("*").alias("events"),
        F.count_if(times.in_session("at", "trading", px.HOURS)).alias("in_session"),
    )


@query(
    "type_distribution",
    f"WITH {FUNDS} SELECT fund_type, count(*) AS n FROM funds GROUP BY 1",
)
def type_distribution(spark, d):
    return universe.type_distribution(px.funds(spark, d))


@query(
    "equity_history",
    f"""
WITH {FUNDS}
SELECT fund_type, count(*) AS orders FROM orders JOIN funds ON ins_code = CAST(o_custkey AS VARCHAR)
WHERE fund_type IN ('equity', 'index', 'sector', 'leveraged') GROUP BY 1""",
)
def equity_history(spark, d):
    members = px.funds(spark, d).filter(text.in_equity_family("fund_type"))
    joined = px.history(spark, d).join(members.select("ins_code", "fund_type"), "ins_code")
    return joined.groupBy("fund_type").agg(F.count("*").alias("orders"))
