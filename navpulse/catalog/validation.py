"""The validator on the event feed: an event type is a fund, a minute with events a cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from navpulse.catalog import proxies as px, query
from navpulse.catalog.base_sql import EV, ticks
from navpulse.functions import flags as fl
from navpulse.plans import quality
from navpulse.plans.ticks import expected_rows, missing_funds, universe_on_days
from navpulse.plans.validate import COUNTERS, Validated, frozen_feed, validate
from navpulse.session import freeze
from navpulse.settings import ValidationLimits

TICKS = ticks("event_type")
# Every minute with events is a cycle; every fund is expected in each.
GRID = """cycles AS (SELECT ts, CAST(ts AS DATE) AS day, strftime(ts, '%Y%m%d%H%M') AS run_id
  FROM ev GROUP BY ts),
universe AS (SELECT DISTINCT event_type AS ins_code FROM ev),
grid AS (SELECT u.ins_code, c.day, c.ts, c.run_id, t.ins_code IS NOT NULL AS here
  FROM cycles c CROSS JOIN universe u LEFT JOIN ticks t ON t.ins_code = u.ins_code AND t.ts = c.ts),
steps AS (SELECT *, count(*) FILTER (here) OVER w AS segment,
    coalesce(NOT here AND date_diff('second', lag(ts) OVER w, ts) > 1800, false) AS far
  FROM grid WINDOW w AS (PARTITION BY ins_code, day ORDER BY ts)),
placed AS (SELECT *, NOT here AND segment > 0 AND NOT bool_or(far) OVER
    (PARTITION BY ins_code, day, segment ORDER BY ts) AS fills FROM steps),
prevs AS (SELECT *, last_value(CASE WHEN here OR fills THEN ts END IGNORE NULLS) OVER
    (PARTITION BY ins_code, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_ts
  FROM placed),
gaps AS (SELECT *, CASE WHEN here AND isodow(day) <= 5 AND prev_ts IS NOT NULL THEN
    list_filter(range(prev_ts + INTERVAL 1 MINUTE, ts, INTERVAL 1 MINUTE),
      lambda m: hour(m) * 60 + minute(m) BETWEEN 480 AND 1080) END AS gap FROM prevs)"""


def feed_cycles(feed: DataFrame) -> DataFrame:
    """Minutes in which anything arrived."""
    return feed.groupBy("ts").agg(
        F.max("run_id").alias("run_id"), F.max("ingested_at").alias("ingested_at")
    ).withColumn("day", F.to_date("ts"))


def expected_of(feed: DataFrame) -> DataFrame:
    cycles = feed_cycles(feed)
    return expected_rows(cycles, universe_on_days(feed.select("ins_code").distinct(), cycles))


def stored_feed(spark, d) -> DataFrame:
    """The feed as the written table it is in practice; several parts of a job read it."""
    return freeze(px.feed(spark, d))


def validated(spark, d) -> Validated:
    feed = stored_feed(spark, d)
    return validate(feed, expected_of(feed), px.HOURS, px.feed_calendar(spark, d))


def fresh(spark, d) -> DataFrame:
    """Repaired rows that came from the feed."""
    return validated(spark, d).ticks.filter(~F.col("filled"))


PREV_MAX = """max({0}) OVER (PARTITION BY ins_code, day ORDER BY ts
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query(
    "validate_counters",
    f"""
WITH {TICKS},
p AS (SELECT *, {PREV_MAX.format("volume")} AS pv, {PREV_MAX.format("value")} AS pa,
    {PREV_MAX.format("trade_count")} AS pt, {PREV_MAX.format("ind_buy_volume")} AS p1,
    {PREV_MAX.format("ind_sell_volume")} AS p2, {PREV_MAX.format("inst_buy_volume")} AS p3,
    {PREV_MAX.format("inst_sell_volume")} AS p4 FROM ticks)
SELECT ins_code, ts, greatest(volume, pv) AS volume, greatest(value, pa) AS value,
  greatest(trade_count, pt) AS trade_count, greatest(ind_buy_volume, p1) AS ind_buy_volume,
  greatest(ind_sell_volume, p2) AS ind_sell_volume, greatest(inst_buy_volume, p3) AS inst_buy_volume,
  greatest(inst_sell_volume, p4) AS inst_sell_volume,
  coalesce(volume < pv OR value < pa OR trade_count < pt OR ind_buy_volume < p1
    OR ind_sell_volume < p2 OR inst_buy_volume < p3 OR inst_sell_volume < p4, false) AS flagged
FROM p""",
)
def validate_counters(spark, d):
    return fresh(spark, d).select(
        "ins_code", "ts", *COUNTERS,
        fl.has_flag("quality_flags", fl.CUMULATIVE_DECREASE).alias("flagged"),
    )


@query(
    "validate_nav",
    f"""
WITH {TICKS},
p AS (SELECT *, last_value(CASE WHEN nav_redemption IS NOT NULL THEN
      {{'nav': nav_redemption, 'sub': nav_subscription, 'at': nav_at}} END IGNORE NULLS) OVER
    (PARTITION BY ins_code, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM ticks),
n AS (SELECT *, CASE WHEN nav_redemption IS NULL THEN prev.nav ELSE nav_redemption END AS nav,
    CASE WHEN nav_redemption IS NULL THEN prev.sub ELSE nav_subscription END AS sub,
    CASE WHEN nav_redemption IS NULL THEN prev.at ELSE nav_at END AS at_ FROM p)
SELECT ins_code, ts, nav AS nav_redemption, sub AS nav_subscription, at_ AS nav_at,
  nav_redemption IS NULL AND prev.nav IS NOT NULL AS carried,
  coalesce(abs(nav_redemption::DOUBLE / prev.nav - 1) > 0.10, false) AS jumped,
  coalesce(date_diff('second', at_, ts) > 1200, false) AS stale
FROM n""",
)
def validate_nav(spark, d):
    flag = lambda bit: fl.has_flag("quality_flags", bit)
    return fresh(spark, d).select(
        "ins_code", "ts", "nav_redemption", "nav_subscription", "nav_at",
        flag(fl.NAV_CARRIED).alias("carried"), flag(fl.NAV_JUMP).alias("jumped"),
        flag(fl.NAV_STALE).alias("stale"),
    )


BAND_SQL = f"""
WITH RECURSIVE {TICKS},
numbered AS (SELECT ins_code, day, ts, last_price, close_price, open_price, high_price, low_price,
    trade_count, CASE WHEN trade_count > 0 THEN band_low END AS lo,
    CASE WHEN trade_count > 0 THEN band_high END AS hi,
    row_number() OVER (PARTITION BY ins_code, day ORDER BY ts) AS n FROM ticks),
fold AS (
  SELECT *, last_price AS new_last, close_price AS new_close FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.*,
    CASE WHEN x.lo IS NOT NULL AND x.last_price NOT BETWEEN x.lo AND x.hi
          AND f.new_last BETWEEN x.lo AND x.hi THEN f.new_last ELSE x.last_price END,
    CASE WHEN x.lo IS NOT NULL AND x.close_price NOT BETWEEN x.lo AND x.hi
          AND f.new_close BETWEEN x.lo AND x.hi THEN f.new_close ELSE x.close_price END
  FROM fold f JOIN numbered x ON x.ins_code = f.ins_code AND x.day = f.day AND x.n = f.n + 1)"""


@query(
    "validate_band",
    BAND_SQL
    + """
SELECT ins_code, ts, new_last AS last_price, new_close AS close_price,
  coalesce(lo IS NOT NULL AND (last_price NOT BETWEEN lo AND hi
    OR close_price NOT BETWEEN lo AND hi), false) AS flagged
FROM fold""",
)
def validate_band(spark, d):
    return fresh(spark, d).select(
        "ins_code", "ts", "last_price", "close_price",
        fl.has_flag("quality_flags", fl.PRICE_OUT_OF_RANGE).alias("flagged"),
    )


@query(
    "validate_ohlc",
    BAND_SQL
    + """,
r AS (SELECT *, greatest(open_price, new_last, high_price, low_price) AS h,
    least(open_price, new_last, high_price, low_price) AS l FROM fold)
SELECT ins_code, ts, CASE WHEN trade_count > 0 THEN h ELSE high_price END AS high_price,
  CASE WHEN trade_count > 0 THEN l ELSE low_price END AS low_price,
  trade_count > 0 AND (h != high_price OR l != low_price) AS flagged
FROM r""",
)
def validate_ohlc(spark, d):
    return fresh(spark, d).select(
        "ins_code", "ts", "high_price", "low_price",
        fl.has_flag("quality_flags", fl.RANGE_REPAIRED).alias("flagged"),
    )


MISMATCH = """CASE WHEN quality_flags & 8 = 0 AND volume > 0 THEN
    greatest(abs(ind_buy_volume + inst_buy_volume - volume),
             abs(ind_sell_volume + inst_sell_volume - volume))::DOUBLE / volume > 0.02 END"""


@query(
    "validate_client_sum",
    f"""
WITH {TICKS}
SELECT ins_code, ts, coalesce({MISMATCH}, false) AS flagged FROM ticks""",
)
def validate_client_sum(spark, d):
    flagged = fl.has_flag("quality_flags", fl.CLIENT_VOLUME_MISMATCH)
    return fresh(spark, d).select("ins_code", "ts", flagged.alias("flagged"))


def _edge_sql(check: str, condition: str) -> str:
    """First rows of each episode: true now, and not true when last judged."""
    return f"""SELECT ins_code, ts, '{check}' AS "check" FROM (
    SELECT ins_code, ts, c, last_value(c IGNORE NULLS) OVER (PARTITION BY ins_code, day ORDER BY ts
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM (SELECT *, {condition} AS c FROM carried)) WHERE c AND NOT coalesce(before, false)"""


@query(
    "validate_edges",
    f"""
WITH {TICKS},
carried AS (SELECT *, CASE WHEN nav_redemption IS NULL THEN last_value(
      CASE WHEN nav_redemption IS NOT NULL THEN {{'at': nav_at}} END IGNORE NULLS) OVER
    (PARTITION BY ins_code, day ORDER BY ts).at ELSE nav_at END AS at_ FROM ticks)
{_edge_sql("client_volume_mismatch", MISMATCH)}
UNION ALL {_edge_sql("nav_missing", "nav_redemption IS NULL")}
UNION ALL {_edge_sql("nav_stale", "date_diff('second', at_, ts) > 1200")}""",
)
def validate_edges(spark, d):
    issues = validated(spark, d).issues
    edges = issues.filter(
        F.col("check").isin("client_volume_mismatch", "nav_missing", "nav_stale")
    )
    return edges.select("ins_code", "ts", "check")


@query(
    "validate_issue_counts",
    f"""
WITH {TICKS},
p AS (SELECT *, {PREV_MAX.format("volume")} AS pv, {PREV_MAX.format("value")} AS pa,
    {PREV_MAX.format("trade_count")} AS pt, {PREV_MAX.format("ind_buy_volume")} AS p1,
    {PREV_MAX.format("ind_sell_volume")} AS p2, {PREV_MAX.format("inst_buy_volume")} AS p3,
    {PREV_MAX.format("inst_sell_volume")} AS p4, last_value(nav_redemption IGNORE NULLS) OVER
    (PARTITION BY ins_code, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pn
  FROM ticks)
SELECT day AS trade_date, 'cumulative_decrease' AS "check", count(*) AS n FROM p
WHERE volume < pv OR value < pa OR trade_count < pt OR ind_buy_volume < p1 OR ind_sell_volume < p2
  OR inst_buy_volume < p3 OR inst_sell_volume < p4 GROUP BY 1
UNION ALL SELECT day, 'nav_jump', count(*) FROM p
WHERE abs(nav_redemption::DOUBLE / pn - 1) > 0.10 GROUP BY 1
UNION ALL SELECT day, 'price_out_of_band',
  count(*) FILTER (last_price NOT BETWEEN band_low AND band_high)
  + count(*) FILTER (close_price NOT BETWEEN band_low AND band_high)
FROM p WHERE trade_count > 0 AND band_low IS NOT NULL GROUP BY 1
HAVING count(*) FILTER (last_price NOT BETWEEN band_low AND band_high)
  + count(*) FILTER (close_price NOT BETWEEN band_low AND band_high) > 0""",
)
def validate_issue_counts(spark, d):
    report = quality.issues_report(validated(spark, d).issues)
    wanted = F.col("check").isin("cumulative_decrease", "nav_jump", "price_out_of_band")
    return report.filter(wanted).groupBy("trade_date", "check").agg(F.sum("n").alias("n"))


@query(
    "gap_fill",
    f"""
WITH {TICKS}, {GRID},
added AS (SELECT ins_code, unnest(gap) AS ts FROM gaps WHERE len(gap) BETWEEN 1 AND 30
  UNION ALL SELECT ins_code, ts FROM placed WHERE fills),
held AS (SELECT ins_code, day, ts, max(volume) OVER w AS volume, max(value) OVER w AS value,
    max(trade_count) OVER w AS trade_count, open_price, prev_close
  FROM ticks WINDOW w AS (PARTITION BY ins_code, day ORDER BY ts))
SELECT a.ins_code, a.ts, h.volume, h.value, h.trade_count, h.open_price, h.prev_close, true AS marked
FROM added a ASOF JOIN held h ON h.ins_code = a.ins_code AND h.ts < a.ts""",
)
def gap_fill(spark, d):
    """Added rows with what they carry on from the fund's last row."""
    return validated(spark, d).ticks.filter("filled").select(
        "ins_code", "ts", "volume", "value", "trade_count", "open_price", "prev_close",
        fl.has_flag("quality_flags", fl.FORWARD_FILLED).alias("marked"),
    )


@query(
    "gap_issues",
    f"""
WITH {TICKS}, {GRID},
m AS (SELECT *, lag(here, 1, true) OVER (PARTITION BY ins_code, day ORDER BY ts) AS before FROM placed)
SELECT ins_code, ts, 'gap' AS "check",
  CASE WHEN len(gap) > 30 THEN 'left_open' ELSE 'forward_filled' END AS action
FROM gaps WHERE len(gap) >= 1
UNION ALL SELECT ins_code, ts, 'missing_fund',
  CASE WHEN fills THEN 'forward_filled' ELSE 'dropped' END FROM m WHERE NOT here AND before""",
)
def gap_issues(spark, d):
    issues = validated(spark, d).issues
    return issues.filter(F.col("check").isin("gap", "missing_fund")).select(
        "ins_code", "ts", "check", "action"
    )


@query(
    "missing_members",
    f"""
WITH {TICKS}, {GRID}
SELECT c.ts, u.ins_code FROM cycles c CROSS JOIN universe u
WHERE NOT EXISTS (SELECT 1 FROM ticks t WHERE t.ts = c.ts AND t.ins_code = u.ins_code)""",
)
def missing_members(spark, d):
    feed = stored_feed(spark, d)
    return missing_funds(expected_of(feed), feed).select("ts", "ins_code")


@query(
    "frozen_feed",
    f"""
WITH {EV},
c AS (SELECT ts, CAST(ts AS DATE) AS day,
    max(hour(ts) * 10000 + (minute(ts) // 10) * 1000) AS heven FROM ev GROUP BY ts),
j AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts)
    - row_number() OVER (PARTITION BY day, heven ORDER BY ts) AS island FROM c WHERE heven > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY day, heven, island ORDER BY ts) - 1 AS unchanged FROM j)
SELECT ts, heven AS feed_heven, unchanged, unchanged >= 3 AS feed_stale FROM n""",
)
def frozen_feed_(spark, d):
    feed = px.feed(spark, d)
    cycles = feed.groupBy(F.to_date("ts").alias("day"), "ts").agg(
        F.max("feed_heven").alias("feed_heven")
    )
    return frozen_feed(cycles, ValidationLimits()).drop("day")


@query(
    "validate_stale",
    f"""
WITH {TICKS},
c AS (SELECT ts, CAST(ts AS DATE) AS day, max(hour(ts) * 10000 + (minute(ts) // 10) * 1000) AS heven FROM ev GROUP BY ts),
j AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts)
    - row_number() OVER (PARTITION BY day, heven ORDER BY ts) AS island FROM c WHERE heven > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY day, heven, island ORDER BY ts) > 3 AS stale FROM j)
SELECT ins_code, t.ts, coalesce(stale, false) AS flagged FROM ticks t LEFT JOIN n ON n.ts = t.ts""",
)
def validate_stale(spark, d):
    """Every row of a cycle whose feed time has not moved carries the mark."""
    return fresh(spark, d).select(
        "ins_code", "ts", fl.has_flag("quality_flags", fl.STALE_QUOTE).alias("flagged")
    )


@query(
    "cycle_counters",
    f"""
WITH {TICKS}, {GRID}
SELECT run_id, sum(CASE WHEN fills THEN 1 WHEN len(gap) BETWEEN 1 AND 30 THEN len(gap) ELSE 0 END)
  ::BIGINT AS filled
FROM gaps GROUP BY run_id HAVING bool_or(here OR fills)""",
)
def cycle_counters(spark, d):
    return quality.cycle_counters(validated(spark, d).ticks).select("run_id", "filled")


@query(
    "quality_flags_report",
    f"""
WITH {TICKS},
bits AS (SELECT unnest([{{'name': 'NAV_MISSING', 'bit': 2, 'kind': 'warn'}},
  {{'name': 'CLIENT_TYPE_MISSING', 'bit': 8, 'kind': 'warn'}},
  {{'name': 'FLOW_VALUE_ESTIMATED', 'bit': 16, 'kind': 'info'}},
  {{'name': 'NO_TRADES', 'bit': 32, 'kind': 'info'}}]) AS b),
t AS (SELECT day, count(*) AS ticks FROM ticks GROUP BY 1)
SELECT k.day AS trade_date, t.ticks, b.name AS flag, count(*) AS n,
  round(count(*)::DOUBLE / t.ticks, 6) AS share, b.kind AS kind
FROM ticks k JOIN bits ON quality_flags & b.bit != 0 JOIN t ON t.day = k.day
GROUP BY k.day, t.ticks, b.name, b.kind""",
)
def quality_flags_report(spark, d):
    return quality.flags_report(px.feed(spark, d))
