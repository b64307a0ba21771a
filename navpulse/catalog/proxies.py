"""The test tables seen as fund-market tables.

``events`` stands for the minute feed (of an event type, or of a user), ``customer`` for the
funds, ``orders`` and ``lineitem`` for daily history. ``base_sql`` states the same
projections for the SQL texts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from navpulse import schemas
from navpulse.functions import times
from navpulse.operators.calendar import span_of, trading_calendar
from navpulse.operators.latest import latest_version
from navpulse.plans.analytics import Market
from navpulse.settings import MarketHours

HOURS = MarketHours(
    opens=dt.time(8), closes=dt.time(18), weekdays=(0, 1, 2, 3, 4), use_holidays=False
)
HISTORY_SHIFT_DAYS = 8214  # brings order dates up to the days of the events


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the number in their JSON, the value in cents and a zoned timestamp."""
    return project_events(table(spark, folder, "events"))


def project_events(raw: DataFrame) -> DataFrame:
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("at"),
        times.floor_minute(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("user_id").cast("string").alias("user_id"),
        "event_type",
        F.from_json("props", "k bigint")["k"].alias("k"),
        (F.col("value").cast("decimal(18,2)") * 100).cast("long").alias("v"),
    )


def raw_ticks(spark: SparkSession, folder: str, instrument: str) -> DataFrame:
    return project_ticks(events(spark, folder), instrument)


def project_ticks(rows: DataFrame, instrument: str) -> DataFrame:
    """Every event as a tick; several in one minute are versions of the same tick."""
    first = rows.selectExpr(
        "ts", f"{instrument} AS ins_code", "at AS ingested_at", "k", "v",
        "date_format(ts, 'yyyyMMddHHmm') AS run_id",
        "hour(at) * 3600 + minute(at) * 60 + second(at) AS sod", "hour(ts) AS hh",
        "10000 + v AS close_price", "10000 + v + k - 50 AS last_price",
        "10000 + v div 2 AS open_price", "10000 + v div 2 - k AS low_price",
        "10000 + v + CASE WHEN k % 5 = 0 THEN -60 ELSE 5 * k END AS high_price",
        "10000 + (v * 7) % 3000 AS prev_close",
        "CASE WHEN k % 7 = 0 THEN NULL ELSE 10000 + 30 * k END AS nav_redemption",
    )
    second = first.selectExpr(
        "*",
        "CAST(sod + 37 * k AS BIGINT) AS volume",
        "CAST(CASE WHEN k % 13 = 0 THEN 0 ELSE sod div 60 + k % 10 END AS BIGINT) AS trade_count",
        "nav_redemption + 100 AS nav_subscription",
        "CASE WHEN k % 7 != 0 AND k % 19 != 0 "
        "THEN timestampadd(MINUTE, CAST(-(k % 30) AS INT), ts) END AS nav_at",
    )
    third = second.selectExpr(
        "*", "volume * 10000 + v AS value",
        "volume * (k % 10) div 10 AS ind_buy_volume", "volume div 2 AS ind_sell_volume",
        "volume - volume * (k % 10) div 10 "
        "+ CASE WHEN k % 9 = 0 THEN volume div 10 ELSE 0 END AS inst_buy_volume",
        "volume - volume div 2 AS inst_sell_volume",
    )
    full = third.selectExpr(
        "ts", "ins_code", "run_id", "last_price", "close_price", "open_price", "high_price",
        "low_price", "prev_close", "volume", "value", "trade_count", "k AS block_volume",
        "k * 10000 AS block_value", "nav_redemption", "nav_subscription", "nav_at",
        "last_price - 10 AS bid_price", "5L AS bid_volume", "last_price + 10 AS ask_price",
        "5L AS ask_volume", "ind_buy_volume", "ind_sell_volume", "inst_buy_volume",
        "inst_sell_volume", "ind_buy_volume * close_price AS ind_buy_value",
        "ind_sell_volume * close_price AS ind_sell_value",
        "inst_buy_volume * close_price AS inst_buy_value",
        "inst_sell_volume * close_price AS inst_sell_value", "k % 10 AS ind_buy_count",
        "k % 6 AS ind_sell_count", "1L AS inst_buy_count", "1L AS inst_sell_count",
        "CAST(16 + CASE WHEN k % 7 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 17 = 0 THEN 8 ELSE 0 END"
        " + CASE WHEN k % 13 = 0 THEN 32 ELSE 0 END AS INT) AS quality_flags",
        "ingested_at",
        "CASE WHEN k % 11 != 0 THEN CAST(9800 + 10 * hh AS BIGINT) END AS band_low",
        "CASE WHEN k % 11 != 0 THEN CAST(14000 + 100 * hh AS BIGINT) END AS band_high",
        "CAST(hh * 10000 + (minute(ts) div 10) * 1000 AS BIGINT) AS feed_heven",
    )
    return full.select(*schemas.TICK_COLUMNS, "band_low", "band_high", "feed_heven")


def feed(spark: SparkSession, folder: str, instrument: str = "event_type") -> DataFrame:
    """Ticks with band and feed time, newest version per fund and minute."""
    return latest_version(raw_ticks(spark, folder, instrument), ["ins_code", "ts"], ["ingested_at"])


FUND_TYPE_OF_SEGMENT = """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'equity'
  WHEN 'BUILDING' THEN 'index' WHEN 'FURNITURE' THEN 'sector'
  WHEN 'HOUSEHOLD' THEN 'leveraged' ELSE 'fixed_income' END"""


def funds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS ins_code", "c_name AS symbol",
        "concat(c_name, ' ', c_mktsegment) AS name",
        "concat('IRT1', lpad(CAST(c_custkey AS STRING), 12, '0'), '0001') AS isin",
        f"{FUND_TYPE_OF_SEGMENT} AS fund_type", "'' AS market", "'' AS board", "'' AS manager",
        "'' AS custodian", "c_acctbal >= 0 AS is_active", "'provider' AS source",
        "TIMESTAMP'2024-01-01 00:00:00' AS updated_at",
    )


def units(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).filter("event_type = 'signup'").selectExpr(
        "user_id AS ins_code", "to_date(ts) AS trade_date", "100 + k AS units", "at AS updated_at"
    )


def states(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).filter("event_type = 'error'").selectExpr(
        "ts", "user_id AS ins_code",
        "element_at(array('A', 'A ', 'AS', 'ar', 'IG', 'I'), CAST(k % 6 AS INT) + 1) AS code",
        "CASE WHEN k % 4 = 0 THEN '' ELSE concat('T', k) END AS title",
        "k % 2 AS under_supervision", "at AS ingested_at",
    )


def market_ticks(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).filter("event_type = 'purchase'").selectExpr(
        "ts", "date_format(ts, 'yyyyMMddHHmm') AS run_id",
        "CAST(CASE WHEN k % 8 = 0 THEN 0 ELSE 1000 + v END AS DOUBLE) AS index_value",
        "CAST(k - 50 AS DOUBLE) AS index_change", "CAST(v AS DOUBLE) AS eq_index_value",
        "CAST(k AS DOUBLE) AS eq_index_change", "CAST(v * 1000 AS DOUBLE) AS market_value",
        "'A' AS state", "at AS ingested_at",
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One cycle per minute with events; an error event is a failed request."""
    failed = F.count_if(F.col("event_type") == "error")
    grouped = events(spark, folder).groupBy("ts").agg(
        F.min("at").alias("started_at"), F.max("at").alias("finished_at"),
        F.count("*").cast("int").alias("requests"), failed.cast("int").alias("failed"),
        F.countDistinct("event_type").cast("int").alias("received_funds"),
    )
    status = (
        F.when(F.col("failed") == F.col("requests"), "failed")
        .when(F.col("failed") > 0, "partial")
        .otherwise("ok")
    )
    zero = F.lit(0)
    return grouped.select(
        F.date_format("ts", "yyyyMMddHHmm").alias("run_id"), "started_at", "finished_at",
        F.col("ts").alias("tick"), status.alias("status"), "requests", "failed",
        F.lit(5).alias("expected_funds"), "received_funds", zero.alias("issues"),
        zero.alias("filled"), zero.alias("repaired"), F.lit("").alias("note"),
    )


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as official daily rows of their customer."""
    return table(spark, folder, "orders").selectExpr(
        f"date_add(to_date(o_orderdate), {HISTORY_SHIFT_DAYS}) AS trade_date",
        "CAST(o_custkey AS STRING) AS ins_code",
        "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents",
        "o_orderkey", "o_orderpriority",
    ).selectExpr(
        "trade_date", "ins_code", "cents AS open_price", "cents AS high_price",
        "cents AS low_price", "cents AS close_price", "cents AS last_price",
        "cents AS prev_close", "o_orderkey AS volume", "cents AS value", "1L AS trade_count",
        *[f"0L AS {w}_{s}_volume" for w in ("ind", "inst") for s in ("buy", "sell")],
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN cents ELSE 0 END"
        " AS ind_buy_value",
        "CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN cents ELSE 0 END"
        " AS ind_sell_value",
        "0L AS inst_buy_value", "0L AS inst_sell_value",
        *[f"0L AS {w}_{s}_count" for w in ("ind", "inst") for s in ("buy", "sell")],
        "timestamp_seconds(o_orderkey) AS updated_at",
    ).select(*schemas.FUND_HISTORY.names)


def brand_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as official prices of their part's brand: one row per brand and date."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents")
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_partkey AS p_partkey", "to_date(l_shipdate) AS trade_date", "l_orderkey",
        "l_linenumber", "l_partkey", "l_suppkey", "CAST(l_quantity AS BIGINT) AS qty",
        "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents",
    )
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("ins_code"))
    return lines.join(parts, "p_partkey").groupBy("ins_code", "trade_date").agg(
        F.max_by(F.expr("cents div qty"), order).alias("close_price"),
        F.sum("qty").alias("volume"), F.sum("cents").alias("value"),
        F.count("*").alias("trade_count"),
    )


def brand_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Open lines bought and closed lines sold, by two groups of customer segments."""
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_partkey AS p_partkey", "l_orderkey AS o_orderkey", "to_date(l_shipdate) AS trade_date",
        "l_linestatus", "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents",
    )
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("ins_code"))
    orders = table(spark, folder, "orders").selectExpr("o_orderkey", "o_custkey AS c_custkey")
    groups = table(spark, folder, "customer").selectExpr(
        "c_custkey", "c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') AS individual"
    )
    rows = lines.join(orders, "o_orderkey").join(groups, "c_custkey").join(parts, "p_partkey")
    buys = F.col("l_linestatus") == "O"
    sums = {
        "ind_buy_value": F.col("individual") & buys,
        "ind_sell_value": F.col("individual") & ~buys,
        "inst_buy_value": ~F.col("individual") & buys,
        "inst_sell_value": ~F.col("individual") & ~buys,
    }
    zero = F.lit(0)
    return rows.groupBy("ins_code", "trade_date").agg(
        *[F.sum(F.when(cond, F.col("cents")).otherwise(zero)).alias(c) for c, cond in sums.items()],
        *[F.count_if(cond).alias(c.replace("value", "count")) for c, cond in sums.items()],
    )


def calendar(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    return trading_calendar(spark, first, last, HOURS)


def _calendar_of(spark: SparkSession, *dates) -> DataFrame:
    """The calendar of exactly the span the data has."""
    span = span_of(*dates) or (dt.date(2024, 1, 1), dt.date(2024, 1, 1))
    return calendar(spark, *span)


def feed_calendar(spark: SparkSession, folder: str) -> DataFrame:
    return _calendar_of(spark, (table(spark, folder, "events"), "ts"))


def history_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates as they are, as days of the history, and the days of the feed."""
    orders = table(spark, folder, "orders")
    shifted = F.date_add(F.to_date("o_orderdate"), HISTORY_SHIFT_DAYS)
    return _calendar_of(spark, (orders, "o_orderdate"), (orders, shifted), (table(spark, folder, "events"), "ts"))


def market(spark: SparkSession, folder: str) -> Market:
    return Market(
        ticks=raw_ticks(spark, folder, "user_id").drop("band_low", "band_high", "feed_heven"),
        funds=funds(spark, folder),
        units=units(spark, folder),
        states=states(spark, folder),
        market_ticks=market_ticks(spark, folder),
        runs=runs(spark, folder),
        history=history(spark, folder),
        calendar=history_calendar(spark, folder),
    )
