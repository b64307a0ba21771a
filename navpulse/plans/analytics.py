"""Investor-facing reports.

Each job works on every day in its input at once; a single day or fund is a filter that
reaches the scan. Stored tables are versioned, so each is reduced to its newest rows first.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from navpulse import schemas
from navpulse.functions import flags, metrics, text, times
from navpulse.operators.asof import asof_lookup, day_block
from navpulse.operators.calendar import jalali_year, year_start
from navpulse.operators.latest import latest_version
from navpulse.session import freeze
from navpulse.settings import MarketHours
from navpulse.sources.sinks import end_of_day

STATUS_LOOKBACK_DAYS = 30
RETURNS_LOOKBACK_DAYS = 400
HORIZONS = {"r_1w": 7, "r_1m": 30, "r_3m": 91}
SNAPSHOT_INPUT = (
    "ins_code", "ts", "last_price", "close_price", "prev_close", "volume", "value", "trade_count",
    "block_value", "nav_redemption", "nav_at", "ind_buy_value", "ind_sell_value", "inst_buy_value",
    "inst_sell_value", "ind_buy_count", "ind_sell_count", "quality_flags", "ingested_at",
)


@dataclass(frozen=True)
class Market:
    """The stored tables a report may read; those it does not need may be left out."""

    ticks: DataFrame | None = None
    funds: DataFrame | None = None
    units: DataFrame | None = None
    states: DataFrame | None = None
    market_ticks: DataFrame | None = None
    runs: DataFrame | None = None
    history: DataFrame | None = None
    rebuilt: DataFrame | None = None
    calendar: DataFrame | None = None  # operators.calendar.trading_calendar


def newest(df: DataFrame, table: str) -> DataFrame:
    return latest_version(df, *schemas.LATEST_WINS[table])


def _dated(df: DataFrame, ts: str = "ts") -> DataFrame:
    """With trade_date; a stored one is kept, because only that prunes partitions."""
    return df if "trade_date" in df.columns else df.withColumn("trade_date", F.to_date(ts))


def _on_day(df: DataFrame, day: dt.date | None, column: str = "trade_date", ts: str = "ts") -> DataFrame:
    """Rows of one day; the range of times reaches the scan where no day is stored."""
    if day is None:
        return df
    if ts in df.columns:
        start = F.lit(day).cast("timestamp")
        df = df.filter((F.col(ts) >= start) & (F.col(ts) < F.date_add(F.lit(day), 1).cast("timestamp")))
    return df.filter(F.col(column) == F.lit(day))


def _window(df: DataFrame, day: dt.date | None, days: int | None, column: str) -> DataFrame:
    """Half-open look-back: after day - days, up to and including day."""
    if day is not None:
        df = df.filter(F.col(column) <= F.lit(day))
        if days is not None:
            df = df.filter(F.col(column) > F.date_sub(F.lit(day), days))
    return df


def equity_funds(funds: DataFrame) -> DataFrame:
    return newest(funds, "funds").filter(text.in_equity_family("fund_type"))


# --- units and status ---------------------------------------------------------------


def units_as_of(probes: DataFrame, units: DataFrame) -> DataFrame:
    """``probes`` (one row per ins_code and trade_date) with the unit count of their day.

    The newest count on or before the day; before the first one, the first one.
    """
    facts = units.filter(F.col("units").isNotNull()).withColumnRenamed("trade_date", "_on")
    return asof_lookup(
        probes, facts, ["ins_code"], "trade_date", "_on", ["units"], day_block(),
        version=["updated_at"], forward_fallback=True, distinct_probes=True,
    )


def status_as_of(probes: DataFrame, states: DataFrame) -> DataFrame:
    """The newest status seen from 30 days before the day up to the day, else none.

    ``probes`` has one row per ins_code and trade_date.
    """
    facts = states.select(
        "ins_code", F.to_date("ts").alias("_on"), F.col("ts").alias("status_at"), "ingested_at",
        "code", "title", "under_supervision",
    )
    facts = facts.withColumn("_seen", F.col("_on"))
    found = asof_lookup(
        probes, facts, ["ins_code"], "trade_date", "_on",
        ["code", "title", "under_supervision", "status_at", "_seen"], day_block(),
        version=["status_at", "ingested_at"], distinct_probes=True,
    )
    recent = F.col("_seen") >= F.date_sub("trade_date", STATUS_LOOKBACK_DAYS)
    kept = {
        c: F.when(recent, F.col(c)) for c in ("code", "title", "under_supervision", "status_at")
    }
    return found.withColumns(kept).drop("_seen")


# --- snapshot and overview ----------------------------------------------------------


def snapshot(
    market: Market, day: dt.date | None = None, ins_code: str | None = None
) -> DataFrame:
    """The last row of each fund on each day, with its metrics.

    The ticks are read once: their last rows (one per fund and day, a small part of them)
    are frozen, and the as-of lookups work on those.
    """
    ticks = _on_day(_dated(market.ticks), day)
    if ins_code is not None:
        ticks = ticks.filter(F.col("ins_code") == ins_code)
    last = freeze(
        latest_version(
            ticks.select("trade_date", *SNAPSHOT_INPUT), ["trade_date", "ins_code"],
            ["ts", "ingested_at"],
        )
    )
    funds = newest(market.funds, "funds").select("ins_code", "symbol", "name", "fund_type")
    rows = units_as_of(last, market.units).join(funds, "ins_code", "left")
    if market.states is not None:
        states = market.states
        if day is not None:  # older states cannot count
            since = F.date_sub(F.lit(day), STATUS_LOOKBACK_DAYS).cast("timestamp")
            until = F.date_add(F.lit(day), 1).cast("timestamp")
            states = states.filter((F.col("ts") >= since) & (F.col("ts") < until))
        rows = status_as_of(rows, states)
    else:
        rows = rows.withColumns(
            {c: F.lit(None).cast(t) for c, t in (
                ("code", "string"), ("title", "string"),
                ("under_supervision", "long"), ("status_at", "timestamp"),
            )}
        )
    kind = F.coalesce(F.nullif("fund_type", F.lit("")), F.lit("other"))
    rows = rows.withColumns({"fund_type": kind, "units": F.nullif("units", F.lit(0))})
    rows = rows.withColumn("aum", metrics.aum("nav_redemption", "units"))
    # A group is one day's funds, one row each.
    rows = rows.withColumn("_total", F.sum("aum").over(W.partitionBy("trade_date")))
    seen = F.col("status_at").isNotNull()
    return rows.select(
        "trade_date",
        "ins_code",
        F.coalesce(F.nullif("symbol", F.lit("")), "ins_code").alias("symbol"),
        F.coalesce("name", F.lit("")).alias("name"),
        "fund_type",
        text.type_label("fund_type").alias("fund_type_fa"),
        "ts",
        "last_price",
        "close_price",
        "prev_close",
        metrics.pct_change("close_price", "prev_close").alias("change"),
        F.col("nav_redemption").alias("nav"),
        "nav_at",
        metrics.nav_premium("close_price", "nav_redemption", "fund_type").alias("premium"),
        "units",
        "aum",
        metrics.share_of("aum", "_total").alias("share_of_aum"),
        "value",
        "volume",
        "trade_count",
        "block_value",
        metrics.net_flow("ind_buy_value", "ind_sell_value").alias("ind_net_flow"),
        metrics.net_flow("inst_buy_value", "inst_sell_value").alias("inst_net_flow"),
        metrics.buyer_power(
            "ind_buy_value", "ind_buy_count", "ind_sell_value", "ind_sell_count"
        ).alias("buyer_power"),
        metrics.turnover("value", "aum").alias("turnover"),
        flags.flag_names("quality_flags").alias("quality_flags"),
        F.when(seen, text.status_kind("code")).otherwise("unknown").alias("status_kind"),
        F.coalesce(F.nullif("title", F.lit("")), "code").alias("status_title"),
        "status_at",
        F.coalesce(F.col("under_supervision") != 0, F.lit(False)).alias("under_supervision"),
    )


def _premium_point() -> list[Column]:
    """Aggregates over one row per fund; a group is never larger than the fund list."""
    return [
        F.median("premium").alias("median"),
        metrics.weighted_mean("premium", "aum").alias("weighted"),
        F.count("premium").alias("funds"),
    ]


def overview(
    market: Market,
    day: dt.date | None = None,
    now: dt.datetime | None = None,
    hours: MarketHours = MarketHours(),
) -> DataFrame:
    """One row per day: totals, premium, breadth, index and completeness."""
    snap = snapshot(market, day)
    change = F.coalesce("change", F.lit(0.0))
    daily = snap.groupBy("trade_date").agg(
        F.max("ts").alias("last_update"),
        F.count("*").alias("funds"),
        F.coalesce(F.sum("aum"), F.lit(0)).alias("total_aum"),
        F.sum("value").alias("total_value"),
        F.sum("ind_net_flow").alias("ind_net_flow"),
        F.median("premium").alias("median_premium"),
        metrics.weighted_mean("premium", "aum").alias("weighted_premium"),
        F.count_if(F.col("premium") > 0).alias("at_premium"),
        F.count_if(F.col("premium") < 0).alias("at_discount"),
        F.count_if(change > 0).alias("advancers"),
        F.count_if(change < 0).alias("decliners"),
        F.count_if(change == 0).alias("unchanged"),
        F.count_if(text.is_halted("status_kind")).alias("not_trading"),
    )
    if market.market_ticks is not None:
        index = latest_version(
            _on_day(_dated(market.market_ticks), day), ["trade_date"], ["ts", "ingested_at"]
        ).select(
            "trade_date",
            "index_value",
            metrics.index_fraction("index_value", "index_change").alias("index_change"),
        )
        daily = daily.join(index, "trade_date", "left")
    if market.runs is not None:
        done = completeness(_on_day(_dated(market.runs, "tick"), day))
        daily = daily.join(done, "trade_date", "left")
    if market.calendar is not None:
        dates = market.calendar.select(
            F.col("day").alias("trade_date"), F.col("day_fa").alias("session_date_fa")
        )
        daily = daily.join(F.broadcast(dates), "trade_date", "left")  # one row per date
    if now is not None:
        open_now = times.second_of_day(F.lit(now)).between(hours.open_second, hours.close_second)
        daily = daily.withColumn(
            "is_live", (F.col("trade_date") == F.to_date(F.lit(now))) & open_now
        )
    return daily


def completeness(runs: DataFrame) -> DataFrame:
    """Rows received over rows expected, per day; null when none were expected."""
    received, expected = F.sum("received_funds"), F.sum("expected_funds")
    return runs.groupBy("trade_date").agg(
        F.when(expected != 0, received / expected.cast("double")).alias("completeness")
    )


def session_date(market: Market) -> DataFrame:
    """The newest day with minute rows or official history; null without either."""
    both = market.ticks.select(F.to_date("ts").alias("d")).unionByName(
        market.history.select(F.col("trade_date").alias("d"))
    )
    return both.agg(F.max("d").alias("session_date"))


def sessions(market: Market, limit: int = 90) -> DataFrame:
    """Newest days that have rows, and whether there is more than one recorded minute."""
    if not 1 <= limit <= 400:
        raise ValueError("limit must be 1-400")
    minutes = (
        _dated(market.ticks)
        .groupBy("trade_date")
        .agg(F.countDistinct("ts").alias("minutes"))
        .withColumn("has_intraday", F.col("minutes") > 1)
        .orderBy(F.col("trade_date").desc())
        .limit(limit)
    )
    if market.calendar is None:
        return minutes
    dates = market.calendar.select(F.col("day").alias("trade_date"), "day_fa")
    return minutes.join(F.broadcast(dates), "trade_date", "left")  # one row per date


# --- premium and flow over time -----------------------------------------------------


def premium_daily(market: Market, day: dt.date | None = None, days: int | None = None) -> DataFrame:
    """Market premium at each session's close."""
    ticks = _window(_dated(market.ticks), day, days, "trade_date")
    closes = end_of_day(ticks)
    funds = equity_funds(market.funds).select("ins_code", "fund_type")
    rows = units_as_of(closes.join(funds, "ins_code"), market.units)
    return (
        rows.withColumns(
            {
                "premium": metrics.nav_premium("close_price", "nav_redemption", "fund_type"),
                "aum": metrics.aum("nav_redemption", "units"),
            }
        )
        .groupBy("trade_date")
        .agg(*_premium_point())
    )


def premium_intraday(market: Market, day: dt.date | None = None) -> DataFrame:
    """Market premium minute by minute; units are those of the day."""
    ticks = _on_day(_dated(market.ticks), day)
    live = newest(
        ticks.select(
            "ins_code", "ts", "trade_date", "close_price", "nav_redemption", "ingested_at"
        ),
        "fund_ticks",
    )
    funds = equity_funds(market.funds).select("ins_code", "fund_type")
    # Units are looked up per fund and day, not per minute.
    fund_days = ticks.select("ins_code", "trade_date").distinct()
    counts = units_as_of(fund_days, market.units)
    rows = live.join(funds, "ins_code").join(counts, ["ins_code", "trade_date"])
    return (
        rows.withColumns(
            {
                "premium": metrics.nav_premium("close_price", "nav_redemption", "fund_type"),
                "aum": metrics.aum("nav_redemption", "units"),
            }
        )
        .groupBy("ts")
        .agg(*_premium_point())
    )


def best_premium_series(intraday: DataFrame, daily: DataFrame, at_least: int = 2) -> DataFrame:
    """Of each day its minutes when there are enough of them, else its daily point."""
    points = intraday.select(
        F.to_date("ts").alias("_day"), F.col("ts").alias("at"), "median", "weighted", "funds"
    )
    days = daily.select(
        F.col("trade_date").alias("_day"), F.col("trade_date").cast("timestamp").alias("at"),
        "median", "weighted", "funds",
    )
    minutes = F.count("*").over(W.partitionBy("_day"))  # a day has at most 1,440
    kept = points.withColumn("_n", minutes).filter(F.col("_n") >= at_least).drop("_n")
    rest = days.join(kept.select("_day").distinct(), "_day", "left_anti")
    return kept.unionByName(rest).drop("_day")


def market_flow(market: Market, day: dt.date | None = None) -> DataFrame:
    """Net individual flow and traded value of all funds per minute, beside the index."""
    live = newest(
        _on_day(_dated(market.ticks), day).select(
            "ins_code", "ts", "value", "ind_buy_value", "ind_sell_value", "ingested_at"
        ),
        "fund_ticks",
    )
    flow = live.groupBy("ts").agg(
        F.sum(metrics.net_flow("ind_buy_value", "ind_sell_value")).alias("ind_net_flow"),
        F.sum("value").alias("value"),
    )
    index = newest(_on_day(_dated(market.market_ticks), day), "market_ticks").select(
        "ts", F.nullif("index_value", F.lit(0.0)).alias("index_value")
    )
    return flow.join(index, "ts", "left")


def fund_intraday(
    market: Market, day: dt.date | None = None, ins_code: str | None = None
) -> DataFrame:
    """Live minutes of each fund, preceded by rebuilt ones where no live row exists yet."""
    ticks = _on_day(_dated(market.ticks), day)
    rebuilt = _on_day(_dated(market.rebuilt), day)
    if ins_code is not None:
        ticks = ticks.filter(F.col("ins_code") == ins_code)
        rebuilt = rebuilt.filter(F.col("ins_code") == ins_code)
    live = newest(ticks, "fund_ticks")
    funds = newest(market.funds, "funds").select("ins_code", "fund_type")
    live_points = live.join(funds, "ins_code", "left").select(
        "trade_date", "ins_code", "ts", "last_price", "close_price",
        F.col("nav_redemption").alias("nav"),
        metrics.nav_premium("close_price", "nav_redemption", "fund_type").alias("premium"),
        metrics.net_flow("ind_buy_value", "ind_sell_value").alias("ind_net_flow"),
        "volume", flags.flag_names("quality_flags").alias("quality_flags"),
        F.lit(False).alias("backfilled"),
    )
    first = ticks.groupBy("trade_date", "ins_code").agg(F.min("ts").alias("_first"))
    before = (
        newest(rebuilt, "rebuilt_ticks")
        .join(first, ["trade_date", "ins_code"])
        .filter(F.col("ts") < F.col("_first"))
        .select(
            "trade_date", "ins_code", "ts", "last_price",
            F.col("last_price").alias("close_price"), F.lit(None).cast("long").alias("nav"),
            F.lit(None).cast("double").alias("premium"),
            F.lit(None).cast("long").alias("ind_net_flow"), "volume",
            F.array().cast("array<string>").alias("quality_flags"),
            F.lit(True).alias("backfilled"),
        )
    )
    return before.unionByName(live_points)


def first_live_points(points: DataFrame) -> DataFrame:
    """Per fund and day with rebuilt minutes: where the live segment starts."""
    return (
        points.groupBy("trade_date", "ins_code")
        .agg(
            F.min(F.when(~F.col("backfilled"), F.col("ts"))).alias("first_live"),
            F.bool_or("backfilled").alias("_any"),
        )
        .filter("_any")
        .drop("_any")
    )


def daily_flows(market: Market, day: dt.date | None = None, days: int | None = None) -> DataFrame:
    """Official individual flow per day and type; a live estimate for days without any."""
    funds = equity_funds(market.funds).select("ins_code", "fund_type")
    flow = metrics.net_flow("ind_buy_value", "ind_sell_value")
    history = _window(
        market.history.select(
            "ins_code", "trade_date", "ind_buy_value", "ind_sell_value", "value", "updated_at"
        ),
        day, days, "trade_date",
    )
    official = (
        newest(history, "fund_history")
        .join(funds, "ins_code")
        .groupBy("trade_date", "fund_type")
        .agg(F.sum(flow).alias("ind_net_flow"), F.sum("value").alias("value"))
        .withColumn("estimated", F.lit(False))
    )
    if market.ticks is None:
        return official
    live = latest_version(
        _on_day(_dated(market.ticks), day).select(
            "trade_date", "ins_code", "ts", "ingested_at", "ind_buy_value", "ind_sell_value", "value"
        ),
        ["trade_date", "ins_code"], ["ts", "ingested_at"],
    )
    known_days = official.select("trade_date").distinct()
    estimate = (
        live.join(known_days, "trade_date", "left_anti")
        .join(funds, "ins_code")
        .groupBy("trade_date", "fund_type")
        .agg(F.sum(flow).alias("ind_net_flow"), F.sum("value").alias("value"))
        .withColumn("estimated", F.lit(True))
    )
    return official.unionByName(estimate)


# --- returns and risk ---------------------------------------------------------------


def _closes(history: DataFrame) -> DataFrame:
    rows = newest(
        history.select("ins_code", "trade_date", "close_price", "updated_at"), "fund_history"
    )
    return rows.filter(F.col("close_price") > 0).select("ins_code", "trade_date", "close_price")


def returns(market: Market, day: dt.date, live: bool = True) -> DataFrame:
    """Price returns of each equity fund over calendar windows ending on ``day``.

    With ``live``, a fund whose history does not reach the day uses its live close.
    """
    span = market.history.filter(
        (F.col("trade_date") <= F.lit(day))
        & (F.col("trade_date") > F.date_sub(F.lit(day), RETURNS_LOOKBACK_DAYS))
    )
    closes = _closes(span).withColumn("year_start", year_start(F.lit(day)))
    on = F.col("trade_date")
    # The previous session: the newest date before the newest. Ordering by date and
    # leaving the newest out needs the newest first, which is one window per fund.
    per_fund = W.partitionBy("ins_code")
    closes = closes.withColumn("_last", F.max("trade_date").over(per_fund))

    def close_at(condition: Column) -> Column:
        return F.max_by("close_price", F.when(condition, on))

    base = closes.groupBy("ins_code").agg(
        F.max(on).alias("d0"),
        F.max_by("close_price", on).alias("c0"),
        close_at(on < F.col("_last")).alias("c1d"),
        close_at(on < F.col("year_start")).alias("cytd"),
        *[
            close_at(on <= F.date_sub(F.lit(day), n)).alias("c" + name[2:])
            for name, n in HORIZONS.items()
        ],
    )
    funds = equity_funds(market.funds).select("ins_code", "symbol", "fund_type")
    rows = base.join(funds, "ins_code")
    if live:
        ticks = _on_day(_dated(market.ticks), day).select(
            "ins_code", "ts", "ingested_at", "close_price", "prev_close"
        )
        last = latest_version(ticks, ["ins_code"], ["ts", "ingested_at"]).select(
            "ins_code", F.col("close_price").alias("_close"), F.col("prev_close").alias("_prev")
        )
        rows = rows.join(last, "ins_code", "left")
        use = F.col("_close").isNotNull() & (F.col("d0") < F.lit(day))
        rows = rows.withColumns(
            {
                "c0": F.when(use, F.col("_close")).otherwise(F.col("c0")),
                "c1d": F.when(use, F.col("_prev")).otherwise(F.col("c1d")),
            }
        )
    return rows.select("ins_code", "symbol", "fund_type", *_return_columns())


def _return_columns() -> list[Column]:
    return [
        metrics.pct_change("c0", "c1d").alias("r_1d"),
        *[metrics.pct_change("c0", "c" + name[2:]).alias(name) for name in HORIZONS],
        metrics.pct_change("c0", "cytd").alias("r_ytd"),
    ]


def returns_every_day(market: Market) -> DataFrame:
    """The same windows ending on each day of each fund's history.

    One row per fund and date, so a fund's window group is as long as the calendar. All
    windows share one partitioning, and each frame only grows, so a group is passed once;
    whether the value found is still within the look-back is tested afterwards.
    """
    closes = _closes(market.history).withColumns(
        {"jalali_year": jalali_year("trade_date"), "_d": F.unix_date("trade_date")}
    )
    by_date = W.partitionBy("ins_code").orderBy("_d")
    by_year = W.partitionBy("ins_code").orderBy("jalali_year")
    priced = F.struct("close_price", "trade_date")

    def in_reach(found: Column) -> Column:
        limit = F.date_sub("trade_date", RETURNS_LOOKBACK_DAYS)
        return F.when(found["trade_date"] > limit, found["close_price"])

    def close_before(days: int) -> Column:
        return F.last(priced).over(by_date.rangeBetween(W.unboundedPreceding, -days))

    earlier_years = by_year.rangeBetween(W.unboundedPreceding, -1)
    found = {
        "c1d": close_before(1),
        **{"c" + name[2:]: close_before(n) for name, n in HORIZONS.items()},
        "cytd": F.max_by(priced, F.col("_d")).over(earlier_years),
    }
    rows = closes.withColumns(found)
    rows = rows.withColumns({c: in_reach(F.col(c)) for c in found})
    rows = rows.withColumn("c0", F.col("close_price"))
    if market.funds is not None:
        funds = equity_funds(market.funds).select("ins_code", "symbol", "fund_type")
        rows = rows.join(funds, "ins_code")
        return rows.select("ins_code", "symbol", "fund_type", "trade_date", *_return_columns())
    return rows.select("ins_code", "trade_date", *_return_columns())


def volatility(closes: DataFrame) -> DataFrame:
    """Annualised volatility and period return of each fund from its closes.

    ``closes`` has one row per fund and date. Undefined below five closes; the return needs
    two.
    """
    ordered = W.partitionBy("ins_code").orderBy("trade_date")
    previous = F.lag("close_price").over(ordered)
    daily = closes.filter(F.col("close_price") > 0).withColumn(
        "_r", F.col("close_price").cast("double") / previous - 1
    )
    first = F.min_by("close_price", "trade_date").cast("double")
    last = F.max_by("close_price", "trade_date").cast("double")
    count = F.count("*")
    return daily.groupBy("ins_code").agg(
        count.alias("closes"),
        F.when(
            count >= metrics.MIN_CLOSES,
            F.stddev_pop("_r") * F.sqrt(F.lit(float(metrics.TRADING_DAYS_PER_YEAR))),
        ).alias("volatility"),
        F.when(count >= 2, last / first - 1).alias("period_return"),
    )


def risk_return(market: Market, day: dt.date, days: int = 90) -> DataFrame:
    """Volatility against return per equity fund; the live close extends its history."""
    if not 20 <= days <= 400:
        raise ValueError("days must be 20-400")
    span = _closes(_window(market.history, day, days, "trade_date"))
    snap = snapshot(market, day).filter(text.in_equity_family("fund_type"))
    live = snap.filter(F.col("close_price") != 0).select(
        "ins_code", F.lit(day).alias("trade_date"), "close_price"
    )
    reached = span.filter(F.col("trade_date") == F.lit(day)).select("ins_code")
    series = span.unionByName(live.join(reached, "ins_code", "left_anti"))
    risk = volatility(series)
    return snap.join(risk, "ins_code", "left").select(
        "ins_code", "symbol", "fund_type", "volatility", "period_return", "aum"
    )


def fund_detail(
    market: Market, ins_code: str, day: dt.date, days: int = 120
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snapshot, returns and daily bars of one fund."""
    if not 5 <= days <= 4000:
        raise ValueError("days must be 5-4000")
    one = lambda df: df.filter(F.col("ins_code") == ins_code)
    narrowed = Market(
        ticks=one(market.ticks), funds=one(market.funds), history=one(market.history),
        calendar=market.calendar,
    )
    bars = daily_bars(narrowed, day, days).drop("ins_code").orderBy("trade_date")
    return snapshot(market, day, ins_code), returns(narrowed, day), bars


def daily_bars(market: Market, day: dt.date, days: int = 120) -> DataFrame:
    """Close, traded value and individuals' net flow of every fund and day."""
    return newest(_window(market.history, day, days, "trade_date"), "fund_history").select(
        "ins_code", "trade_date", "close_price", "value",
        metrics.net_flow("ind_buy_value", "ind_sell_value").alias("ind_net_flow"),
    )
