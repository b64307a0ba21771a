from __future__ import annotations

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from navpulse import schemas

from navpulse.operators.calendar import trading_calendar
from navpulse.plans import analytics, marts, ops
from navpulse.settings import MarketHours

DAY = dt.date(2026, 9, 26)
T = dt.datetime(2026, 9, 26, 10, 0)
MIN = dt.timedelta(minutes=1)


EMPTY = {"string": "", "bigint": 0, "int": 0, "double": 0.0}


def row(schema, **given):
    return tuple(given.get(f.name, EMPTY.get(f.dataType.simpleString())) for f in schema)


@pytest.fixture(scope="module")
def market(spark):
    tick = lambda f, ts, close, nav, value=100, **g: row(
        schemas.FUND_TICKS, ts=ts, ins_code=f, close_price=close, last_price=close, prev_close=1000,
        nav_redemption=nav, value=value, ind_buy_value=g.pop("buy", 0), ind_sell_value=10,
        ind_buy_count=1, ind_sell_count=1, quality_flags=16, ingested_at=g.pop("at", ts), **g)
    ticks = [
        tick("a", T, 900, 1000), tick("a", T + MIN, 1010, 1000, buy=60),
        tick("a", T + MIN, 1, 1, at=T),  # an older version of the same minute
        tick("b", T + MIN, 980, 1000), tick("lev", T + MIN, 500, 1000), tick("mix", T + MIN, 1000, None),
    ]
    fund = lambda f, kind: row(schemas.FUNDS, ins_code=f, symbol=f.upper(), name=f, fund_type=kind,
                               is_active=True, updated_at=T)
    units = [("a", DAY - dt.timedelta(days=5), 10), ("a", DAY + dt.timedelta(days=1), 99),
             ("b", DAY + dt.timedelta(days=2), 30), ("b", DAY + dt.timedelta(days=4), 77), ("lev", DAY, 5)]
    hist = lambda f, d, c: row(schemas.FUND_HISTORY, ins_code=f, trade_date=DAY - dt.timedelta(days=d),
                               close_price=c, value=7, ind_buy_value=5, ind_sell_value=2, updated_at=T)
    closes = [hist("a", d, 1000 + 10 * d) for d in (1, 2, 3, 7, 30, 91, 300)]
    closes += [hist("b", 0, 990), hist("b", 1, 900), hist("mix", 1, 5)]
    states = [("a", T - dt.timedelta(days=2), "A", ""), ("a", T - dt.timedelta(days=1), "AS", "متوقف"),
              ("b", T - dt.timedelta(days=40), "AS", "")]
    df = spark.createDataFrame
    return analytics.Market(
        ticks=df(ticks, schemas.FUND_TICKS),
        funds=df([fund("a", "equity"), fund("b", "sector"), fund("lev", "leveraged"), fund("mix", "mixed")],
                 schemas.FUNDS),
        units=df([(f, d, u, T) for f, d, u in units], schemas.FUND_UNITS),
        states=df([(ts, f, c, t, 0, ts) for f, ts, c, t in states], schemas.FUND_STATE),
        market_ticks=df([row(schemas.MARKET_TICKS, ts=T + MIN, index_value=110.0, index_change=10.0, ingested_at=T)],
                        schemas.MARKET_TICKS),
        runs=df([row(schemas.RUNS, tick=T, received_funds=3, expected_funds=4)], schemas.RUNS),
        history=df(closes, schemas.FUND_HISTORY),
        rebuilt=df([(T + k * MIN, "a", 950, 1, 1, 1, T) for k in (-2, -1, 0)], schemas.REBUILT_TICKS),
        calendar=trading_calendar(spark, dt.date(2025, 1, 1), dt.date(2026, 12, 31), MarketHours()),
    )


def test_snapshot(market):
    rows = {r.ins_code: r for r in analytics.snapshot(market).collect()}
    assert rows["a"].close_price == 1010 and rows["a"].premium == pytest.approx(0.01)
    assert rows["a"].units == 10 and rows["b"].units == 30 and rows["mix"].units is None
    assert rows["a"].aum == 10_000 and rows["a"].ind_net_flow == 50
    assert rows["lev"].premium is None and rows["mix"].aum is None
    assert sum(r.share_of_aum for r in rows.values() if r.share_of_aum) == pytest.approx(1.0)
    assert (rows["a"].status_kind, rows["a"].status_title) == ("suspended", "متوقف")
    assert rows["b"].status_kind == "unknown"  # last seen more than 30 days ago
    assert rows["a"].quality_flags == ["FLOW_VALUE_ESTIMATED"]
    one = analytics.snapshot(market, DAY, "b").collect()
    assert [r.ins_code for r in one] == ["b"] and one[0].share_of_aum == pytest.approx(1.0)


def test_overview(market):
    now = dt.datetime(2026, 9, 26, 11, 0)
    r = analytics.overview(market, DAY, now, MarketHours()).first()
    assert (r.funds, r.total_aum, r.ind_net_flow) == (4, 10_000 + 30_000 + 5_000, 50 - 30)
    assert r.median_premium == pytest.approx(statistics.median([0.01, -0.02]))
    assert r.weighted_premium == pytest.approx((0.01 * 10_000 - 0.02 * 30_000) / 40_000)
    assert (r.at_premium, r.at_discount, r.advancers, r.decliners, r.unchanged) == (1, 1, 1, 2, 1)
    assert r.index_change == pytest.approx(0.1) and r.completeness == pytest.approx(0.75)
    assert r.not_trading == 1 and r.is_live and r.session_date_fa == "1405/07/04"


def test_premium_of_the_rollup_equals_that_of_the_snapshot(market):
    daily = analytics.premium_daily(market, DAY, 30).first()
    equity = analytics.snapshot(market, DAY).filter("fund_type != 'mixed'")
    defined = [r.premium for r in equity.collect() if r.premium is not None]
    assert daily["median"] == pytest.approx(statistics.median(defined)) and daily.funds == len(defined)
    last = analytics.premium_intraday(market, DAY).orderBy(F.col("ts").desc()).first()
    assert last["median"] == pytest.approx(daily["median"])
    assert last.weighted == pytest.approx(daily.weighted)


def test_rebuilt_minutes_never_replace_live_ones(market):
    rows = analytics.fund_intraday(market, DAY, "a").orderBy("ts").collect()
    assert [r.backfilled for r in rows] == [True, True, False, False]
    assert rows[0].close_price == 950 and rows[0].nav is None and rows[2].close_price == 900
    first = analytics.first_live_points(analytics.fund_intraday(market, DAY)).collect()
    assert [(r.ins_code, r.first_live) for r in first] == [("a", T)]


def test_returns(market):
    rows = {r.ins_code: r for r in analytics.returns(market, DAY).collect()}
    assert set(rows) == {"a", "b"}  # mixed funds are not equity
    a = rows["a"]  # history ends yesterday, so the live close counts
    assert a.r_1d == pytest.approx(1010 / 1000 - 1) and a.r_1w == pytest.approx(1010 / 1070 - 1)
    assert a.r_1m == pytest.approx(1010 / 1300 - 1) and a.r_3m == pytest.approx(1010 / 1910 - 1)
    assert a.r_ytd == pytest.approx(1010 / 4000 - 1)
    b = rows["b"]  # history has today, so it counts
    assert b.r_1d == pytest.approx(990 / 900 - 1) and b.r_1w is None


def test_returns_of_every_day_agree_with_one_day(market):
    day = DAY - dt.timedelta(days=1)
    one = {r.ins_code: r for r in analytics.returns(market, day, live=False).collect()}
    many = analytics.returns_every_day(market).filter(F.col("trade_date") == F.lit(day)).collect()
    for r in many:
        for c in marts.RETURN_COLUMNS:
            assert r[c] == pytest.approx(one[r.ins_code][c]) if r[c] is not None else one[r.ins_code][c] is None


def test_risk(market):
    rows = {r.ins_code: r for r in analytics.risk_return(market, DAY, 400).collect()}
    closes = [4000, 1910, 1300, 1070, 1030, 1020, 1010, 1010]
    changes = [b / a - 1 for a, b in zip(closes, closes[1:])]
    assert rows["a"].volatility == pytest.approx(statistics.pstdev(changes) * 252**0.5)
    assert rows["a"].period_return == pytest.approx(1010 / 4000 - 1)
    assert rows["b"].volatility is None and rows["b"].period_return == pytest.approx(990 / 900 - 1)
    assert rows["lev"].period_return is None


def test_flows_and_estimates(market):
    rows = {(r.trade_date, r.fund_type): r for r in analytics.daily_flows(market, DAY, 60).collect()}
    assert rows[(DAY, "sector")].ind_net_flow == 3 and not rows[(DAY, "sector")].estimated
    assert (DAY, "equity") not in rows  # the day has an official row, so nothing is estimated
    earlier = analytics.Market(**{**market.__dict__, "history": market.history.filter("ins_code != 'b'")})
    rows = {(r.trade_date, r.fund_type): r for r in analytics.daily_flows(earlier, DAY, 60).collect()}
    assert rows[(DAY, "equity")].estimated and rows[(DAY, "equity")].ind_net_flow == 50
    assert (DAY, "mixed") not in rows
    wide = marts.flows_pivot(analytics.daily_flows(earlier, DAY, 60)).filter(F.col("trade_date") == F.lit(DAY)).first()
    assert (wide.equity, wide["index"], wide.total) == (50, 0, 50 - 10 - 10)


def test_fund_detail(market):
    snap, returns, bars = analytics.fund_detail(market, "a", DAY - dt.timedelta(days=2), 5)
    assert [b.trade_date for b in bars.collect()] == [DAY - dt.timedelta(days=d) for d in (3, 2)]
    assert returns.count() == 1 and snap.count() == 0


def test_parameter_ranges(market):
    for call in (lambda: analytics.sessions(market, 0), lambda: analytics.risk_return(market, DAY, 5),
                 lambda: ops.recent_runs(market.runs, 501),
                 lambda: analytics.fund_detail(market, "a", DAY, 1)):
        with pytest.raises(ValueError):
            call()


def test_state_of_the_collector(spark):
    base = dt.datetime(2026, 9, 26, 10, 0)
    runs = [(f"r{i}", base + i * MIN, base + i * MIN, base + i * MIN, s)
            for i, s in enumerate(["ok", "failed", "ok", "failed", "failed"])]
    df = spark.createDataFrame(
        runs, "run_id string, started_at timestamp, finished_at timestamp, tick timestamp, status string"
    )
    r = ops.collector_state(df, base + 5 * MIN, True).first()
    assert (r.state, r.lag_seconds, r.failed_streak, r.last_status) == ("ok", 60, 2, "failed")
    assert ops.collector_state(df, base + 9 * MIN, True).first().state == "stale"
    assert ops.collector_state(df.limit(0), base, True).first().state == "stale"
    assert ops.collector_state(df, base, False).first().state == "idle"


def test_heat_of_empty_cells(spark):
    cells = spark.createDataFrame([("f", "r_1d", None), ("g", "r_1d", 0.02)], "f string, horizon string, r double")
    heat = {r.f: r.heat for r in marts.heat_cells(cells, marts.heat_limits(cells)).collect()}
    assert heat == {"f": 0.0, "g": 1.0}

