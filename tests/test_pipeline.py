"""From archived responses to stored rows."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from navpulse import schemas
from navpulse.functions import flags as fl
from navpulse.plans import history, ops, ticks as tick_plan, universe
from navpulse.sources import archive, payloads, sinks

AT = dt.datetime(2026, 9, 23, 16, 0)
FUND = "11427939669935844"
FUND_ISIN = "IRT3SATF0001"


def watch_row(**given):
    base = {
        "insCode": FUND, "lva": "ساتف", "lvc": "صندوق س.ساتف-س", "insID": FUND_ISIN, "csv": "68 ",
        "pdv": 158000.0, "pcl": 157615.0, "pf": 156000.0, "pmn": 155900.0, "pmx": 158400.0,
        "py": 155000.0, "qtj": 9585358.0, "qtc": 1510795429958.0, "ztt": 2401.0, "pMax": 160000.0,
        "pMin": 150000, "hEven": 122959, "ignored": {"deep": [1]},
        "blDs": [{"n": 2, "pmd": 1.0, "pmo": 2.0, "qmd": 3, "qmo": 4},
                 {"n": 1, "pmd": 157974.0, "pmo": 158000.0, "qmd": 10, "qmo": 20}],
    }
    return base | given


WATCH = {"marketwatch": [
    watch_row(),
    watch_row(insCode="2", insID="IRT3SATF0002", qtj=1000.0, qtc=157000000.0),
    watch_row(insCode="3", insID="IRT1EMPT0001", ztt=0.0, qtj=0.0, qtc=0.0, blDs=[], pMin=None),
    watch_row(insCode="9", insID="IRO1STCK0001", csv="27", hEven=123001),
]}
CLIENTS = {"clientTypeAllDto": [
    {"insCode": FUND, "buy_I_Volume": 1.0, "buy_N_Volume": 2.0},
    {"insCode": FUND, "buy_I_Volume": 7000000.0, "buy_N_Volume": 2585358.0, "sell_I_Volume": 100,
     "sell_N_Volume": "", "buy_CountI": 321, "buy_CountN": 12, "sell_CountI": 44, "sell_CountN": None},
]}
NAV = {"etf": {"insCode": FUND, "deven": 20260923, "hEven": 155804, "pRedTran": 157502.0, "pSubTran": 159005.0}}
OVERVIEW = {"marketOverview": {
    "indexLastValue": 7257043.42, "indexChange": 89637.91, "indexEqualWeightedLastValue": 1.5,
    "indexEqualWeightedChange": 0.5, "marketValue": 1e17, "marketState": "A ",
    "marketActivityDEven": 20260923, "marketActivityHEven": 123000}}
STATE = {"closingPriceInfo": {"instrumentState": {"cEtaval": "A ", "cEtavalTitle": "مجاز", "underSupervision": 1}}}


@pytest.fixture(scope="module")
def raw(spark):
    def response(endpoint, body, ins="", status=200):
        text = body if isinstance(body, str) else json.dumps(body)
        return (AT, "run1", "provider", endpoint, ins, status, 10, 1, text)

    rows = [
        response("market_watch", WATCH),
        response("client_type_all", CLIENTS),
        response("etf", NAV, FUND),
        response("etf", {"etf": None}, "3"),
        response("etf", {"etf": {"pRedTran": "abc"}}, "5"),
        response("etf", "{not json", "6"),
        response("etf", "", "7", status=502),
        response("etf", {"other": 1}, "8"),
        response("market_overview", OVERVIEW),
        response("closing_price_info", STATE, FUND),
        response("closing_price_info", {"closingPriceInfo": {"instrumentState": None}}, "3"),
        response("closing_price_info", STATE, "not-in-universe"),
    ]
    return spark.createDataFrame(rows, schemas.RAW_RESPONSES)


@pytest.fixture(scope="module")
def built(spark, raw):
    runs = spark.createDataFrame([("run1", AT + dt.timedelta(seconds=5), AT)],
                                 "run_id string, tick timestamp, finished_at timestamp")
    cycles = tick_plan.cycles_of(runs)
    funds = spark.createDataFrame(
        [(FUND, FUND_ISIN), ("3", "IRT1EMPT0001"), ("4", "IRT1GONE0001")], "ins_code string, isin string"
    )
    members = tick_plan.universe_on_days(funds, cycles)
    out = tick_plan.build_ticks(
        payloads.parse(raw, "market_watch"), payloads.parse(raw, "client_type_all"),
        payloads.parse(raw, "etf", ("run_id", "ins_code")), members, cycles,
    )
    return out, members, cycles


# Figures of a recorded fund.
def test_tick_of_a_recorded_fund(built):
    row = built[0].filter(F.col("ins_code") == FUND).first()
    assert (row.last_price, row.close_price, row.volume) == (158000, 157615, 9585358)
    assert (row.nav_redemption, row.nav_subscription) == (157502, 159005)
    assert row.nav_at == dt.datetime(2026, 9, 23, 15, 58, 4)
    assert (row.bid_price, row.ask_price, row.bid_volume) == (157974, 158000, 10)
    assert (row.block_volume, row.block_value) == (1000, 157000000)
    assert row.quality_flags == fl.FLOW_VALUE_ESTIMATED and row.ts == AT
    assert (row.ind_buy_volume, row.ind_buy_count, row.inst_sell_volume) == (7000000, 321, 0)
    assert row.ind_buy_value == round(7000000 * (1510795429958 / 9585358))
    assert (row.band_low, row.band_high, row.feed_heven) == (150000, 160000, 123001)


def test_tick_without_optional_sides(built):
    row = built[0].filter(F.col("ins_code") == "3").first()
    assert row.quality_flags == 16 | fl.NAV_MISSING | fl.CLIENT_TYPE_MISSING | fl.NO_TRADES
    assert row.nav_redemption is None and row.bid_price == 0 and row.ind_buy_value == 0
    assert row.band_low is None


def test_missing_funds(built):
    ticks, members, cycles = built
    expected = tick_plan.expected_rows(cycles, members)
    assert [r.ins_code for r in tick_plan.missing_funds(expected, ticks).collect()] == ["4"]


def test_states_and_market_tick(raw, built):
    _, members, cycles = built
    states = payloads.parse(raw, "closing_price_info", ("run_id", "ins_code"))
    rows = tick_plan.fund_states(states, members, cycles).collect()
    assert [(r.ins_code, r.code, r.title, r.under_supervision) for r in rows] == [(FUND, "A", "مجاز", 1)]
    row = tick_plan.market_ticks(payloads.parse(raw, "market_overview"), cycles).first()
    assert row.index_value == 7257043.42 and row.state == "A" and row.ts == AT


def test_bad_responses_are_rows_not_failures(raw):
    got = {r.ins_code: r.error for r in payloads.errors(raw).collect()}
    assert got == {
        "5": "etf:5: parse error: a number is not one",
        "6": "etf:6: parse error: expected top-level key 'etf'",
        "7": "etf:7: HTTP 502",
        "8": "etf:8: parse error: expected top-level key 'etf'",
    }


def test_archive_of_a_day(spark, raw):
    runs = spark.createDataFrame(
        [("run1", AT), ("run2", AT + dt.timedelta(days=1))], "run_id string, tick timestamp"
    )
    assert archive.raw_of_days(raw, runs, AT.date(), AT.date()).count() == raw.count()
    tomorrow = AT.date() + dt.timedelta(days=1)
    assert archive.raw_of_days(raw, runs, tomorrow, tomorrow).count() == 0


def test_history_merge(spark):
    prices = [("f", d, d * 10, 5, i) for i, d in enumerate(range(20260901, 20260921))]
    prices += [("f", 0, 1, 1, 90), ("f", 20260930, 1, -1, 91)]
    p = spark.createDataFrame(prices, "ins_code string, deven long, close_price long, volume long, position int")
    flows = [("f", 20260920, 1, 0), ("f", 20260920, 7, 1), ("f", 20261001, 9, 2)]
    fl_ = spark.createDataFrame(flows, "ins_code string, deven long, ind_buy_value long, position int")
    fl_ = fl_.withColumns({c: F.lit(0).cast("long") for c in history.FLOW_COLUMNS if c != "ind_buy_value"})
    rows = history.merge_history(p, fl_, 10).orderBy(F.col("deven").desc()).collect()
    assert [r.deven for r in rows] == list(range(20260920, 20260910, -1))
    assert rows[0].trade_date == dt.date(2026, 9, 20) and rows[0].ind_buy_value == 7
    assert rows[1].ind_buy_value == 0 and rows[1].inst_sell_count == 0


def test_universe_sync(spark, raw):
    info = {"instrumentInfo": {"lVal18AFC": "ساتف", "lVal30": "صندوق ساتف", "faraDesc": "نوع صندوق : سهامي",
                               "etfIssuedUnit": 879892240.0, "flowTitle": "فرابورس"}}
    extra = spark.createDataFrame(
        [(AT, "run1", "provider", "instrument_info", FUND, 200, 1, 1, json.dumps(info))], schemas.RAW_RESPONSES
    )
    details = payloads.parse(extra, "instrument_info", ("run_id", "ins_code"))
    records = universe.fund_records(payloads.parse(raw, "market_watch"), details)
    got = {r.ins_code: (r.fund_type, r.units, r.name) for r in records.collect()}
    assert got == {FUND: ("equity", 879892240, "صندوق ساتف"), "3": ("equity", None, "صندوق س.ساتف-س")}
    known = spark.createDataFrame(
        [("3", "s", "n", "i", "equity"), ("77", "s", "n", "i", "mixed")],
        "ins_code string, symbol string, name string, isin string, fund_type string",
    )
    synced = universe.sync(records, known, "2026-09-23 08:30:00")
    assert {r.ins_code: r.is_active for r in synced.collect()} == {FUND: True, "3": True, "77": False}
    report = universe.report(synced).first()
    assert (report.funds, report.equity, report.deactivated, report.info_failures) == (2, 2, 1, 1)
    assert set(schemas.FUNDS.names) == set(synced.columns)


def test_universe_falls_back_to_the_last_list(spark):
    day = dt.date(2026, 9, 23)
    old = dt.datetime(2026, 9, 20, 8)
    row = lambda ins, kind, at: (ins, "s", "n", "i", kind, "", "", "", "", True, "p", at)
    units = spark.createDataFrame([], schemas.FUND_UNITS)
    none_today = spark.createDataFrame([row("a", "equity", old), row("b", "mixed", old)], schemas.FUNDS)
    assert [r.ins_code for r in archive.universe_of_day(none_today, units, day).collect()] == ["a"]
    today = none_today.union(
        spark.createDataFrame([row("c", "index", dt.datetime(2026, 9, 23, 8))], schemas.FUNDS)
    )
    assert [r.ins_code for r in archive.universe_of_day(today, units, day).collect()] == ["c"]


def test_replacing_a_day_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda d, x: (dt.date(2026, 9, d), "f", x)
    cols = "trade_date date, ins_code string, x int"
    sinks.replace_days(spark.createDataFrame([row(1, 1), row(2, 1)], cols), path, sort=["ins_code"])
    sinks.replace_days(spark.createDataFrame([row(2, 9)], cols), path, sort=["ins_code"])
    got = sorted((r.trade_date.day, r.x) for r in spark.read.parquet(path).collect())
    assert got == [(1, 1), (2, 9)]
    days = [dt.date(2026, 9, d) for d in (1, 2, 3)]
    sinks.replace_days(spark.createDataFrame([row(3, 5)], cols), path, sort=["ins_code"], days=days)
    assert [(r.trade_date.day, r.x) for r in spark.read.parquet(path).collect()] == [(3, 5)]


def test_retention(spark, tmp_path):
    rows = [(dt.date(2026, 9, 1), 1), (dt.date(2026, 8, 1), 2)]
    spark.createDataFrame(rows, "day date, x int").write.partitionBy("day").parquet(str(tmp_path / "a"))
    sinks.expire(spark, str(tmp_path / "a"), str(tmp_path / "b"), "day", 30, "2026-09-15")
    assert [r.x for r in spark.read.parquet(str(tmp_path / "b")).collect()] == [1]


def test_run_status_and_note(spark):
    rows = [("a", 0, 0, 0, []), ("b", 5, 0, 0, []), ("c", 5, 1, 0, []), ("d", 5, 0, 0, [f"e{i}" for i in range(7)])]
    df = spark.createDataFrame(
        rows, "run_id string, received_funds int, missing_funds int, failed_requests int, errors array<string>"
    )
    got = {r.run_id: (r.status, r.note) for r in ops.run_status(df).collect()}
    assert got == {"a": ("failed", ""), "b": ("ok", ""), "c": ("partial", ""), "d": ("partial", "e0; e1; e2; e3; e4")}


def test_history_window():
    day = dt.date(2026, 9, 23)
    assert archive.history_window(None, day) == 400
    assert archive.history_window(day, day) == 0
    assert archive.history_window(day - dt.timedelta(days=2), day) == 10
    assert archive.history_window(day - dt.timedelta(days=60), day) == 65


def test_replay_of_a_day(spark, raw, tmp_path):
    from navpulse.operators.calendar import trading_calendar
    from navpulse.plans import replay
    from navpulse.settings import MarketHours

    later = AT + dt.timedelta(minutes=1)
    runs = spark.createDataFrame(
        [("run1", AT, AT), ("run2", later, later)],  # the second run has no responses
        "run_id string, tick timestamp, finished_at timestamp",
    )
    funds = [(FUND, FUND_ISIN, AT.date()), ("3", "IRT1EMPT0001", AT.date()), ("4", "IRT1GONE0001", AT.date())]
    universe = spark.createDataFrame(funds, "ins_code string, isin string, day date")
    broken = spark.createDataFrame(
        [(later, "run2", "provider", "market_watch", "", 502, 1, 1, ""),
         (later, "run2", "provider", "market_overview", "", 200, 1, 1, json.dumps(OVERVIEW))],
        schemas.RAW_RESPONSES,
    )
    hours = MarketHours()
    cal = trading_calendar(spark, dt.date(2026, 9, 1), dt.date(2026, 9, 30), hours)
    done, cycles = replay.replay(
        raw.unionByName(broken), runs, universe, hours, cal, AT.date(), AT.date()
    )
    rows = {(r.ins_code, r.ts): r for r in done.ticks.collect()}
    assert set(rows) == {(f, t) for f in (FUND, "3") for t in (AT, later)}
    assert rows[(FUND, later)].filled and rows[(FUND, later)].run_id == "run2"
    assert not rows[(FUND, AT)].filled and rows[(FUND, AT)].nav_redemption == 157502
    issues = {(r.ins_code, r.ts, r.check, r.action) for r in done.issues.collect()}
    assert ("4", AT, "missing_fund", "dropped") in issues
    assert (FUND, later, "missing_fund", "forward_filled") in issues
    assert cycles.market.count() == 1  # none for the run without a market watch
    assert "market_watch::" in " ".join(r.error for r in cycles.errors.collect())
    span = (AT.date(), AT.date())
    replay.store(done, cycles, str(tmp_path), *span)
    replay.store(done, cycles, str(tmp_path), *span)  # again: replaced, not doubled
    assert spark.read.parquet(f"{tmp_path}/fund_ticks").count() == 4
    assert spark.read.parquet(f"{tmp_path}/data_quality_log").count() == len(issues)

    # Replayed without issues or rows, a day keeps neither.
    nothing = replay.Cycles(*[getattr(cycles, f).limit(0) for f in ("ticks", "expected", "market", "states", "errors")])
    clean = type(done)(done.ticks.limit(0), done.issues.limit(0), done.state)
    replay.store(clean, nothing, str(tmp_path), AT.date() - dt.timedelta(days=1), AT.date())
    for table in ("fund_ticks", "data_quality_log"):
        assert not list((tmp_path / table).glob("trade_date=*"))
