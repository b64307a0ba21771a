"""What is decided in the course of a day, and dates by arithmetic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from navpulse.operators import calendar as cal
from navpulse.plans import session_day
from navpulse.settings import MarketHours

HOURS = MarketHours()  # 9:00 to 12:30, guard of 20 minutes
MONDAY = dt.date(2026, 9, 28)


def at(h, m=0, day=MONDAY):
    return dt.datetime.combine(day, dt.time(h, m))


def decisions(spark, probes, trading=True, source="weekday"):
    """``probes``: (time, whether the day was shown, None for a failure)."""
    rows = [(i, t, MONDAY if shown else MONDAY - dt.timedelta(days=1), shown is None) for i, (t, shown) in enumerate(probes)]
    df = spark.createDataFrame(rows, "probe long, at timestamp, session_day date, failed boolean")
    days = spark.createDataFrame([(MONDAY, trading, source)], "day date, trading boolean, source string")
    made = session_day.session_decisions(df, days, HOURS)
    return [r.decision for r in made.orderBy("probe").collect()], made


def test_trading_day(spark):
    got, _ = decisions(spark, [(at(9), False), (at(9, 1), True), (at(9, 2), False), (at(9, 30), False)])
    assert got == ["waiting", "collect", "collect", "collect"]
    got, _ = decisions(spark, [(at(9), None), (at(9, 19), False), (at(9, 20), None), (at(9, 21), False), (at(9, 22), True)])
    assert got == ["collect", "waiting", "collect", "closed", "over"]


def test_listed_holiday(spark):
    probes = [(at(9, 19), True), (at(9, 20), True), (at(9, 21), False)]
    got, made = decisions(spark, probes, False, "official")
    assert got == ["holiday", "opened", "collect"]
    days = session_day.observed_days(made, "shut", "wrong list").collect()
    assert [(r.day, r.trading, r.note, r.recorded_at) for r in days] == [(MONDAY, True, "wrong list", at(9, 20))]
    got, _ = decisions(spark, [(at(9, 20), None), (at(9, 21), True), (at(12, 31), True)], False, "extra")
    assert got == ["holiday"] * 3  # the one check failed
    got, _ = decisions(spark, [(at(9, 20), True)], False, "weekend")
    assert got == ["rest"]


def test_closing(spark):
    sunday = MONDAY - dt.timedelta(days=1)
    rows = [  # fund, cycle, session, refresh, trades
        ("a", at(12, 30), MONDAY, False, 5),  # still open
        ("a", at(12, 31), MONDAY, False, 0), ("b", at(12, 31), MONDAY, False, 0),
        ("a", at(12, 32), MONDAY, False, 5), ("b", at(12, 32), MONDAY, False, 0),
        ("a", at(12, 33), MONDAY, False, 6),
        ("a", at(15), MONDAY, True, 7),
        ("a", at(7), sunday, False, 9), ("a", at(8), sunday, True, 9),
    ]
    df = spark.createDataFrame(rows, "ins_code string, ts timestamp, session date, refresh boolean, trade_count long")
    days = spark.createDataFrame([(MONDAY, True)], "day date, trading boolean")
    stored = spark.createDataFrame([(sunday,)], "session date")
    made = session_day.closing_decisions(df, stored, days, HOURS)
    got = {(r.session, r.ts): r.decision for r in made.collect()}
    assert got == {
        (MONDAY, at(12, 30)): "open", (MONDAY, at(12, 31)): "no_trades", (MONDAY, at(12, 32)): "committed",
        (MONDAY, at(12, 33)): "stored", (MONDAY, at(15)): "committed",
        (sunday, at(7)): "stored", (sunday, at(8)): "committed",
    }
    final = {(r.ins_code, r.ts): r.trade_count for r in session_day.closing_rows(df, made, HOURS).collect()}
    assert final == {("a", at(12, 30)): 7, ("b", at(12, 30)): 0, ("a", at(12, 30, sunday)): 9}


def test_jalali_dates_there_and_back(spark):
    """Every date of 140 years; and no other triple is a date."""
    days = cal.jalali_dates(spark, dt.date(1930, 1, 1), dt.date(2050, 1, 1))
    back = days.select("day", cal.jalali_to_date("jalali_year", "jalali_month", "jalali_day").alias("back"))
    assert back.filter("back IS NULL OR back <> day").count() == 0
    triples = spark.range(1400, 1410).selectExpr("id AS y", "explode(sequence(-1, 14)) AS m").selectExpr("y", "m", "explode(sequence(-1, 33)) AS d")
    made = triples.filter(cal.jalali_to_date("y", "m", "d").isNotNull())
    assert made.count() == days.filter(F.col("jalali_year").between(1400, 1409)).count()
    last = {r.y for r in made.filter("m = 12 AND d = 30").collect()}
    assert last == {1403, 1408}
