from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from navpulse.functions import flags, metrics, text, times
from navpulse.operators import calendar as cal
from navpulse.settings import MarketHours
from navpulse.sources.payloads import whole_number


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


def test_premium_and_change(spark):
    L = F.lit
    got = one(
        spark,
        premium=metrics.nav_premium(L(101000), L(100000), L("equity")),
        leveraged=metrics.nav_premium(L(101000), L(100000), L("leveraged")),
        zero=metrics.pct_change(L(0), L(5)),
        no_ref=metrics.pct_change(L(5), L(0)),
        none=metrics.pct_change(L(None).cast("long"), L(5)),
        aum=metrics.aum(L(157502), L(879892240)),
        no_units=metrics.aum(L(157502), L(0)),
        turnover=metrics.turnover(L(1510795429958), metrics.aum(L(157502), L(879892240))),
        power=metrics.buyer_power(L(100), L(2), L(30), L(3)),
        no_sell=metrics.buyer_power(L(100), L(2), L(0), L(3)),
        index=metrics.index_fraction(L(7257043.42), L(89637.91)),
        clamp=metrics.clamp(L(0.4), -0.1, 0.1),
        clamp_none=metrics.clamp(L(None).cast("double"), -0.1, 0.1),
        heat=metrics.clipped_scale(L(-3.0), L(1.0)),
    )
    assert got["premium"] == pytest.approx(0.01)
    assert got["leveraged"] is None and got["zero"] is None and got["no_ref"] is None
    assert got["none"] is None and got["no_units"] is None and got["no_sell"] is None
    assert got["aum"] == 157502 * 879892240
    assert got["turnover"] == pytest.approx(0.0109, abs=1e-4)
    assert got["power"] == pytest.approx(5.0)
    assert got["index"] == pytest.approx(89637.91 / (7257043.42 - 89637.91))
    assert got["clamp"] == pytest.approx(0.1) and got["clamp_none"] is None
    assert got["heat"] == -1.0


def test_median_and_weighted_mean(spark):
    rows = spark.createDataFrame(
        [(0.01, 10), (-0.34, 0), (0.0, 30), (None, 5), (0.02, None)], "v double, w long"
    )
    got = rows.agg(F.median("v").alias("m"), metrics.weighted_mean("v", "w").alias("w")).first()
    assert got.m == pytest.approx(0.005)
    assert got.w == pytest.approx(0.1 / 40)


def test_average_price_and_half_even_estimate(spark):
    L = F.lit
    got = one(
        spark,
        traded=metrics.average_price(L(4), L(10), L(9), L(8)),
        close=metrics.average_price(L(0), L(0), L(9), L(8)),
        prev=metrics.average_price(L(0), L(0), L(0), L(8)),
        half=metrics.flow_estimate(L(1), L(2.5)),
        up=metrics.flow_estimate(L(1), L(3.5)),
    )
    assert got == {"traded": 2.5, "close": 9.0, "prev": 8.0, "half": 2, "up": 4}


def test_whole_numbers(spark):
    values = [("157502.0", 157502), ("7", 7), ("", 0), (None, 0), ("2.5", 2), ("3.5", 4)]
    rows = spark.createDataFrame(values, "raw string, want long")
    for r in rows.select("want", whole_number(F.col("raw")).alias("got")).collect():
        assert r.got == r.want


def test_compact_times(spark):
    L = F.lit
    got = one(
        spark,
        stamp=times.compact_timestamp(L(20260923), L(155804)).cast("string"),
        early=times.compact_timestamp(L(20260923), L(90102)).cast("string"),
        month=times.compact_timestamp(L(20261301), L(90102)),
        hour=times.compact_timestamp(L(20260923), L(250000)),
        second=times.compact_timestamp(L(20260923), L(90060)),
        none=times.compact_timestamp(L(0), L(90102)),
        day=times.compact_date(L(20260923)),
        bad_day=times.compact_date(L(20260231)),
        sod=times.compact_time_seconds(L(90102)),
    )
    assert got["stamp"] == "2026-09-23 15:58:04" and got["early"] == "2026-09-23 09:01:02"
    assert got["month"] is None and got["hour"] is None and got["none"] is None
    assert got["second"] is None
    assert got["day"] == dt.date(2026, 9, 23) and got["bad_day"] is None
    assert got["sod"] == 9 * 3600 + 62


def test_flag_names_and_kinds(spark):
    got = one(
        spark,
        names=flags.flag_names(F.lit(2 | 16 | 8192)),
        none=flags.flag_names(F.lit(0)),
        kind=flags.flag_kind(F.lit("NAV_CARRIED")),
        unknown=flags.flag_kind(F.lit("?")),
    )
    assert got["names"] == ["NAV_MISSING", "FLOW_VALUE_ESTIMATED", "RANGE_REPAIRED"]
    assert got["none"] == [] and got["kind"] == "repair" and got["unknown"] == "warn"


def test_text_normalisation(spark):
    dirty = " سهامي  \t كد‏‌‌‌الف \n"
    rows = spark.createDataFrame([(dirty,), (None,)], "t string")
    got = [r.n for r in rows.select(text.normalize_text("t").alias("n")).collect()]
    assert got == ["سهامی کد‌الف", ""]


CLASSES = [
    ("نوع صندوق : سهامی", "صندوق س.الف-س", "IRT3AAAA0001", "equity"),
    ("نوع صندوق : سهامی", "صندوق شاخصی ب-س", "IRT3AAAA0001", "index"),
    ("نوع صندوق : سهامی", "صندوق بخشی ب-ب", "IRT3AAAA0001", "sector"),
    ("نوع صندوق : سهامي اهرمي", "ب", "IRT3AAAA0001", "leveraged"),
    ("در اوراق بهادار با درآمد ثابت", "ب", "IRT3AAAA0001", "fixed_income"),
    ("", "صندوق آوان-س", "IRT3AAAA0001", "equity"),
    ("", "صندوق شاخص آوان-س", "IRT3AAAA0001", "index"),
    ("", "صندوق آوان-د", "IRT3AAAA0001", "fixed_income"),
    (None, "صندوق طلا آوان", "IRT3AAAA0001", "commodity"),
    (None, "آوان", "IRT3AAAA0001", "other"),
    ("چیز دیگر", "صندوق-س", "IRT3AAAA0001", "other"),
    ("نوع صندوق : سهامی", "ب-س", "IRTKAAAA0001", "commodity"),
]


def test_classification(spark):
    rows = spark.createDataFrame(CLASSES, "d string, n string, i string, want string")
    for r in rows.withColumn("got", text.classify_fund("d", "n", "i")).collect():
        assert r.got == r.want, r


def test_codes_and_status(spark):
    rows = spark.createDataFrame(
        [("A ", "open"), ("as", "suspended"), ("AR", "reserved"), ("IG", "blocked"),
         ("I", "forbidden"), ("", "unknown"), (None, "unknown"), ("X", "unknown")],
        "c string, want string",
    )
    for r in rows.withColumn("got", text.status_kind("c")).collect():
        assert r.got == r.want
    L = F.lit
    got = one(
        spark,
        fund=text.is_fund_unit(L("IRT3SATF0001"), L("68 ")),
        option=text.is_fund_unit(L("IRO9SATF0001"), L("68")),
        primary=text.is_primary_board(L("IRT3SATF0002")),
        stem=text.isin_stem(L("IRT3SATF0001")),
    )
    assert got == {"fund": True, "option": False, "primary": False, "stem": "IRT3SATF"}


def test_bytes_with_errors_become_marks(spark):
    rows = spark.createDataFrame([(bytearray(b"ab\xff"),)], "b binary")
    assert rows.select(text.text_from_bytes("b").alias("t")).first().t == "ab�"


def test_display_units(spark):
    for value, want in ((2 * 10**13, (2.0, "hemat")), (5 * 10**7, (5.0, "million")), (30, (3.0, "toman"))):
        got = one(spark, m=metrics.display_money(F.lit(value)))["m"]
        assert (got["value"], got["unit"]) == want


def test_jalali_golden_dates(spark):
    want = {
        dt.date(2026, 9, 24): "1405/07/02",
        dt.date(2026, 3, 20): "1404/12/29",
        dt.date(2025, 3, 20): "1403/12/30",
        dt.date(2024, 3, 20): "1403/01/01",
    }
    rows = cal.jalali_dates(spark, dt.date(1996, 1, 1), dt.date(2027, 1, 1))
    got = {r.day: r.day_fa for r in rows.collect()}
    assert {d: got[d] for d in want} == want
    assert len(got) == rows.count()  # a date occurs once
    days = sorted(got)
    assert (days[-1] - days[0]).days + 1 == len(days)  # and none is left out


def test_invalid_jalali_date_has_no_match(spark):
    dim = cal.jalali_dates(spark, dt.date(2024, 1, 1), dt.date(2026, 12, 31))
    asked = spark.createDataFrame([(1403, 12, 30), (1404, 12, 30)], "y int, m int, d int")
    got = {r.y: r.gregorian_day for r in cal.from_jalali(asked, dim, "y", "m", "d").collect()}
    assert got == {1403: dt.date(2025, 3, 20), 1404: None}


def test_calendar_priorities(spark):
    hours = MarketHours(extra_closures={dt.date(2026, 10, 5): "ویژه"})
    observed = spark.createDataFrame(
        [(dt.date(2026, 3, 21), True, "باز بود"), (dt.date(2026, 9, 26), False, "بسته بود")],
        "day date, trading boolean, note string",
    )
    rows = {r.day: r for r in cal.calendar_of_year(spark, 1405, hours, observed).collect()}
    assert rows[dt.date(2026, 3, 21)].trading and rows[dt.date(2026, 3, 21)].source == "observed"
    assert rows[dt.date(2026, 3, 21)].reason == "باز بود"
    assert not rows[dt.date(2026, 9, 26)].trading
    assert rows[dt.date(2026, 10, 5)].source == "extra"
    assert rows[dt.date(2026, 3, 22)].reason == "نوروز و تعطیلی عید فطر"
    assert all(r.source != "weekend" for r in rows.values())
    assert all(dt.date(2026, 3, 21) <= d < dt.date(2027, 3, 21) for d in rows)
