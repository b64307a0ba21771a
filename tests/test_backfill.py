from __future__ import annotations

import datetime as dt

import pytest

from navpulse.plans import backfill
from navpulse.settings import BackfillLimits, MarketHours

DAY = dt.date(2026, 9, 26)
HOURS = MarketHours()
S = lambda h, m, s=0: h * 3600 + m * 60 + s
TRADE = "ins_code string, day date, n long, heven long, volume long, price long, canceled long"
NOW = "2026-09-26 13:00:00"


def trades(spark, rows):
    return spark.createDataFrame([(f, DAY, n, h, v, p, c) for f, n, h, v, p, c in rows], TRADE)


def pairs(spark, rows=()):
    return spark.createDataFrame([(f, DAY) for f in rows], "ins_code string, day date")


def live(spark, rows):
    return spark.createDataFrame(
        [(f, DAY, s, v) for f, s, v in rows], "ins_code string, day date, sod long, volume long"
    )


TAPE = [("a", 2, 90100, 50, 1010, 0), ("a", 1, 90010, 100, 1000, 0), ("a", 3, 90030, 999, 5, 1)]


def test_tape_states(spark):
    tape = backfill.tape_from_trades(trades(spark, TAPE))
    probes = spark.createDataFrame(
        [("a", DAY, S(8, 59)), ("a", DAY, S(9, 0, 10)), ("a", DAY, S(9, 1)), ("a", DAY, S(12, 0))],
        "ins_code string, day date, sod long",
    )
    got = {r.sod: (r.last_price, r.volume, r.value, r.trade_count)
           for r in backfill.state_at(probes, tape).collect()}
    assert got[S(8, 59)] == (None, None, None, None)
    assert got[S(9, 0, 10)] == (1000, 100, 100000, 1)
    assert got[S(9, 1)] == got[S(12, 0)] == (1010, 150, 150500, 2)


def test_trades_of_one_second_follow_their_sequence(spark):
    rows = [("a", 7, 90010, 1, 70, 0), ("a", 5, 90010, 1, 50, 0), ("a", 6, 90010, 1, 60, 0)]
    row = backfill.tape_from_trades(trades(spark, rows)).first()
    assert (row.last_price, row.volume, row.value, row.trade_count) == (70, 3, 180, 3)


@pytest.mark.parametrize("volume,matches", [(99, 0), (148, 1), (150, 1), (152, 1), (153, 0)])
def test_live_volume_must_fit_the_tape(spark, volume, matches):
    tape = backfill.tape_from_trades(trades(spark, TAPE))
    got = backfill.verify_live(live(spark, [("a", S(11, 0), volume)]), tape, BackfillLimits()).first()
    assert (got.overlap, got.matched) == (1, matches)


def test_intraday_decisions(spark):
    rows = [(f, *t[1:]) for f in ("good", "bad", "early", "done", "broken") for t in TAPE]
    points = [(f, S(9, 5, 30), 150) for f in ("good", "done", "broken", "silent")]
    points += [("bad", S(9, 5), 900), ("early", S(9, 1), 150)]
    failed = spark.createDataFrame([("broken", DAY, "HTTP 502")], "ins_code string, day date, error string")
    out = backfill.backfill_intraday(
        trades(spark, rows), live(spark, points), pairs(spark, ["done"]), HOURS, NOW, failed=failed
    )
    log = {r.ins_code: r for r in out.log.collect()}
    assert {f: r.status for f, r in log.items()} == {
        "good": "stored", "bad": "rejected", "broken": "error", "silent": "no_trades"
    }
    assert (log["good"].overlap, log["good"].matched, log["good"].minutes) == (1, 1, 4)
    assert log["bad"].note == "first trade 09:00" and log["broken"].note == "HTTP 502"
    assert (log["broken"].overlap, log["broken"].minutes) == (0, 0)
    got = sorted((r.ts.strftime("%H:%M"), r.last_price, r.volume) for r in out.minutes.collect())
    assert got == [("09:01", 1010, 150), ("09:02", 1010, 150), ("09:03", 1010, 150), ("09:04", 1010, 150)]
    report = backfill.report(out.log).first()
    assert (report.funds, report.stored, report.rejected, report.errors) == (4, 1, 1, 1)
    assert report.rejected_symbols == ["bad"]


def test_session_decisions(spark):
    events = [(f, DAY, h, p, v, a, n, i)
              for f in ("good", "bad", "unlisted", "zero")
              for i, (h, p, v, a, n) in enumerate([(90010, 10, 5, 50, 1), (90530, 11, 9, 94, 2)])]
    e = spark.createDataFrame(
        events, "ins_code string, day date, heven long, last_price long, volume long, value long,"
        " trade_count long, position int",
    )
    official = spark.createDataFrame(
        [("good", DAY, 9, 94), ("bad", DAY, 20, 94), ("zero", DAY, 0, 94)],
        "ins_code string, day date, volume long, value long",
    )
    targets = pairs(spark, ["good", "bad", "unlisted", "zero", "silent"])
    out = backfill.backfill_sessions(e, targets, official, pairs(spark), HOURS, NOW)
    log = {r.ins_code: (r.status, r.overlap, r.note) for r in out.log.collect()}
    assert log == {
        "good": ("stored", 1, ""),
        "bad": ("rejected", 1, "mismatch vs official EOD"),
        "zero": ("rejected", 1, "mismatch vs official EOD"),
        "unlisted": ("rejected", 0, "no official daily row"),
        "silent": ("no_trades", 0, ""),
    }
    rows = out.minutes.orderBy("ts").collect()
    assert len(rows) == 210 and rows[0].ts.strftime("%H:%M") == "09:01"
    assert rows[-1].ts.strftime("%H:%M") == "12:30" and rows[-1].volume == 9
