"""The write path on rows of its own: what is shuffled, and what comes out."""

from __future__ import annotations

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from navpulse import schemas, session
from navpulse.catalog import QUERIES, cycles, jobs
from navpulse.operators.calendar import trading_calendar
from navpulse.plans import replay, ticks as tick_plan
from navpulse.plans.validate import validate
from navpulse.settings import MarketHours

DAY = dt.datetime(1995, 3, 2)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Order 300 and 600 are of one minute; order 26 fails, order 7 has no lines, line 99 no order."""
    where = str(tmp_path_factory.mktemp("cycles"))
    orders = [(26, DAY), (300, DAY), (600, DAY), (7, DAY), (8, DAY + dt.timedelta(days=1)), (9, None)]
    lines = [
        (300, 2, 11, 5, 3.0, 10.5), (300, 1, 12, 8, 5.0, 20.25), (300, 2, 11, 5, 3.0, 10.5), (600, 1, 11, 6, 2.0, 9.0),
        (600, 2, 57, 6, 2.0, 9.0), (26, 1, 13, 1, 1.0, 1.0), (8, 1, 11, 1, 4.0, 2.0), (99, 1, 11, 1, 4.0, 2.0),
        (300, 3, None, 1, 1.0, 1.0), (None, 1, 11, 3, 1.0, 1.0), (9, 1, 14, 3, 1.0, 1.0),
    ]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{where}/orders.parquet")
    shape = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double"
    spark.createDataFrame(lines, shape).write.parquet(f"{where}/lineitem.parquet")
    return where


def below_exchanges(df):
    """Lines of the plan that stand below an exchange."""
    deep, out = None, []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" +-:*()0123456789"))
        if deep is not None and at > deep:
            out.append(line)
        else:
            deep = at if line.lstrip(" +-:*()0123456789").startswith("Exchange") else None
    return out


def test_archive_shuffles_numbers_only(spark, folder):
    below = below_exchanges(cycles.cycle_responses(spark, folder))
    assert below and not [line for line in below if "concat(" in line or "collect_list" in line]


def test_archive_of_an_order(spark, folder):
    made = cycles.cycle_responses(spark, folder).collect()
    of = {(r.run_id, r.endpoint): json.loads(r.payload) for r in made if r.ins_code == "" and r.run_id is not None}
    watch = of["300", "market_watch"]["marketwatch"]
    # By line number, parts without a number left out, primary boards before the others.
    assert [w["insCode"] for w in watch] == ["12", "11", "11", "b12", "b11", "b11"]
    assert watch[1]["qtc"] == 1050 and watch[0]["pMax"] == 0 and watch[3]["qtc"] == 56
    assert [c["insCode"] for c in of["300", "client_type_all"]["clientTypeAllDto"]] == ["11", "11"]
    assert of["99", "market_overview"]["marketOverview"]["indexLastValue"] == 99.5
    assert sum(r.run_id is None for r in made) == 3  # lines without an order key are one response of each kind
    lines = [(r.run_id, r.ins_code, r.status_code) for r in made if r.endpoint == "closing_price_info"]
    assert lines.count(("300", "11", 200)) == 2 and not [x for x in lines if x[0] == "99"]


def unfolded(lines):
    return [line for line in lines if re.search(r"explode\(_?cycles", line)]


def plan_lines(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def rows_of(df, *columns):
    return sorted(map(str, df.select(*columns or df.columns).collect()))


def test_responses_of_runs_without_a_minute_are_not_parsed(spark, folder):
    """Of the two orders of one minute the later counts; the other's responses go before any shuffle."""
    made = cycles.cycles(spark, folder)
    assert {r.run_id for r in made.ticks.collect()} == {"600", "8"}
    assert any("BroadcastHashJoin" in line and "LeftSemi" in line for line in plan_lines(made.ticks))


def test_pairs_are_not_shuffled_to_find_the_missing(spark, folder):
    made = cycles.cycles(spark, folder)
    assert rows_of(made.missing) == rows_of(tick_plan.missing_funds(made.expected, made.ticks), *made.missing.columns)
    missing = cycles.cycle_missing(spark, folder)
    assert unfolded(plan_lines(missing)) and not unfolded(below_exchanges(missing))


def test_a_missing_pair_costs_no_conversion_and_no_columns_nobody_reads(spark, folder):
    """A cycle's time is told once per cycle; with it only the times of a day travel, to all tasks whatever they measure."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        missing = QUERIES["cycle_missing"](spark, folder)
        plan = plan_lines(missing)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    unfolds = next(i for i, line in enumerate(plan) if "Generate posexplode(_cycles" in line)
    assert not [line for line in plan[:unfolds] if "cast(" in line or "run_id" in line]
    assert "BroadcastHashJoin [day" in next(line for line in plan[unfolds:] if "Join" in line)
    made = cycles.cycles(spark, folder).missing
    assert [tuple(r) for r in made.select("ins_code", F.col("ts").cast("timestamp_ntz")).orderBy("ins_code", "ts").collect()] == [
        tuple(r) for r in missing.orderBy("ins_code", "ts").collect()
    ]
    told = {(r.ts, r.run_id) for r in made.collect()}
    assert {run for _, run in told} == {"26", "600", "7"} and len(told) == 3


def test_archive_is_shuffled_once(spark, folder):
    """Lines and dates of an order travel once, and every response comes out of the order's one row."""
    plan = plan_lines(cycles.cycle_responses(spark, folder))
    assert sum("Exchange" in line for line in plan) == 1
    assert sum("Generate" in line for line in plan) == 1 and not [line for line in plan if "Join" in line]


def test_archive_of_a_date_that_comes_twice_or_is_null(spark, tmp_path):
    """A line's own responses come once per row of its order; those of the whole order once."""
    orders = [(1, DAY), (1, DAY + dt.timedelta(days=1)), (2, None), (None, DAY), (3, DAY)]
    lines = [(1, 1, 12, 5, 3.0, 1.5), (1, 1, 110, 5, 3.0, 1.5), (2, 1, 11, 5, 3.0, 1.5), (None, 1, 10, 5, 3.0, 1.5), (4, 1, 10, 5, 3.0, 1.5)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    shape = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double"
    spark.createDataFrame(lines, shape).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = cycles.cycle_responses(spark, str(tmp_path)).collect()
    of = lambda run, endpoint: [r.payload for r in made if (r.run_id, r.endpoint) == (run, endpoint)]
    assert [w["insCode"] for w in json.loads(of("1", "market_watch")[0])["marketwatch"]] == ["110", "12", "b110", "b12"]
    assert sorted(json.loads(p)["etf"]["deven"] for p in of("1", "etf") if "deven" in p) == [19950302, 19950303]
    assert (len(of("1", "etf")), len(of("1", "closing_price_info")), len(of("1", "client_type_all"))) == (4, 4, 1)
    assert of("2", "etf") == [None] and len(of("2", "closing_price_info")) == 1
    assert sorted(str(r.run_id) for r in made if r.endpoint == "market_overview") == ["1", "2", "4", "None"]
    assert not of("4", "etf") and not of(None, "etf") and not of("3", "market_watch")


def test_universe_is_shuffled_once_and_shared(spark, folder):
    plan = plan_lines(cycles.cycle_universe(spark, folder).select("ins_code", "day"))
    assert sum("Exchange hashpartitioning(ins_code" in line for line in plan) == 1
    assert not [line for line in plan if "Exchange hashpartitioning(l_partkey" in line]
    missing = cycles.cycle_missing(spark, folder)
    missing.collect()
    final = missing._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReusedExchange \[ins_code#\d+, day", final.split("== Initial Plan ==")[0])


def test_record_counts_pairs_without_making_them(spark, folder):
    record = jobs.cycle_record(spark, folder)
    assert not unfolded(plan_lines(record))
    expected = cycles.cycles(spark, folder).expected
    pairs = {r.run_id: r["count"] for r in expected.groupBy("run_id").count().collect()}
    # The failed order's minute is a cycle of its day too; the minute's earlier order is none.
    assert pairs == {r.run_id: r.expected_funds for r in record.collect() if r.expected_funds}
    assert set(pairs) == {"26", "600", "7", "8"}


def tick(code, minute, **given):
    at = DAY + dt.timedelta(minutes=540 + minute)
    row = dict.fromkeys(schemas.TICK_COLUMNS, 100) | {"ins_code": code, "ts": at, "run_id": f"r{minute}", "ingested_at": at}
    row |= {"nav_at": None, "nav_redemption": None, "quality_flags": 0, "band_low": 50, "band_high": 200, "feed_heven": minute}
    return row | given


def test_leading_absences_decide_nothing(spark):
    """Validated with the decisive pairs only, a day has the same rows, issues and state."""
    minutes = [0, 1, 2, 3, 4, 5, 6, 20, 21, 22]
    runs = [(f"r{m}", DAY + dt.timedelta(minutes=540 + m), DAY + dt.timedelta(minutes=540 + m)) for m in minutes]
    ran = tick_plan.cycles_of(spark.createDataFrame(runs, "run_id string, tick timestamp, finished_at timestamp"))
    rows = [
        tick("a", 0), tick("a", 4, last_price=300), tick("b", 5, last_price=300), tick("b", 20, last_price=90, volume=1),
        tick("c", 22), tick("d", 2, nav_redemption=7), tick("d", 3),
    ]
    shape = ", ".join(
        f"{c} {'timestamp' if c in ('ts', 'ingested_at', 'nav_at') else 'string' if c in ('ins_code', 'run_id') else 'int' if c == 'quality_flags' else 'long'}"
        for c in (*schemas.TICK_COLUMNS, "band_low", "band_high", "feed_heven")
    )
    ticks = spark.createDataFrame([tuple(r[f.split()[0]] for f in shape.split(", ")) for r in rows], shape)
    universe = spark.createDataFrame([(c, DAY.date()) for c in "abcdez"], "ins_code string, day date")
    hours = MarketHours()
    calendar = trading_calendar(spark, DAY.date(), DAY.date(), hours)
    expected, decisive = tick_plan.expected_rows(ran, universe), tick_plan.decisive_rows(universe, ran, ticks)
    # a: all ten; b: from minute 5 on and the first; c: first and last; d: but 1; e, z: first and last.
    assert (expected.count(), decisive.count()) == (60, 10 + 6 + 2 + 9 + 4)
    whole, short = (validate(ticks, due, hours, calendar) for due in (expected, decisive.select(*expected.columns)))
    for part in ("ticks", "issues", "state"):
        assert rows_of(getattr(whole, part)) == rows_of(getattr(short, part))
    assert {r.ins_code for r in short.issues.collect() if r.check == "missing_fund"} == set("abcdez")


def test_a_span_is_taken_from_the_archive_without_a_shuffle(spark, folder, monkeypatch):
    """A replay reads its span's responses out of the archive once; no payload of the archive is shuffled for it."""
    frozen = []
    monkeypatch.setattr(replay, "freeze", lambda df: frozen.append(df) or session.freeze(df), raising=False)
    raw = session.freeze(cycles.cycle_responses(spark, folder))
    calendar = trading_calendar(spark, DAY.date(), DAY.date(), MarketHours())
    universe = cycles.cycle_universe(spark, folder)
    done, made = replay.replay(raw, cycles.cycle_runs(spark, folder), universe, MarketHours(), calendar, DAY.date(), DAY.date())
    assert [r.run_id for r in made.market.collect()] == ["600"]
    assert sorted((r.ins_code, r.filled) for r in done.ticks.collect()) == [("11", False), ("11", True), ("11", True)]
    (responses,) = frozen
    assert not any("payload" in line for line in below_exchanges(responses))
    assert {r.run_id for r in responses.collect()} == {"26", "300", "600"}
