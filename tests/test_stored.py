"""Published versions, backfill units and interpolation over crowded points."""

from __future__ import annotations

import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from navpulse.plans import backfill, sampling
from navpulse.sources import sinks


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = spark.createDataFrame([(dt.date(2026, 9, d), d) for d in range(1, 11)], "day date, x int")
    with pytest.raises(RuntimeError, match="nothing is published"):
        sinks.read_current(spark, table)
    assert sinks.publish(rows, table, ["day"]) == 0

    def die(version):
        raise OSError("gone")

    for _ in range(2):
        with pytest.raises(OSError):
            sinks.expire_published(spark, table, "day", 2, "2026-09-10", ["day"], die)
        assert sinks.read_current(spark, table).count() == 10
    reader = sinks.read_current(spark, table)
    assert sinks.expire_published(spark, table, "day", 4, "2026-09-10", ["day"]) == 1
    assert sorted(r.x for r in sinks.read_current(spark, table).collect()) == [6, 7, 8, 9, 10]
    assert reader.count() == 10  # one that began before the switch goes on
    assert sinks.expire_published(spark, table, "day", 1, "2026-09-10", ["day"]) == 2
    assert not (tmp_path / "t/v=0").exists() and (tmp_path / "t/v=1").exists()


def test_a_backfill_unit_is_stored_once(spark, tmp_path):
    day = dt.date(2026, 9, 26)
    wanted = spark.createDataFrame([(day, c) for c in "abc"], "day date, ins_code string")
    asked = []

    def rebuild(fails, stamp):
        def run(done):
            todo = wanted.join(done, ["day", "ins_code"], "left_anti")
            asked.append(sorted(r.ins_code for r in todo.collect()))
            status = F.when(F.col("ins_code").isin(*fails) if fails else F.lit(False), "error").otherwise("stored")
            log = todo.select("day", "ins_code", status.alias("status"), F.lit(stamp).cast("timestamp").alias("recorded_at"))
            return backfill.Rebuilt(log.filter("status = 'stored'").select("ins_code", F.lit(1).alias("volume")), log)

        return run

    table = str(tmp_path / "backfill")
    assert backfill.stored(spark, table, "log") is None
    assert backfill.resume(spark, table, rebuild(["b"], "2026-09-27 00:00:00")) == 0
    (tmp_path / "backfill/_unit=1/log").mkdir(parents=True)  # what a run left that died
    assert backfill.resume(spark, table, rebuild([], "2026-09-27 01:00:00")) == 1
    assert backfill.resume(spark, table, rebuild([], "2026-09-27 02:00:00")) is None
    assert asked == [["a", "b", "c"], ["b"], []]
    got = sorted((r.unit, r.ins_code) for r in backfill.stored(spark, table, "minutes").collect())
    assert got == [(0, "a"), (0, "c"), (1, "b")]


def line(points, x):
    points = sorted(points)
    if x is None or not points:
        return None
    i = bisect.bisect_left([p for p, _ in points], x)
    if i == 0:
        return points[0][1]
    if i == len(points):
        return points[-1][1]
    (x0, y0), (x1, y1) = points[i - 1], points[i]
    return y0 + (y1 - y0) / (x1 - x0) * (x - x0)


def test_interpolation_where_points_are_crowded(spark):
    """99 % of the points in a thousandth of the axis, a third of the rows at one x."""
    rnd = random.Random(6)
    xs = {round(rnd.random() / 1000, 9) for _ in range(3000)} | {round(rnd.random(), 6) for _ in range(30)}
    points = [(x, rnd.uniform(-5, 5)) for x in xs]
    at = [rnd.random() / 1000 for _ in range(20_000)] + [min(xs)] * 10_000 + [None, -1.0, 2.0] + list(xs)[:500]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(at)], "i int, q double")
    pts = spark.createDataFrame(points, "x double, y double")
    got = {r.i: r.y for r in sampling.interpolate(df, "q", pts, cells=32).collect()}
    assert len(got) == len(at)
    for i, v in enumerate(at):
        want = line(points, v)
        assert got[i] is None if want is None else got[i] == pytest.approx(want, abs=1e-9)
    cells = sampling.equal_cells(df, "q", sampling.segments(pts), 32).groupBy("_cell").count()
    sizes = sorted(r["count"] for r in cells.collect())
    assert len(sizes) >= 30 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_interpolation_with_few_points(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "q double")
    none = spark.createDataFrame([], "x double, y double")
    assert [r.y for r in sampling.interpolate(df, "q", none).collect()] == [None, None]
    one = spark.createDataFrame([(5.0, 7.0)], "x double, y double")
    assert {r.q: r.y for r in sampling.interpolate(df, "q", one).collect()} == {1.0: 7.0, None: None}
