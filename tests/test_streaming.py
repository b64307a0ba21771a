from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from navpulse.plans.ticks import expected_rows, universe_on_days
from navpulse.plans.validate import validate
from navpulse.sources import sinks
from navpulse.streaming import pipeline
from test_validate import DAY, HOURS, calendar, frame, random_days

CUTS = (0, 7, 19, 30)


def feed_files(spark, folder: Path):
    """The random days as files in time order, each with whole cycles."""
    rows, cycles, funds = random_days(21, funds=12)
    ends = [*CUTS[1:], len(cycles)]
    for n, (a, b) in enumerate(zip(CUTS, ends)):
        part = set(cycles[a:b])
        data = frame(spark, [r for r in rows if r["ts"] in part]).coalesce(1)
        data.write.mode("append").parquet(str(folder / f"part={n}"))
    return rows, cycles, funds


def expected_for(funds):
    def expected(feed):
        cycles = feed.groupBy("ts").agg(
            F.max("run_id").alias("run_id"), F.max("ingested_at").alias("ingested_at")
        ).withColumn("day", F.to_date("ts"))
        universe = feed.sparkSession.createDataFrame([(f,) for f in funds], "ins_code string")
        return expected_rows(cycles, universe_on_days(universe, cycles))

    return expected


def rows_of(df, columns):
    return sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect())


def test_stream_equals_batch(spark, tmp_path):
    rows, cycles, funds = feed_files(spark, tmp_path / "in")
    schema = frame(spark, rows[:1]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    job = pipeline.TickValidation(f"{tmp_path}/out", HOURS, calendar(spark), expected_for(funds))
    query = job.start(stream, f"{tmp_path}/checkpoint")
    query.awaitTermination()
    assert len(query.recentProgress) >= len(CUTS)

    feed = frame(spark, rows)
    batch = validate(feed, expected_for(funds)(feed), HOURS, calendar(spark), store=True)
    ticks = ["ins_code", "ts", "last_price", "volume", "nav_redemption", "quality_flags", "filled", "repaired"]
    assert rows_of(job.read(spark, "ticks"), ticks) == rows_of(batch.ticks, ticks)
    issues = ["ins_code", "ts", "check", "severity", "action"]
    assert rows_of(job.read(spark, "issues"), issues) == rows_of(batch.issues, issues)
    announced = job.read(spark, "announced")
    assert announced.count() == len(set(cycles))

    # A repeated micro-batch replaces its own output and nothing else.
    again = frame(spark, [r for r in rows if r["ts"] in set(cycles[CUTS[1]:CUTS[2]])])
    job(again, 1)
    assert rows_of(job.read(spark, "ticks"), ticks) == rows_of(batch.ticks, ticks)


def test_rollup_is_kept_up_to_date(spark, tmp_path):
    rows, _, _ = feed_files(spark, tmp_path / "in")
    schema = frame(spark, rows[:1]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    job = pipeline.DailyRollup(f"{tmp_path}/ticks", f"{tmp_path}/eod")
    job.start(stream, f"{tmp_path}/checkpoint").awaitTermination()
    want = sinks.end_of_day(frame(spark, rows))
    got = spark.read.parquet(f"{tmp_path}/eod")
    assert rows_of(got, want.columns) == rows_of(want, want.columns)
    assert {r.trade_date for r in got.select("trade_date").distinct().collect()} == {DAY, DAY + dt.timedelta(days=1)}


def test_archive_comes_first(spark, tmp_path):
    from navpulse import schemas

    raw = spark.createDataFrame(
        [(dt.datetime(2026, 9, 26), "r", "p", "etf", "1", 200, 1, 1, "not json")], schemas.RAW_RESPONSES
    )
    raw.write.parquet(f"{tmp_path}/in")
    stream = pipeline.raw_stream(spark, f"{tmp_path}/in", files_per_batch=1)
    pipeline.archive_first(stream, f"{tmp_path}/raw", f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/raw").first().payload == "not json"



def test_late_rows_have_their_day_validated_anew(spark, tmp_path):
    """Cycles in any order, over two days; and each key once."""
    rows, cycles, funds = random_days(33, funds=8)
    parts = [cycles[:6], cycles[9:15], cycles[20:], cycles[6:9] + cycles[15:20]]
    job = pipeline.TickValidation(f"{tmp_path}/out", HOURS, calendar(spark), expected_for(funds))
    parts.insert(2, [])  # a micro-batch without rows
    for n, part in enumerate(parts):
        job(frame(spark, [r for r in rows if r["ts"] in set(part)]), n)
    feed = frame(spark, rows)
    batch = validate(feed, expected_for(funds)(feed), HOURS, calendar(spark), store=True)
    ticks = ["ins_code", "ts", "last_price", "volume", "nav_redemption", "quality_flags", "filled", "repaired"]
    assert rows_of(job.read(spark, "ticks"), ticks) == rows_of(batch.ticks, ticks)
    issues = ["ins_code", "ts", "check", "severity", "action"]
    assert rows_of(job.read(spark, "issues"), issues) == rows_of(batch.issues, issues)
    # The state holds the open day only.
    state = spark.read.parquet(job.folder("state", len(parts) - 1))
    assert [r.day for r in state.select("day").distinct().collect()] == [max(c.date() for c in cycles)]


def test_a_missing_state_is_an_error(spark, tmp_path):
    rows, cycles, funds = random_days(34, funds=2)
    job = pipeline.TickValidation(f"{tmp_path}/out", HOURS, calendar(spark), expected_for(funds))
    with pytest.raises(RuntimeError, match="micro-batch 4"):
        job(frame(spark, rows), 5)


def test_windows_take_rows_of_any_lateness(spark, tmp_path):
    from navpulse.plans.ops import sliding_ratio

    at = lambda m: dt.datetime(2026, 9, 26, 23, 30) + dt.timedelta(minutes=m)
    rows = [(at(m), 500 if m % 3 == 0 else 200) for m in range(0, 90, 2)]
    schema = "fetched_at timestamp, status_code int"
    job = pipeline.SlidingRatio(f"{tmp_path}/out", "fetched_at", F.col("status_code") != 200)
    for n, part in enumerate((rows[10:20], rows[30:], rows[:10], rows[20:30])):
        job(spark.createDataFrame(part, schema), n)
    want = sliding_ratio(spark.createDataFrame(rows, schema), "fetched_at", F.col("status_code") != 200)
    assert rows_of(job.read(spark), want.columns) == rows_of(want, want.columns)


def test_late_row_parts_keep_their_files(spark, tmp_path, monkeypatch):
    from navpulse.catalog import streams
    from test_catalog import FOLDER

    if not Path(FOLDER).exists():
        pytest.skip("no test tables here")
    for file in Path(FOLDER).glob("*.parquet"):
        if file.name != "events.parquet":
            (tmp_path / file.name).symlink_to(file)
    spark.read.parquet(f"{FOLDER}/events.parquet").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(streams, "scratch_path", lambda *_: f"{tmp_path}/work")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        streams.stream_late_rows(spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {p.name for p in (tmp_path / "work/checkpoint/commits").iterdir() if p.name.isdigit()} == set("0123")
    for n in range(3):
        assert len(list((tmp_path / f"work/in/part={n}").glob("*.parquet"))) > 1


def test_faults_between_writes_and_a_stream_behind(spark, tmp_path):
    """Dies before each write in turn; announced cycles are there once, and complete, for the next stream."""
    rows, cycles, funds = feed_files(spark, tmp_path / "in")
    schema = frame(spark, rows[:1]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/part=*")
    left = list(pipeline.TickValidation.WRITES)

    def die(table, batch):
        if batch == 1 and left and table == left[0]:
            raise RuntimeError(f"fault before {left.pop(0)}")

    job = pipeline.TickValidation(f"{tmp_path}/out", HOURS, calendar(spark), expected_for(funds), on_write=die)
    behind = pipeline.ValidatedDays(job, f"{tmp_path}/days")
    faults = 0
    while True:
        query = job.start(stream, f"{tmp_path}/checkpoint")
        try:
            query.awaitTermination()
            break
        except StreamingQueryException:
            faults += 1
        if faults in (2, 6):  # the next stream goes on with what has been announced
            behind.start(f"{tmp_path}/checkpoint-days", spark).awaitTermination()
    assert faults == len(pipeline.TickValidation.WRITES)
    behind.start(f"{tmp_path}/checkpoint-days", spark).awaitTermination()

    feed = frame(spark, rows)
    batch = validate(feed, expected_for(funds)(feed), HOURS, calendar(spark), store=True)
    ticks = ["ins_code", "ts", "last_price", "volume", "nav_redemption", "quality_flags", "filled", "repaired"]
    assert rows_of(job.read(spark, "ticks"), ticks) == rows_of(batch.ticks, ticks)
    assert rows_of(spark.read.parquet(f"{tmp_path}/days"), ticks) == rows_of(batch.ticks, ticks)
    issues = ["ins_code", "ts", "check", "severity", "action", "detail"]
    assert rows_of(job.read(spark, "issues"), issues) == rows_of(batch.issues, issues)
    announced = spark.read.parquet(f"{tmp_path}/out/announced")
    assert announced.count() == announced.select("ts").distinct().count() == len(set(cycles))


def test_an_announced_cycle_without_rows_is_an_error(spark, tmp_path):
    rows, cycles, funds = random_days(35, funds=2)
    job = pipeline.TickValidation(f"{tmp_path}/out", HOURS, calendar(spark), expected_for(funds))
    job(frame(spark, rows), 0)
    told = job.read(spark, "announced").withColumn("funds", F.col("funds") + 1)
    with pytest.raises(RuntimeError, match="was announced"):
        pipeline.ValidatedDays(job, f"{tmp_path}/days")(told, 0)
