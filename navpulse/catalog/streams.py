"""Streams over the event file, run until everything there is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from navpulse.catalog import ORACLES, proxies as px, query
from navpulse.catalog.validation import TICKS, expected_of
from navpulse.functions import flags as fl
from navpulse.plans.validate import COUNTERS
from navpulse.session import scratch_path
from navpulse.sources.sinks import end_of_day
from navpulse.streaming import pipeline


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = px.table(spark, folder, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return px.project_events(files.parquet(folder))


def tick_stream(spark: SparkSession, folder: str) -> DataFrame:
    return px.project_ticks(event_stream(spark, folder), "event_type")


def _validated(spark, d) -> pipeline.TickValidation:
    work = scratch_path(spark, "stream")
    job = pipeline.TickValidation(f"{work}/out", px.HOURS, px.feed_calendar(spark, d), expected_of)
    job.start(tick_stream(spark, d), f"{work}/checkpoint").awaitTermination()
    return job


@query("stream_validate", ORACLES["validate_counters"])
def stream_validate(spark, d):
    return _counters(_validated(spark, d).read(spark, "ticks"))


@query("stream_issues", ORACLES["gap_issues"])
def stream_issues(spark, d):
    issues = _validated(spark, d).read(spark, "issues")
    return issues.filter(F.col("check").isin("gap", "missing_fund")).select(
        "ins_code", "ts", "check", "action"
    )


@query("stream_eod", ORACLES["eod_rollup"])
def stream_eod(spark, d):
    work = scratch_path(spark, "stream")
    job = pipeline.DailyRollup(f"{work}/ticks", f"{work}/eod")
    job.start(tick_stream(spark, d), f"{work}/checkpoint").awaitTermination()
    columns = end_of_day(px.raw_ticks(spark, d, "event_type")).columns
    return spark.read.parquet(f"{work}/eod").select(*columns)


@query("stream_error_ratio", ORACLES["error_ratio_sliding"])
def stream_error_ratio(spark, d):
    work = scratch_path(spark, "stream")
    raw = event_stream(spark, d).selectExpr(
        "at AS fetched_at", "CASE WHEN k % 20 = 0 THEN 500 ELSE 200 END AS status_code"
    )
    job = pipeline.SlidingRatio(f"{work}/out", "fetched_at", F.col("status_code") != 200)
    job.start(raw, f"{work}/checkpoint").awaitTermination()
    return job.read(spark)


def _in_parts(spark, d, part: Column, parts: int, run: Callable[[DataFrame, str, int], None]) -> None:
    """The event feed as a growing folder: ``run`` gets the tick stream over it after each part came."""
    work = scratch_path(spark, "stream")
    events = px.table(spark, d, "events")
    for n in range(parts):  # a run reads what came since the one before, in as many files as it has
        rows = events.withColumn("_n", part).filter(F.col("_n") == n).drop("_n")
        rows.write.mode("append").parquet(f"{work}/in/part={n}")
        files = spark.readStream.schema(events.schema).parquet(f"{work}/in/part=*")
        run(px.project_ticks(px.project_events(files), "event_type"), work, n)


def _job(spark, d, work: str, **given) -> pipeline.TickValidation:
    return pipeline.TickValidation(f"{work}/out", px.HOURS, px.feed_calendar(spark, d), expected_of, **given)


def _counters(ticks: DataFrame) -> DataFrame:
    return ticks.filter(~F.col("filled")).select(
        "ins_code", "ts", *COUNTERS,
        fl.has_flag("quality_flags", fl.CUMULATIVE_DECREASE).alias("flagged"),
    )


def _late_parts() -> Column:
    """Three parts in time order, cut in the middle of an hour, and some hours of all days last."""
    share = F.pmod(F.xxhash64(F.date_trunc("hour", "ts")), F.lit(50))
    day = F.lit("2024-01-01").cast("timestamp")
    place = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(day) - 45_300) / 864_000).cast("int")
    return F.when(share == 0, 3).otherwise(F.greatest(F.lit(0), F.least(F.lit(2), place)))


@query("stream_late_rows", ORACLES["validate_counters"])
def stream_late_rows(spark, d):
    """The same feed in four micro-batches of whole minutes; some hours of all days come last.

    State is handed on, and the late rows have the days they touch validated anew.
    """
    share = F.pmod(F.xxhash64(F.date_trunc("hour", "ts")), F.lit(50))
    third = F.least(F.lit(2), F.floor((F.dayofyear("ts") - 1) / 10).cast("int"))
    jobs = []

    def run(stream: DataFrame, work: str, n: int) -> None:
        jobs.append(_job(spark, d, work))
        jobs[-1].start(stream, f"{work}/checkpoint").awaitTermination()

    _in_parts(spark, d, F.when(share == 0, 3).otherwise(third), 4, run)
    return _counters(jobs[-1].read(spark, "ticks"))


@query(
    "stream_feed_issues",
    f"""
WITH {TICKS},
c AS (SELECT ts, CAST(ts AS DATE) AS day, max(hour(ts) * 10000 + (minute(ts) // 10) * 1000) AS heven FROM ev GROUP BY ts),
j AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts)
    - row_number() OVER (PARTITION BY day, heven ORDER BY ts) AS island FROM c WHERE heven > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY day, heven, island ORDER BY ts) AS nth FROM j)
SELECT ts, '' AS ins_code, 'error' AS severity, 'flagged' AS action,
  'market watch unchanged for 3 cycles (hEven=' || heven || ')' AS detail
FROM n WHERE nth = 4""",
)
def stream_feed_issues(spark, d):
    """Spells of an unchanged feed time that cross micro-batches, or get late rows, are logged once."""
    jobs = []

    def run(stream: DataFrame, work: str, n: int) -> None:
        jobs.append(_job(spark, d, work))
        jobs[-1].start(stream, f"{work}/checkpoint").awaitTermination()

    _in_parts(spark, d, _late_parts(), 4, run)
    issues = jobs[-1].read(spark, "issues").filter(F.col("check") == "feed_stale")
    return issues.select("ts", "ins_code", "severity", "action", "detail")


@query("stream_faults", ORACLES["validate_counters"])
def stream_faults(spark, d):
    """The job dies before each of the writes of its last micro-batch, and is started again each time.

    The rows are those of a run without faults.
    """
    jobs = []

    def run(stream: DataFrame, work: str, n: int) -> None:
        for dies_at in pipeline.TickValidation.WRITES if n == 1 else ():

            def die(table: str, batch: int, at: str = dies_at) -> None:
                if table == at:
                    raise RuntimeError(f"fault before {table}")

            broken = _job(spark, d, work, on_write=die).start(stream, f"{work}/checkpoint")
            try:
                broken.awaitTermination()
            except StreamingQueryException:
                continue
            raise AssertionError(f"no fault before {dies_at}")
        jobs.append(_job(spark, d, work))
        jobs[-1].start(stream, f"{work}/checkpoint").awaitTermination()

    last = F.to_date("ts") >= F.lit("2024-01-29").cast("date")
    _in_parts(spark, d, last.cast("int"), 2, run)
    return _counters(jobs[-1].read(spark, "ticks"))


@query("stream_announced", f"WITH {TICKS} SELECT day AS trade_date, ts, count(*) AS funds FROM ticks GROUP BY 1, 2")
def stream_announced(spark, d):
    """The commit log: each cycle with the number of its funds."""
    return _validated(spark, d).read(spark, "announced").select("trade_date", "ts", "funds")


@query("stream_chained", ORACLES["validate_counters"])
def stream_chained(spark, d):
    """Two streams in a row: the second one takes what the first announces, part by part, late days included."""
    tables = []

    def run(stream: DataFrame, work: str, n: int) -> None:
        first = _job(spark, d, work)
        first.start(stream, f"{work}/checkpoint").awaitTermination()
        second = pipeline.ValidatedDays(first, f"{work}/days")
        second.start(f"{work}/checkpoint-days", spark).awaitTermination()
        tables.append(f"{work}/days")

    _in_parts(spark, d, _late_parts(), 4, run)
    return _counters(spark.read.parquet(tables[-1]))
