"""Streams over the archive and the tick feed.

A micro-batch goes through the batch code. What one micro-batch has to tell the next (the
last row of each fund of the open day and the conditions that are active) is a small table
in the shared folder, one version per micro-batch; each version is written under the
micro-batch's own number, so a repeated micro-batch reads the same state and replaces its
own output. Late rows have their days computed anew from what is stored. Nothing depends on
one executor, and stream and batch give the same rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from navpulse import schemas
from navpulse.operators.latest import latest_version
from navpulse.plans.ops import ratio_of_counts, step_counts
from navpulse.plans.validate import validate
from navpulse.session import folder_exists, folder_names, freeze, move_folder
from navpulse.settings import MarketHours, ValidationLimits
from navpulse.sources import sinks

MINUTE_TRIGGER = {"processingTime": "1 minute"}
CATCH_UP = {"availableNow": True}


def raw_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """The archive folder as a stream of responses."""
    reader = spark.readStream.schema(schemas.RAW_RESPONSES).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def archive_first(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict = CATCH_UP
) -> StreamingQuery:
    """Append every response as it came, before anything reads it."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(path)
    )


def _put(df: DataFrame, path: str) -> None:
    """Replace the output of this micro-batch only."""
    df.write.mode("overwrite").parquet(path)


def _put_days(df: DataFrame, table: str, batch: int) -> None:
    """This micro-batch's rows below the days they belong to, so that a day is read without the others."""
    own = df.withColumn("batch", F.lit(batch).cast("long"))
    writer = own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("trade_date", "batch").parquet(table)


def _read_days(spark: SparkSession, table: str, days: list[dt.date], upto: int) -> DataFrame:
    """Stored rows of some days, of micro-batches up to ``upto``; no other day's folder is listed."""
    known = folder_names(spark, table)
    found = [f"{table}/{name}" for name in (f"trade_date={d}" for d in days) if name in known]
    rows = spark.read.option("basePath", table).parquet(*found)
    return rows.filter(F.col("batch") <= upto).withColumn("trade_date", F.col("trade_date").cast("date"))


def _days_of(rows: DataFrame) -> list[dt.date]:
    return sorted(r[0] for r in rows.select("trade_date").distinct().collect())  # one row per date


class TickValidation:
    """Validates micro-batches of a tick feed (tick columns, band, feed_heven).

    A micro-batch holds whole cycles. Rows that come in time order are checked against the
    state of the open day; a micro-batch with rows of an earlier cycle or day, however
    late, has the days they touch validated anew from the stored feed. Output folders below
    ``out``: ``feed``, ``ticks`` and ``issues`` by day and micro-batch; ``rebuilt`` (days
    validated anew), ``state`` (the open day's funds, and the feed's own) and ``announced``
    with one ``batch=N`` folder per micro-batch.

    A micro-batch that fails between two writes is repeated: it replaces what it wrote. Only
    ``announced``, written last, is a commit log: its folder appears by one rename, when all
    rows it tells of can be read, and a repeated micro-batch leaves it as it is, so that
    another stream may take it as its source. ``on_write`` is told of each write before it begins.
    """

    WRITES = ("feed", "ticks", "issues", "rebuilt", "state", "announced")

    def __init__(
        self,
        out: str,
        hours: MarketHours,
        calendar: DataFrame,
        expected: Callable[[DataFrame], DataFrame],
        limits: ValidationLimits = ValidationLimits(),
        on_write: Callable[[str, int], None] = lambda table, batch: None,
    ) -> None:
        self.out = out.rstrip("/")
        self.on_write = on_write
        self.hours = hours
        self.calendar = calendar
        self.expected = expected
        self.limits = limits

    def folder(self, table: str, batch: int) -> str:
        return f"{self.out}/{table}/batch={batch}"

    def _put(self, df: DataFrame, table: str, batch: int) -> None:
        self.on_write(table, batch)
        _put(df, self.folder(table, batch))

    def _put_days(self, df: DataFrame, table: str, batch: int) -> None:
        self.on_write(table, batch)
        _put_days(df, f"{self.out}/{table}", batch)

    def _announce(self, cycles: DataFrame, batch: int) -> None:
        self.on_write("announced", batch)
        spark, place = cycles.sparkSession, self.folder("announced", batch)
        if not folder_exists(spark, place):
            _put(cycles, self.folder("announcing", batch))
            move_folder(spark, self.folder("announcing", batch), place)

    def _check(self, feed: DataFrame, state: DataFrame | None):
        return validate(feed, self.expected(feed), self.hours, self.calendar, self.limits, state, store=True)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        feed = freeze(sinks.with_trade_date(latest_version(rows, ["ins_code", "ts"], ["ingested_at"])))
        before = self.folder("state", batch - 1)
        state = None
        if batch > 0:
            if not folder_exists(spark, before):
                raise RuntimeError(f"state of micro-batch {batch - 1} is missing below {self.out}")
            state = spark.read.parquet(before)
        self._put_days(feed, "feed", batch)

        open_day, seen = (None, None)
        if state is not None:
            open_day, seen = state.agg(F.max("day"), F.max(F.unix_micros("_seen_ts"))).first()
        # In order: after all that was seen of the open day, or on a newer day.
        newer = F.lit(open_day is None) if open_day is None else (
            (F.col("trade_date") > F.lit(open_day)) | ((F.col("trade_date") == F.lit(open_day)) & (F.unix_micros("ts") > F.lit(seen)))
        )
        touched = feed.groupBy("trade_date").agg(F.bool_and(newer).alias("ordered")).collect()  # one row per date
        late = sorted(r["trade_date"] for r in touched if not r["ordered"])
        ordered = sorted(r["trade_date"] for r in touched if r["ordered"])

        none = spark.createDataFrame([], "trade_date date")
        if not touched:  # a micro-batch without rows hands on what it was given
            empty = state if state is not None else self._check(feed.drop("trade_date"), None).state
            self._put(none, "rebuilt", batch)
            self._put(empty, "state", batch)
            return
        states = []
        parts = []
        if ordered:
            own = None if state is None else state.filter(F.col("day").isin(ordered))
            parts.append(self._check(feed.filter(F.col("trade_date").isin(ordered)).drop("trade_date"), own))
        if late:
            stored = _read_days(spark, f"{self.out}/feed", late, batch).drop("batch", "trade_date")
            parts.append(self._check(latest_version(stored, ["ins_code", "ts"], ["ingested_at"]), None))
        for done in parts:
            states.append(done.state)
        ticks = reduce(DataFrame.unionByName, [d.ticks for d in parts])
        issues = reduce(DataFrame.unionByName, [d.issues for d in parts])
        self._put_days(sinks.with_trade_date(ticks), "ticks", batch)
        self._put_days(sinks.with_trade_date(issues), "issues", batch)
        anew = spark.createDataFrame([(d,) for d in late], none.schema)
        self._put(anew, "rebuilt", batch)
        # Only the open day can go on; a row of any other day is a late one.
        newest = max(x for x in (open_day, *ordered, *late) if x is not None)
        if state is not None and newest not in (*ordered, *late):
            states.append(state)
        after = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), states)
        self._put(after.filter(F.col("day") == F.lit(newest)), "state", batch)
        cycles = feed.groupBy("trade_date", "ts").agg(
            F.max("run_id").alias("run_id"), F.count("*").alias("funds")
        )
        self._announce(cycles, batch)

    def start(
        self, feed: DataFrame, checkpoint: str, trigger: dict = CATCH_UP
    ) -> StreamingQuery:
        return (
            feed.writeStream.foreachBatch(self)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )

    def read(self, spark: SparkSession, table: str, days: list[dt.date] | None = None) -> DataFrame:
        """Rows of ``ticks`` or ``issues`` that hold: of a day validated anew, those since then.

        Of ``announced``, the newest row of each cycle. With ``days``, no other day is read.
        """
        rows = spark.read.parquet(f"{self.out}/{table}")
        rows = rows.withColumn("trade_date", F.col("trade_date").cast("date"))
        if days is not None:
            rows = rows.filter(F.col("trade_date").isin(days))
        if table == "announced":
            return latest_version(rows, ["trade_date", "ts"], ["batch"]).drop("batch")
        anew = spark.read.parquet(f"{self.out}/rebuilt").groupBy("trade_date").agg(F.max("batch").alias("_since"))
        since = F.coalesce(F.col("_since"), F.lit(-1))
        return rows.join(anew, "trade_date", "left").filter(F.col("batch") >= since).drop("_since", "batch")

    def announcements(self, spark: SparkSession) -> DataFrame:
        """The commit log as a stream: a row for each announced cycle (trade_date, ts, run_id, funds)."""
        schema = "trade_date date, ts timestamp, run_id string, funds long"
        return spark.readStream.schema(schema).parquet(f"{self.out}/announced/batch=*")


class ValidatedDays:
    """A stream behind another: keeps a table of validated rows by day, fed by what is announced.

    Its source is the commit log of a :class:`TickValidation`; a micro-batch replaces the days of
    its cycles, so taking a cycle twice changes nothing. An announced cycle whose rows are
    not there is an error.
    """

    def __init__(self, upstream: TickValidation, target: str) -> None:
        self.upstream = upstream
        self.target = target

    def __call__(self, announced: DataFrame, batch: int) -> None:
        days = _days_of(announced)
        rows = freeze(self.upstream.read(announced.sparkSession, "ticks", days))
        told = announced.groupBy("trade_date", "ts").agg(F.max("funds").alias("funds"))
        found = rows.filter(~F.col("filled")).groupBy("trade_date", "ts").agg(F.count("*").alias("_found"))
        short = told.join(found, ["trade_date", "ts"], "left").filter(F.coalesce("_found", F.lit(0)) < F.col("funds"))
        first = short.first()
        if first is not None:
            raise RuntimeError(f"cycle {first['ts']} was announced with {first['funds']} funds, {first['_found'] or 0} are readable")
        sinks.replace_days(rows, self.target, sort=["ins_code", "ts"])

    def start(self, checkpoint: str, spark: SparkSession, trigger: dict = CATCH_UP) -> StreamingQuery:
        return (
            self.upstream.announcements(spark).writeStream.foreachBatch(self)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )


class DailyRollup:
    """Keeps the end-of-day roll-up: a micro-batch recomputes the days it touches, and reads no others."""

    def __init__(self, ticks: str, target: str) -> None:
        self.ticks = ticks
        self.target = target

    def __call__(self, rows: DataFrame, batch: int) -> None:
        dated = freeze(sinks.with_trade_date(rows))
        _put_days(dated, self.ticks, batch)
        stored = _read_days(rows.sparkSession, self.ticks, _days_of(dated), batch).drop("batch")
        sinks.replace_days(sinks.end_of_day(stored), self.target, sort=["ins_code"])

    def start(
        self, feed: DataFrame, checkpoint: str, trigger: dict = CATCH_UP
    ) -> StreamingQuery:
        return (
            feed.writeStream.foreachBatch(self)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )


class SlidingRatio:
    """Share of bad rows per moving window, for rows of any lateness.

    A micro-batch is counted per step and the counts are stored by day; windows that hold a
    touched step are computed anew from the stored counts, by the batch code. Output below
    ``out``: ``counts`` by day and micro-batch, ``windows`` by micro-batch.
    """

    def __init__(self, out: str, ts: str, bad: Column, width: str = "10 minutes", step: str = "1 minute") -> None:
        self.out, self.ts, self.bad, self.width, self.step = out.rstrip("/"), ts, bad, width, step

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        counts = freeze(sinks.with_trade_date(step_counts(rows, self.ts, self.bad, self.step), "at"))
        _put_days(counts, f"{self.out}/counts", batch)
        days = _days_of(counts)
        around = sorted({d + dt.timedelta(days=n) for d in days for n in (-1, 0, 1)})
        stored = _read_days(spark, f"{self.out}/counts", around, batch)
        windows = ratio_of_counts(stored, self.width, self.step)
        touched = counts.groupBy(F.window("at", self.width, self.step).alias("w")).count()
        touched = touched.select(F.col("w.start").alias("window_start"))
        _put(windows.join(touched, "window_start", "left_semi"), f"{self.out}/windows/batch={batch}")

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict = CATCH_UP) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest version of each window."""
        rows = spark.read.parquet(f"{self.out}/windows")
        return latest_version(rows, ["window_start"], ["batch"]).drop("batch")
