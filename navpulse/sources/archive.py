"""Readers of stored tables and of the raw archive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from navpulse import schemas
from navpulse.operators.latest import latest_version


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The raw archive from parquet or JSON lines, with its declared schema."""
    return spark.read.schema(schemas.RAW_RESPONSES).format(fmt).load(path)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, table: str | None = None
) -> DataFrame:
    """A stored table; with its name, the newest version of each key only."""
    rows = spark.read.schema(schema).parquet(path)
    if table is None:
        return rows
    keys, version = schemas.LATEST_WINS[table]
    return latest_version(rows, keys, version)


def raw_of_days(
    raw: DataFrame, runs: DataFrame, first: dt.date | None = None, last: dt.date | None = None, few: bool = False
) -> DataFrame:
    """Archived responses of the runs whose tick falls in the span, with the tick.

    ``few`` says that the span is short against the archive: its run ids go to all tasks, and
    the payloads of other runs are not shuffled.
    """
    ticks = runs.select("run_id", "tick").filter(F.col("tick").isNotNull())
    if first is not None:
        ticks = ticks.filter(F.col("tick") >= F.lit(first).cast("timestamp"))
    if last is not None:
        ticks = ticks.filter(F.col("tick") < F.date_add(F.lit(last), 1).cast("timestamp"))
    return raw.join(F.broadcast(ticks) if few else ticks, "run_id")


def active_funds(
    funds: DataFrame, units: DataFrame, synced_on: dt.date | None = None
) -> DataFrame:
    """Active funds (newest version) with their newest unit count; zero units is none."""
    newest = latest_version(funds, *schemas.LATEST_WINS["funds"])
    counted = latest_version(units, *schemas.LATEST_WINS["fund_units"])
    per_fund = counted.groupBy("ins_code").agg(
        F.max_by("units", F.when(F.col("units").isNotNull(), F.col("trade_date"))).alias("units")
    )
    out = newest.filter("is_active")
    if synced_on is not None:
        out = out.filter(F.to_date("updated_at") == F.lit(synced_on))
    return out.join(per_fund, "ins_code", "left").withColumn("units", F.nullif("units", F.lit(0)))


def universe_of_day(funds: DataFrame, units: DataFrame, day: dt.date) -> DataFrame:
    """Equity funds synced on the day; the last known active list when none was synced."""
    known = active_funds(funds, units).withColumn(
        "_today", F.coalesce(F.to_date("updated_at") == F.lit(day), F.lit(False))
    )
    # One row: true when anything was synced today. Equality picks the right half.
    wanted = known.agg(F.coalesce(F.bool_or("_today"), F.lit(False)).alias("_today"))
    chosen = known.join(F.broadcast(wanted), "_today")
    return chosen.filter(F.col("fund_type").isin("equity", "index", "sector", "leveraged")).drop("_today")


def live_volumes(ticks: DataFrame) -> DataFrame:
    """Collected volumes, without rows that were only carried forward."""
    from navpulse.functions.flags import FORWARD_FILLED, has_flag

    newest = latest_version(
        ticks.select("ins_code", "ts", "volume", "quality_flags", "ingested_at"),
        *schemas.LATEST_WINS["fund_ticks"],
    )
    return newest.filter(~has_flag("quality_flags", FORWARD_FILLED)).select(
        "ins_code", "ts", "volume"
    )


def official_totals(history: DataFrame) -> DataFrame:
    newest = latest_version(
        history.select("ins_code", "trade_date", "volume", "value", "trade_count", "updated_at"),
        *schemas.LATEST_WINS["fund_history"],
    )
    return newest.drop("updated_at")


def decided(log: DataFrame) -> DataFrame:
    """(day, ins_code) already decided; errors are left out so that they are tried again."""
    newest = latest_version(log, *schemas.LATEST_WINS["rebuild_log"])
    return newest.filter(F.col("status") != "error").select("day", "ins_code")


def history_window(
    latest: dt.date | None, session: dt.date, full: int = 400, usual: int = 10
) -> int:
    """Trading days to request: everything at first, later the gap but never less than usual."""
    if latest is None:
        return full
    if latest >= session:
        return 0
    return min(full, max(usual, (session - latest).days + 5))


def history_windows(history: DataFrame, funds: DataFrame, session: dt.date, full: int = 400, usual: int = 10) -> DataFrame:
    """:func:`history_window` of every fund, from the newest date its history has."""
    newest = history.groupBy("ins_code").agg(F.max("trade_date").alias("latest"))
    gap = F.datediff(F.lit(session), "latest") + 5
    days = F.when(F.col("latest").isNull(), full).when(F.col("latest") >= F.lit(session), 0)
    days = days.otherwise(F.least(F.lit(full), F.greatest(F.lit(usual), gap)))
    return funds.select("ins_code").join(newest, "ins_code", "left").withColumn("days", days)
