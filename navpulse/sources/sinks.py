"""Writers. Tables are append-only with a version column, or replaced by partition.

Every partition column is stored (``trade_date``), because a filter on ``to_date(ts)``
alone does not prune; rows are sorted inside a file so that row-group statistics help.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from navpulse.operators.latest import last_known
from navpulse.session import folder_names, freeze, make_folder, move_folder, remove_folder


def append(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition).parquet(path)


def replace_days(
    df: DataFrame,
    path: str,
    day: str = "trade_date",
    sort: Sequence[str] = (),
    days: Sequence[dt.date] = (),
) -> None:
    """Replace the days present in ``df`` and, of ``days``, also those it has no rows for.

    A day that was asked for and has no rows any more loses its stored ones; all other days
    stay as they are. A job that dies in between is repeated as a whole.
    """
    spark = df.sparkSession
    spread = df.repartition(day, *sort[:1])  # a day is split by the leading sort key
    if sort:
        spread = spread.sortWithinPartitions(*sort)
    if days:
        spread = freeze(spread)  # written once, read for its days and again for the table
    (
        spread.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(day)
        .parquet(path)
    )
    if days:
        present = {r[0] for r in spread.select(day).distinct().collect()}  # one row per date
        for gone in sorted(set(days) - present):
            remove_folder(spark, f"{path}/{day}={gone}")


def with_trade_date(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("trade_date", F.to_date(ts))


def end_of_day(ticks: DataFrame) -> DataFrame:
    """Roll-up per fund and day: the last known value of each figure.

    Only newest values are taken, never sums, so repeated or carried rows cannot count
    twice. Nulls are skipped: the NAV is the last one known that day.
    """
    order = F.struct("ts", "ingested_at")
    return (
        with_trade_date(ticks)
        .groupBy("ins_code", "trade_date")
        .agg(
            F.max("ts").alias("last_ts"),
            last_known("close_price", order).alias("close_price"),
            last_known("value", order).alias("value"),
            last_known("nav_redemption", order).alias("nav_redemption"),
            last_known(F.col("ind_buy_value") - F.col("ind_sell_value"), order).alias(
                "ind_net_value"
            ),
        )
    )


def expire(
    spark: SparkSession, source: str, target: str, day: str, keep_days: int, today: str
) -> None:
    """Copy what is still within its retention to a new location (the caller swaps them)."""
    rows = spark.read.parquet(source)
    kept = rows.filter(F.col(day) >= F.date_sub(F.lit(today).cast("date"), keep_days))
    kept.write.mode("errorifexists").partitionBy(day).parquet(target)


def current_version(spark: SparkSession, table: str) -> int | None:
    """Number of the published version of a table, None before the first."""
    return max((int(name) for name in folder_names(spark, f"{table}/_current")), default=None)


def read_current(spark: SparkSession, table: str) -> DataFrame:
    """The published version; one that is being written is not seen."""
    version = current_version(spark, table)
    if version is None:
        raise RuntimeError(f"nothing is published in {table}")
    return spark.read.parquet(f"{table}/v={version}")


def publish(
    df: DataFrame, table: str, partition: Sequence[str] = (), before_switch: Callable[[int], None] = lambda version: None
) -> int:
    """Write a whole new version and make it the current one by a single rename.

    A table has one writer. What a failed attempt left under the number is written over. The
    version before stays for readers that are still scanning it; older ones go.
    """
    spark = df.sparkSession
    now = current_version(spark, table)
    version = 0 if now is None else now + 1
    df.write.mode("overwrite").partitionBy(*partition).parquet(f"{table}/v={version}")
    before_switch(version)
    make_folder(spark, f"{table}/_next/{version}")
    move_folder(spark, f"{table}/_next/{version}", f"{table}/_current/{version}")
    for name in folder_names(spark, table):
        if name.startswith("v=") and int(name[2:]) < version - 1:
            remove_folder(spark, f"{table}/{name}")
    return version


def expire_published(
    spark: SparkSession, table: str, day: str, keep_days: int, today: str, partition: Sequence[str] = (),
    before_switch: Callable[[int], None] = lambda version: None,
) -> int:
    """Publish a version with the days that are still within their retention; ``day`` may be a partition column or not."""
    kept = read_current(spark, table).filter(F.col(day) >= F.date_sub(F.lit(today).cast("date"), keep_days))
    return publish(kept, table, partition, before_switch)
