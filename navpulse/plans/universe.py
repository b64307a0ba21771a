"""Which funds exist: classification from the market watch and the instrument details."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from navpulse.functions import text
from navpulse.operators.latest import latest_version


def fund_records(watch: DataFrame, info: DataFrame) -> DataFrame:
    """One record per primary fund instrument of a run, with type and units.

    ``watch`` and ``info`` are parsed payload rows; a fund whose details are missing or
    unreadable is classified by its name alone.
    """
    funds = latest_version(
        watch.filter(text.is_fund_unit("isin", "sector") & text.is_primary_board("isin")),
        ["run_id", "ins_code"], ["position"],
    ).select("run_id", "ins_code", "symbol", F.col("name").alias("_name"), "isin")
    details = latest_version(info, ["run_id", "ins_code"], ["position"]).select(
        "run_id", "ins_code", F.col("name").alias("_full"), "fund_desc", "units", "market", "board",
        F.lit(True).alias("_known"),
    )
    rows = funds.join(details, ["run_id", "ins_code"], "left")
    return rows.select(
        "run_id", "ins_code", "symbol",
        F.when(F.col("_known"), F.col("_full")).otherwise(F.col("_name")).alias("name"),
        "isin",
        text.classify_fund("fund_desc", "_name", "isin").alias("fund_type"),
        F.when(F.col("units") > 0, F.col("units")).alias("units"),
        F.coalesce("market", F.lit("")).alias("market"),
        F.coalesce("board", F.lit("")).alias("board"),
    )


def sync(records: DataFrame, known: DataFrame, updated_at: str, source: str = "provider") -> DataFrame:
    """New versions of the fund table: those seen, and those that vanished as inactive."""
    stamp = F.lit(updated_at).cast("timestamp")
    seen = records.select("ins_code", "symbol", "name", "isin", "fund_type", "market", "board")
    gone = known.join(seen.select("ins_code"), "ins_code", "left_anti").select(
        "ins_code", "symbol", "name", "isin", "fund_type",
        F.lit("").alias("market"), F.lit("").alias("board"),
    )
    both = seen.withColumn("is_active", F.lit(True)).unionByName(
        gone.withColumn("is_active", F.lit(False))
    )
    return both.withColumns(
        {
            "manager": F.lit(""),
            "custodian": F.lit(""),
            "source": F.lit(source),
            "updated_at": stamp,
        }
    )


def units_rows(records: DataFrame, day: str, updated_at: str) -> DataFrame:
    return records.filter(F.col("units").isNotNull()).select(
        "ins_code", F.lit(day).cast("date").alias("trade_date"), "units",
        F.lit(updated_at).cast("timestamp").alias("updated_at"),
    )


def report(synced: DataFrame) -> DataFrame:
    """One row: active and equity funds, the ones deactivated, and missing details."""
    return synced.agg(
        F.count_if("is_active").alias("funds"),
        F.count_if(F.col("is_active") & text.in_equity_family("fund_type")).alias("equity"),
        F.count_if(~F.col("is_active")).alias("deactivated"),
        F.count_if(F.col("is_active") & (F.col("market") == "")).alias("info_failures"),
    )


def type_distribution(records: DataFrame) -> DataFrame:
    return records.groupBy("fund_type").agg(F.count("*").alias("n"))
