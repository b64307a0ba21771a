"""Daily data-quality report: cycles, completeness, flags and issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from navpulse.functions.flags import FLAGS, flag_kind, has_flag


def _by_day(df: DataFrame, ts: str) -> DataFrame:
    return df if "trade_date" in df.columns else df.withColumn("trade_date", F.to_date(ts))


def runs_report(runs: DataFrame) -> DataFrame:
    """Per day and status: cycles, rows received and expected."""
    return _by_day(runs, "tick").groupBy("trade_date", "status").agg(
        F.count("*").alias("n"),
        F.sum("received_funds").alias("received"),
        F.sum("expected_funds").alias("expected"),
    )


def completeness_report(runs: DataFrame) -> DataFrame:
    """Received over expected per day; 0.0 when nothing was expected."""
    received, expected = F.sum("received_funds"), F.sum("expected_funds")
    ratio = F.when(expected != 0, received / expected.cast("double")).otherwise(F.lit(0.0))
    return _by_day(runs, "tick").groupBy("trade_date").agg(ratio.alias("completeness"))


def flags_report(ticks: DataFrame) -> DataFrame:
    """Per day and flag: rows that carry it, their share, and how to take it.

    One pass with a counter per bit; the thirteen counters are then turned into rows.
    """
    counts = _by_day(ticks, "ts").groupBy("trade_date").agg(
        F.count("*").alias("ticks"),
        *[F.count_if(has_flag("quality_flags", bit)).alias(name) for name, bit, _ in FLAGS],
    )
    rows = counts.unpivot(
        ["trade_date", "ticks"], [name for name, _, _ in FLAGS], "flag", "n"
    ).filter(F.col("n") > 0)
    return rows.select(
        "trade_date", "ticks", "flag", "n",
        (F.col("n") / F.col("ticks").cast("double")).alias("share"),
        flag_kind("flag").alias("kind"),
    )


def issues_report(issues: DataFrame) -> DataFrame:
    return (
        _by_day(issues, "ts")
        .groupBy("trade_date", "check", "severity", "action")
        .agg(F.count("*").alias("n"))
    )


def top_issues(issues: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent issue kinds over the whole input."""
    kinds = issues.groupBy("check", "severity", "action").agg(F.count("*").alias("n"))
    return kinds.orderBy(F.col("n").desc(), "check", "severity", "action").limit(k)


def cycle_counters(ticks: DataFrame) -> DataFrame:
    """Rows filled and rows repaired per cycle, from validated ticks."""
    return ticks.groupBy("run_id").agg(
        F.count_if("filled").alias("filled"), F.count_if("repaired").alias("repaired")
    )
