"""Rebuild minutes that were not collected, and keep them only where they can be trusted.

A trade tape may hold any number of trades, but only its state at whole seconds is ever
asked for. So trades first collapse to one row per fund, day and second (map-side), and the
running totals are taken over those: at most 86,400 rows a group, however busy the fund.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from navpulse.functions import times
from navpulse.operators.asof import asof_lookup, number_block
from navpulse.operators.calendar import minute_grid
from navpulse.session import folder_names, freeze, move_folder
from navpulse.settings import BackfillLimits, MarketHours
from navpulse.sources import archive

KEY = ["ins_code", "day"]
HOUR_BLOCK = 3600
STATE = ["last_price", "volume", "value", "trade_count"]


@dataclass(frozen=True)
class Rebuilt:
    minutes: DataFrame  # rows to store
    log: DataFrame  # one decision per fund and day


def tape_from_trades(trades: DataFrame) -> DataFrame:
    """State after each second with a trade: last price and running totals.

    ``trades``: ins_code, day, n (sequence), heven, volume, price, canceled.
    """
    kept = trades.filter(F.col("canceled") == 0).withColumn(
        "sod", times.compact_time_seconds("heven")
    )
    seconds = kept.groupBy(*KEY, "sod").agg(
        F.max_by("price", "n").alias("last_price"),
        F.sum("volume").alias("_volume"),
        F.sum(F.col("volume") * F.col("price")).alias("_value"),
        F.count("*").alias("_trades"),
    )
    upto = W.partitionBy(*KEY).orderBy("sod").rowsBetween(W.unboundedPreceding, W.currentRow)
    return seconds.select(
        *KEY, "sod", "last_price",
        F.sum("_volume").over(upto).alias("volume"),
        F.sum("_value").over(upto).alias("value"),
        F.sum("_trades").over(upto).alias("trade_count"),
    )


def tape_from_events(events: DataFrame) -> DataFrame:
    """The same from price events of a past day, whose figures are running totals already.

    Of several events in one second, the last one in the payload counts.
    """
    return (
        events.withColumn("sod", times.compact_time_seconds("heven"))
        .groupBy(*KEY, "sod")
        .agg(F.max_by(F.struct(*STATE), "position").alias("_s"))
        .select(*KEY, "sod", "_s.*")
    )


def state_at(probes: DataFrame, tape: DataFrame) -> DataFrame:
    """Tape state after every trade at or before the probe's second; null before the first.

    ``probes`` has one row per fund, day and second.
    """
    facts = tape.withColumnRenamed("sod", "_s")
    return asof_lookup(
        probes, facts, KEY, "sod", "_s", STATE, number_block(HOUR_BLOCK), distinct_probes=True
    )


def verify_live(live: DataFrame, tape: DataFrame, limits: BackfillLimits) -> DataFrame:
    """Per fund and day: live minutes compared and matched.

    A live row stamped s was fetched within the next minute and the feed may lag, so its
    volume must lie between the tape's a minute before and a minute after. ``live`` has
    ins_code, day, sod, volume.
    """
    minute = times.MINUTE
    probes = live.select(*KEY, "sod").distinct()
    both = probes.select(*KEY, F.explode(F.array(F.col("sod") - minute, F.col("sod") + minute)).alias("sod"))
    found = state_at(both.distinct(), tape).select(*KEY, "sod", F.col("volume").alias("_v"))
    zero = F.lit(0).cast("long")
    low = found.select(*KEY, (F.col("sod") + minute).alias("sod"), F.coalesce("_v", zero).alias("_lo"))
    high = found.select(*KEY, (F.col("sod") - minute).alias("sod"), F.coalesce("_v", zero).alias("_hi"))
    rows = live.join(low, [*KEY, "sod"]).join(high, [*KEY, "sod"])
    fits = F.col("volume").between(
        F.col("_lo") * (1 - limits.tolerance) - 1, F.col("_hi") * (1 + limits.tolerance) + 1
    )
    return rows.groupBy(*KEY).agg(
        F.count("*").alias("overlap"),
        F.count_if(fits).alias("matched"),
        F.min("sod").alias("first_live"),
    )


def needs_backfill(live: DataFrame, hours: MarketHours) -> DataFrame:
    """Fund-days whose first live row comes more than a minute after the open."""
    first = live.groupBy(*KEY).agg(F.min("sod").alias("first_live"))
    return first.filter(F.col("first_live") > hours.open_second + times.MINUTE)


def _tape_bounds(tape: DataFrame) -> DataFrame:
    return tape.groupBy(*KEY).agg(
        F.min("sod").alias("_tape_first"), F.max_by(F.struct(*STATE), "sod").alias("_tape_last")
    )


def _log(df: DataFrame, status: Column, note: Column, recorded_at: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    judged = F.col("status").isin("stored", "rejected")
    return df.withColumns({"status": status, "note": note}).select(
        "day", "ins_code", "status",
        F.when(judged, F.coalesce("overlap", zero)).otherwise(zero).alias("overlap"),
        F.when(judged, F.coalesce("matched", zero)).otherwise(zero).alias("matched"),
        F.when(F.col("status") == "stored", F.coalesce("_minutes", zero)).otherwise(zero)
        .alias("minutes"),
        "note",
        F.lit(recorded_at).cast("timestamp").alias("recorded_at"),
    )


def _rows(minutes: DataFrame, recorded_at: str) -> DataFrame:
    return minutes.select(
        "ts", "ins_code", *STATE, F.lit(recorded_at).cast("timestamp").alias("ingested_at")
    )


def backfill_intraday(
    trades: DataFrame,
    live: DataFrame,
    done: DataFrame,
    hours: MarketHours,
    recorded_at: str,
    limits: BackfillLimits = BackfillLimits(),
    failed: DataFrame | None = None,
) -> Rebuilt:
    """Rebuild the minutes from the open to a fund's first live row.

    ``live``: ins_code, day, sod, volume of collected rows. ``done``: (day, ins_code) already
    decided. ``failed``: (ins_code, day, error) of responses that could not be read.
    """
    todo = freeze(needs_backfill(live, hours).join(done, KEY, "left_anti"))
    # The trades are read once; what follows needs the tape (one row per second) three times.
    tape = freeze(tape_from_trades(trades.join(todo, KEY, "left_semi")))
    verdict = verify_live(live.join(todo, KEY, "left_semi"), tape, limits)
    passes = (F.col("overlap") > 0) & (F.col("matched") >= limits.min_match * F.col("overlap"))
    errors = _errors_or_none(failed, todo)
    judged = freeze(
        todo.join(verdict.drop("first_live"), KEY, "left")
        .join(_tape_bounds(tape), KEY, "left")
        .join(errors, KEY, "left")
        .withColumns(
            {
                "_traded": F.col("_tape_first").isNotNull(),
                "_passes": F.coalesce(passes, F.lit(False)),
            }
        )
    )
    good = judged.filter(
        F.col("_error").isNull() & F.col("_traded") & F.col("_passes")
    ).select(*KEY, "first_live")
    whole = F.col("first_live") - F.col("first_live") % times.MINUTE
    grid = minute_grid(good, "day", hours.open_second, whole - times.MINUTE).drop("first_live")
    minutes = state_at(grid, tape).filter(F.col("last_price").isNotNull())
    counts = minutes.groupBy(*KEY).agg(F.count("*").alias("_minutes"))
    status = (
        F.when(F.col("_error").isNotNull(), "error")
        .when(~F.col("_traded"), "no_trades")
        .when(F.col("_passes"), "stored")
        .otherwise("rejected")
    )
    first = F.col("_tape_first")
    note = (
        F.when(F.col("status") == "error", F.col("_error"))
        .when(
            F.col("status") == "rejected",
            F.format_string(
                "first trade %02d:%02d",
                F.floor(first / 3600), F.floor(first % 3600 / times.MINUTE),
            ),
        )
        .otherwise("")
    )
    log = judged.join(counts, KEY, "left").withColumn("status", status)
    return Rebuilt(_rows(minutes, recorded_at), _log(log, F.col("status"), note, recorded_at))


def verify_official(tape: DataFrame, official: DataFrame, limits: BackfillLimits) -> DataFrame:
    """Do the tape's final totals agree with the official ones of the day?

    ``official``: ins_code, day, volume, value. Without trades or without an official row
    nothing is compared (overlap 0); an official volume of zero never agrees.
    """
    last = _tape_bounds(tape).select(*KEY, "_tape_last")
    totals = official.select(*KEY, F.col("volume").alias("_ov"), F.col("value").alias("_oval"))
    rows = last.join(totals, KEY, "left")
    tol = limits.tolerance
    volume_ok = (F.col("_ov") != 0) & (
        F.abs(F.col("_tape_last.volume") - F.col("_ov")) <= tol * F.col("_ov")
    )
    value_ok = F.abs(F.col("_tape_last.value") - F.col("_oval")) <= tol * F.greatest(
        F.col("_oval"), F.lit(1)
    )
    known = F.col("_ov").isNotNull()
    return rows.select(
        *KEY,
        known.cast("long").alias("overlap"),
        (known & volume_ok & value_ok).cast("long").alias("matched"),
    )


def backfill_sessions(
    events: DataFrame,
    targets: DataFrame,
    official: DataFrame,
    done: DataFrame,
    hours: MarketHours,
    recorded_at: str,
    limits: BackfillLimits = BackfillLimits(),
    failed: DataFrame | None = None,
) -> Rebuilt:
    """Rebuild whole past sessions from price events.

    ``targets``: (ins_code, day) wanted; see :func:`navpulse.operators.calendar.last_trading_days`.
    """
    todo = freeze(targets.select(*KEY).distinct().join(done, KEY, "left_anti"))
    tape = freeze(tape_from_events(events.join(todo, KEY, "left_semi")))
    verdict = verify_official(tape, official, limits)
    errors = _errors_or_none(failed, todo)
    judged = todo.join(verdict, KEY, "left").join(errors, KEY, "left")
    traded = F.col("overlap").isNotNull()
    passes = (F.col("overlap") > 0) & (F.col("matched") >= F.col("overlap"))
    status = (
        F.when(F.col("_error").isNotNull(), "error")
        .when(~traded, "no_trades")
        .when(passes, "stored")
        .otherwise("rejected")
    )
    judged = freeze(judged.withColumn("status", status))
    good = judged.filter(F.col("status") == "stored").select(*KEY)
    grid = minute_grid(good, "day", hours.open_second, hours.close_second)
    minutes = state_at(grid, tape).filter(F.col("last_price").isNotNull())
    counts = minutes.groupBy(*KEY).agg(F.count("*").alias("_minutes"))
    note = (
        F.when(F.col("status") == "error", F.col("_error"))
        .when(
            F.col("status") == "rejected",
            F.when(F.col("overlap") == 0, "no official daily row").otherwise(
                "mismatch vs official EOD"
            ),
        )
        .otherwise("")
    )
    log = judged.join(counts, KEY, "left")
    return Rebuilt(_rows(minutes, recorded_at), _log(log, F.col("status"), note, recorded_at))


def _errors_or_none(failed: DataFrame | None, like: DataFrame) -> DataFrame:
    if failed is None:
        return like.select(*KEY).limit(0).withColumn("_error", F.lit(None).cast("string"))
    return failed.groupBy(*KEY).agg(F.max("error").alias("_error"))


def report(log: DataFrame, funds: DataFrame | None = None) -> DataFrame:
    """Per day: funds with a gap, and how they were decided; rejected symbols by name."""
    rows = log
    if funds is not None:
        rows = log.join(funds.select("ins_code", "symbol"), "ins_code", "left")
    else:
        rows = log.withColumn("symbol", F.col("ins_code"))
    is_ = lambda s: F.col("status") == s
    return rows.groupBy("day").agg(
        F.count("*").alias("funds"),
        F.count_if(is_("stored")).alias("stored"),
        F.count_if(is_("rejected")).alias("rejected"),
        F.count_if(is_("error")).alias("errors"),
        F.sum("minutes").alias("minutes"),
        F.array_sort(F.collect_list(F.when(is_("rejected"), F.col("symbol")))).alias(
            "rejected_symbols"
        ),
    )


def stored(spark: SparkSession, table: str, part: str) -> DataFrame | None:
    """``minutes`` or ``log`` of all units of a backfill table, with the ``unit``; None before the first."""
    units = [name for name in folder_names(spark, table) if name.startswith("unit=")]
    if not units:
        return None
    return spark.read.option("basePath", table).parquet(*[f"{table}/{name}/{part}" for name in sorted(units)])


def resume(spark: SparkSession, table: str, rebuild: Callable[[DataFrame], Rebuilt]) -> int | None:
    """Decide what is still open and store it; the number of the new unit, None if nothing was open.

    ``rebuild`` gets the fund-days already decided (day, ins_code). Minutes and decisions of a
    run are one unit: they are written under a name that readers pass over, and appear
    together by one rename. A run that dies before it is done again from the start; one
    that dies after it finds its fund-days decided. Errors are tried again.
    """
    log = stored(spark, table, "log")
    none = spark.createDataFrame([], "day date, ins_code string")
    done = rebuild(none if log is None else archive.decided(log.drop("unit")))
    decisions = freeze(done.log)
    if decisions.isEmpty():
        return None
    units = [int(n.removeprefix("unit=")) for n in folder_names(spark, table) if n.startswith("unit=")]
    unit = max(units, default=-1) + 1
    decisions.write.mode("overwrite").parquet(f"{table}/_unit={unit}/log")
    done.minutes.write.mode("overwrite").parquet(f"{table}/_unit={unit}/minutes")
    move_folder(spark, f"{table}/_unit={unit}", f"{table}/unit={unit}")
    return unit
