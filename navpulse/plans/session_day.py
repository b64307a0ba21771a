"""What the collector decides in the course of a day: is there a session, and when is it closed.

Each rule looks at the day's earlier events only, so a decision is a running count or
maximum over the events in order, and an event keeps its size however long the day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from navpulse.functions import times
from navpulse.operators.calendar import require_calendar
from navpulse.operators.latest import latest_version
from navpulse.settings import MarketHours


def session_decisions(probes: DataFrame, calendar: DataFrame, hours: MarketHours) -> DataFrame:
    """The decision at each probe of the feed.

    ``probes``: probe (a number that orders probes of one instant), at, session_day (whose
    figures the feed showed), failed (it could not be asked). On a trading day: ``collect`` once
    the day itself was shown, or when the feed failed, so that the failure is seen;
    ``waiting`` before that; ``closed`` at the first answer after open and guard without it,
    and ``over`` from then on. On a listed holiday one probe counts, the first from open
    and guard to the close: ``opened`` if it shows the day, after which the day is
    collected; else ``holiday``, also if it failed. ``rest`` on other days.
    """
    second = times.second_of_day("at")
    rows = probes.withColumn("day", F.to_date("at")).join(
        F.broadcast(calendar.select("day", "trading", "source")), "day", "left"
    )
    rows = require_calendar(rows, "source", "day")
    upto = W.partitionBy("day").orderBy("at", "probe").rowsBetween(W.unboundedPreceding, W.currentRow)
    failed = F.coalesce("failed", F.lit(False))
    shown = ~failed & F.coalesce(F.col("session_day") == F.col("day"), F.lit(False))
    guarded = second >= hours.open_second + hours.guard_minutes * times.MINUTE
    rows = rows.withColumns(
        {
            "_shown": shown,
            "_failed": failed,
            "_confirmed": F.max(shown).over(upto),
            "_late": guarded,
            "_check": guarded & (second <= hours.close_second),
        }
    )
    shut = F.col("trading") & ~F.col("_confirmed") & F.col("_late") & ~F.col("_failed")
    rows = rows.withColumns({"_shut": shut, "_shuts": F.count_if(shut).over(upto), "_checks": F.count_if("_check").over(upto)})
    opened = F.col("_check") & (F.col("_checks") == 1) & F.col("_shown")
    rows = rows.withColumns({"_opened": opened, "_open": F.max(opened).over(upto)})
    on_trading = (
        F.when(F.col("_shut") & (F.col("_shuts") == 1), "closed")
        .when(F.col("_shuts") >= 1, "over")
        .when(F.col("_confirmed") | F.col("_failed"), "collect")
        .otherwise("waiting")
    )
    on_holiday = F.when(F.col("_opened"), "opened").when(F.col("_open"), "collect").otherwise("holiday")
    decision = F.when(F.col("trading"), on_trading).when(F.col("source").isin("official", "extra"), on_holiday).otherwise("rest")
    return rows.select("probe", "at", "day", decision.alias("decision"))


def observed_days(decisions: DataFrame, closure_note: str, open_note: str) -> DataFrame:
    """Rows for the observed calendar: at most one a day."""
    opened = F.col("decision") == "opened"
    return decisions.filter(F.col("decision").isin("closed", "opened")).select(
        "day", opened.alias("trading"), F.when(opened, open_note).otherwise(closure_note).alias("note"), F.col("at").alias("recorded_at")
    )


def closing_decisions(fetched: DataFrame, stored: DataFrame, calendar: DataFrame, hours: MarketHours) -> DataFrame:
    """For each cycle that might close a session: session, ts and the decision.

    ``fetched``: tick rows with ts (of the cycle), session (the last one at that time) and
    refresh (fetched for the official figures). ``stored``: session, of those that have
    minutes. ``open`` while the market trades; ``no_trades`` if no fund has any;
    ``stored`` if the session has rows, from its minutes or an earlier snapshot, and this is
    no refresh; else ``committed``.
    """
    cycles = fetched.groupBy("session", "ts").agg(
        F.bool_or(F.coalesce(F.col("trade_count") > 0, F.lit(False))).alias("_traded"), F.bool_or("refresh").alias("_refresh")
    )
    days = calendar.select(F.col("day").alias("_day"), F.col("trading").alias("_trading"))
    known = cycles.withColumn("_day", F.to_date("ts")).join(F.broadcast(days), "_day", "left")
    known = require_calendar(known, "_trading", "_day")
    known = known.join(stored.select("session", F.lit(True).alias("_stored")).distinct(), "session", "left")
    is_open = F.col("_trading") & times.second_of_day("ts").between(hours.open_second, hours.close_second)
    upto = W.partitionBy("session").orderBy("ts").rowsBetween(W.unboundedPreceding, W.currentRow)
    could = ~is_open & F.col("_traded")
    known = known.withColumns({"_is_open": is_open, "_nth": F.count_if(could).over(upto)})
    has_rows = F.coalesce("_stored", F.lit(False)) | (F.col("_nth") > F.when(F.col("_traded"), 1).otherwise(0))
    decision = (
        F.when(F.col("_is_open"), "open")
        .when(~F.col("_refresh") & has_rows, "stored")
        .when(~F.col("_traded"), "no_trades")
        .otherwise("committed")
    )
    return known.select("session", "ts", decision.alias("decision"))


def closing_rows(fetched: DataFrame, decisions: DataFrame, hours: MarketHours) -> DataFrame:
    """Rows of the committed cycles stamped at the close of their session, newest version each.

    Official figures fetched later carry the same stamp and replace the first ones.
    """
    kept = decisions.filter(F.col("decision") == "committed").select("session", "ts")
    rows = fetched.join(kept, ["session", "ts"]).withColumn("ingested_at", F.col("ts"))
    stamped = rows.withColumn("ts", times.session_close(F.col("session"), hours)).drop("session", "refresh")
    return latest_version(stamped, ["ins_code", "ts"], ["ingested_at"])
