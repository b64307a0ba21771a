"""Health of the pipeline: runs, streaks, latencies, sliding ratios and alert conditions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from navpulse.functions import times
from navpulse.operators.calendar import require_calendar
from navpulse.operators.latest import latest_version
from navpulse.operators.ranking import values_at_ranks
from navpulse.operators.runs import streaks
from navpulse.settings import MarketHours

HEALTH_RUNS = 10


def run_status(runs: DataFrame) -> DataFrame:
    """Status of each run from its counts; its own note, then its first five errors.

    ``runs``: run_id, received_funds, missing_funds, failed_requests, errors (array) and,
    where a run has one, note.
    """
    flawed = (
        (F.col("failed_requests") > 0) | (F.col("missing_funds") > 0) | (F.size("errors") > 0)
    )
    status = F.when(F.col("received_funds") == 0, "failed").when(flawed, "partial").otherwise("ok")
    listed = F.array_join(F.slice("errors", 1, 5), "; ")
    own = F.col("note") if "note" in runs.columns else F.lit("")
    note = F.array_join(F.filter(F.array(F.coalesce(own, F.lit("")), listed), lambda x: x != ""), "; ")
    return runs.withColumns({"status": status, "note": note})


def cycle_records(
    runs: DataFrame,
    raw: DataFrame,
    expected: DataFrame,
    ticks: DataFrame,
    errors: DataFrame,
    issues: DataFrame | None = None,
) -> DataFrame:
    """The record of each run: requests, funds, issues, status and note, by one row per run.

    ``ticks`` are validated rows (with filled and repaired) or built ones. ``expected`` are
    fund and cycle pairs, or their number per run as ``expected_funds`` (``due_funds``).
    """
    asked = raw.groupBy("run_id").agg(
        F.count("*").alias("requests"), F.count_if(~F.col("status_code").between(200, 299)).alias("failed")
    )
    counted = "expected_funds" in expected.columns
    due = expected if counted else expected.groupBy("run_id").agg(F.count("*").alias("expected_funds"))
    fresh = ~F.col("filled") if "filled" in ticks.columns else F.lit(True)
    repaired = F.col("repaired") if "repaired" in ticks.columns else F.lit(False)
    came = ticks.groupBy("run_id").agg(
        F.count_if(fresh).alias("received_funds"), F.count_if(~fresh).alias("filled"),
        F.count_if(repaired).alias("repaired"),
    )
    # Of a run's errors only the first five are kept, so a failing endpoint cannot grow a row.
    place = F.row_number().over(W.partitionBy("run_id").orderBy("error"))
    first = errors.withColumn("_n", place).filter(F.col("_n") <= 5)
    listed = first.groupBy("run_id").agg(F.array_sort(F.collect_list("error")).alias("errors"))
    out = runs
    for part in (asked, due, came, listed):
        out = out.join(part, "run_id", "left")
    if issues is not None:
        out = out.join(issues.groupBy("run_id").agg(F.count("*").alias("issues")), "run_id", "left")
    else:
        out = out.withColumn("issues", F.lit(0))
    counts = ("requests", "failed", "expected_funds", "received_funds", "issues", "filled", "repaired")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    out = out.withColumns(
        {
            "errors": F.coalesce("errors", F.array().cast("array<string>")),
            "missing_funds": F.col("expected_funds") - F.col("received_funds"),
            "failed_requests": F.col("failed"),
        }
    )
    return run_status(out).drop("errors", "missing_funds", "failed_requests")


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest cycles with their duration."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1-500")
    newest = runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)
    return newest.select(
        "run_id", "tick", "status", "requests", "failed",
        F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("finished_at")).alias(
            "duration_ms"
        ),
    )


def collector_state(
    runs: DataFrame, now: dt.datetime, market_open: bool, stale_after: int = 180
) -> DataFrame:
    """One row: state, newest run, lag and how many of the newest runs failed in a row."""
    newest = runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(HEALTH_RUNS)
    place = F.row_number().over(W.orderBy(F.col("started_at").desc(), F.col("run_id").desc()))
    ranked = newest.withColumn("_n", place)  # ten rows
    lag = times.seconds_between(F.max_by("finished_at", -F.col("_n")), F.lit(now))
    first_good = F.min(F.when(F.col("status") != "failed", F.col("_n")))
    if market_open:
        state = F.when(F.coalesce(lag <= stale_after, F.lit(False)), "ok").otherwise("stale")
    else:
        state = F.lit("idle")
    return ranked.agg(
        state.alias("state"),
        F.max_by("tick", -F.col("_n")).alias("last_tick"),
        F.max_by("status", -F.col("_n")).alias("last_status"),
        lag.alias("lag_seconds"),
        F.coalesce(first_good - 1, F.count("*")).alias("failed_streak"),
    )


def failed_streaks(runs: DataFrame) -> DataFrame:
    """Each run with the number of failed cycles in a row up to it."""
    dated = runs.withColumn("_day", F.to_date("started_at"))
    return streaks(
        dated, [], "_day", ["started_at", "run_id"], F.col("status") == "failed"
    ).drop("_day")


def streak_alerts(runs: DataFrame, threshold: int = 3) -> DataFrame:
    """One alert where a streak reaches the threshold, one recovery where it then ends."""
    counted = failed_streaks(runs)
    ok = F.col("status") != "failed"
    dated = counted.withColumn("_day", F.to_date("started_at"))
    # The streak a good run ends is that of the run before it; blocks are days, and the
    # last run of a day is handed to the next day's first.
    by_day = W.partitionBy("_day").orderBy("started_at", "run_id")
    last = dated.groupBy("_day").agg(
        F.max_by("streak", F.struct("started_at", "run_id")).alias("_end")
    )
    handed = last.withColumn("_carry", F.lag("_end").over(W.orderBy("_day"))).select(
        "_day", "_carry"
    )  # one row per day
    rows = dated.join(handed, "_day").withColumn(
        "_before", F.coalesce(F.lag("streak").over(by_day), F.col("_carry"), F.lit(0))
    )
    event = F.when(~ok & (F.col("streak") == threshold), "failing").when(
        ok & (F.col("_before") >= threshold), "recovered"
    )
    return rows.withColumn("event", event).filter(F.col("event").isNotNull()).select(
        "run_id", "started_at", "event",
        F.when(ok, F.col("_before")).otherwise(F.col("streak")).alias("failed_cycles"),
    )


def latency_report(raw: DataFrame, keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Responses, errors and the exact 95th percentile of the latency, per endpoint.

    The percentile is the value at rank ceil(0.95 n), found without sorting an endpoint's
    rows in one task.
    """
    keys = list(keys)
    counts = raw.groupBy(*keys).agg(
        F.count("*").alias("responses"), F.count_if(F.col("status_code") != 200).alias("errors")
    )
    p95 = values_at_ranks(
        raw, keys, "latency_ms", 0.95, {"p95_ms": F.ceil(F.col("n") * 19 / 20)}
    ).drop("n")
    return counts.join(p95, keys, "left")


def duration_report(runs: DataFrame) -> DataFrame:
    span = F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("finished_at"))
    return runs.groupBy("status").agg(F.count("*").alias("n"), F.avg(span).alias("avg_ms"))


def step_counts(df: DataFrame, ts: str, bad: Column, step: str = "1 minute") -> DataFrame:
    """Rows and bad rows per step: the shuffle carries one row per step and task."""
    steps = df.groupBy(F.window(ts, step).alias("_w")).agg(
        F.count("*").alias("n"), F.count_if(bad).alias("bad")
    )
    return steps.select(F.col("_w.start").alias("at"), "n", "bad")


def ratio_of_counts(counts: DataFrame, width: str = "10 minutes", step: str = "1 minute") -> DataFrame:
    """Share of bad rows per moving window; the copies a window makes are of the counts."""
    return (
        counts.groupBy(F.window("at", width, step).alias("w"))
        .agg(F.sum("n").alias("responses"), F.sum("bad").alias("bad"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "responses",
            "bad",
            (F.col("bad") / F.col("responses").cast("double")).alias("ratio"),
        )
    )


def sliding_ratio(
    df: DataFrame, ts: str, bad: Column, width: str = "10 minutes", step: str = "1 minute"
) -> DataFrame:
    """Share of bad rows per moving window, counted per step first."""
    return ratio_of_counts(step_counts(df, ts, bad, step), width, step)


def sustained(
    df: DataFrame, keys: Sequence[str], ts: str, condition: Column, minutes: int
) -> DataFrame:
    """Rows at which the condition has held without a break for so many minutes."""
    dated = df.withColumn("_day", F.to_date(ts))
    counted = streaks(dated, keys, "_day", [ts], condition, since=ts)
    held = times.seconds_between(F.col("run_start"), F.col(ts))
    return (
        counted.withColumn("held_seconds", held)
        .filter((F.col("streak") > 0) & (F.col("held_seconds") >= minutes * times.MINUTE))
        .drop("_day")
    )


def firing_alerts(samples: DataFrame, rules: dict[str, tuple[Column, int, str, str]]) -> DataFrame:
    """Alert rows: rule name, component and severity, at each sample where a rule fires.

    ``rules``: name -> (condition, minutes it must hold, severity, component). ``samples``
    has ``at`` and one column per measured figure. Each sample unfolds into a row per rule,
    and one pass finds the unbroken spells of all of them.
    """
    judged = [
        F.struct(
            F.lit(name).alias("alert"), F.lit(severity).alias("severity"), F.lit(component).alias("component"),
            F.lit(minutes * times.MINUTE).alias("hold"), F.coalesce(condition, F.lit(False)).alias("hit"),
        )
        for name, (condition, minutes, severity, component) in rules.items()
    ]
    rows = samples.select("at", F.explode(F.array(*judged)).alias("_r")).select("at", "_r.*")
    dated = rows.withColumn("_day", F.to_date("at"))
    counted = streaks(dated, ["alert"], "_day", ["at"], F.col("hit"), since="at")
    held = times.seconds_between(F.col("run_start"), F.col("at"))
    return (
        counted.withColumn("held_seconds", held)
        .filter((F.col("streak") > 0) & (F.col("held_seconds") >= F.col("hold")))
        .select("at", "alert", "severity", "component", "held_seconds")
    )


def inhibit(alerts: DataFrame, causes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Alerts without those that another one firing at the same sample explains.

    A critical alert silences the warnings of its component; ``causes`` names, per alert,
    the alerts it silences. An alert that is silenced itself silences all the same.
    """
    critical = alerts.filter(F.col("severity") == "critical").select("at", "component").distinct()
    warnings = alerts.filter(F.col("severity") != "critical")
    left = alerts.filter(F.col("severity") == "critical").unionByName(
        warnings.join(critical, ["at", "component"], "left_anti")
    )
    if causes:
        pairs = [F.struct(F.lit(c).alias("cause"), F.lit(x).alias("alert")) for c, xs in causes.items() for x in xs]
        silenced = alerts.select("at", F.col("alert").alias("_by"), F.explode(F.array(*pairs)).alias("_p"))
        silenced = silenced.filter(F.col("_by") == F.col("_p.cause")).select("at", F.col("_p.alert").alias("alert"))
        left = left.join(silenced.distinct(), ["at", "alert"], "left_anti")
    return left


# Limits of the operational rules, in seconds or as shares.
STALE_AFTER, LEAST_COMPLETE, MOST_ERRORS, SLOWEST_CYCLE, FAILED_IN_A_ROW = 300, 0.9, 0.2, 45, 3
RULE_CAUSES = {"collector_failing": ("data_stale", "source_errors", "low_completeness")}


def rule_samples(runs: DataFrame, hours: MarketHours, calendar: DataFrame) -> DataFrame:
    """The figures the operational rules look at, one row per run; windows are within its day."""
    dated = runs.withColumns({"at": F.col("tick"), "day": F.to_date("tick"), "_s": F.unix_seconds("tick")})
    counted = streaks(dated, [], "day", ["_s", "run_id"], F.col("status") == "failed")
    by_time = W.partitionBy("day").orderBy("_s")
    upto = by_time.rangeBetween(W.unboundedPreceding, 0)
    last = lambda seconds: by_time.rangeBetween(1 - seconds, 0)
    took = F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("finished_at")) / 1000.0
    days = calendar.select("day", "trading")
    rows = require_calendar(counted.join(F.broadcast(days), "day", "left"), "trading", "day")  # one row per date
    return rows.withColumns(
        {
            "failed_streak": F.col("streak"),
            "age": F.col("_s") - F.max(F.when(F.col("status") != "failed", F.col("_s"))).over(upto),
            "completeness": F.try_divide(F.col("received_funds"), F.col("expected_funds")),
            "error_ratio": F.try_divide(F.sum("failed").over(last(600)), F.sum("requests").over(last(600))),
            "p95_seconds": F.percentile(took, F.lit(0.95)).over(last(900)),
            "open": F.col("trading") & times.second_of_day("tick").between(hours.open_second, hours.close_second),
        }
    )


def operational_rules() -> dict[str, tuple[Column, int, str, str]]:
    """Rules over runs: condition, minutes it must hold, severity and component."""
    return {
        "collector_failing": (F.col("failed_streak") >= FAILED_IN_A_ROW, 1, "critical", "collector"),
        "data_stale": ((F.col("age") > STALE_AFTER) & F.col("open"), 2, "critical", "collector"),
        "low_completeness": ((F.col("completeness") < LEAST_COMPLETE) & F.col("open"), 10, "warning", "collector"),
        "source_errors": (F.col("error_ratio") > MOST_ERRORS, 10, "warning", "collector"),
        "slow_cycles": (F.col("p95_seconds") > SLOWEST_CYCLE, 15, "warning", "collector"),
    }


def market_day_corrections(
    probes: DataFrame, calendar: DataFrame, hours: MarketHours, closure_note: str, open_note: str
) -> DataFrame:
    """Rows for the observed calendar from what the feed showed on each day.

    ``probes``: at, session_day (the day whose figures the feed showed then). A trading day
    on which the feed never showed that day by the open plus the guard is a closure; a
    listed holiday on which it did is a mistake in the list.
    """
    guard = hours.open_second + hours.guard_minutes * times.MINUTE
    daily = probes.withColumn("day", F.to_date("at")).groupBy("day").agg(
        F.bool_or(F.coalesce(F.col("session_day") == F.col("day"), F.lit(False))).alias("_shown"),
        F.max(times.second_of_day("at")).alias("_latest"),
        F.max("at").alias("recorded_at"),
    )
    known = daily.join(F.broadcast(calendar.select("day", "trading", "source")), "day", "left")
    known = require_calendar(known, "source", "day")
    closed = F.col("trading") & ~F.col("_shown") & (F.col("_latest") >= guard)
    opened = ~F.col("trading") & F.col("source").isin("official", "extra") & F.col("_shown")
    return known.filter(closed | opened).select(
        "day", opened.alias("trading"),
        F.when(opened, open_note).otherwise(closure_note).alias("note"), "recorded_at",
    )


def restamp_at_close(ticks: DataFrame, hours: MarketHours) -> DataFrame:
    """Closing snapshot: rows fetched after the close, stamped at the close of their day.

    The official figures fetched later get the same stamp and a newer version, so the
    latest-version rule replaces the first ones.
    """
    day = F.to_date("ts")
    closing = times.session_close(day, hours)
    late = ticks.filter(times.second_of_day("ts") >= hours.close_second)
    stamped = late.withColumn("ts", closing)
    return latest_version(stamped, ["ins_code", "ts"], ["ingested_at"])
