"""One row per fund and cycle from the parsed payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from navpulse import schemas
from navpulse.functions import flags, metrics, text, times
from navpulse.operators.latest import latest_version
from navpulse.sources import payloads

CLIENT_SIDES = ("ind_buy", "ind_sell", "inst_buy", "inst_sell")


def cycles_of(runs: DataFrame) -> DataFrame:
    """run_id, ts (floored to the minute), day, ingested_at; one cycle per minute."""
    stamped = runs.select(
        "run_id",
        times.floor_minute("tick").alias("ts"),
        F.to_date("tick").alias("day"),
        F.col("finished_at").alias("ingested_at"),
    ).filter(F.col("ts").isNotNull())
    return latest_version(stamped, ["ts"], ["ingested_at", "run_id"])


def expected_days(cycles: DataFrame, universe: DataFrame) -> DataFrame:
    """One row per fund and day with the day's cycles (at most one per minute) as the array ``cycles``.

    The short form of :func:`expected_rows`: ``universe`` has ins_code and day.
    """
    rest = [c for c in cycles.columns if c not in ("day", "ts")]
    by_day = cycles.groupBy("day").agg(
        F.array_sort(F.collect_list(F.struct("ts", *rest))).alias("cycles"),
    )
    return universe.join(by_day, "day")


def unfold_days(days: DataFrame) -> DataFrame:
    """The fund and cycle pairs of ``days``, with every column that is no part of the array."""
    inner = [f.name for f in days.schema["cycles"].dataType.elementType.fields]
    kept = [c for c in days.columns if c != "cycles"]
    return days.withColumn("_c", F.explode("cycles")).select(*kept, *[F.col(f"_c.{c}").alias(c) for c in inner])


def expected_rows(cycles: DataFrame, universe: DataFrame) -> DataFrame:
    """One row per fund and cycle of its day.

    ``universe`` has ins_code and day. A day's cycles travel as one array that is joined by
    day and unfolded, so the only rows made are real ones.
    """
    rest = [c for c in cycles.columns if c != "day"]
    return unfold_days(expected_days(cycles, universe)).select(*universe.columns, *rest)


def due_funds(cycles: DataFrame, universe: DataFrame) -> DataFrame:
    """Per run the number of its expected rows, counted per day instead of pair by pair."""
    per_day = universe.groupBy("day").agg(F.count("*").alias("_n"))
    return cycles.join(per_day, "day").groupBy("run_id").agg(F.sum("_n").alias("expected_funds"))


def universe_on_days(universe: DataFrame, cycles: DataFrame) -> DataFrame:
    """The same fund list on every day that has cycles."""
    days = cycles.agg(F.collect_set("day").alias("_days"), F.lit(1).alias("_k"))
    return (
        universe.withColumn("_k", F.lit(1))
        .join(F.broadcast(days), "_k")  # one row, as many entries as there are days
        .select(*universe.columns, F.explode("_days").alias("day"))
    )


def board_rollup(watch: DataFrame) -> DataFrame:
    """Turnover of the secondary boards per run and ISIN stem."""
    secondary = watch.filter(
        text.is_fund_unit("isin", "sector") & ~text.is_primary_board("isin")
    )
    return secondary.groupBy("run_id", text.isin_stem("isin").alias("stem")).agg(
        F.sum("volume").alias("block_volume"), F.sum("value").alias("block_value")
    )


def build_ticks(
    watch: DataFrame,
    clients: DataFrame,
    navs: DataFrame,
    universe: DataFrame,
    cycles: DataFrame,
) -> DataFrame:
    """The stored tick columns plus band (``band_low``, ``band_high``) and ``feed_heven``.

    Inputs are parsed payload rows with run_id; ``universe`` has ins_code, isin and day;
    ``cycles`` as from :func:`cycles_of`. Where a payload repeats an instrument, its last
    row counts. Funds without a watch row are not here: see :func:`missing_funds`.
    """
    watch_1 = latest_version(watch, ["run_id", "ins_code"], ["position"])
    clients_1 = latest_version(clients, ["run_id", "ins_code"], ["position"])
    nav_1 = (
        latest_version(navs, ["run_id", "ins_code"], ["position"])
        .filter(F.col("redemption") > 0)
        .select(
            "run_id",
            "ins_code",
            F.col("redemption").alias("nav_redemption"),
            F.col("subscription").alias("nav_subscription"),
            payloads.nav_time().alias("nav_at"),
        )
    )
    boards = board_rollup(watch)
    feed = watch.groupBy("run_id").agg(F.max("heven").alias("feed_heven"))
    members = universe.select("ins_code", "day", text.isin_stem("isin").alias("stem"))
    # Joins by the key the rows are already grouped by come first: they shuffle nothing again.
    rows = (
        watch_1.select([c for c in watch_1.columns if c not in ("symbol", "name", "position")])
        .join(
            clients_1.drop("position").withColumn("_client", F.lit(True)),
            ["run_id", "ins_code"],
            "left",
        )
        .join(nav_1, ["run_id", "ins_code"], "left")
        .join(cycles.join(feed, "run_id", "left"), "run_id")
        .join(members, ["ins_code", "day"])
        .join(boards, ["run_id", "stem"], "left")
    )
    price = metrics.average_price("volume", "value", "close_price", "prev_close")
    banded = (F.col("min_allowed") > 0) & (F.col("max_allowed") > 0)
    mask = flags.combine(
        F.lit(flags.FLOW_VALUE_ESTIMATED),
        flags.bit_when(F.col("nav_redemption").isNull(), flags.NAV_MISSING),
        flags.bit_when(F.col("_client").isNull(), flags.CLIENT_TYPE_MISSING),
        flags.bit_when(F.col("trade_count") == 0, flags.NO_TRADES),
    )
    zero = F.lit(0).cast("long")
    derived = {
        "quality_flags": mask,
        "band_low": F.when(banded, F.col("min_allowed")),
        "band_high": F.when(banded, F.col("max_allowed")),
        "bid_price": F.coalesce(F.col("top.bid_price"), zero),
        "bid_volume": F.coalesce(F.col("top.bid_volume"), zero),
        "ask_price": F.coalesce(F.col("top.ask_price"), zero),
        "ask_volume": F.coalesce(F.col("top.ask_volume"), zero),
        "block_volume": F.coalesce("block_volume", zero),
        "block_value": F.coalesce("block_value", zero),
        **{f"{s}_volume": F.coalesce(f"{s}_volume", zero) for s in CLIENT_SIDES},
        **{f"{s}_count": F.coalesce(f"{s}_count", zero) for s in CLIENT_SIDES},
        **{
            f"{s}_value": F.coalesce(metrics.flow_estimate(f"{s}_volume", price), zero)
            for s in CLIENT_SIDES
        },
    }
    out = rows.withColumns(derived)
    return out.select(*schemas.TICK_COLUMNS, "band_low", "band_high", "feed_heven")


def missing_funds(expected: DataFrame, ticks: DataFrame) -> DataFrame:
    """Expected fund and cycle pairs without a tick."""
    return expected.join(ticks.select("ins_code", "ts"), ["ins_code", "ts"], "left_anti")


def missing_of_days(universe: DataFrame, cycles: DataFrame, ticks: DataFrame) -> DataFrame:
    """:func:`missing_funds` of the expected rows of whole days, without shuffling the pairs.

    A fund's ticks of a day (at most one per minute) are joined to its one row of the day;
    the day's cycles come last and are unfolded in place. They go to all tasks, an array per
    column (at most one entry per minute), so that columns nobody reads are not carried.
    """
    came = ticks.groupBy("ins_code", F.to_date("ts").alias("day")).agg(F.collect_set("ts").alias("_came"))
    rest = [c for c in cycles.columns if c not in ("day", "ts")]
    by_day = cycles.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("ts", *rest))).alias("_c")).select(
        "day", F.col("_c.ts").alias("_cycles"), *[F.col(f"_c.{c}").alias(f"_{c}") for c in rest]
    )
    days = universe.join(came, ["ins_code", "day"], "left").join(F.broadcast(by_day), "day")
    pairs = days.select("*", F.posexplode("_cycles").alias("_at", "ts"))
    absent = pairs.filter(~F.coalesce(F.array_contains("_came", F.col("ts")), F.lit(False)))
    return absent.select(*universe.columns, "ts", *[F.col(f"_{c}")[F.col("_at")].alias(c) for c in rest])


def decisive_rows(universe: DataFrame, cycles: DataFrame, ticks: DataFrame) -> DataFrame:
    """The expected rows of whole days that the validator needs to judge those days from their start.

    Before a fund's first tick of a day nothing can be carried: its absence is told by the
    day's first cycle, where it starts, and the last, which the state remembers. The rows
    between these two are left out; from the first tick on all are here.
    """
    first = ticks.groupBy("ins_code", F.to_date("ts").alias("day")).agg(F.min("ts").alias("_first"))
    days = expected_days(cycles, universe.join(first, ["ins_code", "day"], "left")).withColumns(
        {"_opens": F.col("cycles")[0]["ts"], "_ends": F.element_at("cycles", -1)["ts"]}
    )
    needed = (F.col("ts") >= F.col("_first")) | F.col("ts").isin(F.col("_opens"), F.col("_ends"))
    return unfold_days(days).filter(needed).drop("_first", "_opens", "_ends")


def market_ticks(overview: DataFrame, cycles: DataFrame) -> DataFrame:
    joined = overview.join(cycles.select("run_id", "ts", "ingested_at"), "run_id")
    return joined.select(*schemas.MARKET_TICKS.names)


def fund_states(states: DataFrame, universe: DataFrame, cycles: DataFrame) -> DataFrame:
    """Status observations of the funds in the universe only."""
    stamped = states.join(cycles, "run_id")
    return stamped.join(universe.select("ins_code", "day"), ["ins_code", "day"], "left_semi").select(
        *schemas.FUND_STATE.names
    )


def any_fund_traded(watch: DataFrame, universe: DataFrame) -> DataFrame:
    """Per run: did any fund of the universe trade in the session the feed shows?"""
    return (
        watch.join(universe.select("ins_code").distinct(), "ins_code", "left_semi")
        .groupBy("run_id")
        .agg(F.bool_or(F.col("trade_count") > 0).alias("traded"))
    )
