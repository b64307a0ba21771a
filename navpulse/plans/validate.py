"""Check and repair each tick against the fund's previous one.

State belongs to one fund and day, and a fund has one row per minute, so a window group is
at most a day of minutes however large the table is. Every repair sets a flag and leaves an
issue row; a condition that persists is flagged on every row but logged once per episode.

Values depend only on the rows that came from the feed: carried rows repeat the previous
one. So values are repaired on feed rows alone, and rows are then added for missing
cycles and for gaps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from navpulse import schemas
from navpulse.functions import flags as fl, times
from navpulse.operators.runs import rising_edge
from navpulse.session import freeze
from navpulse.settings import MarketHours, ValidationLimits

COUNTERS = (
    "volume", "value", "trade_count",
    "ind_buy_volume", "ind_sell_volume", "inst_buy_volume", "inst_sell_volume",
)
KEY = ("ins_code", "day")
#: Under this instrument the state holds what belongs to the feed as a whole.
FEED = ""


@dataclass(frozen=True)
class Validated:
    ticks: DataFrame  # repaired and added rows, in the stored columns
    issues: DataFrame
    state: DataFrame  # what a later run of the same day has to know


def _issue(check: str, severity: str, action: Column | str, detail: Column | str) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(severity).alias("severity"),
        (F.lit(action) if isinstance(action, str) else action).alias("action"),
        (F.lit(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"),
    )


def frozen_feed(cycles: DataFrame, limits: ValidationLimits) -> DataFrame:
    """Per cycle: how often in a row the feed time was unchanged, and whether it is stale.

    Cycles without rows or feed time are not judged. ``cycles`` has day, ts, feed_heven.
    """
    judged = cycles.filter(F.col("feed_heven") > 0)
    ordered = W.partitionBy("day").orderBy("ts")
    same = F.col("feed_heven") == F.lag("feed_heven").over(ordered)
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = judged.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn(
        "_run", F.sum("_new").over(upto)
    )
    run = W.partitionBy("day", "_run").orderBy("ts")
    counted = counted.withColumn("unchanged", (F.row_number().over(run) - 1).cast("long"))
    stale = F.col("unchanged") >= limits.feed_stale_cycles
    return counted.select("day", "ts", "feed_heven", "unchanged", stale.alias("feed_stale"))


def price_segments(df: DataFrame, p: str) -> DataFrame:
    """Adds what decides about a bad price of ``p``: ``_start``, ``_segments``, ``_least``, ``_most``.

    A run is a good row and the bad ones after it. It is cut where a band takes in the raw
    price of the bad row before. Inside such a segment the price held at its start is kept
    until one band leaves it out, and from there on every row keeps its own: whether that
    has happened is told by the highest low and the lowest high so far. Only the price held
    at a segment's start depends on the segments before it, one (low, high, last raw) each.
    Bands that stay as they are give one segment a run, so a row's size does not depend on
    how many bad rows there are.
    """
    ordered = W.partitionBy(*KEY).orderBy("ts")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    raw, bad, here = F.col(p), F.col(f"_bad_{p}"), F.col("here")
    seen = F.when(here, F.struct(raw.alias("raw"), bad.alias("bad")))
    df = df.withColumn("_prev", F.last(seen, ignorenulls=True).over(before))
    opens = bad & F.col("_prev.bad") & F.col("_prev.raw").between(F.col("band_low"), F.col("band_high"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False))).over(upto)
    df = df.withColumns({"_run": count(here & ~bad), "_segment": count(here & (~bad | opens))}).drop("_prev")

    # One order serves both windows: fund, day, run, segment, time.
    segment = W.partitionBy(*KEY, "_run", "_segment").orderBy("ts")
    so_far = segment.rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumns(
        {
            "_least": F.max(F.when(bad, F.col("band_low"))).over(so_far),
            "_most": F.min(F.when(bad, F.col("band_high"))).over(so_far),
            "_last_raw": F.last(F.when(here, raw), ignorenulls=True).over(so_far),
            "_ends": F.lead(F.lit(1)).over(segment).isNull(),
        }
    )
    run = W.partitionBy(*KEY, "_run").orderBy("_segment", "ts")
    summary = F.struct(F.col("_least").alias("low"), F.col("_most").alias("high"), F.col("_last_raw").alias("raw"))
    df = df.withColumns(
        {
            "_start": F.first(F.when(here & ~bad, raw), ignorenulls=True).over(
                run.rowsBetween(W.unboundedPreceding, W.currentRow)
            ),
            "_segments": F.collect_list(F.when(F.col("_ends"), summary)).over(run.rowsBetween(W.unboundedPreceding, -1)),
        }
    )
    return df.drop("_run", "_segment", "_last_raw", "_ends")


def _fold_prices(df: DataFrame, prices: tuple[str, ...]) -> DataFrame:
    """Adds ``_new_<price>``: the raw one, or the previous repaired one while it fits the band.

    A row is *bad* when its price is outside its band; then the previous repaired price is
    kept if it lies in this row's band, else the raw price stays. Which price is "previous"
    depends on all earlier bad rows of the same unbroken run.
    """
    fits = lambda h, low, high: low.isNull() | h.between(low, high)
    for p in prices:
        df = price_segments(df, p)
        held = F.aggregate(
            F.coalesce("_segments", F.array().cast("array<struct<low:bigint,high:bigint,raw:bigint>>")),
            F.col("_start"),
            lambda h, x: F.when(fits(h, x["low"], x["high"]), h).otherwise(x["raw"]),
        )
        df = df.withColumn("_held", held)
        kept = F.col(f"_bad_{p}") & fits(F.col("_held"), F.col("_least"), F.col("_most"))
        df = df.withColumn(f"_new_{p}", F.when(kept, F.col("_held")).otherwise(F.col(p)))
        df = df.drop("_start", "_segments", "_least", "_most", "_held")
    return df


def check_values(rows: DataFrame, limits: ValidationLimits) -> DataFrame:
    """Repaired tick columns, ``found`` (array of issues) and ``changed``.

    Input: tick columns, band, day, ``feed_stale``; ``here`` is false on a cycle in which
    the fund was missing (its values are null and take no part); ``seed`` is set on a row
    that only brings the state of an earlier run (it is not checked).
    """
    ordered = W.partitionBy(*KEY).orderBy("ts")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    is_seed = F.col("seed").isNotNull()
    checked = F.col("here") & ~is_seed
    has_trades = F.col("trade_count") > 0
    prices = ("last_price", "close_price")

    # 1. price band
    banded = checked & F.col("band_low").isNotNull() & has_trades
    df = rows
    for p in prices:
        bad = F.coalesce(banded & ~F.col(p).between(F.col("band_low"), F.col("band_high")), F.lit(False))
        df = df.withColumn(f"_bad_{p}", bad)
    df = _fold_prices(df, prices)

    # 2. high and low hold open and last
    points = [F.nullif(c, F.lit(0)) for c in (
        F.col("open_price"), F.col("_new_last_price"), F.col("high_price"), F.col("low_price")
    )]
    points = [F.when(p > 0, p) for p in points]
    high, low = F.greatest(*points), F.least(*points)
    range_off = (
        checked & has_trades & high.isNotNull()
        & ((high != F.col("high_price")) | (low != F.col("low_price")))
    )
    df = df.withColumn("_range_off", F.coalesce(range_off, F.lit(False)))
    df = df.withColumn("_high", F.when(F.col("_range_off"), high).otherwise(F.col("high_price")))
    df = df.withColumn("_low", F.when(F.col("_range_off"), low).otherwise(F.col("low_price")))

    # 3. counters only grow: the repaired value is the running maximum
    for c in COUNTERS:
        df = df.withColumn(f"_prev_{c}", F.max(c).over(before))
    drops = {c: F.coalesce(checked & (F.col(c) < F.col(f"_prev_{c}")), F.lit(False)) for c in COUNTERS}
    dropped = None
    for c in COUNTERS:
        dropped = drops[c] if dropped is None else dropped | drops[c]
    drop_detail = F.array_join(
        F.array_compact(F.array(*[
            F.when(drops[c], F.concat(F.lit(f"{c} "), F.col(f"_prev_{c}"), F.lit("→"), F.col(c)))
            for c in COUNTERS
        ])), ", ",
    )
    df = df.withColumns({"_dropped": dropped, "_drop_detail": drop_detail})

    # 4. both groups' buys, and both groups' sells, make up the raw volume
    buys = F.col("ind_buy_volume") + F.col("inst_buy_volume")
    sells = F.col("ind_sell_volume") + F.col("inst_sell_volume")
    vol = F.col("volume")
    off = F.greatest(F.abs(buys - vol), F.abs(sells - vol)).cast("double") / F.nullif(vol, F.lit(0))
    judged = ~fl.has_flag("quality_flags", fl.CLIENT_TYPE_MISSING) & (vol > 0)
    df = df.withColumn(
        "_mismatch",
        F.when(is_seed, F.col("seed.mismatch")).when(judged, off > limits.client_mismatch_ratio),
    )

    # 5. NAV: carried when missing, then its jump and its age
    nav = F.struct("nav_redemption", "nav_subscription", "nav_at")
    known = F.when(F.col("nav_redemption").isNotNull(), nav)
    df = df.withColumn("_prev_nav", F.last(known, ignorenulls=True).over(before))
    absent = checked & F.col("nav_redemption").isNull()
    carried = F.coalesce(absent & F.col("_prev_nav").isNotNull(), F.lit(False))
    prev = F.col("_prev_nav.nav_redemption")
    jump = F.abs(F.col("nav_redemption").cast("double") / F.nullif(prev, F.lit(0)) - 1)
    jumped = checked & ~absent & (jump > limits.nav_jump_ratio)
    df = df.withColumns(
        {
            "_carried": carried,
            "_jump": F.when(F.coalesce(jumped, F.lit(False)), jump),
            "_absent": F.when(is_seed, F.col("seed.absent")).when(checked, absent),
            "_nav": F.when(carried, F.col("_prev_nav")).otherwise(nav),
        }
    )
    age = times.seconds_between(F.col("_nav.nav_at"), F.col("ts"))
    df = df.withColumn(
        "_old_nav",
        F.when(is_seed, F.col("seed.old_nav")).when(
            F.col("_nav.nav_at").isNotNull(), age > limits.nav_stale_minutes * times.MINUTE
        ),
    )

    # 6. flags and issues
    edge = lambda c: checked & rising_edge(F.col(c), ordered)
    df = df.withColumns(
        {"_e_mismatch": edge("_mismatch"), "_e_absent": edge("_absent"), "_e_old": edge("_old_nav")}
    )
    bad_any = F.col("_bad_last_price") | F.col("_bad_close_price")
    mask = fl.combine(
        F.col("quality_flags"),
        fl.bit_when(bad_any, fl.PRICE_OUT_OF_RANGE),
        fl.bit_when(F.col("_range_off"), fl.RANGE_REPAIRED),
        fl.bit_when(F.col("_dropped"), fl.CUMULATIVE_DECREASE),
        fl.bit_when(checked & F.col("_mismatch"), fl.CLIENT_VOLUME_MISMATCH),
        fl.bit_when(F.col("_carried"), fl.NAV_CARRIED),
        fl.bit_when(F.col("_jump").isNotNull(), fl.NAV_JUMP),
        fl.bit_when(checked & F.col("_old_nav"), fl.NAV_STALE),
        fl.bit_when(checked & F.col("feed_stale"), fl.STALE_QUOTE),
    )

    def band_issue(p: str) -> Column:
        replaced = F.col(f"_new_{p}") != F.col(p)  # a replacement is in the band, p is not
        return F.when(
            F.col(f"_bad_{p}"),
            _issue(
                "price_out_of_band",
                "error",
                F.when(replaced, "replaced_with_previous").otherwise("kept"),
                F.format_string(f"{p}=%d outside [%d, %d]", p, "band_low", "band_high"),
            ),
        )

    found = F.array_compact(F.array(
        band_issue("last_price"),
        band_issue("close_price"),
        F.when(F.col("_range_off"), _issue("ohlc_inconsistent", "warn", "recomputed",
            F.format_string("high/low %d/%d → %d/%d", "high_price", "low_price", "_high", "_low"))),
        F.when(F.col("_dropped"),
            _issue("cumulative_decrease", "error", "kept_previous", F.col("_drop_detail"))),
        F.when(F.col("_e_mismatch"), _issue("client_volume_mismatch", "warn", "flagged",
            F.format_string("buys=%d sells=%d volume=%d", buys, sells, vol))),
        F.when(F.col("_e_absent"), _issue("nav_missing", "warn",
            F.when(F.col("_carried"), "carried_forward").otherwise("none"), "")),
        F.when(F.col("_jump").isNotNull(), _issue("nav_jump", "warn", "flagged",
            F.format_string("%d→%d (%.1f%%)", prev, "nav_redemption", F.col("_jump") * 100))),
        F.when(F.col("_e_old"), _issue("nav_stale", "info", "flagged",
            F.concat(F.lit("NAV from "), F.date_format("_nav.nav_at", "yyyy-MM-dd HH:mm")))),
    ))

    changed = (
        (F.col("_bad_last_price") & (F.col("_new_last_price") != F.col("last_price")))
        | (F.col("_bad_close_price") & (F.col("_new_close_price") != F.col("close_price")))
        | F.col("_range_off") | F.col("_dropped") | F.col("_carried")
    )
    repaired = {
        "last_price": F.col("_new_last_price"),
        "close_price": F.col("_new_close_price"),
        "high_price": F.col("_high"),
        "low_price": F.col("_low"),
        **{c: F.greatest(F.col(c), F.col(f"_prev_{c}")) for c in COUNTERS},
        "nav_redemption": F.col("_nav.nav_redemption"),
        "nav_subscription": F.col("_nav.nav_subscription"),
        "nav_at": F.col("_nav.nav_at"),
        "quality_flags": mask.cast("int"),
    }
    kept = [
        (repaired[c] if c in repaired else F.col(c)).alias(c) for c in schemas.TICK_COLUMNS
    ]
    return df.select(
        *kept, "day", "here", "seed", found.alias("found"), changed.alias("changed"),
        *[F.last(c, ignorenulls=True).over(upto).alias(c)
          for c in ("_mismatch", "_absent", "_old_nav")],
    )


def validate(
    ticks: DataFrame,
    expected: DataFrame,
    hours: MarketHours,
    calendar: DataFrame,
    limits: ValidationLimits = ValidationLimits(),
    state: DataFrame | None = None,
    store: bool = False,
) -> Validated:
    """Validate whole days.

    ``ticks``: tick columns, band and feed_heven, one row per fund and minute (see
    :func:`navpulse.operators.latest.latest_version`). ``expected``: fund and cycle pairs
    (ins_code, day, ts, run_id, ingested_at), present or not. ``calendar``: day, trading.
    ``state``: output of an earlier run over the same days, to continue from. ``store``
    writes the checked rows to the shared folder once, for callers that use more than one
    of the results.

    Feed rows, expected rows and seeds are put in one set that is shuffled once by fund and
    day; every window after that works inside those partitions.
    """
    feed_rows = ticks.withColumn("day", F.to_date("ts"))
    feed = feed_rows.groupBy("day", "ts").agg(F.max("feed_heven").alias("feed_heven"))
    if state is not None:
        feed = feed.unionByName(state.select(F.explode("feed_cycles").alias("_f")).select("_f.*"))
        state = state.filter(F.col("ins_code") != FEED)
    frozen = frozen_feed(feed, limits)
    grid = _one_set(feed_rows, frozen, expected, state).repartition(*KEY)
    grid = grid.withColumn("_came", F.max("here").over(W.partitionBy(*KEY, "ts")))
    grid = grid.filter(F.col("here") | ~F.col("_came")).drop("_came")
    grid = check_values(grid, limits)

    ordered = W.partitionBy(*KEY).orderBy("ts")
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    is_seed = F.col("seed").isNotNull()
    limit = limits.max_gap_minutes * times.MINUTE
    step = times.seconds_between(F.lag("ts").over(ordered), F.col("ts"))
    grid = grid.withColumns(
        {
            "_segment": F.count_if(F.col("here")).over(upto),
            "_far": F.coalesce(~F.col("here") & (step > limit), F.lit(False)),
        }
    )
    segment = W.partitionBy(*KEY, "_segment").orderBy("ts")
    lost = F.max("_far").over(segment.rowsBetween(W.unboundedPreceding, W.currentRow))
    grid = grid.withColumn("_fills", ~F.col("here") & (F.col("_segment") > 0) & ~lost)
    tick = F.struct(*schemas.TICK_COLUMNS)
    stored = F.col("here") | F.col("_fills")
    missing = F.when(is_seed, F.col("seed.missing")).otherwise(~F.col("here"))
    grid = grid.withColumns(
        {
            "_prev_ts": F.last(F.when(stored, F.col("ts")), ignorenulls=True).over(before),
            "_prev_row": F.last(F.when(F.col("here"), tick), ignorenulls=True).over(before),
            "_missing": missing,
        }
    )
    grid = grid.withColumn("_missing_edge", rising_edge(F.col("_missing"), ordered))

    # Minutes between two stored rows that lie in market hours.
    open_days = calendar.filter("trading").select("day", F.lit(True).alias("_open_day"))
    grid = grid.join(F.broadcast(open_days), "day", "left")  # one row per date
    gap = times.seconds_between(F.col("_prev_ts"), F.col("ts"))
    steps = F.floor(gap / times.MINUTE).cast("int") - 1
    wanted = (
        F.col("here") & ~is_seed & (gap > times.MINUTE) & (steps >= 1)
        & F.coalesce("_open_day", F.lit(False))
    )
    offsets = F.sequence(F.lit(1), F.when(wanted, steps).otherwise(F.lit(1)))
    minutes = F.when(wanted, F.filter(
        F.transform(offsets, lambda k: times.add_seconds("_prev_ts", k * times.MINUTE)),
        lambda m: times.second_of_day(m).between(hours.open_second, hours.close_second),
    ))
    grid = grid.withColumn("_gap", minutes)
    n_gap = F.when(F.col("_gap").isNull(), 0).otherwise(F.size("_gap"))
    grid = grid.withColumns(
        {
            "_n_gap": n_gap,
            "_fill_gap": (n_gap > 0) & (n_gap <= limits.max_gap_minutes),
            "_open_gap": n_gap > limits.max_gap_minutes,
        }
    )
    grid = grid.withColumn("_issues", F.concat(_presence_issues(is_seed), "found"))
    if store:
        grid = freeze(grid)

    # Every grid row unfolds into the rows to store: gap minutes, then itself.
    no_stamps = F.array().cast("array<timestamp>")
    gap_stamps = F.when(F.col("_fill_gap"), F.col("_gap")).otherwise(no_stamps)
    own = F.when((F.col("here") & ~is_seed) | F.col("_fills"), F.array("ts")).otherwise(no_stamps)
    out = grid.withColumn("_at", F.explode(F.concat(gap_stamps, own)))
    fresh = F.col("here") & (F.col("_at") == F.col("ts"))
    carried = F.col("_prev_row.quality_flags").bitwiseOR(F.lit(fl.FORWARD_FILLED))
    stamped = {
        "ts": F.col("_at"),
        "ins_code": F.col("ins_code"),
        "run_id": F.col("run_id"),
        "ingested_at": F.col("ingested_at"),
        "quality_flags": F.when(fresh, F.col("quality_flags")).otherwise(carried),
    }
    final = out.select(
        *[
            stamped.get(c, F.when(fresh, F.col(c)).otherwise(F.col(f"_prev_row.{c}"))).alias(c)
            for c in schemas.TICK_COLUMNS
        ],
        (fresh & F.col("changed")).alias("repaired"),
        (~fresh).alias("filled"),
    )

    fund_issues = grid.filter(F.size("_issues") > 0).select(
        "ts", "run_id", "ins_code", F.explode("_issues").alias("_i")
    ).select("ts", "run_id", "ins_code", "_i.check", "_i.severity", "_i.action", "_i.detail")
    issues = fund_issues.unionByName(_feed_issues(frozen, feed_rows))
    return Validated(final, issues, _end_state(grid, frozen, limits))


def _one_set(
    feed_rows: DataFrame, frozen: DataFrame, expected: DataFrame, state: DataFrame | None
) -> DataFrame:
    """Feed rows, a placeholder per expected pair, and the seeds, in one shape."""
    seed_type = "struct<mismatch:boolean,absent:boolean,old_nav:boolean,missing:boolean>"
    rows = feed_rows.join(frozen.select("day", "ts", "feed_stale"), ["day", "ts"], "left").select(
        *schemas.TICK_COLUMNS, "band_low", "band_high", "day",
        F.coalesce("feed_stale", F.lit(False)).alias("feed_stale"),
        F.lit(True).alias("here"), F.lit(None).cast(seed_type).alias("seed"),
    )

    def shaped(df: DataFrame, given: dict[str, Column]) -> DataFrame:
        return df.select(*[
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema
        ])

    off = {"here": F.lit(False), "feed_stale": F.lit(False)}
    due = {c: F.col(c) for c in ("ins_code", "day", "ts", "run_id", "ingested_at")}
    out = rows.unionByName(shaped(expected, {**due, **off}))
    if state is None:
        return out
    memory = F.struct(
        F.col("_mismatch").alias("mismatch"), F.col("_absent").alias("absent"),
        F.col("_old_nav").alias("old_nav"), F.col("_missing").alias("missing"),
    )
    known = {c: F.col(f"_row.{c}") for c in schemas.TICK_COLUMNS}
    known |= {
        "ins_code": F.col("ins_code"),
        "day": F.col("day"),
        "ts": F.coalesce("_last_ts", "_seen_ts"),
        # A fund never stored that day is remembered only as being missing.
        "here": F.col("_row").isNotNull(),
        "feed_stale": F.lit(False),
        "seed": memory,
    }
    return out.unionByName(shaped(state, known))


def _presence_issues(is_seed: Column) -> Column:
    count = F.col("_n_gap").cast("string")
    clock = lambda c: F.date_format(c, "HH:mm")
    filled = F.concat(
        count, F.lit(" minutes "), clock(F.get("_gap", F.lit(0))), F.lit("–"),
        clock(F.get("_gap", F.col("_n_gap") - 1)),
    )
    left = F.concat(
        count, F.lit(" minutes since "), clock(F.col("_prev_ts")), F.lit(" exceed the fill limit")
    )
    gap = F.when(F.col("_fill_gap"), _issue("gap", "warn", "forward_filled", filled)).when(
        F.col("_open_gap"), _issue("gap", "error", "left_open", left)
    )
    absent = F.when(
        F.col("_missing_edge") & ~F.col("here") & ~is_seed,
        F.when(
            F.col("_fills"),
            _issue("missing_fund", "warn", "forward_filled", "absent from market watch"),
        ).otherwise(_issue("missing_fund", "error", "dropped", "no recent tick")),
    )
    return F.array_compact(F.array(gap, absent))


def _feed_issues(frozen: DataFrame, feed_rows: DataFrame) -> DataFrame:
    """One issue without a fund where a frozen episode starts, among this run's cycles."""
    by_day = W.partitionBy("day").orderBy("ts")
    runs = feed_rows.groupBy("ts").agg(F.max("run_id").alias("run_id"))
    detail = F.format_string(
        "market watch unchanged for %d cycles (hEven=%d)", "unchanged", "feed_heven"
    )
    starts = frozen.withColumn("_edge", rising_edge(F.col("feed_stale"), by_day)).filter("_edge")
    return starts.join(runs, "ts").select(
        "ts", "run_id", F.lit(FEED).alias("ins_code"), F.lit("feed_stale").alias("check"),
        F.lit("error").alias("severity"), F.lit("flagged").alias("action"), detail.alias("detail"),
    )


def _end_state(grid: DataFrame, frozen: DataFrame, limits: ValidationLimits) -> DataFrame:
    """One row per fund and day: its last stored row and the conditions that are active.

    And one row per day for the feed, with its newest cycles.
    """
    tick = F.struct(*schemas.TICK_COLUMNS)
    at = F.col("ts")
    stored = F.col("here") | F.col("_fills")
    last = grid.groupBy(*KEY).agg(
        F.max_by(F.when(F.col("here"), tick), F.when(F.col("here"), at)).alias("_row"),
        F.max(F.when(F.col("_fills"), at)).alias("_filled_ts"),
        F.max(F.when(stored, at)).alias("_last_ts"),
        F.max("ts").alias("_seen_ts"),
        *[F.max_by(c, at).alias(c) for c in ("_missing", "_mismatch", "_absent", "_old_nav")],
    )
    # The newest feed times of the day, enough to go on counting.
    newest = W.partitionBy("day").orderBy(F.col("ts").desc())
    recent = (
        frozen.withColumn("_n", F.row_number().over(newest))
        .filter(F.col("_n") <= limits.feed_stale_cycles + 2)
        .groupBy(F.lit(FEED).alias("ins_code"), "day")
        .agg(F.collect_list(F.struct("day", "ts", "feed_heven")).alias("feed_cycles"))
    )
    # A carried last row keeps the mark of a carried row.
    carried = F.col("_filled_ts") == F.col("_last_ts")
    mask = F.col("_row.quality_flags").bitwiseOR(
        F.when(F.coalesce(carried, F.lit(False)), fl.FORWARD_FILLED).otherwise(0)
    )
    row = F.when(
        F.col("_row").isNotNull(), F.col("_row").withField("quality_flags", mask.cast("int"))
    )
    return last.withColumn("_row", row).drop("_filled_ts").unionByName(recent, allowMissingColumns=True)
