"""Exact positions in a large sorted set, without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from navpulse.session import freeze

SKETCH_ACCURACY = 10_000
BRACKET = 0.001
#: A group's values are put in order once there are no more distinct ones than this.
ORDERED = 100_000
SLICES = 64


def values_at_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    fraction: float,
    ranks: dict[str, Column],
    ordered: int = ORDERED,
) -> DataFrame:
    """Per key: ``n`` (values that are not null) and the value at each 1-based rank.

    ``ranks`` maps an output name to an expression over ``n``; every rank must lie next to
    ``fraction * n``. A sketch (bounded, merged map-side) brackets the wanted position,
    one grouped pass counts what lies below the bracket and tallies the distinct values
    inside it (about 0.2 % of a group). While a group still has more than ``ordered``
    distinct values there, they are cut into slices, the slices counted, and only those that
    hold a wanted rank kept; what is left is put in order. A rank outside its bracket raises;
    it never gives a neighbouring value.
    """
    keys = list(keys) or ["_all"]
    v = F.col(value) if isinstance(value, str) else value
    base = df.withColumn("_all", F.lit(1)).select(*keys, v.alias("_v"))
    base = base.filter(F.col("_v").isNotNull())
    low, high = max(fraction - BRACKET, 0.0), min(fraction + BRACKET, 1.0)
    # Frozen, because the counts below rely on one and the same bracket; being a written
    # table also gives the optimizer its true size when it picks the join.
    bounds = freeze(
        base.groupBy(*keys)
        .agg(F.percentile_approx("_v", [low, high], SKETCH_ACCURACY).alias("_b"))
        .select(*keys, F.col("_b")[0].alias("_low"), F.col("_b")[1].alias("_high"))
    )
    tally = freeze(
        base.join(bounds, keys)
        .select(
            *keys,
            F.when(F.col("_v").between(F.col("_low"), F.col("_high")), F.col("_v")).alias("_in"),
            (F.col("_v") < F.col("_low")).alias("_is_below"),
        )
        .groupBy(*keys, "_in")
        .agg(F.count("*").alias("_cnt"), F.count_if("_is_below").alias("_below"))
    )
    while (_sizes(tally, keys).agg(F.max("_distinct")).first()[0] or 0) > ordered:
        tally = freeze(_narrowed(tally, keys, ranks))
    whole = W.partitionBy(*keys)
    upto = whole.orderBy(F.col("_in").asc_nulls_first()).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    inside = F.when(F.col("_in").isNotNull(), F.col("_cnt")).otherwise(0)
    placed = tally.select(
        *keys,
        "_in",
        F.sum("_cnt").over(whole).alias("n"),
        F.sum("_below").over(whole).alias("_base"),
        F.sum(inside).over(whole).alias("_inside"),
        F.sum(inside).over(upto).alias("_upto"),
    )

    def pick(rank: Column) -> Column:
        hit = (F.col("_base") + F.col("_upto") >= rank) & F.col("_in").isNotNull()
        outside = (rank <= F.col("_base")) | (rank > F.col("_base") + F.col("_inside"))
        guarded = F.when(outside, F.raise_error(F.lit("rank outside its bracket"))).otherwise(
            F.when(hit, F.col("_in"))
        )
        return F.min(guarded)

    out = placed.groupBy(*keys).agg(
        F.max("n").alias("n"), *[pick(rank).alias(name) for name, rank in ranks.items()]
    )
    return out.drop("_all") if keys == ["_all"] else out


def _sizes(tally: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: values in all, values below the bracket, and distinct values inside it."""
    return tally.groupBy(*keys).agg(
        F.sum("_cnt").alias("n"), F.sum("_below").alias("_base"), F.count("_in").alias("_distinct")
    )


def _narrowed(tally: DataFrame, keys: Sequence[str], ranks: dict[str, Column]) -> DataFrame:
    """The tally with only those slices of its bracket that hold a wanted rank.

    Slices are about equal in distinct values; a key has at most SLICES of them, so adding
    them up in order is a small window.
    """
    parts = [k / SLICES for k in range(1, SLICES)]
    cuts = tally.filter(F.col("_in").isNotNull()).groupBy(*keys).agg(
        F.percentile_approx("_in", parts, SKETCH_ACCURACY).alias("_cuts")
    )
    slice_of = F.size(F.filter("_cuts", lambda c: c < F.col("_in")))
    sliced = tally.join(cuts, keys, "left").withColumn("_slice", F.when(F.col("_in").isNotNull(), slice_of))
    sliced = sliced.drop("_cuts")
    counts = sliced.filter(F.col("_slice").isNotNull()).groupBy(*keys, "_slice").agg(F.sum("_cnt").alias("_c"))
    upto = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = counts.withColumn("_upto", F.sum("_c").over(upto)).join(_sizes(tally, keys), keys)
    to = F.col("_base") + F.col("_upto")
    wanted = F.lit(False)
    for rank in ranks.values():
        wanted = wanted | ((rank > to - F.col("_c")) & (rank <= to))
    kept = placed.filter(wanted).groupBy(*keys).agg(F.min("_slice").alias("_from"), F.max("_slice").alias("_to"))
    joined = sliced.join(kept, keys, "left")
    stays = F.coalesce(F.col("_slice").between(F.col("_from"), F.col("_to")), F.lit(False))
    below = F.when(F.col("_slice").isNull(), F.col("_below")).when(F.col("_slice") < F.col("_from"), F.col("_cnt"))
    moved = joined.select(
        *keys, F.when(stays, F.col("_in")).alias("_in"), "_cnt", F.coalesce(below, F.lit(0)).alias("_below")
    )
    return moved.groupBy(*keys, "_in").agg(F.sum("_cnt").alias("_cnt"), F.sum("_below").alias("_below"))


def exact_median(df: DataFrame, keys: Sequence[str], value: Column | str) -> DataFrame:
    """Median (mean of the two middle values) of groups that may be very large."""
    n = F.col("n")
    found = values_at_ranks(
        df,
        keys,
        value,
        0.5,
        {"_lo": F.floor((n + 1) / 2), "_hi": F.floor(n / 2) + 1},
    )
    return found.withColumn("median", (F.col("_lo") + F.col("_hi")) / 2.0).drop("_lo", "_hi")


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Adds the 1-based position of each row in the given total order.

    Rows are range-partitioned, so equal leading values split over tasks by the columns
    after them; each slice is ranked by itself and shifted by the sizes of the slices
    before it. The slices are frozen so that sizes and rows agree after a lost executor.
    """
    sliced = freeze(
        df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())
    )
    sizes = sliced.groupBy("_slice").agg(F.count("*").alias("_size"))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(  # one row per slice
        "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    local = F.row_number().over(W.partitionBy("_slice").orderBy(*order))
    return (
        sliced.withColumn("_local", local)
        .join(offsets, "_slice")
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .select(*df.columns, name)
    )
