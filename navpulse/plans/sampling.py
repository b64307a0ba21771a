"""A stratified sample of funds and figures extrapolated from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from navpulse.operators.ranking import global_rank
from navpulse.session import freeze


def stratified_sample(
    funds: DataFrame, size: int, busiest: int = 10, by: str = "trade_count", tie: str = "ins_code"
) -> DataFrame:
    """The busiest funds, then the rest at evenly spread ranks.

    Whether a rank is picked follows from the rank and the number of funds alone, so rows
    are kept or dropped where they are.
    """
    ranked = global_rank(funds, [F.col(by).desc(), F.col(tie)])
    total = ranked.agg(F.max("rank").alias("_n"), F.lit(1).alias("_k"))  # one row
    head = min(busiest, size)
    k = size - head
    rows = ranked.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k")
    place = F.col("rank") - head - 1  # position among the rest, from 0
    step = (F.col("_n") - head - 1).cast("double") / max(k - 1, 1)
    slot = F.bround(place / F.nullif(step, F.lit(0.0)))
    # Rounding may put two slots on one rank or shift it by one, so neighbours are tried.
    on_slot = F.lit(False)
    for shift in (-1, 0, 1):
        s = F.coalesce(slot, F.lit(0.0)) + shift
        on_slot = on_slot | ((s >= 0) & (s <= k - 1) & (F.bround(s * step) == place))
    chosen = (F.col("_n") <= size) | (F.col("rank") <= head)
    if k > 0:
        chosen = chosen | ((place >= 0) & on_slot)
    return rows.filter(chosen).select(*funds.columns, "rank")


def interpolate(
    df: DataFrame, x: str, points: DataFrame, px: str = "x", py: str = "y", cells: int | None = None
) -> DataFrame:
    """Adds ``y``: piecewise linear through the points, constant beyond both ends.

    The points are one probe's sample with distinct x; without points, or for a null x, y is
    null. Rows and segments are dealt to cells of equal depth, each finds the last segment
    that starts before it in its cell, and one summary row a cell carries the segment that
    reaches in from the left. So points may lie as close together as they like, and a value
    that very many rows share lies in several cells.
    """
    pts = points.select(F.col(px).cast("double").alias("x"), F.col(py).cast("double").alias("y")).filter("x IS NOT NULL")
    ends = pts.agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min_by("y", "x").alias("_y0"), F.max_by("y", "x").alias("_y1")
    ).withColumn("_k", F.lit(1))  # one row
    dealt = equal_cells(df, x, segments(pts), cells or 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = dealt.filter("_kind = 1").groupBy("_cell").agg(F.max(F.struct("_at", "_segment")).alias("_own"))
    number = dealt.select("_cell").distinct().join(own, "_cell", "left")  # a row a cell
    left = W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    carried = number.select("_cell", F.last("_own", ignorenulls=True).over(left)["_segment"].alias("_carried"))
    before = W.partitionBy("_cell").orderBy("_at", "_kind", "_salt").rowsBetween(W.unboundedPreceding, -1)
    found = dealt.withColumn("_last", F.last("_segment", ignorenulls=True).over(before)).filter("_kind = 0")
    found = found.join(F.broadcast(carried), "_cell", "left").withColumn("_k", F.lit(1)).join(F.broadcast(ends), "_k")
    line, at = F.coalesce("_last", "_carried"), F.col("_at")
    slope = (line["y1"] - line["y0"]) / (line["x1"] - line["x0"])
    value = (
        F.when(at <= F.col("_x0"), F.col("_y0"))
        .when(at > F.col("_x1"), F.col("_y1"))
        .otherwise(line["y0"] + slope * (at - line["x0"]))
    )
    return found.select("_row.*", value.alias("y"))


def equal_cells(df: DataFrame, x: str, lines: DataFrame, cells: int) -> DataFrame:
    """Rows of ``df`` (_kind 0) and segments (_kind 1) in order of x, cut into ranges of about equal depth.

    At the same x rows come before segments, and rows are told apart by a running number, so
    that a cut can lie between equal values. Written to the shared folder, because the
    ranges come from a sample and must not change.
    """
    row = F.struct(*[df[c] for c in df.columns])
    rows = df.select(
        F.col(x).cast("double").alias("_at"), F.lit(0).alias("_kind"), F.monotonically_increasing_id().alias("_salt"), row.alias("_row")
    )
    starts = lines.select(
        F.col("x0").alias("_at"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_salt"), F.struct("x0", "y0", "x1", "y1").alias("_segment")
    )
    both = rows.unionByName(starts, allowMissingColumns=True).repartitionByRange(cells, "_at", "_kind", "_salt")
    return freeze(both.withColumn("_cell", F.spark_partition_id()))


def segments(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Consecutive points as rows (x0, y0, x1, y1): each meets the one of the next rank, by a join."""
    ranked = global_rank(points.select(F.col(x).alias("x0"), F.col(y).alias("y0")), [F.col("x0")], "_rank")
    following = ranked.select((F.col("_rank") - 1).alias("_rank"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    return ranked.join(following, "_rank").select("x0", "y0", "x1", "y1")
