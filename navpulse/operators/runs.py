"""Runs of a condition over ordered rows: streaks, first rows of an episode, sustained time.

Rows are cut into blocks (a day, usually); a block is scanned by itself and what it
inherits from earlier blocks comes from one summary row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F


def rising_edge(condition: Column, window: WindowSpec) -> Column:
    """True where an episode starts: the condition holds and did not hold when last judged.

    A null condition is "not judged": it neither starts nor ends an episode.
    """
    earlier = F.last(condition, ignorenulls=True).over(
        window.rowsBetween(W.unboundedPreceding, -1)
    )
    return F.coalesce(condition & ~F.coalesce(earlier, F.lit(False)), F.lit(False))


def streaks(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str],
    condition: Column,
    since: str | None = None,
) -> DataFrame:
    """Adds ``streak``: rows of the current unbroken run of the condition (0 outside one).

    ``since`` names a time column; then ``run_start`` is its value at the first row of the
    run. Order must be total within a block, and blocks must follow the order. A block is
    scanned in one task: choose one whose rows are bounded (a day of one row per minute).
    """
    keys = list(keys)
    scope = [*keys, block]
    marked = df.withColumn("_hit", F.coalesce(condition, F.lit(False)))
    ordered = W.partitionBy(*scope).orderBy(*order)
    so_far = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = marked.withColumn(
        "_breaks", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(so_far)
    )
    run = W.partitionBy(*scope, "_breaks").orderBy(*order)
    run_so_far = run.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = numbered.withColumn(
        "_len", F.sum(F.when(F.col("_hit"), 1).otherwise(0)).over(run_so_far)
    )
    if since:
        local = local.withColumn(
            "_from", F.min(F.when(F.col("_hit"), F.col(since))).over(run_so_far)
        )
    # What a block hands on is the run it ends with; a block without a break also passes
    # on what it received.
    position = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    tails = local.groupBy(*scope).agg(
        (F.max("_breaks") > 0).alias("_broken"),
        F.max_by("_len", position).alias("_tail"),
        *([F.max_by("_from", position).alias("_tail_from")] if since else []),
    )
    across = W.partitionBy(*keys).orderBy(block) if keys else W.partitionBy(F.lit(0)).orderBy(block)
    group = tails.withColumn(
        "_g",
        F.sum(F.when(F.col("_broken"), 1).otherwise(0)).over(
            across.rowsBetween(W.unboundedPreceding, W.currentRow)
        ),
    )
    in_group = (
        W.partitionBy(*keys, "_g")
        .orderBy(block)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    carried = group.withColumn("_open", F.sum("_tail").over(in_group))
    if since:
        carried = carried.withColumn("_open_from", F.min("_tail_from").over(in_group))
    carried = carried.select(
        *scope,
        F.lag("_open").over(across).alias("_carry"),
        *([F.lag("_open_from").over(across).alias("_carry_from")] if since else []),
    )
    inherits = F.col("_hit") & (F.col("_breaks") == 0)
    out = local.join(carried, scope).withColumn(
        "streak",
        (
            F.col("_len") + F.when(inherits, F.coalesce(F.col("_carry"), F.lit(0))).otherwise(0)
        ).cast("long"),
    )
    columns = [*df.columns, "streak"]
    if since:
        out = out.withColumn(
            "run_start",
            F.when(
                F.col("_hit"),
                F.coalesce(
                    F.when(inherits & (F.col("_carry") > 0), F.col("_carry_from")), F.col("_from")
                ),
            ),
        )
        columns.append("run_start")
    return out.select(*columns)
