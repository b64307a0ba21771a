"""As-of lookup: for each probe, the newest fact at or before its time.

Work is cut into blocks of time, so that no window group grows with one key's history:

1. facts collapse to one row per key and time (map-side), probes to distinct key and time;
2. each (key, block) is scanned by itself; a group holds at most two rows per time step;
3. what a block inherits comes from one summary row per (key, block), scanned per key.

The blocks of a key are few (the span of the data over the block width), whatever the
number of rows. Probes that share a key and time are joined back by equality, which AQE
can split when one of them is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def asof_lookup(
    probes: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    probe_time: str,
    fact_time: str,
    values: Sequence[str],
    block: Column,
    *,
    version: Sequence[str] = (),
    distinct_probes: bool = False,
    forward_fallback: bool = False,
) -> DataFrame:
    """``probes`` with ``values`` of the newest fact whose time is not later.

    ``block`` is an expression over a column named ``_t`` (the time of either side) that
    never falls as time grows. ``version`` decides between facts of equal key and time.
    With ``forward_fallback`` a probe before its key's first fact takes that first fact.
    ``distinct_probes`` says that no two probes share key and time.
    """
    keys = list(keys)
    ranking = F.struct(*[F.col(v) for v in version]) if version else F.lit(1)
    facts_1 = (
        facts.select(*keys, F.col(fact_time).alias("_t"), *values, *_extra(version, values, keys))
        .filter(F.col("_t").isNotNull())
        .groupBy(*keys, "_t")
        .agg(F.max_by(F.struct(*values), ranking).alias("_fact"))
        .withColumn("_probe", F.lit(0))
    )
    fact_type = facts_1.schema["_fact"].dataType
    wanted = probes.select(*keys, F.col(probe_time).alias("_t")).filter(F.col("_t").isNotNull())
    if not distinct_probes:
        wanted = wanted.distinct()
    both = facts_1.unionByName(
        wanted.withColumn("_fact", F.lit(None).cast(fact_type)).withColumn("_probe", F.lit(1))
    ).withColumn("_block", block)

    summary = both.groupBy(*keys, "_block").agg(
        F.max_by("_fact", F.when(F.col("_fact").isNotNull(), F.col("_t"))).alias("_newest"),
        F.min_by("_fact", F.when(F.col("_fact").isNotNull(), F.col("_t"))).alias("_oldest"),
    )
    across = W.partitionBy(*keys).orderBy("_block")
    before = across.rowsBetween(W.unboundedPreceding, -1)
    inherited = summary.select(
        *keys,
        "_block",
        F.last("_newest", ignorenulls=True).over(before).alias("_inherited"),
        F.first("_oldest", ignorenulls=True)
        .over(across.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        .alias("_first"),
    )
    within = (
        W.partitionBy(*keys, "_block")
        .orderBy("_t", "_probe")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    found = (
        both.join(inherited, [*keys, "_block"])
        .withColumn("_here", F.last("_fact", ignorenulls=True).over(within))
        .filter(F.col("_probe") == 1)
    )
    choices = [F.col("_here"), F.col("_inherited")]
    if forward_fallback:
        choices.append(F.col("_first"))
    answer = found.select(*keys, F.col("_t").alias(probe_time), F.coalesce(*choices).alias("_hit"))
    picked = [F.col(f"_hit.{v}").alias(v) for v in values]
    joined = probes.join(answer, [*keys, probe_time], "left")
    return joined.select(*probes.columns, *picked)


def _extra(version: Sequence[str], values: Sequence[str], keys: Sequence[str]) -> list[str]:
    return [v for v in version if v not in values and v not in keys]


def day_block(days: int = 32) -> Column:
    """Blocks of so many days over a date."""
    return F.floor(F.unix_date(F.col("_t")) / days)


def number_block(width: int) -> Column:
    return F.floor(F.col("_t") / width)
