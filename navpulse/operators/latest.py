"""Newest row per key.

Both forms are one grouped ``max_by``: each map task keeps a single candidate per key, so
a key that holds most of the rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def latest_version(
    df: DataFrame, keys: Sequence[str], version: Sequence[str | Column]
) -> DataFrame:
    """One row per key: the one with the highest version, all columns kept in order."""
    order = [F.col(v) if isinstance(v, str) else v for v in version]
    ranking = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), ranking).alias("_row")
    return df.groupBy(*keys).agg(best).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def last_known(value: Column | str, order: Column) -> Column:
    """Aggregate: the newest value that is not null."""
    v = F.col(value) if isinstance(value, str) else value
    return F.max_by(v, F.when(v.isNotNull(), order))
