"""Registered queries: every job on the shared test tables, each with an independent SQL text.

A query takes (spark, folder) and returns a DataFrame; ``sql`` is the same result for a
SQL engine, written from the definition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, folder: plain(fn(spark, folder))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def plain(df: DataFrame) -> DataFrame:
    """Types every engine has: wall-clock timestamps, 64-bit integers, rounded doubles."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def load_all() -> None:
    from navpulse.catalog import cycles, market, operations, payload_rows, texts, trades, validation  # noqa: F401
    from navpulse.catalog import jobs, streams  # noqa: F401  (uses texts registered above)
