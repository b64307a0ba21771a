"""Official daily history: prices and investor flows joined by trading date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from navpulse import schemas
from navpulse.functions import times
from navpulse.operators.latest import latest_version
from navpulse.session import freeze
from navpulse.sources import payloads, sinks

FLOW_COLUMNS = tuple(
    f"{who}_{side}_{what}"
    for what in ("volume", "value", "count")
    for who in ("ind", "inst")
    for side in ("buy", "sell")
)


def merge_history(prices: DataFrame, flows: DataFrame, days: int) -> DataFrame:
    """The newest ``days`` trading days of each fund, with flows where there are any.

    Both inputs have ins_code and deven (YYYYMMDD). A day without a flow row has zero
    flows; a flow row without prices is dropped. Where flows repeat a day, the last one in
    the payload counts. The rank limit is applied before the shuffle.
    """
    usable = prices.filter((F.col("deven") > 0) & (F.col("volume") >= 0))
    newest = W.partitionBy("ins_code").orderBy(F.col("deven").desc(), F.col("position"))
    top = usable.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= days)
    flow_1 = latest_version(
        flows.select("ins_code", "deven", "position", *FLOW_COLUMNS),
        ["ins_code", "deven"], ["position"],
    ).drop("position")
    joined = top.join(flow_1, ["ins_code", "deven"], "left")
    zero = F.lit(0).cast("long")
    filled = {c: F.coalesce(F.col(c), zero) for c in FLOW_COLUMNS}
    return joined.withColumns(filled).withColumn("trade_date", times.compact_date("deven"))


def history_rows(
    prices: DataFrame, flows: DataFrame, days: int, updated_at: str
) -> DataFrame:
    """Merged history in the stored columns."""
    merged = merge_history(prices, flows, days)
    stamped = merged.withColumn("updated_at", F.lit(updated_at).cast("timestamp"))
    return stamped.select(*schemas.FUND_HISTORY.names)


def failed_funds(raw: DataFrame) -> DataFrame:
    """Funds whose price history could not be read; the others are written all the same."""
    bad = payloads.errors(raw.filter(F.col("endpoint") == "daily_history"))
    return bad.select("ins_code", "error")


def sync(raw: DataFrame, days: int, updated_at: str, table: str) -> DataFrame:
    """Read, merge and append the histories of all funds; one row a fund: rows written, error.

    ``raw``: price and client histories of one sync. A fund whose prices were not answered, or of
    which an answer cannot be read, gets no rows and does not stop the others; one whose
    client history was not answered gets its prices alone.
    """
    prices, flows = F.col("endpoint") == "daily_history", F.col("endpoint") == "client_type_history"
    judged = raw.filter(prices | (flows & F.col("status_code").between(200, 299)))
    failed = freeze(payloads.errors(judged).groupBy("ins_code").agg(F.min("error").alias("error")))
    named = ("ins_code",)

    def read(endpoint: str) -> DataFrame:
        return payloads.parse(raw, endpoint, named).join(failed, "ins_code", "left_anti")

    rows = freeze(history_rows(read("daily_history"), read("client_type_history"), days, updated_at))
    sinks.append(rows, table)
    written = rows.groupBy("ins_code").agg(F.count("*").alias("rows"))
    asked = raw.filter(prices).select("ins_code").distinct()
    made = asked.join(written, "ins_code", "left").join(failed, "ins_code", "left")
    return made.select("ins_code", F.coalesce("rows", F.lit(0)).alias("rows"), "error")
