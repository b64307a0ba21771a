"""Tables behind the charts: pivots, top lists, hierarchies, limits and quadrants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from navpulse.functions import metrics, text
from navpulse.operators.ranking import exact_median, values_at_ranks

HEAT_FLOOR = 0.005
RETURN_COLUMNS = ("r_1d", "r_1w", "r_1m", "r_3m", "r_ytd")


def flows_pivot(
    flows: DataFrame, types: Sequence[str] = text.EQUITY_FAMILY, value: str = "ind_net_flow"
) -> DataFrame:
    """Day by type with a total. The types are given, so no extra pass looks for them."""
    wide = flows.groupBy("trade_date").pivot("fund_type", list(types)).agg(F.sum(value))
    filled = wide.fillna(0, list(types))
    total = sum((F.col(t) for t in types[1:]), F.col(types[0]))
    return filled.withColumn("total", total)


def returns_unpivot(returns: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per fund and horizon, empty cells included."""
    return returns.select(*ids, *RETURN_COLUMNS).unpivot(
        list(ids), list(RETURN_COLUMNS), "horizon", "r"
    )


def heat_limits(cells: DataFrame, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Per horizon the absolute return at sorted position floor(0.9 n), not below a floor.

    Position counts from 0, an empty cell counts as 0.
    """
    size = F.abs(F.coalesce("r", F.lit(0.0)))
    found = values_at_ranks(cells, keys, size, 0.9, {"_at": F.floor(F.col("n") * 9 / 10) + 1})
    return found.select(*keys, F.greatest(F.lit(HEAT_FLOOR), F.col("_at")).alias("limit"))


def heat_cells(cells: DataFrame, limits: DataFrame) -> DataFrame:
    """Each cell scaled by its horizon's limit to [-1, 1]."""
    return cells.join(limits, "horizon").withColumn("heat", metrics.clipped_scale("r", "limit"))


def type_medians(rows: DataFrame, value: str = "premium", key: str = "fund_type") -> DataFrame:
    """Exact median per type; types are few and may be huge, so no type meets one task."""
    return exact_median(rows, [key], value)


def hierarchy(snap: DataFrame, parents: Sequence[str], leaf: str, size: str) -> DataFrame:
    """Totals of every leaf, of every parent, and of everything."""
    rows = snap.filter(metrics.present(size))
    levels = [*parents, leaf]
    depth = F.lit(len(levels)).cast("long") - sum(
        (F.grouping(c).cast("long") for c in levels[1:]), F.grouping(levels[0]).cast("long")
    )
    return rows.rollup(*levels).agg(
        depth.alias("depth"), F.sum(size).alias("size"), F.count("*").alias("members")
    )


def money_map(snap: DataFrame, edge: float = 0.1) -> DataFrame:
    """Premium (clamped) against flow as a share of net assets, with its quadrant."""
    rows = snap.filter(F.col("premium").isNotNull() & metrics.present("aum"))
    share = F.col("ind_net_flow").cast("double") / F.col("aum")
    return rows.withColumns(
        {
            "x": metrics.clamp("premium", -edge, edge),
            "y": share,
            "quadrant": metrics.money_quadrant("premium", "ind_net_flow"),
        }
    )


def risk_map(risk: DataFrame, mid_volatility: float) -> DataFrame:
    rows = risk.filter(F.col("volatility").isNotNull() & F.col("period_return").isNotNull())
    return rows.withColumn(
        "quadrant",
        metrics.risk_quadrant("volatility", "period_return", F.lit(mid_volatility)),
    )


def searched(snap: DataFrame, needle: str) -> DataFrame:
    return snap.filter(text.matches_search(needle, "symbol", "name")) if needle.strip() else snap


def table_order(key: str, descending: bool = True) -> list[Column]:
    """Order of the fund table by any column, empty values last either way."""
    c = F.col(key)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("ins_code").asc()]


def sorted_table(snap: DataFrame, key: str, descending: bool = True, needle: str = "") -> DataFrame:
    """The fund table: searched, sorted by any column, empty values last either way."""
    return searched(snap, needle).orderBy(*table_order(key, descending))


def returns_of_largest(returns: DataFrame, snap: DataFrame, k: int = 25) -> DataFrame:
    """Returns of the k equity funds with the most net assets."""
    sizes = snap.filter(text.in_equity_family("fund_type")).select(
        "ins_code", F.coalesce("aum", F.lit(0)).alias("_size")
    )
    return returns.join(sizes, "ins_code").orderBy(F.col("_size").desc(), "ins_code").limit(k)
