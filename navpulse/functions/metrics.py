"""Financial ratios. Money is integer Rials; an undefined ratio is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TRADING_DAYS_PER_YEAR = 252
MIN_CLOSES = 5

# Magnitudes of the display units, in Rials.
RIALS_PER_TOMAN = 10
RIALS_PER_MILLION_TOMAN = 10**7
RIALS_PER_MILLIARD_TOMAN = 10**10
RIALS_PER_HEMAT = 10**13


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """Neither null nor zero."""
    return F.coalesce(_col(c) != 0, F.lit(False))


def pct_change(current: Column | str, reference: Column | str) -> Column:
    cur, ref = _col(current), _col(reference)
    return F.when(present(cur) & present(ref), cur.cast("double") / ref.cast("double") - 1)


def nav_premium(price: Column | str, nav: Column | str, fund_type: Column | str) -> Column:
    """Price over NAV; undefined for leveraged funds, whose published NAV is of other units."""
    return F.when(F.coalesce(_col(fund_type), F.lit("")) != "leveraged", pct_change(price, nav))


def aum(nav: Column | str, units: Column | str) -> Column:
    n, u = _col(nav), _col(units)
    return F.when(present(n) & present(u), n.cast("long") * u.cast("long"))


def net_flow(buy_value: Column | str, sell_value: Column | str) -> Column:
    return _col(buy_value) - _col(sell_value)


def per_capita(value: Column | str, count: Column | str) -> Column:
    v, n = _col(value), _col(count)
    return F.when(n > 0, v.cast("double") / n.cast("double"))


def buyer_power(buy_value, buy_count, sell_value, sell_count) -> Column:
    """Average buy ticket over average sell ticket."""
    buy, sell = per_capita(buy_value, buy_count), per_capita(sell_value, sell_count)
    return F.when(buy.isNotNull() & present(sell), buy / sell)


def turnover(value: Column | str, net_assets: Column | str) -> Column:
    v, a = _col(value), _col(net_assets)
    return F.when(present(a), v.cast("double") / a.cast("double"))


def average_price(volume, value, close, prev_close) -> Column:
    """Traded average, else the close, else the previous close."""
    vol, val, c = _col(volume), _col(value), _col(close)
    reference = F.coalesce(F.nullif(c, F.lit(0)), _col(prev_close))
    return F.when((vol > 0) & (val > 0), val.cast("double") / vol.cast("double")).otherwise(
        reference.cast("double")
    )


def flow_estimate(volume: Column | str, price: Column | str) -> Column:
    """Volume at the average price, rounded half to even."""
    return F.rint(_col(volume).cast("double") * _col(price)).cast("long")


def index_fraction(level: Column | str, change: Column | str) -> Column:
    """Change in points as a fraction of the previous level."""
    v, c = _col(level), _col(change)
    return F.try_divide(c, v - c)


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Aggregate: pairs with a missing side or a weight of zero or less do not count.

    Integer weights are summed as integers, so the result does not depend on row order
    through the denominator.
    """
    v, w = _col(value), _col(weight)
    used = v.isNotNull() & (w > 0)
    return F.try_divide(F.sum(F.when(used, v * w)), F.sum(F.when(used, w)).cast("double"))


def share_of(part: Column | str, total: Column | str) -> Column:
    p, t = _col(part), _col(total)
    return F.when(present(p) & present(t), p.cast("double") / t.cast("double"))


def clamp(value: Column | str, low: float, high: float) -> Column:
    v = _col(value)  # least and greatest would skip a null
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def clipped_scale(value: Column | str, limit: Column | str) -> Column:
    """Value over limit, clipped to [-1, 1]; a missing value is the middle."""
    scaled = F.coalesce(_col(value) / _col(limit), F.lit(0.0))
    return clamp(scaled, -1.0, 1.0)


def money_quadrant(premium: Column | str, flow: Column | str) -> Column:
    """Which corner of the money/valuation map a fund is in; an axis belongs to no corner."""
    p, f = _col(premium), _col(flow)
    return (
        F.when((p > 0) & (f > 0), "inflow_at_premium")
        .when((p < 0) & (f > 0), "inflow_at_discount")
        .when((p < 0) & (f < 0), "outflow_at_discount")
        .when((p > 0) & (f < 0), "outflow_at_premium")
        .otherwise("on_axis")
    )


def risk_quadrant(volatility, period_return, mid_volatility) -> Column:
    v, r, m = _col(volatility), _col(period_return), _col(mid_volatility)
    calm = F.when(v <= m, "calm").otherwise("bumpy")
    return F.concat_ws("_", calm, F.when(r >= 0, "gain").otherwise("loss"))


def display_money(rials: Column | str) -> Column:
    """Struct(value, unit): the figure in the largest Toman unit it reaches."""
    v = _col(rials)
    size = F.abs(v)

    def scaled(by: int, unit: str) -> Column:
        return F.struct((v / F.lit(by)).alias("value"), F.lit(unit).alias("unit"))

    return (
        F.when(size >= RIALS_PER_HEMAT, scaled(RIALS_PER_HEMAT, "hemat"))
        .when(size >= RIALS_PER_MILLIARD_TOMAN, scaled(RIALS_PER_MILLIARD_TOMAN, "milliard"))
        .when(size >= RIALS_PER_MILLION_TOMAN, scaled(RIALS_PER_MILLION_TOMAN, "million"))
        .when(v.isNotNull(), scaled(RIALS_PER_TOMAN, "toman"))
    )
