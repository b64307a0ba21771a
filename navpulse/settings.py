"""Thresholds and market hours, with the defaults of the exchange."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class MarketHours:
    """Session bounds (both ends included) and the weekdays on which the market trades.

    Weekdays count from Monday = 0, as Spark's ``weekday`` does. The default week is
    Saturday to Wednesday.
    """

    opens: dt.time = dt.time(9, 0)
    closes: dt.time = dt.time(12, 30)
    weekdays: tuple[int, ...] = (0, 1, 2, 5, 6)
    extra_closures: dict[dt.date, str] = field(default_factory=dict)
    use_holidays: bool = True
    guard_minutes: int = 20

    @property
    def open_second(self) -> int:
        return self.opens.hour * 3600 + self.opens.minute * 60 + self.opens.second

    @property
    def close_second(self) -> int:
        return self.closes.hour * 3600 + self.closes.minute * 60 + self.closes.second


@dataclass(frozen=True)
class ValidationLimits:
    nav_stale_minutes: int = 20
    nav_jump_ratio: float = 0.10
    client_mismatch_ratio: float = 0.02
    max_gap_minutes: int = 30
    feed_stale_cycles: int = 3


@dataclass(frozen=True)
class BackfillLimits:
    tolerance: float = 0.01
    min_match: float = 0.9
