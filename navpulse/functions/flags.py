"""Quality flags: a bitmask per row, append-only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Bit of each flag in the stored mask.
NAV_MISSING = 2
NAV_STALE = 4
CLIENT_TYPE_MISSING = 8
FLOW_VALUE_ESTIMATED = 16
NO_TRADES = 32
PRICE_OUT_OF_RANGE = 64
CUMULATIVE_DECREASE = 128
FORWARD_FILLED = 256
STALE_QUOTE = 512
CLIENT_VOLUME_MISMATCH = 1024
NAV_CARRIED = 2048
NAV_JUMP = 4096
RANGE_REPAIRED = 8192

# Flag name, bit, and how a reader should take it.
FLAGS: tuple[tuple[str, int, str], ...] = (
    ("NAV_MISSING", NAV_MISSING, "warn"),
    ("NAV_STALE", NAV_STALE, "info"),
    ("CLIENT_TYPE_MISSING", CLIENT_TYPE_MISSING, "warn"),
    ("FLOW_VALUE_ESTIMATED", FLOW_VALUE_ESTIMATED, "info"),
    ("NO_TRADES", NO_TRADES, "info"),
    ("PRICE_OUT_OF_RANGE", PRICE_OUT_OF_RANGE, "warn"),
    ("CUMULATIVE_DECREASE", CUMULATIVE_DECREASE, "repair"),
    ("FORWARD_FILLED", FORWARD_FILLED, "repair"),
    ("STALE_QUOTE", STALE_QUOTE, "warn"),
    ("CLIENT_VOLUME_MISMATCH", CLIENT_VOLUME_MISMATCH, "warn"),
    ("NAV_CARRIED", NAV_CARRIED, "repair"),
    ("NAV_JUMP", NAV_JUMP, "warn"),
    ("RANGE_REPAIRED", RANGE_REPAIRED, "repair"),
)


def has_flag(mask: Column | str, bit: int) -> Column:
    m = F.col(mask) if isinstance(mask, str) else mask
    return m.bitwiseAND(F.lit(bit)) != 0


def bit_when(condition: Column, bit: int) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(bit)).otherwise(F.lit(0))


def combine(*masks: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), masks)


def flag_names(mask: Column | str) -> Column:
    named = [F.when(has_flag(mask, bit), F.lit(name)) for name, bit, _ in FLAGS]
    return F.array_compact(F.array(*named))


def flag_kind(name: Column | str) -> Column:
    n = F.col(name) if isinstance(name, str) else name
    table = F.create_map(*[F.lit(x) for flag, _, kind in FLAGS for x in (flag, kind)])
    return F.coalesce(F.try_element_at(table, n), F.lit("warn"))
