"""Declared schemas of every stored table, in column order. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def _struct(columns: str) -> T.StructType:
    """Columns as "name type, ..."; needs no session, unlike a DDL string."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_RESPONSES = _struct(
    "fetched_at timestamp, run_id string, source string, endpoint string, ins_code string, "
    "status_code int, latency_ms int, attempts int, payload string"
)
RUNS = _struct(
    "run_id string, started_at timestamp, finished_at timestamp, tick timestamp, status string, "
    "requests int, failed int, expected_funds int, received_funds int, issues int, filled int, "
    "repaired int, note string"
)
FUNDS = _struct(
    "ins_code string, symbol string, name string, isin string, fund_type string, market string, "
    "board string, manager string, custodian string, is_active boolean, source string, "
    "updated_at timestamp"
)
FUND_UNITS = _struct("ins_code string, trade_date date, units long, updated_at timestamp")
FUND_TICKS = _struct(
    "ts timestamp, ins_code string, run_id string, last_price long, close_price long, "
    "open_price long, high_price long, low_price long, prev_close long, volume long, value long, "
    "trade_count long, block_volume long, block_value long, nav_redemption long, "
    "nav_subscription long, nav_at timestamp, bid_price long, bid_volume long, ask_price long, "
    "ask_volume long, ind_buy_volume long, ind_sell_volume long, inst_buy_volume long, "
    "inst_sell_volume long, ind_buy_value long, ind_sell_value long, inst_buy_value long, "
    "inst_sell_value long, ind_buy_count long, ind_sell_count long, inst_buy_count long, "
    "inst_sell_count long, quality_flags int, ingested_at timestamp"
)
MARKET_TICKS = _struct(
    "ts timestamp, run_id string, index_value double, index_change double, "
    "eq_index_value double, eq_index_change double, market_value double, state string, "
    "ingested_at timestamp"
)
FUND_HISTORY = _struct(
    "trade_date date, ins_code string, open_price long, high_price long, low_price long, "
    "close_price long, last_price long, prev_close long, volume long, value long, "
    "trade_count long, ind_buy_volume long, ind_sell_volume long, inst_buy_volume long, "
    "inst_sell_volume long, ind_buy_value long, ind_sell_value long, inst_buy_value long, "
    "inst_sell_value long, ind_buy_count long, ind_sell_count long, inst_buy_count long, "
    "inst_sell_count long, updated_at timestamp"
)
FUND_EOD = _struct(
    "ins_code string, trade_date date, last_ts timestamp, close_price long, value long, "
    "nav_redemption long, ind_net_value long"
)
REBUILT_TICKS = _struct(
    "ts timestamp, ins_code string, last_price long, volume long, value long, trade_count long, "
    "ingested_at timestamp"
)
REBUILD_LOG = _struct(
    "day date, ins_code string, status string, overlap long, matched long, minutes long, "
    "note string, recorded_at timestamp"
)
FUND_STATE = _struct(
    "ts timestamp, ins_code string, code string, title string, under_supervision long, "
    "ingested_at timestamp"
)
MARKET_DAYS = _struct("day date, trading boolean, note string, recorded_at timestamp")
ISSUES = _struct(
    "ts timestamp, run_id string, ins_code string, check string, severity string, "
    "action string, detail string"
)

TICK_COLUMNS = FUND_TICKS.names

# Version columns of the tables in which the newest row of a key wins.
LATEST_WINS = {
    "funds": (["ins_code"], ["updated_at"]),
    "fund_units": (["ins_code", "trade_date"], ["updated_at"]),
    "fund_ticks": (["ins_code", "ts"], ["ingested_at"]),
    "market_ticks": (["ts"], ["ingested_at"]),
    "fund_history": (["ins_code", "trade_date"], ["updated_at"]),
    "rebuilt_ticks": (["ins_code", "ts"], ["ingested_at"]),
    "rebuild_log": (["day", "ins_code"], ["recorded_at"]),
    "fund_state": (["ins_code", "ts"], ["ingested_at"]),
    "market_days": (["day"], ["recorded_at"]),
}
