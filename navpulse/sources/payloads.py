"""Typed rows from archived JSON responses.

Each payload is described by its envelope key and fields; one ``from_json`` with declared
types reads it. The provider writes integers as ``157502.0`` or ``157502``, both of which a
double takes, but also in quotes or as an empty string: only such responses are read again
as text, and converted afterwards. A response that cannot be read becomes an error row
and never fails the batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from navpulse.functions import times
from navpulse.functions.text import clean_code, normalize_text


@dataclass(frozen=True)
class Payload:
    envelope: str
    fields: tuple[tuple[str, str, str], ...]  # column, JSON name, kind
    many: bool = True
    inner: str | None = None  # nested object that holds the fields
    levels: tuple[tuple[str, str, str], ...] = ()  # fields of the order-book levels
    levels_name: str = ""
    optional: bool = False  # a null body is no row instead of an error


# Field names of the provider's payloads.
MARKET_WATCH = Payload(
    "marketwatch",
    (
        ("ins_code", "insCode", "code"),
        ("symbol", "lva", "text"),
        ("name", "lvc", "text"),
        ("isin", "insID", "code"),
        ("sector", "csv", "code"),
        ("last_price", "pdv", "int"),
        ("close_price", "pcl", "int"),
        ("open_price", "pf", "int"),
        ("low_price", "pmn", "int"),
        ("high_price", "pmx", "int"),
        ("prev_close", "py", "int"),
        ("volume", "qtj", "int"),
        ("value", "qtc", "int"),
        ("trade_count", "ztt", "int"),
        ("max_allowed", "pMax", "int"),
        ("min_allowed", "pMin", "int"),
        ("heven", "hEven", "int"),
    ),
    levels_name="blDs",
    levels=(
        ("level", "n", "int"),
        ("bid_price", "pmd", "int"),
        ("bid_volume", "qmd", "int"),
        ("bid_orders", "zmd", "int"),
        ("ask_price", "pmo", "int"),
        ("ask_volume", "qmo", "int"),
        ("ask_orders", "zmo", "int"),
    ),
)
CLIENT_TYPES = Payload(
    "clientTypeAllDto",
    (
        ("ins_code", "insCode", "code"),
        ("ind_buy_volume", "buy_I_Volume", "int"),
        ("inst_buy_volume", "buy_N_Volume", "int"),
        ("ind_sell_volume", "sell_I_Volume", "int"),
        ("inst_sell_volume", "sell_N_Volume", "int"),
        ("ind_buy_count", "buy_CountI", "int"),
        ("inst_buy_count", "buy_CountN", "int"),
        ("ind_sell_count", "sell_CountI", "int"),
        ("inst_sell_count", "sell_CountN", "int"),
    ),
)
ETF_NAV = Payload(
    "etf",
    (
        ("deven", "deven", "int"),
        ("heven", "hEven", "int"),
        ("redemption", "pRedTran", "int"),
        ("subscription", "pSubTran", "int"),
    ),
    many=False,
    optional=True,
)
INSTRUMENT_STATE = Payload(
    "closingPriceInfo",
    (
        ("code", "cEtaval", "text"),
        ("title", "cEtavalTitle", "text"),
        ("under_supervision", "underSupervision", "int"),
    ),
    many=False,
    inner="instrumentState",
    optional=True,
)
INSTRUMENT_INFO = Payload(
    "instrumentInfo",
    (
        ("symbol", "lVal18AFC", "text"),
        ("name", "lVal30", "text"),
        ("isin", "instrumentID", "text"),
        ("fund_desc", "faraDesc", "text"),
        ("units", "etfIssuedUnit", "int"),
        ("units_deven", "etfUnitDeven", "int"),
        ("market", "flowTitle", "text"),
        ("board", "cgrValCotTitle", "text"),
    ),
    many=False,
)
MARKET_OVERVIEW = Payload(
    "marketOverview",
    (
        ("index_value", "indexLastValue", "float"),
        ("index_change", "indexChange", "float"),
        ("eq_index_value", "indexEqualWeightedLastValue", "float"),
        ("eq_index_change", "indexEqualWeightedChange", "float"),
        ("market_value", "marketValue", "float"),
        ("state", "marketState", "code"),
        ("deven", "marketActivityDEven", "int"),
        ("heven", "marketActivityHEven", "int"),
    ),
    many=False,
)
DAILY_PRICES = Payload(
    "closingPriceDaily",
    (
        ("deven", "dEven", "int"),
        ("open_price", "priceFirst", "int"),
        ("high_price", "priceMax", "int"),
        ("low_price", "priceMin", "int"),
        ("close_price", "pClosing", "int"),
        ("last_price", "pDrCotVal", "int"),
        ("prev_close", "priceYesterday", "int"),
        ("volume", "qTotTran5J", "int"),
        ("value", "qTotCap", "int"),
        ("trade_count", "zTotTran", "int"),
    ),
)
CLIENT_HISTORY = Payload(
    "clientType",
    (
        ("deven", "recDate", "int"),
        ("ind_buy_volume", "buy_I_Volume", "int"),
        ("inst_buy_volume", "buy_N_Volume", "int"),
        ("ind_sell_volume", "sell_I_Volume", "int"),
        ("inst_sell_volume", "sell_N_Volume", "int"),
        ("ind_buy_value", "buy_I_Value", "int"),
        ("inst_buy_value", "buy_N_Value", "int"),
        ("ind_sell_value", "sell_I_Value", "int"),
        ("inst_sell_value", "sell_N_Value", "int"),
        ("ind_buy_count", "buy_I_Count", "int"),
        ("inst_buy_count", "buy_N_Count", "int"),
        ("ind_sell_count", "sell_I_Count", "int"),
        ("inst_sell_count", "sell_N_Count", "int"),
    ),
)
TRADES = Payload(
    "trade",
    (
        ("n", "nTran", "int"),
        ("heven", "hEven", "int"),
        ("volume", "qTitTran", "int"),
        ("price", "pTran", "int"),
        ("canceled", "canceled", "int"),
    ),
)
PRICE_EVENTS = Payload(
    "closingPriceHistory",
    (
        ("heven", "hEven", "int"),
        ("last_price", "pDrCotVal", "int"),
        ("volume", "qTotTran5J", "int"),
        ("value", "qTotCap", "int"),
        ("trade_count", "zTotTran", "int"),
    ),
)

# Endpoint names in the archive.
ENDPOINTS: dict[str, Payload] = {
    "market_watch": MARKET_WATCH,
    "client_type_all": CLIENT_TYPES,
    "market_overview": MARKET_OVERVIEW,
    "etf": ETF_NAV,
    "closing_price_info": INSTRUMENT_STATE,
    "instrument_info": INSTRUMENT_INFO,
    "daily_history": DAILY_PRICES,
    "client_type_history": CLIENT_HISTORY,
    "trades": TRADES,
    "price_history": PRICE_EVENTS,
}


def whole_number(text: Column) -> Column:
    """Text of a JSON scalar to a long: missing or empty is 0, fractions round half to even."""
    return F.coalesce(F.rint(text.try_cast("double")), F.lit(0.0)).cast("long")


def _convert(raw: Column, kind: str) -> Column:
    if kind == "int":
        return whole_number(raw)
    if kind == "float":
        return raw.try_cast("double")
    return normalize_text(raw) if kind == "text" else clean_code(raw)


#: Filled by ``from_json`` with the payload where a value does not have its declared type.
REST = "_rest"


def _scalar(kind: str, typed: bool) -> T.DataType:
    return T.DoubleType() if typed and kind in ("int", "float") else T.StringType()


def _row_type(payload: Payload, typed: bool = False) -> T.StructType:
    row = T.StructType([T.StructField(name, _scalar(kind, typed)) for _, name, kind in payload.fields])
    if payload.levels:
        level = T.StructType([T.StructField(n, _scalar(kind, typed)) for _, n, kind in payload.levels])
        row = row.add(payload.levels_name, T.ArrayType(level))
    return row


def _body_type(payload: Payload, typed: bool = False) -> T.StructType:
    body: T.DataType = _row_type(payload, typed)
    if payload.inner:
        body = T.StructType().add(payload.inner, body)
    whole = T.StructType().add(payload.envelope, T.ArrayType(body) if payload.many else body)
    return whole.add(REST, T.StringType()) if typed else whole


def _typed_row(row: Column, payload: Payload) -> Column:
    """A row read as text in the declared types."""

    def scalar(value: Column, kind: str) -> Column:
        return value.try_cast("double") if kind in ("int", "float") else value

    fields = [scalar(row[name], kind).alias(name) for _, name, kind in payload.fields]
    if payload.levels:
        one = lambda x: F.struct(*[scalar(x[n], kind).alias(n) for _, n, kind in payload.levels])
        fields.append(F.transform(row[payload.levels_name], one).alias(payload.levels_name))
    return F.when(row.isNotNull(), F.struct(*fields))


def _unreadable_number(row: Column, payload: Payload) -> Column:
    """True when a numeric field holds text that is not a number.

    Plain digits and points, the usual case, are judged by one pattern over all fields;
    anything else (signs, exponents, letters) is tried field by field.
    """
    numbers = [row[name] for _, name, kind in payload.fields if kind in ("int", "float")]
    if not numbers:
        return F.lit(False)
    text = F.concat_ws("|", *numbers)
    one_by_one = F.lit(False)
    for raw in numbers:
        wrong = (raw != "") & raw.try_cast("double").isNull()
        one_by_one = one_by_one | F.coalesce(wrong, F.lit(False))
    malformed = text.rlike(r"[.][0-9]*[.]|(^|[|])[.]([|]|$)")
    return F.when(text.rlike("[^0-9.|]"), one_by_one).otherwise(malformed)


def _may_hold_text(payload: Payload) -> Column:
    """False when every numeric field in the payload's text is a JSON number, null or empty.

    One look at the text spares the exact test, field by field, on all ordinary responses.
    """
    names = "|".join(name for _, name, kind in payload.fields if kind in ("int", "float"))
    usual = r'(?:null|""|-?[0-9]+(?:[.][0-9]+)?(?:[eE][-+]?[0-9]+)?)\s*[,}\]]'
    return F.col("payload").rlike(rf'"(?:{names})"\s*+:\s*+(?!{usual})|\\u00')


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _body(doc: Column, payload: Payload) -> Column:
    body = doc[payload.envelope]
    return body[payload.inner] if payload.inner else body


def _problem(doc: Column, payload: Payload) -> Column:
    """Why a response cannot be used, null when it can."""
    body = _body(doc, payload)
    if payload.many:
        exact = F.exists(body, lambda row: _unreadable_number(row, payload))
    else:
        exact = _unreadable_number(body, payload)
    bad = F.when(_may_hold_text(payload), exact).otherwise(F.lit(False))
    # Asked only where no body was read; nested values are skipped, not built.
    keys = F.json_object_keys("payload")
    missing = ~F.coalesce(F.array_contains(keys, payload.envelope), F.lit(False))
    unreadable = F.lit(None) if payload.optional else F.lit("parse error: unreadable body")
    no_body = F.when(
        missing, F.lit(f"parse error: expected top-level key '{payload.envelope}'")
    ).otherwise(unreadable)
    return (
        F.when(~F.col("status_code").between(200, 299), F.concat(F.lit("HTTP "), "status_code"))
        .when(body.isNull(), no_body)
        .when(bad, F.lit("parse error: a number is not one"))
    )


def _answered() -> Column:
    return F.coalesce(F.col("status_code").between(200, 299), F.lit(False))


def _as_declared(payload: Payload) -> Column:
    """The payload by one parse into declared types; an empty text is absent, as everywhere.

    Inside a JSON text quotes are escaped, so the replaced pair is always a whole value.
    """
    text = F.replace("payload", F.lit(':""'), F.lit(":null"))
    return F.from_json(text, _body_type(payload, True), {"columnNameOfCorruptRecord": REST})


def _as_text(payload: Payload) -> Column:
    return F.from_json("payload", _body_type(payload))


def _fits(doc: Column, payload: Payload) -> Column:
    """Every value had its declared type, so nothing is left to judge."""
    return doc[REST].isNull() & _body(doc, payload).isNotNull()


def _listed(body: Column, payload: Payload) -> Column:
    return body if payload.many else F.when(body.isNotNull(), F.array(body))


def _usable_rows(payload: Payload) -> Column:
    """The rows of a response as an array; null when it cannot be used or is empty.

    Only what does not fit the declared types (numbers in quotes, empty texts, no body) is
    read again as text and judged value by value.
    """

    def judged(doc: Column) -> Column:
        rows = F.transform(_listed(_body(doc, payload), payload), lambda row: _typed_row(row, payload))
        return F.when(_problem(doc, payload).isNull(), rows)

    def rows(doc: Column) -> Column:
        usual = _listed(_body(doc, payload), payload)
        return F.when(_fits(doc, payload), usual).otherwise(_once(_as_text(payload), judged))

    return F.when(_answered(), _once(_as_declared(payload), rows))


def parse(raw: DataFrame, endpoint: str, keep: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Rows of the usable responses of one endpoint, with ``keep`` columns of the archive.

    ``ins_code`` comes from the payload where it lists instruments, else from the archive.
    The outer form of the unfolding keeps the optimizer from testing the parsed array in a
    filter of its own, which would parse every payload a second time.
    """
    payload = ENDPOINTS[endpoint]
    own = any(name == "ins_code" for name, _, _ in payload.fields)
    carried = [c for c in keep if not (own and c == "ins_code")]
    rows = (
        raw.filter(F.col("endpoint") == endpoint)
        .select(*carried, F.posexplode_outer(_usable_rows(payload)).alias("position", "_row"))
        .filter(F.col("position").isNotNull())
    )
    columns = [
        _convert(F.col("_row")[name], kind).alias(column)
        for column, name, kind in payload.fields
    ]
    if payload.levels:
        first = F.get(
            F.filter(
                F.col("_row")[payload.levels_name],
                lambda x: whole_number(x[payload.levels[0][1]]) == 1,
            ),
            F.lit(0),
        )
        top = F.struct(
            *[_convert(first[name], kind).alias(column) for column, name, kind in payload.levels]
        )
        columns.append(F.when(first.isNotNull(), top).alias("top"))
    return rows.select(*carried, "position", *columns)


def _problem_of(payload: Payload) -> Column:
    slow = _once(_as_text(payload), lambda doc: _problem(doc, payload))
    fits = _once(_as_declared(payload), lambda doc: _fits(doc, payload))
    return F.when(_answered() & fits, F.lit(None)).otherwise(slow)


def errors(raw: DataFrame) -> DataFrame:
    """One row per response that could not be used, in one pass over the archive.

    Each response is parsed with the schema of its own endpoint only.
    """
    reason = None
    for endpoint, payload in ENDPOINTS.items():
        problem = _problem_of(payload)
        here = F.col("endpoint") == endpoint
        reason = F.when(here, problem) if reason is None else reason.when(here, problem)
    failed = ~F.col("status_code").between(200, 299)
    other = F.when(failed, F.concat(F.lit("HTTP "), "status_code"))
    rows = raw.withColumn("_error", reason.otherwise(other)).filter(F.col("_error").isNotNull())
    place = F.concat_ws(":", "endpoint", "ins_code", F.concat(F.lit(" "), "_error"))
    return rows.select("run_id", "endpoint", "ins_code", "fetched_at", place.alias("error"))


def nav_time() -> Column:
    return times.compact_timestamp("deven", "heven")
