"""One query per payload kind, every field compared: orders written as archived responses.

Each response has two items (one where the payload is a single object). A field's value
comes from the order key; its spelling changes from row to row: whole number, float, text,
null, empty text. Some responses failed, are cut short, have the wrong envelope or hold a
number that is not one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from navpulse.catalog import proxies as px, query
from navpulse.sources import payloads

# Fields as the provider names them, the column they become, and their kind.
KINDS = {
    "client_type_all": ("clientTypeAllDto", "", 2, """
        insCode ins_code code, buy_I_Volume ind_buy_volume int, buy_N_Volume inst_buy_volume int,
        sell_I_Volume ind_sell_volume int, sell_N_Volume inst_sell_volume int, buy_CountI ind_buy_count int,
        buy_CountN inst_buy_count int, sell_CountI ind_sell_count int, sell_CountN inst_sell_count int"""),
    "etf": ("etf", "", 1, """
        deven deven int, hEven heven int, pRedTran redemption int, pSubTran subscription int"""),
    "closing_price_info": ("closingPriceInfo", "instrumentState", 1, """
        cEtaval code text, cEtavalTitle title text, underSupervision under_supervision int"""),
    "instrument_info": ("instrumentInfo", "", 1, """
        lVal18AFC symbol text, lVal30 name text, instrumentID isin text, faraDesc fund_desc text,
        etfIssuedUnit units int, etfUnitDeven units_deven int, flowTitle market text, cgrValCotTitle board text"""),
    "market_overview": ("marketOverview", "", 1, """
        indexLastValue index_value float, indexChange index_change float,
        indexEqualWeightedLastValue eq_index_value float, indexEqualWeightedChange eq_index_change float,
        marketValue market_value float, marketState state code, marketActivityDEven deven int,
        marketActivityHEven heven int"""),
    "daily_history": ("closingPriceDaily", "", 2, """
        dEven deven int, priceFirst open_price int, priceMax high_price int, priceMin low_price int,
        pClosing close_price int, pDrCotVal last_price int, priceYesterday prev_close int,
        qTotTran5J volume int, qTotCap value int, zTotTran trade_count int"""),
    "client_type_history": ("clientType", "", 2, """
        recDate deven int, buy_I_Volume ind_buy_volume int, buy_N_Volume inst_buy_volume int,
        sell_I_Volume ind_sell_volume int, sell_N_Volume inst_sell_volume int, buy_I_Value ind_buy_value int,
        buy_N_Value inst_buy_value int, sell_I_Value ind_sell_value int, sell_N_Value inst_sell_value int,
        buy_I_Count ind_buy_count int, buy_N_Count inst_buy_count int, sell_I_Count ind_sell_count int,
        sell_N_Count inst_sell_count int"""),
    "trades": ("trade", "", 2, """
        nTran n int, hEven heven int, qTitTran volume int, pTran price int, canceled canceled int"""),
    "price_history": ("closingPriceHistory", "", 2, """
        hEven heven int, pDrCotVal last_price int, qTotTran5J volume int, qTotCap value int, zTotTran trade_count int"""),
}


def fields_of(text: str) -> list[tuple[str, str, str]]:
    return [tuple(f.split()) for f in text.split(",")]


def number(i: int, item: int) -> str:
    return f"((o_orderkey * {i + 3} + o_custkey + {item}) % 100000)"


def spelling(i: int, item: int) -> str:
    return f"((o_orderkey + {i} + {item}) % 5)"


def written(name: str, kind: str, i: int, item: int, broken: bool) -> str:
    """Spark SQL for one JSON field."""
    v, how = f"CAST({number(i, item)} AS STRING)", spelling(i, item)
    if broken and kind in ("int", "float"):
        return f"""concat('"{name}":"x', {v}, '"')"""
    if kind in ("int", "float"):
        fraction = ".0" if kind == "int" else ".5"
        value = f"""CASE {how} WHEN 0 THEN {v} WHEN 1 THEN concat({v}, '{fraction}') WHEN 2 THEN 'null'
            WHEN 3 THEN '""' ELSE concat('"', {v}, '"') END"""
    elif kind == "text":
        value = f"""CASE {how} WHEN 0 THEN concat('"a  b', {v}, ' "') WHEN 1 THEN 'null' ELSE concat('"x', {v}, '"') END"""
    else:
        value = f"""CASE {how} WHEN 0 THEN concat('" ', {v}, ' "') WHEN 1 THEN 'null' ELSE {v} END"""
    return f"""concat('"{name}":', {value})"""


def read(kind: str, i: int, item: str) -> str:
    """DuckDB SQL for what the field means; ``item`` is the position."""
    v, how = number(i, item), spelling(i, item)
    if kind == "int":
        return f"CAST(CASE WHEN {how} IN (2, 3) THEN 0 ELSE {v} END AS BIGINT)"
    if kind == "float":
        return f"CAST(CASE {how} WHEN 1 THEN {v} + 0.5 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE {v} END AS DOUBLE)"
    if kind == "text":
        return f"CASE {how} WHEN 0 THEN 'a b' || {v} WHEN 1 THEN '' ELSE 'x' || {v} END"
    return f"CASE {how} WHEN 1 THEN '' ELSE {v}::VARCHAR END"


def responses(spark, d, endpoint):
    envelope, inner, items, text = KINDS[endpoint]

    def body(broken: bool) -> str:
        made = []
        for item in range(items):
            parts = [written(n, k, i, item, broken) for i, (n, _, k) in enumerate(fields_of(text))]
            made.append("concat('{', " + ", ',', ".join(parts) + ", '}')")
        one = "concat('[', " + ", ',', ".join(made) + ", ']')" if items > 1 else made[0]
        if inner:
            one = f"""concat('{{"{inner}":', {one}, '}}')"""
        return f"""concat('{{"{envelope}":', {one}, ',"more":[1]}}')"""

    return px.table(spark, d, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS run_id", f"'{endpoint}' AS endpoint", "CAST(o_custkey AS STRING) AS ins_code",
        "CAST(o_orderdate AS TIMESTAMP) AS fetched_at",
        "CASE WHEN o_custkey % 10 = 9 THEN 503 ELSE 200 END AS status_code",
        f"""CASE o_custkey % 10 WHEN 8 THEN '{{"{envelope}":' WHEN 7 THEN '{{"other":1}}'
            WHEN 6 THEN {body(True)} ELSE {body(False)} END AS payload""",
    )


def oracle(endpoint: str) -> str:
    _, _, items, text = KINDS[endpoint]
    fields = fields_of(text)
    own = any(column == "ins_code" for _, column, _ in fields)
    columns = [f"{read(k, i, 'item')} AS {c}" for i, (_, c, k) in enumerate(fields)]
    carried = "" if own else "o_custkey::VARCHAR AS ins_code, "
    return (
        f"SELECT o_orderkey::VARCHAR AS run_id, item AS position, {carried}{', '.join(columns)} "
        f"FROM orders, range({items}) t(item) WHERE o_custkey % 10 < 6"
    )


def register(endpoint: str) -> None:
    @query(f"payload_{endpoint}", oracle(endpoint))
    def parsed(spark, d):
        return payloads.parse(responses(spark, d, endpoint), endpoint, ("run_id", "ins_code"))


for _endpoint in KINDS:
    register(_endpoint)


@query(
    "payload_errors",
    " UNION ALL ".join(
        f"""SELECT o_orderkey::VARCHAR AS run_id, '{e}:' || o_custkey || ': ' || CASE o_custkey % 10
          WHEN 9 THEN 'HTTP 503' WHEN 6 THEN 'parse error: a number is not one'
          ELSE 'parse error: expected top-level key ''{KINDS[e][0]}''' END AS error
        FROM orders WHERE o_custkey % 10 >= 6"""
        for e in ("trades", "etf", "daily_history")
    ),
)
def payload_errors(spark, d):
    parts = [responses(spark, d, e) for e in ("trades", "etf", "daily_history")]
    raw = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return payloads.errors(raw).select("run_id", F.col("error"))
