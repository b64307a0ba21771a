"""Payload parsing, tick building and text functions on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from navpulse.catalog import proxies as px, query
from navpulse.functions import metrics, text, times
from navpulse.plans import ticks as tick_plan
from navpulse.sources import payloads

# Languages of the test texts stand in for the letters of the market's own.
LETTERS = ("éèêáóúíñàçôûâîùëïüöäß", "eeeaouinacouaiueiuoas")


@query(
    "normalize_text",
    """
SELECT doc_id, length(t) AS length, md5(t) AS digest FROM (
  SELECT doc_id, regexp_replace(regexp_replace(translate(text,
      'éèêáóúíñàçôûâîùëïüöäß', 'eeeaouinacouaiueiuoas'), '[ \\t\u00a0]+', ' ', 'g'),
    '^\\s+|\\s+$', '', 'g') AS t FROM documents)""",
)
def normalize_text(spark, d):
    cleaned = text.normalize_text("text", LETTERS, "")
    docs = px.table(spark, d, "documents").select("doc_id", cleaned.alias("t"))
    return docs.select("doc_id", F.length("t").alias("length"), F.md5("t").alias("digest"))


@query(
    "classify",
    """
SELECT doc_id, CASE WHEN source LIKE 'src1%' THEN 'commodity'
  WHEN w IS NOT NULL AND lang != 'en' THEN w
  WHEN lang != 'en' THEN 'other' ELSE coalesce(w, 'other') END AS fund_type
FROM (SELECT doc_id, source, lang, CASE WHEN contains(text, 'tion') THEN 'index'
  WHEN contains(text, 'ent') THEN 'sector' WHEN contains(text, 'ou') THEN 'mixed' END AS w
  FROM (SELECT doc_id, source, lang, regexp_replace(regexp_replace(text,
    '[ \\t\u00a0]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents))""",
)
def classify(spark, d):
    """The rule chain with words of the test texts; the source plays the ISIN."""
    words = (("tion", "index"), ("ent", "sector"), ("ou", "mixed"))
    docs = px.table(spark, d, "documents")
    described = F.when(F.col("lang") != "en", F.col("text"))
    kind = text.classify_fund(described, "text", "source", words, {"\u0000": "equity"}, "src1")
    return docs.select("doc_id", kind.alias("fund_type"))


@query(
    "status_kind",
    """
SELECT o_orderkey, CASE WHEN code = '' THEN 'unknown' WHEN code[2] = 'S' THEN 'suspended'
  WHEN code[2] = 'R' THEN 'reserved' WHEN code[2] = 'G' THEN 'blocked' WHEN code[1] = 'I' THEN 'forbidden'
  WHEN code = 'A' THEN 'open' ELSE 'unknown' END AS kind
FROM (SELECT o_orderkey, upper(trim(replace(replace(o_orderstatus, 'O', 'A'), 'F', 'I')
  || substr('SRG b ', (o_orderkey % 6)::INT + 1, 1))) AS code FROM orders)""",
)
def status_kind(spark, d):
    code = F.expr(
        "concat(replace(replace(o_orderstatus, 'O', 'A'), 'F', 'I'),"
        " substr('SRG b ', CAST(o_orderkey % 6 AS INT) + 1, 1))"
    )
    return px.table(spark, d, "orders").select("o_orderkey", text.status_kind(code).alias("kind"))


@query(
    "search",
    """
SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'gi') OR contains(p_brand, 'gi')""",
)
def search(spark, d):
    parts = px.table(spark, d, "part")
    return parts.filter(text.matches_search(" gi ", "p_name", "p_brand")).select(
        "p_partkey", "p_name"
    )


@query(
    "board_rollup",
    """
SELECT l_orderkey::VARCHAR AS run_id, 'IRT1' || lpad(l_partkey::VARCHAR, 8, '0') AS stem,
  sum(l_quantity)::BIGINT AS block_volume,
  sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT))::BIGINT AS block_value
FROM lineitem WHERE l_linenumber != 1 AND l_returnflag != 'R' GROUP BY 1, 2""",
)
def board_rollup(spark, d):
    watch = px.table(spark, d, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) AS run_id",
        "concat('IRT1', lpad(CAST(l_partkey AS STRING), 8, '0'),"
        " lpad(CAST(l_linenumber AS STRING), 4, '0')) AS isin",
        "CASE WHEN l_returnflag = 'R' THEN '67' ELSE '68 ' END AS sector",
        "CAST(l_quantity AS BIGINT) AS volume",
        "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS value",
    )
    return tick_plan.board_rollup(watch)


def archived(spark, d):
    """Line items as archived market-watch responses of one instrument each.

    Numbers are written as the provider does (floats for whole numbers, empty texts); some
    responses failed, are cut short or have the wrong envelope.
    """
    return px.table(spark, d, "lineitem").selectExpr(
        "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS run_id",
        "'market_watch' AS endpoint", "CAST(l_partkey AS STRING) AS ins_code",
        "CAST(l_shipdate AS TIMESTAMP) AS fetched_at",
        "CASE WHEN l_suppkey % 10 = 9 THEN 503 ELSE 200 END AS status_code",
        """CASE WHEN l_suppkey % 10 = 8 THEN '{"marketwatch":[{"insCode":"1"'
          WHEN l_suppkey % 10 = 7 THEN '{"other":[]}'
          WHEN l_suppkey % 10 = 6 THEN '{"marketwatch":[{"insCode":"1","pdv":"x"}]}'
          ELSE concat('{"marketwatch":[{"insCode":" ', l_partkey, ' ","lva":"s  ', l_linenumber,
            '","insID":"IRT1","csv":"68 ","pdv":', l_extendedprice, ',"pcl":', l_quantity,
            ',"pf":null,"pmn":"","qtj":', l_quantity, ',"extra":{"a":1},"blDs":[{"n":2,"pmd":1.0},',
            '{"n":1,"pmd":', l_quantity, ',"qmd":', l_linenumber, ',"pmo":7.5,"qmo":null}]}]}')
        END AS payload""",
    )


GOOD = "FROM lineitem WHERE l_suppkey % 10 < 6"
KEY = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS run_id"


@query(
    "market_watch_rows",
    f"""
SELECT {KEY}, l_partkey::VARCHAR AS ins_code, 's ' || l_linenumber AS symbol, '68' AS sector,
  round_even(l_extendedprice, 0)::BIGINT AS last_price, l_quantity::BIGINT AS close_price,
  0::BIGINT AS open_price, 0::BIGINT AS low_price, l_quantity::BIGINT AS volume,
  l_quantity::BIGINT AS bid_price, l_linenumber::BIGINT AS bid_volume, 8::BIGINT AS ask_price,
  0::BIGINT AS ask_volume {GOOD}""",
)
def market_watch_rows(spark, d):
    rows = payloads.parse(archived(spark, d), "market_watch")
    return rows.select(
        "run_id", "ins_code", "symbol", "sector", "last_price", "close_price", "open_price",
        "low_price", "volume", "top.bid_price", "top.bid_volume", "top.ask_price", "top.ask_volume",
    )


@query(
    "response_errors",
    f"""
SELECT {KEY}, 'market_watch:' || l_partkey || ': ' || CASE l_suppkey % 10 WHEN 9 THEN 'HTTP 503'
  WHEN 6 THEN 'parse error: a number is not one'
  ELSE 'parse error: expected top-level key ''marketwatch''' END AS error
FROM lineitem WHERE l_suppkey % 10 >= 6""",
)
def response_errors(spark, d):
    return payloads.errors(archived(spark, d)).select("run_id", "error")


@query(
    "json_events",
    """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  round_even(value, 0)::BIGINT AS whole,
  round_even(CAST(json_extract(props, '$.k') AS BIGINT) * value, 0)::BIGINT AS estimate
FROM events""",
)
def json_events(spark, d):
    rows = px.table(spark, d, "events").select(
        "event_id", "value", F.from_json("props", "k string")["k"].alias("k")
    )
    k = payloads.whole_number(F.col("k"))
    return rows.select(
        "event_id", k.alias("k"),
        payloads.whole_number(F.col("value").cast("string")).alias("whole"),
        metrics.flow_estimate(k, F.col("value")).alias("estimate"),
    )


@query(
    "compact_dates",
    """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day,
  CASE WHEN o_orderkey % 24 < 24 AND o_orderkey % 100 < 60 THEN
    o_orderdate + to_hours((o_orderkey % 24)::INT) + to_minutes((o_orderkey % 60)::INT)
    + to_seconds((o_orderkey % 100)::INT) END AS stamp,
  o_orderkey % 24 * 3600 + o_orderkey % 60 * 60 + o_orderkey % 100 AS sod
FROM orders""",
)
def compact_dates(spark, d):
    rows = px.table(spark, d, "orders").selectExpr(
        "o_orderkey", "CAST(date_format(o_orderdate, 'yyyyMMdd') AS BIGINT) AS deven",
        "(o_orderkey % 24) * 10000 + (o_orderkey % 60) * 100 + o_orderkey % 100 AS heven",
    )
    return rows.select(
        "o_orderkey", times.compact_date("deven").alias("day"),
        times.compact_timestamp("deven", "heven").alias("stamp"),
        times.compact_time_seconds("heven").alias("sod"),
    )


@query(
    "traded_in_feed",
    """
SELECT l_orderkey::VARCHAR AS run_id, bool_or(l_quantity > 25) AS traded
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type != 'PROMO' GROUP BY 1""",
)
def traded_in_feed(spark, d):
    watch = px.table(spark, d, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) AS run_id", "CAST(l_partkey AS STRING) AS ins_code",
        "greatest(CAST(l_quantity AS BIGINT) - 25, 0) AS trade_count",
    )
    funds = px.table(spark, d, "part").filter("p_type != 'PROMO'").selectExpr(
        "CAST(p_partkey AS STRING) AS ins_code"
    )
    return tick_plan.any_fund_traded(watch, funds)
