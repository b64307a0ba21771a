"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from navpulse.llm import (
    byte_bpe,
    exact_dedup,
    html_text,
    licenses,
    line_dedup,
    packing,
    ranked_search,
    simhash,
    spelling,
    suffix_dedup,
    token_counts,
    toxicity,
    vafile,
)
from navpulse.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.coded(table(spark, sf_dir, "documents"), with_ids=False)


@query(
    "op5_exact_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS points,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
        FROM documents
    )
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
           row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
    FROM d
    WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query(
    "op1_vafile",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
    FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER w <= 5
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vafile.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), min_bytes=100)
    return made.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048)


@query("op8_html_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_licenses")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = licenses.licenses(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        F.array_join("licenses.license", ",").alias("licenses"),
        F.array_join(F.transform("licenses.start", lambda x: x.cast("string")), ",").alias("starts"),
        F.array_join("sentences", ",").alias("sentences"),
        F.size("licenses").cast("long").alias("n_licenses"),
    )


@query(
    "op11_line_dedup",
    r"""
    WITH lines AS (
        SELECT doc_id, i, parts[i] AS line, len(parts) AS n_lines
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
             unnest(range(1, len(parts) + 1)) AS u(i)
    ), keyed AS (
        SELECT *, translate(
            regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines
    ), many AS (
        SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
    )
    SELECT doc_id, any_value(n_lines) AS n_lines, count(m.key) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (m.key IS NULL), '')) AS kept_sha256
    FROM keyed LEFT JOIN many m USING (key) GROUP BY doc_id
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.line_dedup(table(spark, sf_dir, "documents"), min_documents=10, with_text=False)
    return made.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@query("op12_spelling")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), min_points=6, min_count=5, typo_every=199)
    return spelling.spelling_variants(words, factor=5)


@query(
    "op13_ranked_search",
    r"""
    WITH t AS (
        SELECT doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM documents
    ), q AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    ), sizes AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
    total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
    norm AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM sizes, total),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY doc_id, term),
    w AS (
        SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM tf, total GROUP BY term
    ), s AS (
        SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
        FROM q JOIN tf USING (term) JOIN w USING (term) JOIN norm USING (doc_id)
        GROUP BY item_id, doc_id
    )
    SELECT item_id, CAST(row_number() OVER r AS INTEGER) AS rank, doc_id, score
    FROM s WHERE score > 0
    WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
    QUALIFY row_number() OVER r <= 50
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)
