"""From raw documents to packed training sequences, a stage after the other.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the
last return the columns of ``documents``. ``run`` writes each stage's rows as Parquet to
the shared folder and reads them again, so a lost executor costs a stage at most.

doc_id names a document: rows that repeat an id with the same text stay or go together,
and rows without an id are never dropped as copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from navpulse.llm import exact_dedup, packing, simhash, suffix_dedup, toxicity
from navpulse.llm.common import freeze, table


def without(docs: DataFrame, groups: DataFrame, kept) -> DataFrame:
    """``docs`` without the ids of ``groups`` of which no row is ``kept``."""
    ids = groups.groupBy("doc_id").agg(F.max(kept).alias("kept")).where("NOT kept").select("doc_id")
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject the documents that the model calls toxic."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    _, hit = toxicity.score_columns(docs.columns)
    return toxicity.scored(docs, model).where(~F.col(hit)).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one stays."""
    return without(docs, exact_dedup.exact_groups(docs), F.col("kept"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links between close fingerprints connect, the first stays."""
    groups = simhash.near_duplicates(docs)
    return without(docs, groups, F.col("doc_id") == F.col("component_id"))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out every passage of 100 bytes or more that occurs earlier."""
    return suffix_dedup.shortened(docs, min_bytes=100)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of a document lies in the training sequences."""
    return packing.pack_documents(docs, capacity=2048)


STAGES = [
    ("toxicity", toxic_stage),
    ("exact_dedup", exact_stage),
    ("simhash", simhash_stage),
    ("suffix_dedup", suffix_stage),
    ("packing", packing_stage),
]
#: A learned classifier and connected components are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
