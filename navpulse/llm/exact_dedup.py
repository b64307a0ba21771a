"""Exact deduplication by recipes of content-defined chunks.

A text without its ASCII white space is cut where a rolling hash of its last 32 bytes has
``mask_bits`` zero bits, so equal texts give equal chunks. A chunk's identifier is its
64-bit hash, and the identifier is verified: all chunks of a hash must agree in 128 bits of
their SHA-256, which is checked by partial minima and maxima, so a chunk that many texts
share travels once a task. Should different chunks share a hash, each gets a number beside
it. A text's recipe is the ordered list of its verified identifiers; texts with equal
recipes are equal, and only recipes, never documents, are moved, grouped and compared.

Null counts as an empty text, whose recipe is empty; all such rows are equal. Of equal
texts the one with the most code points in its original form stays, ties by the smallest
doc_id (a null id comes last). Repeated rows of one id are a group of their own like any
others. An empty table gives no rows. Other columns stay untouched unless asked for.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from navpulse.llm.common import WHITE, freeze, map_batches, texts

GRAM = 32
#: Odd multipliers of the rolling hash, one a doubling.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def halves(digest: bytes) -> tuple[int, int]:
    """The first 16 bytes of a digest as two longs."""
    return struct.unpack("<qq", digest[:16])


def rolling(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step = 1
    for m in MIX:
        h = h[:-step] * np.uint64(m) + h[step:]
        step *= 2
    h ^= h >> np.uint64(31)
    return h


def cuts(raw: np.ndarray, mask_bits: int, longest: int) -> np.ndarray:
    """Ends of the chunks: after a hash with ``mask_bits`` zero bits, and never ``longest`` bytes apart."""
    n = len(raw)
    if n == 0:
        return np.empty(0, np.int64)
    marks = np.empty(0, np.int64)
    if n > GRAM:
        h = rolling(raw)
        marks = np.flatnonzero(h >> np.uint64(64 - mask_bits) == 0) + GRAM
        # In a run of marks, as one repeated letter can make, only the first cuts.
        marks = marks[(np.diff(marks, prepend=-1) > 1) & (marks < n)]
    ends = np.append(marks, n)
    starts = np.concatenate([[0], ends[:-1]])
    if (ends - starts).max() <= longest:
        return ends
    return np.concatenate([np.append(np.arange(a + longest, b, longest), b) for a, b in zip(starts, ends)])


def recipes(docs: DataFrame, mask_bits: int, longest: int) -> DataFrame:
    """doc_id, code points of the original, SHA-256 of the normalised text; per chunk its hash and two checks."""
    source = texts(docs).withColumn("points", F.length("text").cast("long"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        sha, hashes, checks = [], [], []
        for text in batch.column("text").cast(pa.binary()):
            raw = text.as_py().translate(None, WHITE)
            sha.append(hashlib.sha256(raw).hexdigest())
            ends = cuts(np.frombuffer(raw, np.uint8), mask_bits, longest).tolist()
            parts = [raw[a:b] for a, b in zip([0, *ends], ends)]
            hashes.append([xxhash.xxh64_intdigest(p) - (1 << 63) for p in parts])
            checks.append([x for p in parts for x in halves(hashlib.sha256(p).digest())])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("points"),
                pa.array(sha, pa.string()),
                pa.array(hashes, pa.list_(pa.int64())),
                pa.array([x[::2] for x in checks], pa.list_(pa.int64())),
                pa.array([x[1::2] for x in checks], pa.list_(pa.int64())),
            ],
            ["doc_id", "points", "text_sha256", "hashes", "first", "second"],
        )

    lists = "hashes array<long>, first array<long>, second array<long>"
    return map_batches(source, cut, f"doc_id long, points long, text_sha256 string, {lists}")


def chunk_rows(made: DataFrame, *keep: str, outer: bool = False) -> DataFrame:
    """A row for each chunk: its place, hash and checks; with ``outer`` also one for an empty recipe."""
    explode = F.posexplode_outer if outer else F.posexplode
    rows = made.select(*keep, explode(F.arrays_zip("hashes", "first", "second")).alias("at", "c"))
    return rows.select(*keep, "at", F.col("c.hashes").alias("hash"), "c.first", "c.second")


def clashes(made: DataFrame) -> DataFrame:
    """Hashes under which different chunks were found, a row for each chunk with its number from 0."""
    chunks = chunk_rows(made)
    suspect = chunks.groupBy("hash").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("first", "second") for n, f in (("low", F.min), ("high", F.max))]
    ).where("low_first <> high_first OR low_second <> high_second")
    distinct = chunks.join(suspect.select("hash"), "hash", "left_semi").groupBy("hash", "first", "second").count()
    numbered = distinct.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("first", "second"))).alias("all"))
    return numbered.select("hash", F.posexplode("all").alias("number", "c")).select("hash", "number", "c.first", "c.second")


def exact_groups(docs: DataFrame, mask_bits: int = 10, longest: int = 1 << 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row, dropped ones too."""
    made = freeze(recipes(docs, mask_bits, longest).withColumn("row", F.monotonically_increasing_id()))
    numbers = freeze(clashes(made))
    if numbers.isEmpty():  # nearly always: each hash stands for one chunk and is its identifier
        return grouped(made.withColumn("recipe", F.col("hashes")))
    return grouped(numbered(made, numbers))


def numbered(made: DataFrame, numbers: DataFrame) -> DataFrame:
    """Recipes in which a hash shared by different chunks is followed by the chunk's number."""
    keep = ("row", "doc_id", "points", "text_sha256")
    named = chunk_rows(made, *keep, outer=True).join(numbers, ["hash", "first", "second"], "left")
    element = F.when(F.col("hash").isNotNull(), F.struct("at", "hash", F.coalesce("number", F.lit(0)).alias("number")))
    lists = named.groupBy(*keep).agg(F.array_sort(F.collect_list(element)).alias("list"))
    return lists.select(*keep, F.flatten(F.array(F.col("list.hash"), F.col("list.number").cast("array<long>"))).alias("recipe"))


def grouped(rows: DataFrame) -> DataFrame:
    """The row that stays in each group of equal recipes; partial maxima make hot groups small."""
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row"))).alias("best")
    groups = rows.groupBy("recipe").agg(best, F.count("*").alias("group_size")).withColumnRenamed("recipe", "of")
    joined = rows.join(groups, F.col("recipe") == F.col("of"))
    return joined.select(
        "doc_id",
        F.bitwise_not("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.bitwise_not("best.row")).alias("kept"),
        "text_sha256",
    )
