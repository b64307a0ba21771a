"""Ranked lexical search by hashed max-sketches and exact rescoring.

The queries are taken in blocks of bounded size. One pass over all documents counts their
terms and keeps, for the terms of a block's queries only, how often each occurs. From the
counts follow the weights, and from these each document's impacts, which are folded by a
hash of the term into a short vector of coordinatewise maxima. A query's bound on a
document is the sum of the sketch at its terms' coordinates, so one matrix product gives
the bounds of a batch of documents under all queries. Documents are then scored exactly in
falling order of their bounds until the next bound is below the k-th score found so far,
which every task keeps for each query. A task returns k rows a query, and these are merged.

All arithmetic is in 64-bit integers; sums and bounds stay below 2^53, where the doubles of the
matrix product are exact (inputs beyond that raise). Only a term's weight uses a logarithm.

Every row is a document or query of its own, repeated ids included; a null doc_id comes
last among equal scores. Null and empty texts have no terms: such documents count nowhere,
such queries find nothing. Other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from navpulse.llm.common import freeze, texts

#: ASCII letters and digits, and all beyond ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LAST = (1 << 63) - 1
OUT = "query long, rank int, doc_id long, score long"


def terms(raw: bytes) -> list[str]:
    """All terms of a text in UTF-8; bytes.lower changes A-Z only."""
    return TERM.findall(raw.lower().decode())


def query_blocks(queries: DataFrame, most_queries: int, most_terms: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Lists of (row number, different terms), of bounded length (one query may be longer by itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [list(dict.fromkeys(terms(t.as_py()))) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array(made, pa.list_(pa.string()))], ["query", "terms"])

    block, size = [], 0
    for row in queries.mapInArrow(run, "query long, terms array<string>").toLocalIterator():
        if not row["terms"]:
            continue
        if block and (len(block) == most_queries or size + len(row["terms"]) > most_terms):
            yield block
            block, size = [], 0
        block.append((row["query"], row["terms"]))
        size += len(row["terms"])
    if block:
        yield block


def counted(docs: DataFrame, number: dict[str, int]) -> DataFrame:
    """doc_id, terms with repeats, and number and count of each term that is in ``number``."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            sizes, ids, counts = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                found = terms(text.as_py())
                sizes.append(len(found))
                tally = Counter(map(of.get, found))
                tally.pop(None, None)
                ids.append(list(tally.keys()))
                counts.append(list(tally.values()))
            columns = [pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n", "ids", "counts"])

    return docs.mapInArrow(run, "doc_id long, n long, ids array<int>, counts array<long>")


def weights(frequency: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)


class Searcher:
    """The best k documents of each query of a block among the batches given so far."""

    def __init__(self, queries: list[np.ndarray], weight: np.ndarray, documents: int, length: int, k: int, width: int):
        self.queries, self.weight, self.documents, self.length, self.k = queries, weight, documents, length, k
        # A term's share of the score is below its weight times 10**6, and no weight is below 0.
        if max(int(weight[q].sum()) for q in queries) * 1_000_000 >= 1 << 53:
            raise ValueError("scores could exceed exact doubles; use shorter queries")
        self.width = width
        self.place = np.arange(len(weight)) % width  # terms are numbered in order of their hashes
        self.lookup = np.zeros((width, len(queries)))
        for nr, q in enumerate(queries):
            np.add.at(self.lookup[:, nr], self.place[q], 1.0)
        self.best: list[list[tuple[int, int]]] = [[] for _ in queries]  # (score, doc) by falling score, then doc

    def impacts(self, n: np.ndarray, doc: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        norm = np.array([50 + (50 * x * self.documents) // self.length for x in n.tolist()], np.int64)
        return self.weight[ids] * ((1_000_000_000 * counts) // (1000 * counts + 20 * norm[doc]))

    def add(self, doc_id: np.ndarray, n: np.ndarray, doc: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """A batch of documents; ``doc``, ``ids``, ``counts`` have an entry for each of their terms."""
        impact = self.impacts(n, doc, ids, counts)
        sketch = np.zeros((len(doc_id), self.width))
        np.maximum.at(sketch, (doc, self.place[ids]), impact)
        bounds = (sketch @ self.lookup).astype(np.int64)
        key = doc.astype(np.int64) * len(self.weight) + ids
        order = np.argsort(key)
        key, impact = key[order], impact[order]
        for nr, query in enumerate(self.queries):
            self.rescore(nr, query, bounds[:, nr], doc_id, key, impact)

    def rescore(self, nr: int, query: np.ndarray, bound: np.ndarray, doc_id: np.ndarray, key: np.ndarray, impact: np.ndarray) -> None:
        best = self.best[nr]
        least = best[-1][0] if len(best) == self.k else 1
        open_docs = np.flatnonzero(bound >= least)
        open_docs = open_docs[np.argsort(-bound[open_docs], kind="stable")]
        step = self.k
        at = 0
        while at < len(open_docs) and bound[open_docs[at]] >= least:
            chosen = open_docs[at : at + step]
            wanted = chosen[:, None] * len(self.weight) + query
            where = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
            score = np.where(key[where] == wanted, impact[where], 0).sum(axis=1)
            good = score >= least
            best += zip(score[good].tolist(), doc_id[chosen[good]].tolist())
            best.sort(key=lambda x: (-x[0], x[1]))
            del best[self.k :]
            least = best[-1][0] if len(best) == self.k else 1
            at, step = at + step, 2 * step


def search_block(docs: DataFrame, block: list[tuple[int, list[str]]], k: int, width: int, batch_docs: int) -> DataFrame:
    """The k best documents of each query of one block: query, rank, doc_id, score."""
    vocabulary = sorted({t for _, ts in block for t in ts}, key=lambda t: (xxhash.xxh64_intdigest(t.encode()), t))
    number = {t: nr for nr, t in enumerate(vocabulary)}
    table = freeze(counted(docs, number))
    has = table.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
    if not has["documents"]:
        return docs.sparkSession.createDataFrame([], OUT)
    frequency = np.zeros(len(vocabulary), np.int64)  # as long as the block's terms
    for row in table.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
        frequency[row["id"]] = row["count"]
    queries = [np.sort(np.array([number[t] for t in ts], np.int64)) for _, ts in block]
    names = np.array([q for q, _ in block], np.int64)
    given = (queries, weights(frequency, has["documents"]), has["documents"], has["length"], k, width)
    shared = docs.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, batch_docs):
                batch = whole.slice(at, batch_docs)
                ids, counts = batch.column("ids"), batch.column("counts")
                sizes = np.diff(ids.offsets.to_numpy())
                if not sizes.sum():
                    continue
                doc_id = batch.column("doc_id").fill_null(LAST).to_numpy()
                doc = np.repeat(np.arange(batch.num_rows), sizes)
                search.add(doc_id, batch.column("n").to_numpy(), doc, ids.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy())
        sizes = [len(b) for b in search.best]
        found = np.array([x for b in search.best for x in b], np.int64).reshape(-1, 2)
        ids = pa.array([None if i == LAST else i for i in found[:, 1].tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, sizes)), ids, pa.array(found[:, 0])], ["query", "doc_id", "score"])

    rows = table.where("size(ids) > 0").mapInArrow(run, "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query", "rank", "doc_id", "score")


def ranked_search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 50,
    width: int = 1024,
    batch_docs: int = 2048,
    most_queries: int = 1024,
    most_terms: int = 1 << 17,
) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents with a score above 0 for each row of ``queries`` (item_id, text)."""
    source = texts(docs)
    items = freeze(
        queries.select(F.col("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn(
            "query", F.monotonically_increasing_id()
        )
    )
    parts = [
        freeze(search_block(source, block, k, width, batch_docs))
        for block in query_blocks(items.select("query", "text"), most_queries, most_terms)
    ]
    found = docs.sparkSession.createDataFrame([], OUT)
    for part in parts:
        found = found.unionByName(part)
    return found.join(items.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
