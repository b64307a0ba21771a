"""Exact top-k search with a vector-approximation file.

The components of a block of vectors are quantised to ``cells`` cells a dimension; the file
of cell numbers is scanned first. From the bounds of a vector's cells follow an upper and a
lower bound of its score with a query. Vectors whose upper bound is below the k-th largest
lower bound are out; the others are read exactly, best bound first, until the k-th best
exact score is certain: no unread vector can reach it, ties included.

Queries are dealt out in blocks to all blocks of vectors; a task holds one block of each.
Every block gives its own k best, which is certain within the block, and the best of all
blocks are merged per query in two partial steps. So no task holds a table, and what meets
for a query is k rows a block.

Scores are exact 64-bit integers; a finite vector whose components or scores do not fit
raises. Vectors that are null or have null, NaN or infinite components take no part, nor do rows without an id; vectors of another length than
the query's are not compared with it. Repeated rows are candidates each, but rows with the
query's own id are not. A query with fewer than k candidates gets all; one without any
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from navpulse.llm.common import freeze



def scaled(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """vec_id and the integer components of the vectors that take part."""
    parts = F.transform(F.col(embedding), lambda x: x.cast("double") * scale)
    good = F.forall("parts", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), parts.alias("parts"))
    rows = rows.where("vec_id IS NOT NULL AND parts IS NOT NULL").where(F.coalesce(good, F.lit(False)))
    wide = F.raise_error(F.concat(F.lit("a component is too large for 64 bits in vector "), F.col("vec_id").cast("string"))).cast("long")
    whole = F.transform("parts", lambda x: F.when(F.abs(x) < 2.0**63, F.floor(x).cast("long")).otherwise(wide))
    return rows.select("vec_id", whole.alias("v"))


def approximation(v: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each component, and the least and largest component of each cell by dimension."""
    m, dims = v.shape
    marks = np.quantile(v, np.linspace(0, 1, cells + 1)[1:-1], axis=0)
    cell = np.empty(v.shape, np.uint8)
    low, high = np.zeros((cells, dims)), np.zeros((cells, dims))
    for d in range(dims):
        cell[:, d] = np.searchsorted(marks[:, d], v[:, d], side="right")
        for c in np.unique(cell[:, d]):
            inside = v[cell[:, d] == c, d]
            low[c, d], high[c, d] = inside.min(), inside.max()
    return cell, low, high


def products(rows: np.ndarray, query: np.ndarray, small: bool) -> np.ndarray:
    """Exact inner products; ``small`` if none of their sums can leave 64 bits."""
    if small:
        return rows @ query
    made = [sum(x * y for x, y in zip(row, query.tolist())) for row in rows.tolist()]
    if any(not -(1 << 63) <= x < 1 << 63 for x in made):
        raise OverflowError("a score does not fit 64 bits")
    return np.array(made, np.int64)


def block_top(queries: np.ndarray, query_ids: np.ndarray, exact: np.ndarray, ids: np.ndarray, k: int, cells: int):
    """(query, vector, score) of each query's k best vectors of the block, all in whole numbers, in the order of ids."""
    v = exact.astype(float)
    cell, low, high = approximation(v, cells)
    dims = np.arange(v.shape[1])
    lows, highs = low[cell, dims], high[cell, dims]
    wide = np.abs(v).max(initial=0)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 21) // max(1, len(v)))
    for a in range(0, len(queries), step):
        whole = queries[a : a + step]
        q = whole.astype(float)
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        slack = np.abs(q).sum(axis=1, keepdims=True) * wide * 2.0**-45  # more than the rounding of the sums
        upper = plus @ highs.T + minus @ lows.T + slack
        lower = plus @ lows.T + minus @ highs.T - slack
        own = query_ids[a : a + step, None] == ids[None, :]
        upper[own], lower[own] = -np.inf, -np.inf
        if len(v) > k:
            least = np.partition(lower, len(v) - k, axis=1)[:, len(v) - k]
        else:
            least = np.full(len(q), -np.inf)
        small = (np.abs(q).sum(axis=1) * wide < 2.0**62).tolist()
        for i in range(len(q)):
            open_rows = np.flatnonzero((upper[i] >= least[i]) & (upper[i] > -np.inf))
            open_rows = open_rows[np.argsort(-upper[i, open_rows], kind="stable")]
            rows, scores, at, more = open_rows[:0], np.empty(0, np.int64), 0, 4 * k
            while at < len(open_rows):
                if len(scores) >= k and upper[i, open_rows[at]] < np.partition(scores, len(scores) - k)[len(scores) - k]:
                    break  # the k-th score is certain
                new = open_rows[at : at + more]
                rows, scores = np.append(rows, new), np.append(scores, products(exact[new], whole[i], small[i]))
                at, more = at + len(new), 2 * more
            best = np.lexsort((ids[rows], -scores))[:k]
            found.append((np.full(len(best), query_ids[a + i]), ids[rows[best]], scores[best]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else None


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: int = 256,
    cells: int = 16,
    block: int = 4096,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query with other rows.

    ``block`` is the number of vectors, and of queries, that meet in a task, so a task's
    memory is bounded whatever the tables hold.
    """
    base = freeze(scaled(vectors, vec_id, embedding, scale))
    asked = freeze(scaled(queries, vec_id, embedding, scale).dropDuplicates(["vec_id"]))
    n, m = base.count(), asked.count()
    vector_blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // block))
    spread = lambda blocks, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(blocks)).cast("int")
    # Every pair of blocks is a cell of the grid: rows go to each cell of their row or column.
    right = base.withColumn("b", spread(vector_blocks, 1)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    left = asked.withColumn("a", spread(query_blocks, 2)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1))))
    grid = right.select("a", "b", "vec_id", "v", F.lit(False).alias("query")).unionByName(
        left.select("a", "b", "vec_id", "v", F.lit(True).alias("query"))
    )
    dealt = grid.repartition(max(1, min(vector_blocks * query_blocks, 1 << 20)), "a", "b").sortWithinPartitions("a", "b")

    def cell_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows of one cell of the grid at a time; they come in order."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            edges = (np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist()
            for s, e in zip([0, *edges], [*edges, len(a)]):
                if held and (held[0].column("a")[0].as_py(), held[0].column("b")[0].as_py()) != (a[s], b[s]):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(s, e - s))
        if held:
            yield pa.Table.from_batches(held)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cell_tables(batches):
            is_query, ids = cell.column("query").to_numpy(), cell.column("vec_id").to_numpy()
            lists = cell.column("v").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            starts, values = lists.offsets.to_numpy()[:-1], lists.values.to_numpy()
            for dims in np.unique(sizes[is_query]).tolist():
                own, others = np.flatnonzero(is_query & (sizes == dims)), np.flatnonzero(~is_query & (sizes == dims))
                if not len(others):
                    continue
                at = np.arange(dims)
                q, v = (values[starts[rows][:, None] + at] for rows in (own, others))
                made = block_top(q, ids[own], v, ids[others], k, cells)
                if made is not None and len(made[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
