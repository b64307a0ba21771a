"""Conflict-constrained best-fit packing of documents into sequences.

Documents, longest first, go into the open bin that they leave least room in, unless it
holds a document of the same source or of the same duplicate cluster. Open bins are kept
in the order of their residual room, and each carries a bitmap of its sources and one of
its clusters; the search starts at the first bin with room enough and goes on from
successor to successor until both bitmaps allow the document. If none does, a bin opens.
A document longer than a bin is cut: its whole pieces fill bins of their own, the rest is
packed like a short document.

Packing runs per shard. A document's shard is a hash of its id, and there is one shard for
about every ``shard_size`` of total length, so shards are alike in size whatever the
sources and clusters are; a shard's lengths, never texts, fit a task many times over.
Bins are numbered within their shard.

Empty documents fill no room and get no bin (null). Null sources and clusters conflict
with nothing. Rows that repeat an id are packed each, in order of length. An empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from navpulse.llm.common import WHITE, flat_bytes, freeze, map_batches

SPACE = np.isin(np.arange(256), list(WHITE))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, number of words, source, and a hash of the text without white space as duplicate cluster."""
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("source").cast("string").alias("source"),
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, offsets = flat_bytes(batch.column("text"))
        sizes = []
        clusters = []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            visible = ~SPACE[flat[a:b]]
            sizes.append(int(np.count_nonzero(visible[1:] & ~visible[:-1])) + bool(len(visible) and visible[0]))
            clusters.append(xxhash.xxh64_intdigest(flat[a:b][visible].tobytes()) - (1 << 63))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), batch.column("source"), pa.array(clusters, pa.int64())],
            ["doc_id", "size", "source", "cluster"],
        )

    return map_batches(source, run, "doc_id long, size long, source string, cluster long")


class Bins:
    """Open bins by residual room, with the bitmaps of what they hold."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def open(self, room: int, source: int, cluster: int) -> int:
        nr = len(self.sources)
        self.sources.append(source)
        self.clusters.append(cluster)
        if room:
            insort(self.by_room, (room, nr))
        return nr

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for a document; ``source`` and ``cluster`` are single bits, or 0."""
        by_room, sources, clusters = self.by_room, self.sources, self.clusters
        for at in range(bisect_left(by_room, (size, -1)), len(by_room)):
            room, nr = by_room[at]
            if not (sources[nr] & source or clusters[nr] & cluster):
                del by_room[at]
                sources[nr] |= source
                clusters[nr] |= cluster
                if room > size:
                    insort(by_room, (room - size, nr))
                return nr, self.capacity - room
        return self.open(self.capacity - size, source, cluster), 0


def pack_shard(
    sizes: list[int], sources: list[str | None], clusters: list[int | None], capacity: int
) -> list[list[tuple[int, int, int | None, int]]]:
    """For each document, given longest first: its pieces as (start, size, bin, offset)."""
    bins = Bins(capacity)
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    twice = [c for c, n in Counter(c for c in clusters if c is not None).items() if n > 1]
    cluster_bit = {c: 1 << i for i, c in enumerate(twice)}  # a cluster met once conflicts with nothing
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        bits = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        pieces: list[tuple[int, int, int | None, int]] = []
        start = 0
        while size - start >= capacity:
            pieces.append((start, capacity, bins.open(0, *bits), 0))
            start += capacity
        if size > start:
            pieces.append((start, size - start, *bins.place(size - start, *bits)))
        out.append(pieces or [(0, 0, None, 0)])
    return out


def packed(items: DataFrame, capacity: int = 2048, shard_size: int = 1 << 20) -> DataFrame:
    """doc_id, piece, start, size, bin_id and bin_offset for (doc_id, size, source, cluster)."""
    # The running number spreads rows that share an id, or have none; it is written with them.
    rows = freeze(items.select("doc_id", "size", "source", "cluster", F.monotonically_increasing_id().alias("row")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_size))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "row"), F.lit(shards)))
    dealt = dealt.drop("row").repartition("shard").sortWithinPartitions("shard", F.desc("size"), "doc_id", "source", "cluster")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows of one shard at a time."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard").to_numpy()
            edges = (np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist()
            for s, e in zip([0, *edges], [*edges, len(shard)]):
                if held and held[0].column("shard")[0].as_py() != shard[s]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(s, e - s))
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            ids, sizes, sources, clusters, shard = (
                table.column(c).to_pylist() for c in ("doc_id", "size", "source", "cluster", "shard")
            )
            made = pack_shard(sizes, sources, clusters, capacity)
            flat = [
                (doc, n, start, size, None if nr is None else shard[0] << 32 | nr, offset)
                for doc, pieces in zip(ids, made)
                for n, (start, size, nr, offset) in enumerate(pieces)
            ]
            names = ["doc_id", "piece", "start", "size", "bin_id", "bin_offset"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*flat)], names)

    schema = "doc_id long, piece long, start long, size long, bin_id long, bin_offset long"
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = 2048, shard_size: int = 1 << 20) -> DataFrame:
    """Pack whole texts by their number of words; copies of a text and documents of a source never share a bin."""
    return packed(measured(docs), capacity, shard_size)
