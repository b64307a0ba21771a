"""SimHash near-duplicates by an inverted index of byte positions with count filtering.

Fingerprints that differ in at most ``bits`` bits agree in at least ``8 - bits`` of their 8
bytes. A posting list holds the fingerprints with given bytes at given positions: three
positions at a time, from a family of triples of which every set of ``8 - bits`` positions
contains one, so each pair to be found meets in some list and lists stay short. Where two
members of a list meet, the shared positional bytes are tallied; the pair is kept if it
reaches the guaranteed minimum, and then verified by its differing bits.

Links are only needed to join classes, so a list is searched from a frontier: members that
have been reached leave the set still to be compared. A list of near copies costs a few
passes over it, not a pass for each member, and gives at most one link a member. Equal
fingerprints are one node from the start.

Null and empty texts have fingerprint zero and link like others. Rows without an id link
too; a component of such rows only has no name (null). Rows that repeat give a
row each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from navpulse.llm.common import freeze, map_batches, texts
from navpulse.llm.components import components

BYTES = 8


def fingerprint(raw: bytes, words: int, seed: int) -> int:
    """Majority bits of the XXH64 of all shingles of ``words`` words; ASCII lower case."""
    parts = raw.lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed)], np.uint64)
    else:
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        starts = np.concatenate([[0], ends[:-words]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], np.uint64
        )
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [fingerprint(t.as_py(), words, seed) for t in batch.column("text").cast(pa.binary())]
        signed = np.array(made, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed)], ["doc_id", "fp"])

    return map_batches(texts(docs), run, "doc_id long, fp long")


def covering(size: int, shared: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` of the 8 positions such that every set of ``shared`` positions contains one.

    Greedy: the set that covers most of what is still uncovered comes next.
    """
    open_sets = {frozenset(c) for c in combinations(range(BYTES), shared)}
    choices = [frozenset(c) for c in combinations(range(BYTES), size)]
    family = []
    while open_sets:
        best = max(choices, key=lambda c: sum(c <= o for o in open_sets))
        open_sets = {o for o in open_sets if not best <= o}
        family.append(tuple(sorted(best)))
    return family


def postings(nodes: DataFrame, bits: int, positions: int) -> DataFrame:
    """A row for each fingerprint and set of positions: the list it belongs to."""
    family = covering(positions, BYTES - bits)

    def of(at: tuple[int, ...], nr: int):
        mask = sum(0xFF << (8 * p) for p in at)
        signed = mask - (1 << 64) if mask >> 63 else mask
        return F.struct(F.lit(nr).alias("nr"), F.col("fp").bitwiseAND(F.lit(signed)).alias("key"))

    lists = F.explode(F.array(*[of(at, nr) for nr, at in enumerate(family)])).alias("list")
    return nodes.select("fp", lists).select("list.nr", "list.key", "fp")


def differing(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a)


def shared_bytes(a: np.ndarray) -> np.ndarray:
    """Tally of positions at which the bytes of a XOR are zero."""
    return (a[:, None].view(np.uint8).reshape(len(a), BYTES) == 0).sum(axis=1)


def list_links(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect the members of one list as all pairs within ``bits`` would."""
    out: list[tuple[int, int]] = []
    left = members
    while left.size > 1:
        frontier, left = [int(left[0])], left[1:]
        while frontier and left.size:
            x = np.uint64(frontier.pop())
            apart = left ^ x
            kept = np.flatnonzero(shared_bytes(apart) >= BYTES - bits)
            near = kept[differing(apart[kept]) <= bits]
            if near.size:
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                frontier += found.tolist()
                left = np.delete(left, near)
    return out


def links(nodes: DataFrame, bits: int = 4, positions: int = 3) -> DataFrame:
    """Pairs (a, b) of fingerprints whose classes are those of all pairs within ``bits`` bits."""
    if not 0 <= bits <= BYTES - positions:
        raise ValueError("bits and positions must leave a shared set of positions")
    lists = postings(nodes, bits, positions)
    counted = lists.repartition("nr", "key").sortWithinPartitions("nr", "key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # the last list may go on in the next batch

        def pairs(nr: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero((nr[1:] != nr[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], new, [len(fp)]])
            sizes = np.diff(starts)
            twos = starts[:-1][sizes == 2]
            apart = fp[twos] ^ fp[twos + 1]
            good = twos[(shared_bytes(apart) >= BYTES - bits) & (differing(apart) <= bits)]
            out = list(zip(fp[good].tolist(), fp[good + 1].tolist()))
            for a, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                out += list_links(fp[a : a + n], bits)
            made = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("nr", "key", "fp")]
            columns[2] = columns[2].view(np.uint64)
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns)]
            nr, key, fp = columns
            last = int(np.flatnonzero((nr != nr[-1]) | (key != key[-1]))[-1]) + 1 if (nr[0], key[0]) != (nr[-1], key[-1]) else 0
            kept = (nr[last:], key[last:], fp[last:])
            if last:
                yield pairs(nr[:last], key[:last], fp[:last])
        if kept is not None:
            yield pairs(*kept)

    return counted.mapInArrow(search, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, words: int = 4, seed: int = 42, bits: int = 4, positions: int = 3
) -> DataFrame:
    """doc_id, fingerprint in hex, component_id: the smallest doc_id reachable over links."""
    made = freeze(fingerprints(docs, words, seed))
    nodes = freeze(made.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = freeze(links(nodes, bits, positions))
    # Fingerprints are joined first and named last, so one that has only rows without an id still links.
    labels = components(edges, "a", "b")
    named = freeze(nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", F.coalesce("component", "fp").alias("class"), "least"))
    least = named.groupBy("class").agg(F.min("least").alias("component_id"))
    classes = freeze(named.join(least, "class").select(F.col("fp").alias("of"), "component_id"))
    joined = made.join(classes, F.col("fp") == F.col("of"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
