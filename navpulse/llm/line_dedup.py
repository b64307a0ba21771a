"""Lines that many documents share, found with two Bloom filters.

A line's key is the line without ASCII white space at both ends, A-Z in lower case. Each
task folds the hashes of its keys into two filters, of keys seen in a document and of keys
seen in a second one, and sends them on as packed, compressed segments. A segment is put
together from all tasks: what two tasks have each seen once has been seen twice. Only keys
that the second filter holds (every repeated key, and a few others) are shuffled, with the
number of their documents, summed in each batch and task before; there the keys themselves
are compared, so no result depends on the filters. Lines of keys in ``min_documents`` or
more documents go from every document, or with ``keep_first`` from all but the first line
(smallest doc_id, then place).

The filters take ``bits_per_line`` bits for each line of the input and at most 2**``most_bits``
(128 MB for each in a task, and for the second one everywhere); beyond 2**``most_bits`` / 8
lines more keys than repeated ones are confirmed, so the shuffle grows, never the result.
Up to ``most_held`` confirmed keys are handed to every task as 16-byte digests; more are
joined to the documents that may hold them.

Each row is a document of its own, repeated rows and ids included. A null or empty text is
one empty line; keys of fewer than ``min_points`` code points stay. A null doc_id comes
last where the first line is chosen. Other columns are neither read nor returned; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from navpulse.llm.common import WHITE, freeze, map_batches, texts

#: A filter's segments have this many bits at most; both positions of a key lie in one.
SEGMENT = 20
LAST = (1 << 63) - 1
OUT = "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string"


def keys_of(raw: bytes) -> list[bytes]:
    """The key of each line; bytes.lower changes A-Z only."""
    return [line.strip(WHITE) for line in raw.lower().split(b"\n")]


def long_enough(key: bytes, points: int) -> bool:
    return len(key) >= points and (points <= 1 or len(key.decode()) >= points)


def digests(keys: Iterable[bytes]) -> np.ndarray:
    """128-bit digests, a row of two words each."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2).astype(np.uint64)


def document_keys(raw: bytes, points: int) -> dict[bytes, int]:
    """The different keys of a document that may be dropped, and the first line of each."""
    places: dict[bytes, int] = {}
    for n, key in enumerate(keys_of(raw)):
        if long_enough(key, points):
            places.setdefault(key, n)
    return places


class Filter:
    """Two positions for each digest in a filter of 2**bits bits, as a segment and two places in it."""

    def __init__(self, bits: int):
        self.bits, self.inner = bits, min(bits, SEGMENT)

    def segments(self, words: np.ndarray) -> np.ndarray:
        if self.bits == self.inner:
            return np.zeros(len(words), np.uint64)
        return words[:, 0] >> np.uint64(64 - self.bits + self.inner)

    def places(self, words: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.inner) - 1)
        return np.stack([words[:, 1] & mask, (words[:, 1] >> np.uint64(32)) & mask], axis=1)

    def plane(self, places: np.ndarray) -> np.ndarray:
        """Bits set at the places, eight to a byte."""
        whole = np.zeros(1 << self.inner, bool)
        whole[places.ravel()] = True
        return np.packbits(whole)


def once_and_twice(docs: DataFrame, shape: Filter, points: int) -> DataFrame:
    """A row for each segment with bits seen twice: segment, and those bits packed and compressed."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty((0, 2), np.uint64)]
        for batch in batches:
            documents = (document_keys(text.as_py(), points) for text in batch.column("text").cast(pa.binary()))
            held.append(digests(key for keys in documents for key in keys))
        words, seen = np.unique(np.concatenate(held), axis=0, return_counts=True)
        if not len(words):
            return
        at = shape.segments(words)  # in order, as the words are
        starts = np.flatnonzero(np.diff(at, prepend=at[0] + np.uint64(1)))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
            places = shape.places(words[a:b])
            planes = [shape.plane(places), shape.plane(places[seen[a:b] > 1])]
            packed = [pa.array([zlib.compress(p.tobytes(), 1)], pa.binary()) for p in planes]
            yield pa.RecordBatch.from_arrays([pa.array([int(at[a])], pa.int32()), *packed], ["segment", "once", "twice"])

    def merge(table: pa.Table) -> pa.Table:
        once = np.zeros(1 << (shape.inner - 3), np.uint8)
        twice = once.copy()
        for one, two in zip(table["once"], table["twice"]):
            new = np.frombuffer(zlib.decompress(one.as_py()), np.uint8)
            twice |= np.frombuffer(zlib.decompress(two.as_py()), np.uint8) | (once & new)
            once |= new
        rows = [zlib.compress(twice.tobytes(), 1)] if twice.any() else []
        return pa.table([table["segment"].slice(0, len(rows)), pa.array(rows, pa.binary())], names=["segment", "bits"])

    folded = docs.select("text").mapInArrow(fold, "segment int, once binary, twice binary")
    return folded.groupBy("segment").applyInArrow(merge, "segment int, bits binary")


class Suspects:
    """Tells of which digests the second filter holds both bits; it is unpacked once in each task."""

    def __init__(self, shape: Filter, filters):
        self.shape, self.filters, self.whole = shape, filters, None

    def __call__(self, words: np.ndarray) -> np.ndarray:
        shape = self.shape
        if self.whole is None:
            segments, empty = self.filters.value, np.zeros(1 << (shape.inner - 3), np.uint8)
            count = 1 << (shape.bits - shape.inner)
            parts = [np.frombuffer(zlib.decompress(segments[s]), np.uint8) if s in segments else empty for s in range(count)]
            self.whole = np.concatenate(parts)
        base = shape.segments(words)[:, None] << np.uint64(shape.inner) | shape.places(words)
        bits = self.whole[base >> np.uint64(3)] >> (7 - (base & np.uint64(7))).astype(np.uint8) & 1
        return bits.all(axis=1)


def confirmed(docs: DataFrame, suspected: Suspects, points: int, documents: int) -> DataFrame:
    """Digest of each key in at least ``documents`` documents, and the place of its first line."""

    def suspects(batch: pa.RecordBatch) -> pa.RecordBatch:
        places = [document_keys(text.as_py(), points) for text in batch.column("text").cast(pa.binary())]
        held = iter(suspected(digests(key for keys in places for key in keys)).tolist())
        seen: Counter[bytes] = Counter()
        first: dict[bytes, tuple[int, int]] = {}
        for i, keys in zip(batch.column("doc_id").to_pylist(), places):
            for key, n in keys.items():
                if next(held):
                    seen[key] += 1
                    place = (LAST if i is None else i, n)
                    first[key] = min(first.get(key, place), place)
        made = [list(seen), list(seen.values()), [first[k][0] for k in seen], [first[k][1] for k in seen]]
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds)], ["key", "n", "doc", "at"])

    rows = map_batches(docs, suspects, "key binary, n long, doc long, at long")
    sums = rows.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "at")).alias("first"))

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [xxhash.xxh3_128_digest(k.as_py()) for k in batch.column("key")]
        return pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), *batch.columns[1:]], ["digest", "doc", "at"])

    many = sums.where(F.col("n") >= documents).select("key", "first.doc", "first.at")
    return map_batches(many, digest, "digest binary, doc long, at long")


def cut(i: int | None, raw: bytes, dropped: dict[bytes, tuple[int, int]], keep_first: bool) -> tuple[bytes, int, int]:
    """The text without the lines of ``dropped`` keys, its lines and how many went."""
    lines = raw.split(b"\n")
    if not dropped:
        return raw, len(lines), 0
    me, kept = LAST if i is None else i, []
    for n, (line, key) in enumerate(zip(lines, keys_of(raw))):
        first = dropped.get(xxhash.xxh3_128_digest(key))
        if first is None or keep_first and first == (me, n):
            kept.append(line)
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def rows_of(ids: pa.Array, made: list[tuple[bytes, int, int]], with_text: bool) -> pa.RecordBatch:
    sha = [hashlib.sha256(t).hexdigest() for t, _, _ in made]
    texts_out = pa.array([t for t, _, _ in made], pa.binary()).cast(pa.string()) if with_text else pa.nulls(len(made), pa.string())
    columns = [ids, texts_out, pa.array([n for _, n, _ in made], pa.int64()), pa.array([d for _, _, d in made], pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(sha, pa.string())], ["doc_id", "text", "n_lines", "n_dropped", "kept_sha256"])


def cut_by_held(docs: DataFrame, many: DataFrame, keep_first: bool, with_text: bool) -> DataFrame:
    """Few confirmed keys: every task gets their digests."""
    held = {bytes(r["digest"]): (r["doc"], r["at"]) for r in many.toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()))
        made = [cut(i, t.as_py(), shared.value, keep_first) for i, t in pairs]
        return rows_of(batch.column("doc_id"), made, with_text)

    return map_batches(docs, run, OUT)


def cut_by_join(
    docs: DataFrame, many: DataFrame, suspected: Suspects, points: int, keep_first: bool, with_text: bool
) -> DataFrame:
    """Many confirmed keys: joined to the suspects of each different text, and the lists found to the texts."""

    def suspects(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = [text.as_py() for text in batch.column("text").cast(pa.binary())]
        lists = [list(document_keys(raw, points)) for raw in raws]
        held = iter(suspected(digests(key for keys in lists for key in keys)).tolist())
        out, of = [], []
        for raw, keys in zip(raws, lists):
            found = [xxhash.xxh3_128_digest(k) for k in keys if next(held)]
            out += found
            of += [xxhash.xxh3_128_digest(raw)] * len(found)
        return pa.RecordBatch.from_arrays([pa.array(of, pa.binary()), pa.array(out, pa.binary())], ["whole", "digest"])

    pairs = map_batches(docs.select("text"), suspects, "whole binary, digest binary").distinct()
    found = freeze(pairs.join(many, "digest"))  # a plain scan on both sides, so hot keys can be split
    lists = freeze(found.groupBy("whole").agg(F.collect_list(F.struct("digest", "doc", "at")).alias("found")))

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole = [xxhash.xxh3_128_digest(t.as_py()) for t in batch.column("text").cast(pa.binary())]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(whole, pa.binary())], ["doc_id", "text", "whole"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = (batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("found").to_pylist())
        made = [
            cut(i, t.as_py(), {x["digest"]: (x["doc"], x["at"]) for x in found or ()}, keep_first)
            for i, t, found in zip(*columns)
        ]
        return rows_of(batch.column("doc_id"), made, with_text)

    joined = map_batches(docs, named, "doc_id long, text string, whole binary").join(lists, "whole", "left")
    return map_batches(joined.select("doc_id", "text", "found"), run, OUT)


def line_dedup(
    docs: DataFrame,
    min_documents: int = 10,
    min_points: int = 1,
    keep_first: bool = False,
    with_text: bool = True,
    bits_per_line: int = 16,
    most_bits: int = 30,
    most_held: int = 1 << 18,
) -> DataFrame:
    """doc_id, text without the dropped lines, n_lines, n_dropped and kept_sha256 of every row."""
    source = texts(docs)
    newlines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    lines = source.agg(F.sum(newlines + 1)).first()[0] or 0
    shape = Filter(min(max((bits_per_line * lines - 1).bit_length(), 10), most_bits))
    # At most 2**most_bits bits in all, and zeros are compressed.
    segments = {r["segment"]: bytes(r["bits"]) for r in once_and_twice(source, shape, min_points).toLocalIterator()}
    suspected = Suspects(shape, source.sparkSession.sparkContext.broadcast(segments))
    many = freeze(confirmed(source, suspected, min_points, min_documents))
    if many.count() <= most_held:
        return cut_by_held(source, many, keep_first, with_text)
    return cut_by_join(source, many, suspected, min_points, keep_first, with_text)
