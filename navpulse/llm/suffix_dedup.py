"""Removal of byte strings that occur earlier in the corpus, by range-partitioned suffix sorting.

A string of ``min_bytes`` that occurs twice has the same local minima of a rolling hash in
both places, so only suffixes that start at such anchors need sorting, about 3 in 100
positions. What surrounds an anchor, up to ``min_bytes - GRAM`` bytes before it and
``min_bytes`` from it on, is its context and holds every string the anchor answers for.

1. Anchors meet by the hash of their first GRAM bytes. Unique ones are done. Of equal
   contexts all but the earliest are repeats in full; they are sorted out in each task
   before the shuffle, so a passage that millions of documents share costs a row a task.
2. The suffixes left, whose first bytes recur with other surroundings, are dealt out by
   splitters over their leading bytes, sampled from the corpus. A splitter is cut to GRAM
   bytes, so that suffixes of one beginning stay together, unless that beginning is so
   frequent that several splitters fall into it: then it is split by what follows.
3. A bucket sorts its suffixes, and their reversed left sides, by multikey quicksort; the
   common prefixes of neighbours give, for each offset of a string to its anchor, which
   strings are equal. Strings whose right part also begins a splitter may have equals in
   the next buckets: the earliest of each bucket are compared across boundaries by their
   bytes, at most one row a bucket and string.
4. Each document's strings with an earlier equal are joined to it and their bytes removed.

Earlier means smaller doc_id, or the same document and an earlier start. Strings are judged
on the input, never on what is left, and never cross documents. Null texts are empty.
doc_id names a document: rows that share one are versions of one document, not repeats of
each other, and each loses what any of them would; rows without a doc_id stay whole and
take no part. Texts shorter than ``min_bytes`` stay whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from navpulse.llm.common import flat_bytes, free_name, freeze, map_batches, schema_of, texts
from navpulse.llm.exact_dedup import GRAM, rolling

BLOCK = 1 << 19
#: Documents and anchors a document in the sample that places the splitters.
SAMPLE_DOCS, SAMPLE_ANCHORS = 3000, 64
#: Buckets for each shuffle partition.
BUCKETS = 4
LATER, FREQUENT = 1, 2


def slide(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` over each run of ``width`` values, by doubling."""
    n, step = len(x) - width + 1, 1
    while 2 * step <= width:
        x = op(x[:-step], x[step:])
        step *= 2
    return op(x[:n], x[width - step : width - step + n])


def anchors(flat: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Document, position, hash of the first bytes and hash of the context of each anchor."""
    n, span = len(flat), size - GRAM
    found = []
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        lo, hi = max(0, a - 2 * span), min(n, b + 2 * size)
        if hi - lo < size:
            continue
        h = rolling(flat[lo:hi]) | np.uint64(1)
        low = slide(np.minimum, h, span + 1)
        # Only strings within one document count.
        first = max(0, int(np.searchsorted(offsets, lo, side="right")) - 1)
        last = int(np.searchsorted(offsets, hi, side="left"))
        starts = np.clip(offsets[first:last] - lo, 0, len(low))
        ends = np.clip(offsets[first + 1 : last + 1] - size + 1 - lo, 0, len(low))
        whole = ends > starts
        edge = np.zeros(len(low) + 1, np.int32)
        np.add.at(edge, starts[whole], 1)
        np.add.at(edge, ends[whole], -1)
        low[np.cumsum(edge[:-1]) == 0] = 0
        pad = np.zeros(span, np.uint64)
        at = np.flatnonzero(slide(np.maximum, np.concatenate([pad, low, pad]), span + 1) == h) + lo
        at = at[(at >= a) & (at < b)]
        doc = np.searchsorted(offsets, at, side="right") - 1
        left = np.maximum(offsets[doc], at - span)
        right = np.minimum(offsets[doc + 1], at + size)
        context = ((at - left) * 1009 + (right - at)).astype(np.uint64)
        for o in [*range(-span, size - GRAM, GRAM), size - GRAM]:
            context = (context ^ h[np.clip(at + o, left, right - GRAM) - lo]) * np.uint64(0xD6E8FEB86659FD93)
            context ^= context >> np.uint64(29)
        found.append((doc, at - offsets[doc], h[at - lo], context))
    if not found:
        empty = np.empty(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def runs(*keys: np.ndarray) -> np.ndarray:
    """True where a new run of equal keys starts."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def batch_anchors(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, ...]:
    flat, offsets = flat_bytes(batch.column("text"))
    doc, pos, gram, context = anchors(flat, offsets, size)
    return batch.column("doc_id").to_numpy(zero_copy_only=False)[doc], pos, gram, context


def splitters(docs: DataFrame, size: int, buckets: int) -> tuple[list[bytes], np.ndarray]:
    """Sorted splitters, and the hashes of beginnings so frequent that they are split inside."""
    total = docs.count()
    sample = docs if total <= SAMPLE_DOCS else docs.sample(SAMPLE_DOCS / total, 17)

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, offsets = flat_bytes(batch.column("text"))
        doc, pos, gram, context = anchors(flat, offsets, size)
        order = np.lexsort((context, doc))
        order = order[runs(doc[order], context[order])]
        nr = np.arange(len(order)) - np.maximum.accumulate(np.where(runs(doc[order]), np.arange(len(order)), 0))
        order = order[nr < SAMPLE_ANCHORS]
        at = offsets[doc[order]] + pos[order]
        ends = np.minimum(at + size, offsets[doc[order] + 1])
        raw = flat.tobytes()
        return pa.RecordBatch.from_arrays([pa.array([raw[a:b] for a, b in zip(at, ends)], pa.binary())], ["suffix"])

    suffixes = sorted(bytes(r[0]) for r in map_batches(sample, pick, "suffix binary").collect())
    chosen = [suffixes[len(suffixes) * k // buckets] for k in range(1, buckets)] if suffixes else []
    begins = [s[:GRAM] for s in chosen]
    often = {g for g, after in zip(begins, begins[1:]) if g == after}
    made = sorted({s if s[:GRAM] in often else s[:GRAM] for s in chosen} | often)
    hashes = [int(rolling(np.frombuffer(g, np.uint8))[0]) | 1 for g in sorted(often)]
    return made, np.array(hashes, np.uint64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


def meeting(docs: DataFrame, size: int, frequent: np.ndarray) -> DataFrame:
    """Anchors of all documents, later copies of a context within a task already told apart."""

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, pos, gram, context = batch_anchors(batch, size)
        kind = np.where(np.isin(gram, frequent), FREQUENT, 0)
        both = gram ^ (context * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(both)
        new = runs(both[order])
        alone = new & np.append(new[1:], True)
        many = order[~alone]
        many = many[np.lexsort((pos[many], doc[many], both[many]))]
        begin = runs(both[many])
        head = many[np.maximum.accumulate(np.where(begin, np.arange(len(many)), 0))] if len(many) else many
        later = (doc[many] != doc[head]) | (pos[many] != pos[head])
        kind[many[later]] = LATER
        same = many[~later & ~begin]  # the very same anchor of a repeated row
        keep = np.ones(len(doc), bool)
        keep[same] = False
        gram, context = np.where(kind == LATER, 0, gram), np.where(kind == LATER, 0, context)
        return pa.RecordBatch.from_arrays(
            [signed(gram[keep]), signed(context[keep]), pa.array(doc[keep]), pa.array(pos[keep] << 2 | kind[keep])],
            ["gram", "context", "doc_id", "at"],
        )

    return map_batches(docs, emit, "gram long, context long, doc_id long, at long")


def gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    some = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(some).combine_chunks() if some else None


def judged(met: DataFrame) -> DataFrame:
    """doc_id and position * 2 + 1 for repeats in full, + 0 for suffixes that are to be sorted."""
    route = F.when(F.col("at").bitwiseAND(F.lit(3)) == LATER, F.xxhash64("doc_id", "at"))
    route = route.when(F.col("at").bitwiseAND(F.lit(3)) == FREQUENT, F.xxhash64("gram", "context"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gather(batches)
        if rows is None:
            return
        gram, context, doc, at = (rows.column(c).to_numpy() for c in ("gram", "context", "doc_id", "at"))
        kind, pos = at & 3, at >> 2
        done = kind == LATER
        docs, marks = [doc[done]], [pos[done] * 2 + 1]
        rest = np.flatnonzero(~done)
        order = rest[np.argsort(gram[rest])]
        new = runs(gram[order])
        alone = new & np.append(new[1:], True) & (kind[order] != FREQUENT)
        order = order[~alone]
        order = order[np.lexsort((pos[order], doc[order], context[order], gram[order]))]
        if len(order):
            first = runs(gram[order], context[order])
            head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            later = (doc[order] != doc[head]) | (pos[order] != pos[head])
            docs.append(doc[order[later]])
            marks.append(pos[order[later]] * 2 + 1)
            group = np.cumsum(runs(gram[order])) - 1
            varied = np.bincount(group, weights=first)[group] > 1
            still = order[first & (varied | (kind[order] == FREQUENT))]
            docs.append(doc[still])
            marks.append(pos[still] * 2)
        docs, marks = np.concatenate(docs), np.concatenate(marks)
        if len(docs):
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(marks)], ["doc_id", "mark"])

    dealt = met.repartition(route.otherwise(F.col("gram")))
    return dealt.mapInArrow(judge, "doc_id long, mark long")


def contexts(docs: DataFrame, open_marks: DataFrame, size: int, cuts: list[bytes]) -> DataFrame:
    """Bucket, suffix, reversed left side, document and position of the suffixes to be sorted."""
    lists = open_marks.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list("mark").alias("marks"))
    joined = docs.join(lists, docs["doc_id"] == lists["of"]).select("doc_id", "text", "marks")
    span = size - GRAM

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        bucket, rights, lefts, ids, places = [], [], [], [], []
        lists = batch.column("marks")
        for doc, text, marks in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary()), lists):
            raw, doc = text.as_py(), doc.as_py()
            for mark in marks.as_py():
                p = mark >> 1
                right = raw[p : p + size]
                bucket.append(bisect_right(cuts, right))
                rights.append(right)
                lefts.append(raw[max(0, p - span) : p][::-1])
                ids.append(doc)
                places.append(p)
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int32()), pa.array(rights, pa.binary()), pa.array(lefts, pa.binary()),
             pa.array(ids, pa.int64()), pa.array(places, pa.int64())],
            ["bucket", "suffix", "before", "doc_id", "pos"],
        )

    return map_batches(joined, extract, "bucket int, suffix binary, before binary, doc_id long, pos long")


def padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each row, zero-filled to a multiple of 8, and their lengths."""
    width = -(-width // 8) * 8
    flat, offsets = flat_bytes(column)
    size = np.diff(offsets)
    out = np.zeros((len(size), width), np.uint8)
    inside = np.arange(width) < size[:, None]
    out[inside] = flat
    return out, size


def multikey_quicksort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and the common prefix of each with the one before (of the first: -1).

    The keys are 8 bytes each. All rows are parted by the first key; where rows tie, they and
    only they are parted by the next one.
    """
    m = len(rows)
    words = rows.view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0])
    new = runs(words[order, 0])
    for d in range(1, words.shape[1]):
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        own = order[tied]
        by = np.lexsort((words[own, d], group))
        order[tied] = own[by]
        new[tied] |= runs(group, words[order[tied], d])
    ahead = rows[order]
    differ = ahead[1:] != ahead[:-1]
    common = np.full(m, -1)
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, common


def equal_strings(
    suffix: pa.Array, before: pa.Array, place: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each row (in order of age) and offset: is there the string, and is it an earlier row's.

    Rows of one ``place`` are the same position of the same document, given twice.
    """
    span = size - GRAM
    right, right_size = padded(suffix, size)
    left, left_size = padded(before, span)
    m = len(right)
    by_right, common_right = multikey_quicksort(right)
    by_left, common_left = multikey_quicksort(left)
    there = np.zeros((m, span + 1), bool)
    again = np.zeros((m, span + 1), bool)

    def classes(order: np.ndarray, common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        joins = common >= least
        name, tied = np.empty(m, np.int64), np.empty(m, bool)
        name[order] = np.cumsum(~joins)
        tied[order] = joins | np.append(joins[1:], False)
        return name, tied

    for o in range(span + 1):
        there[:, o] = (left_size >= o) & (right_size >= size - o)
        r, tied_r = classes(by_right, common_right, size - o)
        if o:
            x, tied_x = classes(by_left, common_left, o)
        else:
            x, tied_x = np.zeros(m, np.int64), np.ones(m, bool)
        rows = np.flatnonzero(there[:, o] & tied_r & tied_x)
        if len(rows) > 1:
            key = r[rows] * (m + 1) + x[rows]
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            again[rows, o] = place[rows[first[inverse]]] != place[rows]
    return there, again


def reach(right: np.ndarray, bucket: np.ndarray, cuts: list[bytes]) -> np.ndarray:
    """Longest common prefix of each suffix with a splitter beside its bucket, if that one splits a beginning."""
    out = np.zeros(len(right), np.int64)
    for k in np.unique(bucket):
        rows = np.flatnonzero(bucket == k)
        for cut in [cuts[c] for c in (k - 1, k) if 0 <= c < len(cuts) and len(cuts[c]) > GRAM]:
            same = right[rows][:, : len(cut)] == np.frombuffer(cut, np.uint8)
            prefix = np.where(same.all(axis=1), len(cut), np.argmin(same, axis=1))
            out[rows] = np.maximum(out[rows], prefix)
    return out


def sorted_buckets(dealt: DataFrame, size: int, cuts: list[bytes]) -> DataFrame:
    """Ranges lo..hi of starts of repeated strings; with ``string``, one to be compared across boundaries."""
    span = size - GRAM

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gather(batches)
        if rows is None:
            return
        doc, pos = rows.column("doc_id").to_numpy(), rows.column("pos").to_numpy()
        age = np.lexsort((pos, doc))
        rows, doc, pos = rows.take(pa.array(age)).combine_chunks(), doc[age], pos[age]
        suffix, before = (rows.column(c).chunk(0) for c in ("suffix", "before"))
        there, again = equal_strings(suffix, before, np.cumsum(runs(doc, pos)), size)
        # Runs of offsets of one row are runs of starts.
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, from_o = np.nonzero(edge == 1)
        _, to_o = np.nonzero(edge == -1)
        ids, lo, hi = [doc[row]], [pos[row] - to_o + 1], [pos[row] - from_o]
        strings: list[bytes | None] = [None] * len(row)
        deep = reach(padded(suffix, size)[0], rows.column("bucket").to_numpy(), cuts)
        near = np.flatnonzero(deep > GRAM)
        if len(near):
            o = np.arange(span + 1)
            r, c = np.nonzero(there[near] & ~again[near] & (size - o <= deep[near][:, None]))
            r = near[r]
            right, left = suffix.to_pylist(), before.to_pylist()
            strings += [left[i][:k][::-1] + right[i][: size - k] for i, k in zip(r.tolist(), c.tolist())]
            ids.append(doc[r])
            lo.append(pos[r] - c)
            hi.append(pos[r] - c)
        ids, lo, hi = np.concatenate(ids), np.concatenate(lo), np.concatenate(hi)
        if len(ids):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(lo), pa.array(hi), pa.array(strings, pa.binary())],
                ["doc_id", "lo", "hi", "string"],
            )

    return dealt.repartition("bucket").mapInArrow(sort, "doc_id long, lo long, hi long, string binary")


def repeats(docs: DataFrame, size: int, buckets: int | None = None) -> DataFrame:
    """doc_id, lo, hi: every string of ``size`` bytes that starts in lo..hi has an earlier equal (hi may reach too far)."""
    spark = docs.sparkSession
    if buckets is None:
        buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = docs.where("doc_id IS NOT NULL")
    cuts, frequent = splitters(known, size, buckets)
    marks = freeze(judged(meeting(known, size, frequent)))
    is_open = F.col("mark").bitwiseAND(F.lit(1)) == 0
    found = freeze(sorted_buckets(contexts(known, marks.where(is_open), size, cuts), size, cuts))
    pos = F.shiftright("mark", 1)
    full = marks.where(~is_open).select("doc_id", F.greatest(pos - (size - GRAM), F.lit(0)).alias("lo"), pos.alias("hi"))
    inside = found.where("string IS NULL").select("doc_id", "lo", "hi")
    age = F.rank().over(Window.partitionBy("string").orderBy("doc_id", "lo"))
    across = found.where("string IS NOT NULL").withColumn("age", age).where("age > 1").select("doc_id", "lo", "hi")
    return full.unionByName(inside).unionByName(across)


def with_ranges(docs: DataFrame, min_bytes: int, buckets: int | None) -> DataFrame:
    """All columns of ``docs`` and the packed ranges of each row, in the last column."""
    if min_bytes < GRAM + 8:
        raise ValueError("strings must be longer than the beginnings by which they meet")
    ranges = repeats(texts(docs), min_bytes, buckets)
    of, name = free_name(docs.columns, "_of"), free_name(docs.columns, "_ranges")
    packed = ranges.select(F.col("doc_id").alias(of), (F.shiftleft("lo", 32) + F.col("hi")).alias("r"))
    lists = packed.groupBy(of).agg(F.collect_set("r").alias(name))  # rows of one id bring the same ranges
    return docs.join(lists, docs["doc_id"].cast("long") == lists[of], "left").select(*docs.columns, name)


def cut_out(raw: bytes, ranges: list[int] | None, min_bytes: int) -> tuple[bytes, list[list[int]]]:
    """What is left of ``raw``, and the maximal runs of removed bytes."""
    n = len(raw)
    if not ranges or n < min_bytes:
        return raw, []
    pairs = np.array(ranges, np.int64)
    lo, hi = pairs >> 32, np.minimum(pairs & 0xFFFFFFFF, n - min_bytes)
    ok = lo <= hi
    edge = np.bincount(lo[ok], minlength=n + 1) - np.bincount(hi[ok] + min_bytes, minlength=n + 1)
    covered = np.cumsum(edge)[:n] > 0
    spans = np.flatnonzero(np.diff(np.pad(covered, 1).astype(np.int8))).reshape(-1, 2).tolist()
    return np.frombuffer(raw, np.uint8)[~covered].tobytes(), spans


def without_repeats(docs: DataFrame, min_bytes: int = 100, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, the removed spans, and the bytes that are kept with their digest."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, gone, spans, kept, sha = [], [], [], [], []
        for text, ranges in zip(batch.column("text").cast(pa.binary()), batch.column(batch.num_columns - 1)):
            raw = text.as_py()
            rest, cut = cut_out(raw, ranges.as_py(), min_bytes)
            sizes.append(len(raw))
            gone.append(len(raw) - len(rest))
            spans.append([{"start": a, "end": b} for a, b in cut])
            kept.append(rest)
            sha.append(hashlib.sha256(rest).hexdigest())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span),
             pa.array(kept, pa.binary()), pa.array(sha, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"],
        )

    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary, kept_sha256 string"
    return map_batches(with_ranges(texts(docs), min_bytes, buckets), run, schema)


def shortened(docs: DataFrame, min_bytes: int = 100, buckets: int | None = None) -> DataFrame:
    """The columns of ``docs`` with repeats cut from the text; of a character cut in two nothing stays.

    A column n_chars is counted anew.
    """
    source = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [
            cut_out(text.as_py(), ranges.as_py(), min_bytes)[0].decode(errors="ignore")
            for text, ranges in zip(batch.column("text").cast(pa.binary()), batch.column(batch.num_columns - 1))
        ]
        columns = [pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays(columns, names)

    out = map_batches(with_ranges(source, min_bytes, buckets), run, schema_of(source.select(*names)))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
