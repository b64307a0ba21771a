"""Spelling variants: words one edit apart, by a bit-sliced position index.

The index of 64 words of one length is, for each position and letter, a machine word with a
bit for each of them that has the letter there. A query word is read letter by letter: the
set with no error so far and the set with one are machine words too, narrowed by the
letter's bits at the same position, or at the next one where the index words hold an
inserted letter. All queries of a batch take a step together, so a step costs a few array
operations. Deletions are the insertions of the other word, hence a pair is found from its
shorter word and told to both.

Two words one edit apart, the longer of M letters, share their first M div 2 letters or
the rest of the longer one from there on, as M is counted. So the vocabulary is dealt out by these
parts: only words of one part meet. Parts with very many words are cut into a grid of
slices of index words and of queries, whose cells are tasks' work of bounded size. A pair
that shares both parts counts in the first.

Words are counted per task first, so a frequent word reaches the shuffle as a row a task.
A null text has no words, and a null doc_id counts as the empty text in the checksum rule.
Rows that repeat count each. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from navpulse.llm.common import freeze, texts

WIDTH = 64
#: Above every code point.
CODES = np.int64(1 << 21)


def vocabulary(
    docs: DataFrame, min_points: int = 6, min_count: int = 5, typo_every: int | None = None, flush: int = 1 << 18
) -> DataFrame:
    """word and n of the words of letters, A-Z in lower case, that are long and frequent enough.

    With ``typo_every`` a run loses one letter in the documents in which that number divides
    the CRC-32 of ``<doc_id>:<run>``. Shorter runs cannot become words and are not looked at.
    """
    letters = re.compile(rf"[a-zÀ-ÿ]{{{min_points},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})
            seen.clear()
            return made

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                runs = letters.findall(text.as_py().lower().decode())
                if typo_every is None:
                    seen.update(runs)
                else:
                    start = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for run, n in Counter(runs).items():
                        h = zlib.crc32(run.encode(), start)
                        if h % typo_every == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                        seen[run] += n
                if len(seen) >= flush:
                    yield rows()
        if seen:
            yield rows()

    counts = texts(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= min_count) & (F.length("word") >= min_points))


def postings(words: DataFrame) -> DataFrame:
    """A row for each word and part under which it may meet another: as longer word, or as shorter by one."""
    size = F.length("word")

    def under(longer: int):
        m = size + longer
        first = (m / 2).cast("int")
        return [
            F.struct(
                m.alias("m"),
                F.lit(side).alias("side"),
                (F.substring("word", F.lit(1), first) if side == 0 else F.right("word", m - first)).alias("part"),
                F.lit(longer == 0).alias("long"),
            )
            for side in (0, 1)
        ]

    return words.select("word", "n", F.explode(F.array(*under(0), *under(1))).alias("p")).select("word", "n", "p.*")


def cells(words: DataFrame, index_slice: int, query_slice: int) -> DataFrame:
    """Postings of parts in which words can meet, once as index word (role 0) and once as query (role 1)."""
    rows = postings(words)
    sizes = rows.groupBy("m", "side", "part").agg(F.count_if("long").alias("longs"), F.count("*").alias("all"))
    # A plain scan on this side, so that a hot part can be split in the join.
    sizes = freeze(sizes.where("longs > 0 AND all > 1"))
    down = F.ceil(F.col("longs") / index_slice).cast("int")
    across = F.ceil(F.col("all") / query_slice).cast("int")
    at = F.xxhash64("word")
    index = F.transform(
        F.sequence(F.lit(0), across - 1), lambda j: F.struct(F.pmod(at, down).cast("int").alias("i"), j.alias("j"), F.lit(0).alias("role"))
    )
    query = F.transform(
        F.sequence(F.lit(0), down - 1), lambda i: F.struct(i.alias("i"), F.pmod(at, across).cast("int").alias("j"), F.lit(1).alias("role"))
    )
    met = rows.join(sizes, ["m", "side", "part"])
    both = F.when(F.col("long"), F.concat(index, query)).otherwise(query)
    return met.select("m", "side", "part", "word", "n", F.explode(both).alias("c")).select("m", "side", "part", "c.i", "c.j", "c.role", "word", "n")


def code_points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(words), length)


class Index:
    """Position index over words of ``m`` letters, 64 of one group to a block."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.codes, (n, self.m) = codes, codes.shape
        starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        sizes = np.diff(np.append(starts, n))
        self.groups = group[starts]
        self.blocks = -(-sizes // WIDTH)  # of each group
        self.first_block = np.cumsum(self.blocks) - self.blocks
        at = np.arange(n) - np.repeat(starts, sizes)
        block = np.repeat(self.first_block, sizes) + at // WIDTH
        self.first_word = np.flatnonzero(np.diff(block, prepend=-1))
        bit = np.uint64(1) << (at % WIDTH).astype(np.uint64)
        self.full = np.bitwise_or.reduceat(bit, self.first_word)
        self.tables = []
        for p in range(self.m):
            keys = block * CODES + codes[:, p]
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            new = np.flatnonzero(np.diff(keys, prepend=-1))
            self.tables.append((keys[new], np.bitwise_or.reduceat(bit[order], new)))

    def bits(self, position: int, block: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Which words of the blocks have the letters at the position."""
        keys, bits = self.tables[position]
        wanted = block * CODES + code
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, bits[at], np.uint64(0))

    def one_edit(self, codes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, index word) of one group that one replaced letter, or one inserted into the query, tells apart."""
        place = np.searchsorted(self.groups, group)
        known = np.flatnonzero((place < len(self.groups)) & (self.groups[np.minimum(place, len(self.groups) - 1)] == group))
        times = self.blocks[place[known]]
        query = np.repeat(known, times)
        block = np.repeat(self.first_block[place[known]], times) + np.arange(len(query)) - np.repeat(np.cumsum(times) - times, times)
        none, one = self.full[block], np.zeros(len(query), np.uint64)
        inserted = codes.shape[1] < self.m
        for p in range(codes.shape[1]):
            letter = codes[query, p]
            here = self.bits(p, block, letter)
            if inserted:
                one = (one | none) & self.bits(p + 1, block, letter)
            else:
                one = (one & here) | (none & ~here)
            none = none & here
            alive = np.flatnonzero(none | one)
            if len(alive) < len(query):
                query, block, none, one = query[alive], block[alive], none[alive], one[alive]
        if inserted:
            one = one | none  # the last letter is the inserted one
        hit = np.flatnonzero(one)
        row, bit = np.nonzero(np.unpackbits(one[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return query[hit[row]], self.first_word[block[hit[row]]] + bit


def group_pairs(m: int, side: np.ndarray, group: np.ndarray, role: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near words (word, near word) among rows of parts of words of ``m`` letters."""
    size = np.fromiter(map(len, word), np.int64, len(word))
    longs = np.flatnonzero(role == 0)
    if not len(longs):
        return
    index = Index(code_points(word[longs].tolist(), m), group[longs])
    for length in (m, m - 1):
        asked = np.flatnonzero((role == 1) & (size == length))
        if not len(asked):
            continue
        codes = code_points(word[asked].tolist(), length)
        a, b = index.one_edit(codes, group[asked])
        first = m // 2
        new = (side[asked[a]] == 0) | (codes[a, :first] != index.codes[b, :first]).any(axis=1)
        a, b = asked[a[new]], longs[b[new]]
        yield a, b
        if length < m:
            yield b, a


def near_words(words: DataFrame, index_slice: int = 4096, query_slice: int = 16384, flush: int = 1 << 15) -> DataFrame:
    """word, near and the n of near, for all words exactly one edit apart."""
    where = ["m", "side", "part", "i", "j"]
    dealt = cells(words, index_slice, query_slice).repartition(*where).sortWithinPartitions(*where, "role")

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        new = np.zeros(table.num_rows, bool)
        for c in where:
            column = table.column(c)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy()
        group = np.cumsum(new)
        m, side, role, n = (table.column(c).to_numpy() for c in ("m", "side", "role", "n"))
        word = np.array(table.column("word").to_pylist(), object)
        for letters in np.unique(m).tolist():
            rows = np.flatnonzero(m == letters)
            for a, b in group_pairs(letters, side[rows], group[rows], role[rows], word[rows]):
                made = [pa.array(word[rows[a]], pa.string()), pa.array(word[rows[b]], pa.string()), pa.array(n[rows[b]])]
                yield pa.RecordBatch.from_arrays(made, ["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < flush:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = table.slice(table.num_rows - 1)
            same = np.ones(table.num_rows, bool)
            for c in where:
                same &= pc.equal(table.column(c), last.column(c)[0]).to_numpy()
            end = table.num_rows - int(same.sum())  # the last cell may go on
            if end:
                yield from pairs(table.slice(0, end))
            held = table.slice(end).to_batches()
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the last word that the chain of forms leads to. Each round doubles the steps taken."""
    now = freeze(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = freeze(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(words: DataFrame, factor: int = 5, index_slice: int = 4096, query_slice: int = 16384) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of ``words`` (word, n; each word once)."""
    words = freeze(words.select("word", "n"))
    near = near_words(words, index_slice, query_slice).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    best_n = -F.col("best.less")
    takes = best_n >= factor * F.col("n")
    made = freeze(
        words.join(near, "word", "left").select(
            "word",
            F.when(takes, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(takes, best_n).alias("form_n"),
        )
    )
    ends = roots(made.where("form IS NOT NULL"))
    joined = made.join(ends, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
