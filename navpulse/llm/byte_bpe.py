"""Byte-level BPE over whole texts: encode to ids, decode ids to bytes.

A piece that the vocabulary does not hold as a whole is merged over a segment tree. Its
leaves are byte positions; a leaf that starts a live symbol holds the rank of the pair it
makes with the next symbol, and every inner node holds the smallest rank below it, the
left child winning ties. The root therefore names the leftmost of the lowest pairs; a
merge retires one leaf and recomputes two others, so it costs a logarithm of the length.

Null texts are empty and have no ids; repeated rows are encoded each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from navpulse.llm.common import byte_slices, map_batches, texts, tokenizer_path

NONE = 1 << 40
#: A space before white space or at the end, or characters that are white space to some engines only.
UNSAFE = re.compile(r" \s| $|[\x1c-\x1f\x85]").search
#: Pieces of up to so many bytes are merged many at a time.
SHORT = 64


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``piece`` after all merges, lowest rank first and leftmost among equals."""
    n = len(piece)
    width = 1
    while width < n:
        width *= 2
    # A key is rank * width + position: the smallest one is the leftmost of the lowest rank.
    none = NONE * width
    tree = [none] * (2 * width)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    rank = ranks.get
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r * width + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, key: int) -> None:
        i += width
        tree[i] = key
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                break
            tree[i] = low

    while (best := tree[1]) < none:
        i = best % width
        j = after[i]
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        put(j, none)
        r = rank(piece[i : after[k]]) if k < n else None
        put(i, none if r is None else r * width + i)
        if (p := before[i]) >= 0:
            r = rank(piece[p:k])
            put(p, none if r is None else r * width + p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class PairTable:
    """Id of the token that two neighbouring tokens make, for whole arrays of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = sorted(
            (ranks[t[:c]] << 32 | ranks[t[c:]], r)
            for t, r in ranks.items()
            for c in range(1, len(t))
            if t[:c] in ranks and t[c:] in ranks
        )
        self.keys = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.ids = np.array([r for _, r in pairs] + [NONE], np.int64)
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ids[at], NONE)


def merge_many(pieces: tuple[bytes, ...], pairs: PairTable) -> list[tuple[int, ...]]:
    """:func:`merge` for pieces of similar length: a row of trees, one merge in each at a time."""
    m, n = len(pieces), max(map(len, pieces))
    width = 1
    while width < n:
        width *= 2
    none = NONE * width
    size = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(n, b"\0") for p in pieces), np.uint8).reshape(m, n)
    ids = pairs.of_byte[raw]
    place = np.arange(n)
    after = np.tile(place + 1, (m, 1))
    before = np.tile(place - 1, (m, 1))
    tree = np.full((m, 2 * width), none)
    if n > 1:
        r = pairs.rank(ids[:, :-1], ids[:, 1:])
        r[place[None, 1:] >= size[:, None]] = NONE
        tree[:, width : width + n - 1] = np.where(r < NONE, r * width + place[:-1], none)
    level = width // 2
    while level:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        level //= 2

    def put(rows: np.ndarray, at: np.ndarray, keys: np.ndarray) -> None:
        at = at + width
        tree[rows, at] = keys
        for _ in range(width.bit_length() - 1):
            at = at >> 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

    def key(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        r = pairs.rank(ids[rows, left], ids[rows, right])
        return np.where(r < NONE, r * width + left, none)

    while (rows := np.flatnonzero(tree[:, 1] < none)).size:
        i = tree[rows, 1] % width
        j = after[rows, i]
        k = after[rows, j]
        ids[rows, i] = tree[rows, 1] // width
        after[rows, i] = k
        put(rows, j, np.full(rows.size, none))
        more = k < size[rows]
        before[rows[more], k[more]] = i[more]
        put(rows[~more], i[~more], np.full((~more).sum(), none))
        put(rows[more], i[more], key(rows[more], i[more], k[more]))
        p = before[rows, i]
        ok = p >= 0
        put(rows[ok], p[ok], key(rows[ok], p[ok], i[ok]))
    live = np.zeros((m, n + 1), bool)
    at, rows = np.zeros(m, int), np.flatnonzero(size)
    while rows.size:
        live[rows, at[rows]] = True
        at[rows] = after[rows, at[rows]]
        rows = rows[at[rows] < size[rows]]
    live = live[:, :n]
    flat, ends = ids[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
    return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]


class Codec:
    """Ranks of a vocabulary file, its pattern, and the ids of what it has met so far.

    With the pattern of the public byte-level vocabularies, a piece never reaches across a
    space that is followed by a visible character, so texts are cut there and the ids of a
    word with its leading space are looked up or made once. Any other pattern
    (``words=False``) is matched on the whole text.
    """

    def __init__(self, path: str, pattern: str, memory: int = 1_500_000, words: bool = True):
        import regex

        with open(path, "rb") as lines:
            split = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in split}
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.pairs = PairTable(self.ranks)
        self.pieces = regex.compile(pattern).findall
        self.memory, self.words = memory, words
        self.known: dict[str, tuple[int, ...]] = {}

    def segments(self, text: str) -> list[str]:
        """Parts of the text that hold whole pieces; all but the first start with a space."""
        if not self.words or UNSAFE(text):
            return self.pieces(text)
        return text.replace(" ", "\0 ").split("\0") if "\0" not in text else self.pieces(text)

    def learn(self, segments: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of segments; short pieces go through the trees together, by length."""
        known = self.known
        cut = {s: self.pieces(s) for s in segments}
        pieces = set(chain.from_iterable(cut.values()))
        ids = {p: known[p] for p in pieces if p in known}  # a word met before without what follows it here
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces.difference(ids):
            raw = p.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                ids[p] = (whole,)
            elif len(raw) > SHORT:
                ids[p] = tuple(merge(raw, self.ranks))
            else:
                classes.setdefault((len(raw) - 1).bit_length(), []).append((p, raw))
        for some in classes.values():
            for a in range(0, len(some), 20_000):
                names, raws = zip(*some[a : a + 20_000])
                ids.update(zip(names, merge_many(raws, self.pairs)))
        return {s: tuple(chain.from_iterable([ids[p] for p in ps])) for s, ps in cut.items()}

    def encode_all(self, rows: list[str]) -> list[list[int]]:
        """Ids of each text. No cycles arise here, so the collector needn't walk the many small tuples."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode_all(rows)
        finally:
            if collecting:
                gc.enable()

    def _encode_all(self, rows: list[str]) -> list[list[int]]:
        if len(self.known) > self.memory:
            self.known.clear()
        get, flat = self.known.get, chain.from_iterable
        out, open_rows, missing = [], [], set()
        for n, text in enumerate(rows):
            cut = self.segments(text)
            ids = list(map(get, cut))
            if None in ids:
                open_rows.append((n, cut, ids))
                missing.update(s for s, x in zip(cut, ids) if x is None)
                out.append(None)
            else:
                out.append(list(flat(ids)))
        fresh = self.learn(missing)
        for n, cut, ids in open_rows:
            out[n] = list(flat([fresh[s] if x is None else x for s, x in zip(cut, ids)]))
        self.known.update((s, x) for s, x in fresh.items() if len(s) <= 64)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        table = self.bytes_of
        return b"".join(map(table.__getitem__, ids))


_codecs: dict[tuple, Codec] = {}


def codec_of(path: str, pattern: str, words: bool) -> Codec:
    """One codec for all tasks of a worker."""
    key = (path, pattern, words)
    if key not in _codecs:
        _codecs[key] = Codec(path, pattern, words=words)
    return _codecs[key]


def coded(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.tiktoken",
    folder: str | None = None,
    pattern: str | None = None,
    with_ids: bool = True,
    slice_bytes: int = 4 << 20,
) -> DataFrame:
    """doc_id, n_tokens, ids (if ``with_ids``), the digest of the ids and that of the bytes they decode to."""
    path = tokenizer_path(tokenizer, folder)
    words = pattern is None
    if words:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = codec_of(path, pattern, words)
        column, decimal, sha = batch.column("text"), codec.decimal.__getitem__, hashlib.sha256
        counts, ids_sha, back_sha, lists = [], [], [], []
        for a, b in byte_slices(column, slice_bytes):
            for ids in codec.encode_all(column.slice(a, b - a).to_pylist()):
                counts.append(len(ids))
                ids_sha.append(sha(" ".join(map(decimal, ids)).encode()).hexdigest())
                back_sha.append(sha(codec.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(ids)
        arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(back_sha)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            arrays.append(pa.array(lists, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(texts(docs), run, schema + (", ids array<int>" if with_ids else ""))


def decoded(tokens: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """doc_id and the bytes that the column ids stands for; null ids are an empty list."""
    path = tokenizer_path(tokenizer, folder)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = codec_of(path, ".", False)
        raw = [codec.decode(ids or []) for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return map_batches(tokens.select("doc_id", "ids"), run, "doc_id long, bytes binary")
