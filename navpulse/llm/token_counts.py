"""Token counts of whole texts under a subword tokenizer, without keeping the tokens.

Each Arrow batch is cut into slices of about ``slice_bytes`` of text. Texts are split at
ASCII white space: the tokenizer's own normaliser and pattern never let a token or a
special string reach across it, so counts of the parts add up to that of the text, and a
very long text costs no more memory than its slice. The parts a slice has not met before
go to the library in one batch of bounded bytes; only lengths come back. Lengths of short
parts are remembered (at most ``memory`` of them, then the memory starts anew), because
words repeat: it changes the cost and never the result.

Null and empty texts have 0 tokens; repeated rows are counted each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from navpulse.llm.common import byte_slices, map_batches, texts, tokenizer_path

#: str.split() also cuts at these, which the tokenizers take as symbols.
SEPARATORS = re.compile("[\x1c-\x1f\x85]")
PARTS = re.compile(r"[^\x20\x09-\x0D]+")


class Lengths:
    """Token counts of texts for one tokenizer file."""

    def __init__(self, path: str, memory: int = 1_500_000, batch_bytes: int = 1 << 20):
        self.path, self.memory, self.batch_bytes = path, memory, batch_bytes
        self.known: dict[str, int] = {}
        if path.endswith(".json"):
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encode = lambda parts: [
                len(e) for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)
            ]
            self.whole = False
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.encode = lambda parts: [len(x) for x in model.encode(parts, num_threads=1)]
            self.whole = True  # its pieces hold the space before a word, so texts stay whole

    def fresh(self, parts: list[str]) -> list[int]:
        """Lengths from the library, in batches of about equal bytes."""
        out, batch, size = [], [], 0
        for p in parts:
            batch.append(p)
            size += len(p)
            if size >= self.batch_bytes:
                out += self.encode(batch)
                batch, size = [], 0
        return out + (self.encode(batch) if batch else [])

    def of(self, rows: list[str]) -> list[int]:
        if self.whole:
            return self.fresh(rows)
        split = [PARTS.findall(t) if SEPARATORS.search(t) else t.split() for t in rows]
        if len(self.known) > self.memory:
            self.known.clear()
        known = self.known
        new = set(chain.from_iterable(split)).difference(known)
        # A full stop or comma after a letter is a token of its own; the word before it is likely known.
        tailed = [p for p in new if p[-1] in ".," and p[-2:-1].lower().isalpha()]
        if tailed:
            new.difference_update(tailed)
            new.update(x for p in tailed for x in (p[:-1], p[-1]) if x not in known)
        new = list(new)
        lengths = dict(zip(new, self.fresh(new)))
        for p in tailed:
            lengths[p] = sum(lengths[x] if x in lengths else known[x] for x in (p[:-1], p[-1]))
        known.update((p, n) for p, n in lengths.items() if len(p) <= 64)
        count = lengths.get
        get = known.get
        out = []
        for parts in split:
            n = 0
            for p in parts:
                k = get(p)
                n += count(p) if k is None else k
            out.append(n)
        return out


_lengths: dict[str, Lengths] = {}


def lengths_of(path: str) -> Lengths:
    """One tokenizer for all tasks of a worker."""
    if path not in _lengths:
        _lengths[path] = Lengths(path)
    return _lengths[path]


def token_counts(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    folder: str | None = None,
    limit: int = 2048,
    slice_bytes: int = 4 << 20,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row."""
    path = tokenizer_path(tokenizer, folder)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths = lengths_of(path)
        column = batch.column("text")
        n: list[int] = []
        for a, b in byte_slices(column, slice_bytes):
            n += lengths.of(column.slice(a, b - a).to_pylist())
        tokens = pa.array(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pc.cast(pc.binary_length(column), pa.int64()),
                tokens,
                pc.greater(tokens, limit),
            ],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return map_batches(texts(docs), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
