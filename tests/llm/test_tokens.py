from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from navpulse.llm import byte_bpe, token_counts

POOL = [
    *"abcdefghij  \n\t'sABÉéßñ漢字カ🙂́  \x1c\x1d\x85\x0b1234567890.,!?-_",
    "<|endoftext|>", "<|startoftext|>", "'ll", "İ", "ſ", "Å", "‍", "﻿", "²", "٣", "‿",
]


def random_texts(seed: int, n: int = 400) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(POOL) for _ in range(rnd.randrange(300))) for _ in range(n)]


def reference():
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bytes_encode_as_the_library_and_back(spark):
    texts = random_texts(1) + ["", "x" * 5000, "ab" * 3000, "é" * 500, "  a  b ", " \n x"]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(-1, None, "n"), (0, texts[0], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    lib = reference()
    made = byte_bpe.coded(df)
    got = made.collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r["doc_id"]] if r["doc_id"] >= 0 else ""
        ids = lib.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = {r["doc_id"]: bytes(r["bytes"]) for r in byte_bpe.decoded(made).collect()}
    assert back[5] == texts[5].encode() and back[-1] == b""
    assert byte_bpe.coded(df.where("false")).collect() == []


def test_tree_merges_one_piece_as_many():
    codec = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    lib = reference()
    rnd = random.Random(3)
    pieces = ["".join(rnd.choice("abcdefgé漢") for _ in range(rnd.randrange(1, 33))) for _ in range(500)]
    raws = tuple(p.encode() for p in pieces)
    many = byte_bpe.merge_many(raws, codec.pairs)
    for p, raw, ids in zip(pieces, raws, many):
        assert list(ids) == byte_bpe.merge(raw, codec.ranks)
        assert codec.encode(p) == lib.encode_ordinary(p)


def test_counts_are_those_of_the_library(spark):
    texts = random_texts(2) + ["", "x" * 9000, "word " * 3000, "a.\tb,  c."]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(-1, None, 1), (0, texts[0], 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = token_counts.token_counts(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r["doc_id"]] if r["doc_id"] >= 0 else ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)
    assert token_counts.token_counts(df.where("false")).collect() == []


def test_counts_of_a_sentencepiece_model(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = ["", "Hello world", " two  spaces ", "é漢"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, "piece_bpe_32k.model").collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate(texts)}
