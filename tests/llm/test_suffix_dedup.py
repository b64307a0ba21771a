from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from navpulse.llm import suffix_dedup as S


def brute(docs: dict[int, bytes], size: int) -> dict[int, tuple]:
    seen: dict[bytes, tuple[int, int]] = {}
    out = {}
    for doc in sorted(docs):
        raw = docs[doc]
        covered = [False] * len(raw)
        for p in range(len(raw) - size + 1):
            w = raw[p : p + size]
            if w in seen:
                covered[p : p + size] = [True] * size
            else:
                seen[w] = (doc, p)
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        spans = sum(c and (i == 0 or not covered[i - 1]) for i, c in enumerate(covered))
        out[doc] = (len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed: int, n: int = 60) -> list[tuple[int, str]]:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéß漢") for _ in range(rnd.randrange(1, 8))) for _ in range(300)]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passages = [text(rnd.randrange(10, 90)) for _ in range(6)]
    common, docs = text(12), []
    for i in range(n):
        parts = [text(rnd.randrange(0, 40)) for _ in range(rnd.randrange(1, 4))]
        for _ in range(rnd.randrange(3)):
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice(passages))
        if i % 3 == 0:
            parts.insert(rnd.randrange(len(parts) + 1), common)
        if i % 10 == 5:
            parts.append("ab" * rnd.randrange(40, 200))
        if i % 7 == 3 and docs:  # a near copy
            old = docs[rnd.randrange(len(docs))][1].split(" ")
            if old:
                old[rnd.randrange(len(old))] = "changed"
            parts = [" ".join(old)]
        docs.append((i * 3 + 1, " ".join(parts)))
    docs += [(1000, ""), (1001, None), (1002, "a" * 700), (1003, "x" * 99), (1004, docs[4][1])]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed, buckets", [(1, 1), (2, 7), (3, 200)])
def test_matches_brute_force(spark, seed, buckets):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {
        r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"])
        for r in S.without_repeats(df, 100, buckets).collect()
    }
    assert got == brute({i: (t or "").encode() for i, t in rows}, 100)


def test_boundaries_cut_through_a_frequent_beginning(spark):
    """Many right sides of one beginning, so that splitters fall inside it and buckets must be compared."""
    rnd = random.Random(9)
    core = "".join(rnd.choice("abcdefgh") for _ in range(60))
    tails = ["".join(rnd.choice("xyz") for _ in range(60)) for _ in range(12)]
    heads = ["".join(rnd.choice("uvw") for _ in range(60)) for _ in range(12)]
    rows = [(i, rnd.choice(heads) + core + rnd.choice(tails)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cuts, frequent = S.splitters(df, 100, 64)
    assert len(frequent) and any(len(c) > S.GRAM for c in cuts)
    got = {
        r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"])
        for r in S.without_repeats(df, 100, 64).collect()
    }
    assert got == brute({i: t.encode() for i, t in rows}, 100)


def test_blocks_of_long_texts_do_not_matter(monkeypatch):
    rnd = np.random.default_rng(4)
    flat = rnd.integers(97, 100, 5000).astype(np.uint8)
    flat[3000:3600] = flat[100:700]
    offsets = np.array([0, 1500, 1500, 1520, 4000, 5000])
    whole = S.anchors(flat, offsets, 100)
    monkeypatch.setattr(S, "BLOCK", 333)
    for a, b in zip(whole, S.anchors(flat, offsets, 100)):
        assert np.array_equal(a, b)


def test_multikey_quicksort():
    rnd = np.random.default_rng(5)
    rows = rnd.integers(0, 2, (500, 24)).astype(np.uint8)
    rows[100:200] = rows[:100]
    order, common = S.multikey_quicksort(rows)
    keys = [rows[i].tobytes() for i in order]
    assert keys == sorted(r.tobytes() for r in rows)
    for a, b, c in zip(keys, keys[1:], common[1:]):
        assert c == next((i for i in range(24) if a[i] != b[i]), 24)


def test_shortened_keeps_columns_and_whole_characters(spark):
    passage = "éàüñ passage that occurs in both of them, " + "".join(f"{i}é" for i in range(40))
    rows = [(1, "one " + passage, "s", 5), (2, passage + "é two", None, 7), (None, passage, "t", 1), (3, None, "u", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r for r in S.shortened(df).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_chars"] == len(rows[0][1])
    assert got[2]["text"].endswith("two") and len(got[2]["text"]) < 10 and got[2]["source"] is None
    assert got[None]["text"] == passage and got[3]["text"] == ""
    assert S.shortened(df).columns == df.columns


def test_repeated_rows_and_empty_table(spark):
    text = "the same document given twice, which is one document and no repeat of itself; " * 2
    df = spark.createDataFrame([(1, text[:110]), (1, text[:110])], "doc_id long, text string")
    assert [r["n_removed"] for r in S.without_repeats(df).collect()] == [0, 0]
    assert S.without_repeats(df.where("doc_id < 0")).collect() == []
