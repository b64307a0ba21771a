from __future__ import annotations

import math
import random

import numpy as np
import pytest

from navpulse.llm import vafile as V


def brute(rows, k):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * x) for x in v]))
    out = {}
    for q, a in {i: v for i, v in good if i % 5 == 0}.items():
        scores = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b)]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return {q: x for q, x in out.items() if x}


@pytest.mark.parametrize("block, cells", [(7, 4), (4096, 16), (64, 2)])
def test_top_k(spark, block, cells):
    rnd = random.Random(block)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(90)]
    rows += [(i, rows[3][1]) for i in range(200, 230)]  # ties
    rows += [(300, None), (305, [1.0, None]), (310, [math.nan] * 6), (315, [math.inf] * 6), (None, [1.0] * 6)]
    rows += [(320, [1.0, 2.0]), (325, []), (330, [1e7, -1e7] * 3), (331, [1e6, 1.0, -1e6, 0.0, 5e5, 7.0]), (335, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, a int")
    import struct

    exact = [(i, None if v is None else [None if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v]) for i, v in rows]
    got = {}
    for r in V.top_k(df, df.where("vec_id % 5 = 0"), k=4, block=block, cells=cells).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got == brute(exact, 4)


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in V.top_k(df, df.where("vec_id = 0")).collect()]
    assert got == [(0, 50, 256 * 512)]
    assert V.top_k(df.where("false"), df).collect() == []
    assert V.top_k(df, df.where("false")).collect() == []


def test_scores_beyond_64_bits_raise(spark):
    for big in (1e30, 1e9):
        df = spark.createDataFrame([(0, [big] * 9), (1, [big] * 9)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64 bits"):
            V.top_k(df, df.where("vec_id = 0")).collect()


def test_bounds_hold():
    rnd = np.random.default_rng(1)
    v = rnd.integers(-300, 300, (200, 5)).astype(float)
    cell, low, high = V.approximation(v, 8)
    dims = np.arange(5)
    assert (low[cell, dims] <= v).all() and (v <= high[cell, dims]).all()
