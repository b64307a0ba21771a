from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from navpulse.llm import ranked_search as R

TERM = "[0-9A-Za-z\x80-\U0010ffff]+"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(TERM, text or "")]


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    total, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * total // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) if c[t]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("width, batch, most", [(1024, 2048, 1024), (2, 7, 3), (16, 50, 1)])
def test_ranks_as_brute_force(spark, width, batch, most):
    rnd = random.Random(width)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "Straße", "A", "a", "中文", "x\x00y", "\x80"]
    pick = lambda n: " ".join(rnd.choice(words[: rnd.choice([5, 68])]) for _ in range(n))
    docs = [(i, pick(rnd.randrange(1, 40))) for i in range(200)]
    docs += [(i, docs[3][1]) for i in range(500, 620)]  # ties: a third of all rows
    docs += [(3, docs[3][1]), (3, "w1"), (None, docs[3][1]), (900, None), (901, ""), (902, " .-\x7f"), (903, "w1 w2 " * 30_000)]
    items = [(i, pick(8) + " unseen") for i in range(12)] + [(1, pick(5)), (None, "w3"), (50, None), (51, "?"), (52, "unseen"), (53, docs[3][1])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, n int").repartition(3)
    qs = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, query string, doc_id int")
    made = R.ranked_search(df, qs, k=9, width=width, batch_docs=batch, most_queries=most)
    assert made.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in made.collect()), key=repr) == brute(docs, items, 9)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    qs = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert R.ranked_search(df.where("false"), qs).collect() == []
    assert R.ranked_search(df, qs.where("false")).collect() == []
    assert [tuple(r) for r in R.ranked_search(df, qs).collect()] == brute([(1, "a b")], [(1, "a")], 50)
