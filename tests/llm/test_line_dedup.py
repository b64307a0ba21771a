from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from navpulse.llm import line_dedup as L

SCHEMA = "doc_id long, text string, key string, n int, digest string, found string"


def brute(rows, least, points, keep_first):
    def key(line):
        line = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line)
        return re.sub("[A-Z]", lambda m: m[0].lower(), line)

    where = defaultdict(set)
    for r, (i, t) in enumerate(rows):
        for n, line in enumerate((t or "").split("\n")):
            where[key(line)].add((i is None, i or 0, n, r))
    gone = {k for k, v in where.items() if len(k) >= points and len({r for *_, r in v}) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [
            line for n, line in enumerate(lines)
            if key(line) not in gone or keep_first and min(where[key(line)])[:3] == (i is None, i or 0, n)
        ]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def made_rows(seed):
    rnd = random.Random(seed)
    words = ["Read more", " read MORE\t", "É", "é", "", " ", "\x0b", "x", "Über uns", "a\r", "A", "one\x00two"]
    rows = [(i, "\n".join(rnd.choice(words) + rnd.choice(["", "", str(rnd.randrange(30))]) for _ in range(rnd.randrange(1, 9)))) for i in range(150)]
    rows += [(i, "hot\nline") for i in range(1000, 1100)]  # a third of all rows
    rows += [(7, rows[7][1])] * 3 + [(None, "hot\nx1"), (None, None), (2000, ""), (2001, "y\n" * 50_000)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("most_bits, most_held", [(30, 1 << 18), (10, 1 << 18), (30, 0), (10, 0), (22, 1 << 18)])
@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_as_brute_force(spark, most_bits, most_held, keep_first):
    rows = made_rows(most_bits)
    df = spark.createDataFrame([(i, t, "k", 1, "d", "f") for i, t in rows], SCHEMA).repartition(5)
    bits = 3000 if most_bits == 22 else 16  # several segments
    made = L.line_dedup(df, 10, 1, keep_first, bits_per_line=bits, most_bits=most_bits, most_held=most_held).collect()
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in made), key=repr) == brute(rows, 10, 1, keep_first)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in made)


def test_short_keys_stay_and_empty_table(spark):
    rows = [(i, "é\nab\n" + "x" * i) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in L.line_dedup(df, 10, 2).collect()]
    assert sorted(got, key=repr) == brute(rows, 10, 2, False)
    assert L.line_dedup(df.where("false")).collect() == []


def test_filter_has_no_false_negatives():
    words = np.random.default_rng(1).integers(0, 1 << 63, (500, 2)).astype(np.uint64)
    for bits in (10, 20, 23):
        shape = L.Filter(bits)
        assert shape.segments(words).max() < 1 << (bits - shape.inner)
        assert shape.places(words).max() < 1 << shape.inner
