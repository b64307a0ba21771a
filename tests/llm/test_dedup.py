from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from navpulse.llm import exact_dedup as E, simhash as H
from navpulse.llm.components import components


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), min(g)[1] == i) for g in groups.values() for _, i in g}


def test_exact_groups(spark):
    rnd = random.Random(1)
    base = ["".join(rnd.choice("ab \n\té ") for _ in range(rnd.randrange(9000))) for _ in range(25)]
    rows = [(i, rnd.choice(base).replace("b", rnd.choice(["b", "b ", " b"]))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \x0b\x0c\r"), (503, " "), (504, "x\x1cy"), (505, "xy")]
    df = spark.createDataFrame([(i, t, 1, True) for i, t in rows], "doc_id long, text string, row long, kept boolean")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in E.exact_groups(df, mask_bits=6).collect()}
    assert got == exact_brute(rows)
    assert E.exact_groups(df.where("false")).collect() == []


def test_repeated_rows_and_null_ids_keep_one(spark):
    df = spark.createDataFrame([(7, "a b"), (7, "a b"), (None, "ab"), (None, "z")], "doc_id long, text string")
    got = E.exact_groups(df).collect()
    assert sorted((r["group_size"], r["kept"]) for r in got) == [(1, True), (3, False), (3, False), (3, True)]
    assert {r["keep_id"] for r in got} == {7, None}


def test_chunks_that_share_a_hash_are_told_apart(spark):
    rows = [(1, [5, 6], [1, 1], [1, 1]), (2, [5, 6], [1, 1], [2, 1]), (3, [5, 6], [1, 1], [1, 1]), (4, [], [], [])]
    schema = "doc_id long, hashes array<long>, first array<long>, second array<long>"
    made = spark.createDataFrame(rows, schema).select(
        "*", F.lit(1).cast("long").alias("points"), F.lit("s").alias("text_sha256"), F.col("doc_id").alias("row")
    )
    numbers = E.clashes(made)
    assert {(r["hash"], r["number"], r["second"]) for r in numbers.collect()} == {(5, 0, 1), (5, 1, 2)}
    got = {r["doc_id"]: r["keep_id"] for r in E.grouped(E.numbered(made, numbers)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def test_cuts_follow_content():
    rnd = np.random.default_rng(1)
    raw = rnd.integers(0, 256, 50_000).astype(np.uint8)
    ends = E.cuts(raw, 8, 1 << 16)
    moved = E.cuts(np.concatenate([raw[:7], raw]), 8, 1 << 16) - 7
    assert len(set(ends.tolist()) & set(moved.tolist())) > 0.95 * len(ends)
    assert np.diff(E.cuts(np.zeros(1000, np.uint8), 30, 100), prepend=0).max() == 100


def print_of(text: str) -> int:
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints: dict[int, int], bits: int = 4) -> dict[int, int]:
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_near_duplicates(spark):
    rnd = random.Random(4)
    words = ["Word%d" % i for i in range(400)] + ["É", "ß", "\x1c"]
    rows = []
    for i in range(150):
        text = [rnd.choice(words) for _ in range(rnd.randrange(0, 300))]
        if i % 2 and rows:
            text = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.randrange(3)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(900, None), (901, " \n"), (902, "ONE two"), (903, "one\tTWO")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in H.near_duplicates(df).collect()}
    prints = {i: print_of(t or "") for i, t in rows}
    reached = classes(prints)
    assert got == {i: (f"{prints[i]:016x}", reached[i]) for i in prints}
    assert H.near_duplicates(df.where("false")).collect() == []


@pytest.mark.parametrize("positions", [2, 3, 4])
def test_links_join_what_all_pairs_would(spark, positions):
    rnd = random.Random(positions)
    prints = []
    for _ in range(12):  # clouds of near fingerprints, and some that touch others
        centre = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 60)):
            x = centre
            for _ in range(rnd.randrange(6)):
                x ^= 1 << rnd.randrange(64)
            prints.append(x)
    prints = {i: x for i, x in enumerate(dict.fromkeys(prints))}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in prints.values()], "fp long")
    of = {signed(x): i for i, x in prints.items()}
    pairs = [(of[r["a"]], of[r["b"]]) for r in H.links(nodes, 4, positions).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 4 for a, b in pairs)
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {i: root(i) for i in prints} == classes(prints)


def test_every_set_of_shared_positions_is_covered():
    from itertools import combinations

    for size in (2, 3, 4):
        family = [set(c) for c in H.covering(size, 4)]
        assert all(any(c <= set(s) for c in family) for s in combinations(range(8), 4))


def test_components(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(40)]
    edges += [(200, x) for x in range(201, 260)] + [(3, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    parent = {x: x for e in edges for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in touched}


def test_links_through_rows_without_an_id(spark):
    """A chain of texts, each near the next; those in the middle have no id."""
    rnd = random.Random(12)
    words = [f"word{i}" for i in range(400)]
    chain, prints = [], []
    while len(chain) < 40:
        chain.append(" ".join(words))
        prints.append(H.fingerprint(chain[-1].encode(), 4, 42))
        words[rnd.randrange(len(words))] = f"new{len(chain)}"
    rows = [(i if i % 7 == 3 else None, t) for i, t in enumerate(chain)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4
    group = list(range(len(chain)))
    for _ in chain:
        group = [min(group[b] for b in range(len(chain)) if near(a, b)) for a in range(len(chain))]
    ids = {g: min((i for j, i in enumerate(x for x, _ in rows) if group[j] == g and i is not None), default=None) for g in set(group)}
    want = sorted(((i, ids[group[j]]) for j, (i, _) in enumerate(rows)), key=repr)
    got = sorted(((r["doc_id"], r["component_id"]) for r in H.near_duplicates(df).collect()), key=repr)
    assert got == want and len(set(group)) < len(chain)
