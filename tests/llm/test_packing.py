from __future__ import annotations

import random

from pyspark.sql import functions as F

from navpulse.llm import packing as P


def brute(sizes, sources, clusters, capacity):
    """Best fit by a look at every bin."""
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        pieces, start = [], 0
        while size - start >= capacity:
            bins.append([0, {source}, {cluster}])
            pieces.append((start, capacity, len(bins) - 1, 0))
            start += capacity
        rest = size - start
        if rest:
            fits = [
                (room, nr) for nr, (room, s, c) in enumerate(bins)
                if room >= rest and not (source is not None and source in s) and not (cluster is not None and cluster in c)
            ]
            if fits:
                room, nr = min(fits)
            else:
                bins.append([capacity, set(), set()])
                room, nr = capacity, len(bins) - 1
            bins[nr][0] -= rest
            bins[nr][1].add(source)
            bins[nr][2].add(cluster)
            pieces.append((start, rest, nr, capacity - room))
        out.append(pieces or [(0, 0, None, 0)])
    return out


def random_items(seed, n):
    rnd = random.Random(seed)
    items = [(rnd.choice([0, 1, 5, 30, 99, 100, 101, 260]) if rnd.random() < 0.3 else rnd.randrange(100),
              rnd.choice(["hot", "hot", "a", "b", "c", None]), rnd.choice([None, *range(40)])) for _ in range(n)]
    return sorted(items, key=lambda x: -x[0])


def test_matches_a_search_of_all_bins():
    for seed in range(8):
        sizes, sources, clusters = zip(*random_items(seed, 150))
        assert P.pack_shard(list(sizes), list(sources), list(clusters), 100) == brute(sizes, sources, clusters, 100)


def test_packing_of_a_table(spark):
    items = [(i, *x) for i, x in enumerate(random_items(20, 400))] + [(3, 10, "a", 1), (None, 10, "a", 1)]
    df = spark.createDataFrame(items, "doc_id long, size long, source string, cluster long")
    rows = P.packed(df, 100, 2000).collect()
    total, used = {}, {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["size"]
        if r["bin_id"] is None:
            assert r["size"] == 0
            continue
        used.setdefault(r["bin_id"], []).append((r["bin_offset"], r["size"], r["doc_id"]))
    wanted = {}
    for i, size, *_ in items:
        wanted[i] = wanted.get(i, 0) + size
    assert total == wanted and len({b >> 32 for b in used}) > 1
    of = {i: (s, c) for i, _, s, c in items}
    for places in used.values():
        places.sort()
        at = 0
        for offset, size, _ in places:
            assert offset == at
            at += size
        assert at <= 100
        for k in (0, 1):
            marks = [of[d][k] for _, _, d in places if of[d][k] is not None]
            assert len(marks) == len(set(marks))
    assert P.packed(df.where("false")).collect() == []


def test_lengths_and_clusters_of_texts(spark):
    rows = [(1, " a bb\tc ", "s"), (2, "abbc", "s"), (3, None, None), (4, "", "s"), (5, "é\x0bü x", "s"), (6, "w " * 9000, "t")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")
    got = {r["doc_id"]: r for r in P.measured(df).collect()}
    assert [got[i]["size"] for i in range(1, 7)] == [3, 1, 0, 0, 3, 9000]
    assert got[1]["cluster"] == got[2]["cluster"] and got[3]["cluster"] == got[4]["cluster"]
    made = P.pack_documents(df, 2048).collect()
    assert sum(r["size"] for r in made if r["doc_id"] == 6) == 9000 and len([r for r in made if r["doc_id"] == 6]) == 5


def test_rows_without_an_id_are_spread_over_shards(spark):
    rows = [(None, 40, None, 7)] * 2000
    df = spark.createDataFrame(rows, "doc_id long, size long, source string, cluster long")
    made = P.packed(df, capacity=100, shard_size=8000)
    shards = {r["shard"]: r["count"] for r in made.groupBy((F.col("bin_id") / (1 << 32)).cast("int").alias("shard")).count().collect()}
    assert len(shards) == 10 and sum(shards.values()) == 2000 and max(shards.values()) < 400
