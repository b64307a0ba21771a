from __future__ import annotations

import bisect
import random

import pytest
from pyspark.sql import functions as F

from navpulse.operators.asof import asof_lookup, number_block
from navpulse.operators.latest import latest_version
from navpulse.operators.ranking import exact_median, global_rank, values_at_ranks
from navpulse.operators.runs import streaks
from navpulse.plans.sampling import interpolate, stratified_sample


def test_latest_version_keeps_columns_and_newest(spark):
    rows = spark.createDataFrame(
        [("a", 1, None), ("a", 2, "x"), ("b", 5, "y"), ("a", 3, None)], "k string, v int, p string"
    )
    got = sorted(latest_version(rows, ["k"], ["v"]).collect())
    assert [tuple(r) for r in got] == [("a", 3, None), ("b", 5, "y")]


@pytest.mark.parametrize("distinct", [True, False])
@pytest.mark.parametrize("fallback", [True, False])
def test_asof_equals_bisect(spark, distinct, fallback):
    rng = random.Random(7)
    facts = {(k, t): (k, t, rng.randrange(99), v) for k in "abc" for t in rng.sample(range(500), 40)
             for v in (0, 1)}
    fact_rows = list(facts.values())
    times = [(k, t) for k in "abcd" for t in rng.sample(range(-50, 600), 120)]
    probes = times if distinct else times + times[:50]
    f = spark.createDataFrame(fact_rows, "k string, ft long, x long, ver long")
    p = spark.createDataFrame(probes, "k string, t long")
    got = asof_lookup(p, f, ["k"], "t", "ft", ["x"], number_block(37), version=["ver"],
                      distinct_probes=distinct, forward_fallback=fallback)
    want = []
    for k, t in probes:
        series = sorted((ft, x) for kk, ft, x, _ in fact_rows if kk == k)
        i = bisect.bisect_right([s[0] for s in series], t)
        hit = series[i - 1][1] if i else (series[0][1] if fallback and series else None)
        want.append((k, t, hit))
    key = lambda r: (r[0], r[1], str(r[2]))
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted(want, key=key)


def test_streaks_cross_blocks(spark):
    rng = random.Random(3)
    rows = [(k, i // 10, i, rng.random() < 0.8) for k in "ab" for i in range(100)]
    # whole blocks of one kind as well
    rows += [("c", i // 10, i, True) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, b int, i int, hit boolean")
    got = {
        (r.k, r.i): (r.streak, r.run_start)
        for r in streaks(df, ["k"], "b", ["i"], F.col("hit"), since="i").collect()
    }
    run, start, last = 0, None, None
    for k, _, i, hit in sorted(rows):
        if k != last:
            run, last = 0, k
        if hit:
            start = i if run == 0 else start
            run += 1
        else:
            run, start = 0, None
        assert got[(k, i)] == (run, start)


def test_exact_median_of_hot_and_tied_groups(spark):
    rng = random.Random(11)
    rows = [("hot", float(rng.randrange(50))) for _ in range(5000)]
    rows += [("odd", 1.0), ("odd", 9.0), ("odd", 4.0), ("one", 2.0), ("null", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.n, r["median"]) for r in exact_median(df, ["k"], "v").collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    assert got == {
        "hot": (5000, (hot[2499] + hot[2500]) / 2), "odd": (3, 4.0), "one": (1, 2.0)
    }


def test_rank_outside_its_bracket_raises(spark):
    df = spark.range(50_000).select(F.col("id").cast("double").alias("v"))
    bad = values_at_ranks(df, [], "v", 0.5, {"x": F.lit(1)})
    with pytest.raises(Exception, match="bracket"):
        bad.collect()


def test_global_rank_is_total(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    rows = global_rank(df, [F.col("a").desc(), F.col("b")]).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 1001))
    assert [(r.a, r.b) for r in rows] == sorted(((r.a, r.b) for r in rows), key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("n,size,busiest", [(40, 15, 5), (12, 20, 4), (30, 6, 10), (50, 11, 10), (21, 20, 3)])
def test_stratified_sample(spark, n, size, busiest):
    df = spark.range(n).select(
        F.format_string("f%03d", "id").alias("ins_code"), (F.col("id") * 7 % 13).alias("trade_count")
    )
    ranked = sorted(((r.ins_code, r.trade_count) for r in df.collect()), key=lambda x: (-x[1], x[0]))
    if size >= n:
        want = ranked
    else:
        head = ranked[: min(busiest, size)]
        rest, k = ranked[len(head):], size - len(head)
        want = head
        if k > 0:
            step = (len(rest) - 1) / max(k - 1, 1)
            want = head + [rest[i] for i in sorted({round(i * step) for i in range(k)})]
    got = stratified_sample(df, size, busiest).orderBy("rank").collect()
    assert [(r.ins_code, r.trade_count) for r in got] == want


def test_interpolation_is_clamped(spark):
    points = spark.createDataFrame([(0.0, 1.0), (10.0, 2.0), (20.0, 6.0)], "x double, y double")
    asked = spark.createDataFrame([(-5.0,), (0.0,), (5.0,), (10.0,), (15.0,), (99.0,)], "q double")
    got = {r.q: r.y for r in interpolate(asked, "q", points).collect()}
    assert got == {-5.0: 1.0, 0.0: 1.0, 5.0: 1.5, 10.0: 2.0, 15.0: 4.0, 99.0: 6.0}


def test_ranks_of_a_group_too_large_to_order(spark):
    """Most values lie inside the bracket; they are narrowed by slices until few are left."""
    rows = spark.range(60_000).selectExpr(
        "IF(id % 3 = 0, 'a', 'b') AS k", "IF(id < 50, id, 1000 + (id * 7919) % 60000 / 600000.0D) AS v"
    )
    n = F.col("n")
    got = values_at_ranks(rows, ["k"], "v", 0.5, {"lo": F.floor((n + 1) / 2), "hi": F.floor(n / 2) + 1}, ordered=20)
    by_key = {}
    for r in rows.collect():
        by_key.setdefault(r.k, []).append(r.v)
    for r in got.collect():
        values = sorted(by_key[r.k])
        assert (r.n, r.lo, r.hi) == (len(values), values[(len(values) + 1) // 2 - 1], values[len(values) // 2])
