"""Connected components of an edge list by alternating star contractions, all in joins and minima.

Each round hangs every larger neighbour of a node onto the node's smallest neighbour, then
every smaller one likewise; the edge list never grows beyond its length, and a logarithmic
number of rounds leaves a star around the smallest node of each component. Minima are taken
per task first, but in the join with its minimum the edges of one node, two longs each,
come to one task. The edge list of a round is written to the shared folder, which cuts the
lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from navpulse.llm.common import freeze


def hang(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over (u, v) with u > v."""
    if larger:  # all neighbours of u; those above u are hung onto the smallest
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low"))
        least = least.select(F.col("u").alias("w"), F.least("u", "low").alias("low"))
        out = both.join(least, both["u"] == least["w"]).where("v > u")
        out = out.select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:  # neighbours of u below it, and u itself
        least = edges.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("w"), "low")
        out = edges.join(least, edges["u"] == least["w"])
        out = out.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").unionByName(
            least.select(F.col("w").alias("u"), F.col("low").alias("v"))
        )
    return out.where("u > v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node on an edge between different nodes; component is the smallest node."""
    larger, smaller = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = freeze(edges.where(F.col(a) != F.col(b)).select(larger, smaller).distinct())
    before = None
    while True:
        now = freeze(hang(hang(now, True), False))
        # In a star forest both steps change nothing; the sums tell a change apart.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
        before = state
