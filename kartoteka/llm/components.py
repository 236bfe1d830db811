"""Connected components of a graph that is a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.operators.tables import staged_table

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the smallest of the vertex and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("v"), F.least("a", "low").alias("low"))
    return (both.where("b > a").join(least, both["a"] == least["v"]).select(F.col("low").alias("a"), "b")
            .where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex and its smaller neighbours are tied to the smallest of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("low")).select(F.col("b").alias("v"), "low")
    moved = edges.join(least, edges["b"] == least["v"]).select(F.col("low").alias("a"), F.col("a").alias("b")).where("a <> b")
    return moved.unionByName(least.select(F.col("low").alias("a"), F.col("v").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex reachable, for every vertex that is not itself the smallest.

    `edges` has a < b. Each round is written to the shared folder; the number of rounds grows
    with the logarithm of the longest path. Rows and hot vertices are only ever aggregated and
    joined, never gathered.
    """
    current = staged_table(edges.select("a", "b").where("a < b").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("digest")).first()
        if not state.n or state == before:
            return current.select(F.col("b").alias("vertex"), F.col("a").alias("component"))
        before = state
        current = staged_table(_small_star(_large_star(current)), "edges")
    raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")
