"""Connected components of links between long ids, by alternating star steps.

A step hangs a node's neighbours on its smallest one: first those above the node,
then those below it. Every step is an aggregate by node with map-side minima and
an equi-join, so a node with very many links is no large group; tables between
steps are written to the shared folder. The number of steps grows with the
logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.sources.staging import Staging


def _mark(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()


def components(links: DataFrame, stage: Staging, name: str) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every node of ``links`` (a, b); others are not listed."""
    down = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = stage.table(f"{name}-0", links.filter("a <> b").select(*down).distinct())
    before, step = _mark(edges), 0
    while before["n"]:
        step += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage.table(f"{name}-{step}-large", large.filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stage.table(f"{name}-{step}-small", small)
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
