"""Connected components of an edge table, as joins and aggregations."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import written


def _with_min(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the smallest of u and its neighbours."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(low, "u")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b; both bigint): the
    label is the smallest node of its component.

    Alternates the large-star and small-star steps until the edges stay the same;
    every step hangs neighbours onto smaller nodes, so a component becomes a star in
    about the logarithm of its size.  A hub is one row a task in the aggregation and a
    splittable side in the join; no neighbour list is ever gathered."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                  "components")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = _with_min(large)         # here every v is below its u
        small = (down.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = written(small, "components")
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return (now.select(F.col("u").alias("node"), F.col("v").alias("label"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")))
            .groupBy("node").agg(F.min("label").alias("label")))


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free hash of the edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
