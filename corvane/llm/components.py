"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.runtime import packed

#: Rounds after which something is wrong: the number needed grows with the logarithm of the input.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins each node's greater neighbours to the least of it and its neighbours."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins each node and its lesser neighbours to the least of them (edges have a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a").select(F.col("b").alias("x"), "m")
    return near.union(least).toDF("a", "b").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, least): every node of an edge, and the least node that it reaches.

    ``edges`` has two long columns; self-loops and repeats don't matter.
    """
    a, b = edges.columns
    edges = packed(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        edges = packed(_small_star(_large_star(edges)))
        # a star forest stays as it is: equal marks mean that nothing moves any more
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            stars = edges.select(F.col("a").alias("node"), F.col("b").alias("least"))
            return packed(stars.union(edges.select("b", "b").distinct()))
        mark = now
    raise RuntimeError("components did not settle")
