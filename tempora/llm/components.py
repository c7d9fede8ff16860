"""Connected components of a graph of any size by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b) that isn't its component's smallest node; root is that one.

    Each round hangs every node's larger neighbours, then its smaller ones, on its smallest neighbour,
    until nothing changes: some logarithm of the longest path in rounds, each a few shuffles of at most
    as many edges as before. A node's neighbours are never gathered; its minimum is aggregated before the
    shuffle, and the joins with it may be split where one node has very many.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = cut(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    now = state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).withColumn("m", F.least("k", "m"))
        large = both.join(least, F.col("u") == F.col("k")).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        new = cut(small.select("x.*").filter(F.col("u") != F.col("v")).distinct())
        before, now = now, state(new)
        discard(e)
        e = new
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
