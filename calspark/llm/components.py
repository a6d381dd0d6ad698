"""Connected components of a graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, joined


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id but the smallest of each component; ``edges`` has a and b (long).

    Each step is a grouped minimum and a join on the same key; the edge list never grows. The minimum of an id with
    very many edges is broadcast, so these stay where they are. The edges of each round are written to the shared
    folder, and rounds end when they stay as they are.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = cut(joined(both, least, ["u"], "n", 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = joined(large, least, ["u"], "n", before[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
