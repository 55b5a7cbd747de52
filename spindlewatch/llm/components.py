"""Connected components of a graph of ids, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewatch.llm.common import written


def _lowest(edges: DataFrame, at: str, to: str) -> DataFrame:
    # written, so that the join with it reads plain shuffles on both sides and splits a hub's rows
    return written(edges.groupBy(at).agg(F.min(to).alias("low")), "component-lows")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``edges``; a component is named by its smallest node.

    Each round links every neighbour above a node to the node's lowest neighbour (large star), then every node and its
    neighbours below it to the lowest of those (small star). Edges never grow in number, and the rounds grow with the
    logarithm of a component's width. Self-loops and null ends are left out; repeated edges count once.
    """
    spark = edges.sparkSession
    now = written(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(),
        "component-edges",
    )
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark[0] == 0:
            return spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("component"))
        if mark == before:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        before = mark
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        large = (
            both.filter("v > u").join(_lowest(both, "u", "v"), "u")
            .select(F.col("v").alias("hi"), F.least("u", "low").alias("lo")).distinct()
        )
        large = written(large, "component-large")
        small = large.join(_lowest(large, "hi", "lo"), "hi").select("hi", "lo", "low")
        now = written(
            small.select("hi", F.col("low").alias("lo"))
            .unionByName(small.filter("lo <> low").select(F.col("lo").alias("hi"), F.col("low").alias("lo")))
            .distinct(),
            "component-edges",
        )
