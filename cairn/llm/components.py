"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` long edges to ``(node, root)``; root is the smallest node of the component.

    Every node that has an edge gets a row; loops and repeated edges are ignored, edges with a null
    end as well; no edges give no rows. Rounds grow with the logarithm of the component, not with
    its length. Minima are written before they are joined back, so both sides of a join are plain
    shuffles and a hub's rows can be split by AQE; only two numbers per round reach the driver.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .filter("u > v AND a IS NOT NULL AND b IS NOT NULL")
                .select("u", "v").distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.filter("v > u").join(low, "u")
                    .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (large.join(least, "u").filter("v > m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
