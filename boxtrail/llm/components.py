"""Connected components of a table of links, without collecting any group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.runtime import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them; ``u`` is the larger end of every link."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of a link and the least node of its component.

    Alternates star operations until all links of a node go to one root. Rounds grow with the logarithm of the longest
    chain; each is written to the shared folder, so that neither the plan nor the lineage grows.
    """
    ordered = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = materialize(ordered, "component_links")
    while True:
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        loose = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in")).where("out > 1 or (out > 0 and in > 0)")
        if loose.isEmpty():
            break
        links = materialize(_small_star(_large_star(links)), "component_links")
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
