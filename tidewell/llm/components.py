"""Connected components of an edge table, by alternating large and small stars.

Every round is two grouped minima and joins, and ends in a written table; the driver sees
counts only.  Hubs are no problem: minima combine before the shuffle, and the joins are
plain equi-joins, which adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.sources.shared import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge but the least of each component.

    ``edges`` has columns u and v of one type; a component is named by its least node.
    """
    stars = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        # done when all nodes but the centres have one edge, and centres have none upwards
        sources = stars.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if sources.filter("n > 1").isEmpty() and stars.join(sources.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, stars = stars, written(_small_star(_large_star(stars)), "stars")
        discard(before)
    raise RuntimeError("components did not settle")
