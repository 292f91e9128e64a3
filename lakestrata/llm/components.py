"""Connected components by alternating large-star and small-star.

Each half step reads written tables and writes its result to the shared
folder, so no lineage grows and a lost executor costs one step at most. The
joins have a plain table on either side, so that the adaptive planner can split
a node with very many edges.

Defined results: links with a null end and of a node with itself are ignored,
repeated links and both directions count once, only a and b are read; no links
give an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def large_star(edges: DataFrame) -> DataFrame:
    """Leads every larger neighbour of u to the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Leads u and its smaller neighbours to the least of these."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    smaller = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b): the least node that can
    be reached. Nodes without links are not listed. Ends when a round of both
    stars changes nothing; the rounds grow with the logarithm of the nodes."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = written(small_star(written(large_star(edges), "large")), "small")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
