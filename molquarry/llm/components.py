"""Connected components by alternating large-star and small-star rounds (p4, p5, p6).

Every round is two aggregations by node with their joins back, then a reliable checkpoint, so the
plan stays short and a lost executor costs one round. A node of many edges is pre-aggregated to
its minimum before the shuffle, and the join back of a hot node is split by adaptive execution.

Defined results: edges with a null end are ignored, self loops make a component of one node, and
repeated edges change nothing. Each node of an edge gets one row with the smallest node of its
component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.session import cut

#: rounds after which the search gives up; the number of rounds grows as log^2 of the nodes
MAX_ROUNDS = 60


def _with_least(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node it knows. edges: (u, v), u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    known = _with_least(both)
    return known.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them. edges: (u, v), u > v."""
    known = _with_least(edges)
    down = known.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = known.select("u", F.col("m").alias("v"))
    return down.unionByName(own).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the edges (a, b)."""
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    ends = cut(ends.distinct())  # what made the edges runs once
    nodes = ends.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = ends.where("u <> v")
    before = None
    for _ in range(MAX_ROUNDS):
        links = cut(small_star(large_star(links)))
        # a forest of stars is reached when a round changes nothing
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no stable components after {MAX_ROUNDS} rounds")
    return nodes.join(links, nodes.node == links.u, "left").select("node", F.coalesce("v", "node").alias("component"))
