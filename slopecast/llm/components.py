"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopecast.llm.common import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction step over links (a, b), a > b. Every node is tied to its least neighbour:
    the larger neighbours in a large step, the smaller neighbours and itself in a small one."""
    if large:
        sides = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = sides.join(least, "a")
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the least node reachable.

    Large and small star steps alternate until nothing changes; the number of rounds is about the
    logarithm of the longest chain, not its length. Each round is written to the shared folder, so
    no lineage grows and lost executors cost one round. Self links and repeats are allowed; an empty
    table gives an empty table; a link with a null end is no link.
    """
    edges = settle(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    mark = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        mark = state
        edges = settle(_star(_star(edges, True), False), "links")
