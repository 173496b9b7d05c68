"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlework.llm.hot import lookup
from needlework.llm.store import stored


def large_star(edges: DataFrame, n: int) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
    found = lookup(both.where("b > a"), least, ["a"], "n", 2 * n)
    return found.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame, n: int) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = lookup(edges, least, ["a"], "n", n).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def stars(links: DataFrame) -> DataFrame:
    """Links (a, b) -> (a, b) with a > b, where b is the smallest node of a's component.

    Both steps keep the components, only ever shrink the targets and use aggregations and
    lookups of a node's smallest neighbour, so a node with very many neighbours is never
    gathered in one place.
    """
    ordered = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, before = stored(ordered.distinct()), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.hash("a", "b"))).first()
        if state == before or not state[0]:
            return edges
        before = state
        larger = stored(large_star(edges, state[0]))
        edges = stored(small_star(larger, larger.count()))


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root, label (smallest doc_id) of the nodes that ``links`` (a, b) join, for every node.

    ``nodes`` has node and doc_id, one row per node; a null doc_id counts only if there
    is no other.
    """
    roots = stars(links).select(F.col("a").alias("node"), F.col("b").alias("root"))
    placed = stored(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    labels = placed.groupBy("root").agg(F.min("doc_id").alias("label"), F.count("*").alias("n"))
    return lookup(placed.select("node", "root"), labels, ["root"], "n", placed.count()).select("node", "root", "label")
