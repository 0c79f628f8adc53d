"""Distributed connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import aggregated, materialise, release


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns (node, component) for every node of edges(src, dst); component is the smallest node reachable.

    Each round hooks neighbours to the smallest member of their closed neighbourhood: first the larger
    neighbours (large-star), then the smaller ones (small-star), so the rounds grow with the logarithm of
    the longest chain. The minimum is a partial aggregate, written out before the join back to it, so that adaptive
    execution can split that join when one hub holds millions of edges. Tables of earlier rounds are removed.
    Null ends and self-loops carry no link; repeated edges count once; an empty input gives no rows.
    """
    links = (
        edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .distinct()
    )
    links = materialise(links, "links")
    nodes = materialise(links.select(F.explode(F.array("hi", "lo")).alias("node")).distinct(), "nodes")
    before, edges_now = None, links.count()
    for _ in range(max_rounds):
        hooked, smallest = _large_star(links, edges_now)
        star = aggregated(hooked, "star", edges_now)
        hooked, again = _small_star(star, edges_now)
        links, old = materialise(hooked, "star"), links
        release(old, star, smallest, again)
        # A forest of stars is reached when neither operation changes the edge set.
        now = links.agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest"),
        ).first()
        if now == before:
            break
        before, edges_now = now, now["n"]
    else:
        raise RuntimeError("connected components did not converge")
    return nodes.join(links.withColumnRenamed("hi", "node"), "node", "left").select(
        "node", F.coalesce("lo", "node").alias("component")
    )


def _large_star(links: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Edges from every larger neighbour of a node to the smallest of the node and its neighbours, and these smallest."""
    either = F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))
    both = links.select(F.explode(either).alias("e")).select("e.u", "e.v")
    least = aggregated(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", rows)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), least


def _small_star(links: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Edges from a node and its smaller neighbours to the smallest of them, and these smallest."""
    least = aggregated(links.groupBy("hi").agg(F.min("lo").alias("m")), "least", rows)
    hooked = links.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return hooked.union(least.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct(), least
