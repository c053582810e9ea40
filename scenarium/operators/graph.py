"""Connected components over an edge relation, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenarium.plans.materialize import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; ``component`` is the smallest node reachable.

    Self pairs and nulls are ignored as links (a self pair still yields its node). Each round is a
    combinable ``min`` per node and one equi-join on the node, so that no neighbour list is ever
    collected; rounds needed grow with the logarithm of the longest path.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    pairs = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    links, seen = pairs.where("u <> v"), None
    while True:
        before, links = links, materialize(_small_star(_large_star(links)), "links")
        if seen is not None:
            discard(before)
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    own = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return own.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _beside(links: DataFrame, least: DataFrame) -> DataFrame:
    """``links`` with the ``m`` of their ``u``.

    The aggregate comes with the partitioning of ``u``; under another expression it is dealt out again, as few rows as
    it has, so that both sides of the join are plain shuffles and AQE can split the links of a node that has very many.
    """
    own = least.select(F.greatest("u", "u").alias("w"), "m")
    return links.join(own, links["u"] == own["w"]).select("u", "v", "m")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _beside(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = _beside(links, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
