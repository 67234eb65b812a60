"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.session import discard, measured


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges, with their number and a hash of all of them."""
    out, state = measured(edges, "links", n=F.count("*"), mix=F.bit_xor(F.xxhash64("u", "v")))
    return out, (state["n"], state["mix"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v): component is the smallest node it reaches.

    Each round ties the larger neighbours of every node to the smallest node next to it, then the smaller
    ones, until nothing changes: O(log^2 n) rounds. Rounds are written to shared storage, and the one before is deleted. Neighbour
    minima are pre-aggregated and joined back, so a node that most others link to is no task of its own. The joins sort
    and merge, so that no round leaves a broadcast with the driver.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, state = _kept(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # u > v in all of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, old = state, edges
        edges, state = _kept(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(old)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
