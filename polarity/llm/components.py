"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.llm.scratch import materialise, scratch_scope


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)`` (long columns):
    ``component`` is the smallest node reachable. Each round links every node
    to the smallest node it knows (first among larger neighbours, then among
    smaller ones) until the edges form stars. A node's links are only ever
    aggregated with ``min`` and joined back, so a node with very many links
    needs no task of its own. Rounds grow with the logarithm of the longest
    path; the edges of a round are checkpointed and never leave the cluster.
    """
    with scratch_scope(edges.sparkSession) as keep:
        now = keep(_stars(edges, rounds))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _stars(edges: DataFrame, rounds: int) -> DataFrame:
    now = materialise(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = materialise(small.filter("a != b").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            return now
        last = state
    raise RuntimeError("components did not settle")
