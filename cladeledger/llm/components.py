"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeledger.workspace import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """Each edge (``u``, ``v``) with ``m``, the least of ``u`` and all its partners; partial sums run before the shuffle."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return edges.join(least, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """``edges`` have ``u > v``."""
    starred = _stars(edges)
    hung = starred.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(starred.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``component``, its least reachable node, of every node that some link joins to another.

    Links are undirected; repeated links and links to oneself do no harm. The number of rounds grows with the
    logarithm of the longest chain. Each round is a written table, so lost executors cost one round at most.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u > v").distinct()
    edges = materialize(edges, "links")
    state = None
    while True:
        summary = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if summary == state or summary[0] == 0:
            break
        state = summary
        edges = materialize(_small(_large(edges)), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
