"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def _large_star(e: DataFrame) -> DataFrame:
    """Ties each larger neighbour of a node to the smallest node around it."""
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written out, so that a node with very many neighbours can be split
    least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Ties each smaller neighbour of a node, and the node, to the smallest of them. Edges come as u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least.hint("merge"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(u, v) pairs of ids -> (id, component): the smallest id that can be reached; nodes without an edge are absent.

    Self-loops, repeated and null edges are ignored; an empty table gives an empty table. Each round is written
    to the shared folder; only a count and a checksum come to the driver. The number of rounds grows with the logarithm of
    the longest path; more than `rounds` of them are an error, never a cut.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = staged(e, "edges"), None
    for _ in range(rounds):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        before = mark
        e = staged(_small_star(_large_star(e)), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
