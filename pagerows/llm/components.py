"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Every vertex's least neighbour (itself included) comes from a partial aggregate and a join, so
    that no task ever holds all neighbours of one vertex."""
    if large:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select("v", "m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``(node, root)`` for every node that has an edge to another one; ``root`` is the least id
    reachable. Null ends, loops and repeated edges are ignored; no edges give no rows. Each round is checkpointed in
    the shared folder; the links never leave the executors."""
    now = cut(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u is not null and v is not null and u != v")
        .distinct()
    )
    before = None
    while True:  # as many rounds as it takes; each leaves fewer or lower links
        now = cut(_star(_star(now, True), False))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = mark
