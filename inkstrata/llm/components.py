"""Connected components of an edge table by alternating stars, entirely in shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stash


def _least(edges: DataFrame) -> DataFrame:
    """(u, v) with m, the least neighbour of u.

    The minimum is taken before the shuffle; of the join, whose right side has one row a node, Spark splits the hubs' partitions.
    """
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """From undirected edges (u long, v long) gives (node, root): root is the least node that node can reach.

    Large-star, then small-star, until nothing changes (about the log of the longest path). Each round is written to
    the shared folder; the driver gets a count and a checksum. Nodes without an edge to another node aren't returned.
    """
    cur = stash(
        edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = _mark(cur)
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _least(large)
        last = cur
        cur = stash(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v"))).distinct(),
            "edges",
        )
        new = _mark(cur)
        discard(last)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()
