"""Connected components of a link table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.shared import written


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label) of every node of ``edges`` (a long, b long): the label is its component's smallest node.

    Null ends and loops are ignored. Each round is written to the shared folder, so lineage stays short; the
    table shrinks towards one row per node, and the driver sees a count and a checksum per round. The smallest
    neighbours are written before they are joined back, so that both sides of the join are plain shuffles, of which
    Spark splits a hub's large partition.
    """
    e = (edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e, last = written(e, "edges"), None
    for _ in range(rounds):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "smallest")
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "stars")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "smallest")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = written(small.distinct(), "edges")
        # the edges are distinct, so a change shows in the XOR of their hashes, which no number of edges overflows
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v").distinct())
