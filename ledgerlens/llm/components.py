"""Connected components of links, by alternating star contraction.

Large star: every node tells its larger neighbours the smallest node it knows. Small star: every node
joins its smaller neighbours to the smallest of them. Both keep components and shrink their
diameter geometrically, so the number of rounds is logarithmic. Each round is one aggregate
(smallest neighbour, combined map-side) and one join; a node with very many neighbours is
a skewed join key, which adaptive execution splits. Rounds end in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.shared import materialize

ROUNDS = 40
#: Links of one written partition; links are 16 bytes, and rounds on few of them need few tasks.
TASK_LINKS = 50_000


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest member) for every node of ``links`` (columns a, b)."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    tasks = max(4, edges.count() // TASK_LINKS)  # contraction never adds links
    before = None
    for _ in range(ROUNDS):
        # large star: (u, v) with v > u becomes (v, smallest of u and its neighbours)
        ways = _both_ways(edges)
        least = materialize(ways.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).coalesce(tasks), "least")
        large = (ways.where("v > u").join(least, "u").where("v <> m")
                 .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        large = materialize(large.coalesce(tasks), "large-star")
        # small star: a's smaller neighbours and a itself join the smallest of them
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks), "least")
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialize(small.select("e.a", "e.b").where("a <> b").distinct().coalesce(tasks), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
