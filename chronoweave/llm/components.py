"""Connected components of a set of links between long ids, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import discard, stored


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest one."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself are linked to the smallest of them; edges point from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of `links` (a, b): root is the smallest node of its component.

    Each round halves the depth of every star tree at least, is written to the shared folder, and costs shuffles of the links only. No group is
    gathered in one task: a node's links meet in a hash aggregation and a join that can be split. Loops and repeated links do no harm;
    without links there are no rows.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = mark(edges)
    if before[0]:
        for _ in range(rounds):
            last, edges = edges, stored(_small(_large(edges)), "links")
            discard(last)
            now = mark(edges)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError(f"links did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
