"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinforge.llm.textcols import checkpointed, forget


def _directed(u, v) -> DataFrame:
    return F.struct(u.alias("u"), v.alias("v"))


def spread_join(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """``many`` joined with ``one``, an aggregate by the integer ``key``.

    The key is turned over for the join, so that both sides are dealt anew: a join below
    which one side is still dealt by its aggregate can't be split where one key has very many rows.
    """
    return many.withColumn("__k", F.bitwise_not(key)).join(one.withColumn("__k", F.bitwise_not(key)).drop(key), "__k").drop("__k")


def _with_least(edges: DataFrame, of: DataFrame) -> DataFrame:
    """``edges`` with m, the least v of their u in ``of``."""
    return spread_join(edges, of.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the node's least neighbour (itself included)."""
    both = edges.select(F.explode(F.array(_directed(F.col("u"), F.col("v")), _directed(F.col("v"), F.col("u")))).alias("e")).select("e.u", "e.v")
    moved = _with_least(both.where("v > u"), both).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it all move to the least of them. Edges have u > v."""
    moved = _with_least(edges, edges).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(edges.groupBy("u").agg(F.min("v").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node has either one neighbour below it and none above, or none below: rounds would change nothing more."""
    end = lambda c, down: F.struct(F.col(c).alias("node"), F.lit(down).alias("down"))
    ends = edges.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e")).select("e.*")
    others = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count(F.lit(1)).alias("n")).where("down > 0 and n > 1")
    return not others.agg(F.count(F.lit(1))).first()[0]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node that has an edge; the component is its least node.

    Nodes are integers.  Null ends and loops are no edges.  A node with very many edges
    is a skewed join key, which adaptive execution splits; nothing is collected per node.
    The number of rounds grows with the logarithm of the longest path; edges that are stars already take none.
    """
    now = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    now = checkpointed(now)
    while not _stars(now):
        after = checkpointed(_small_star(_large_star(now)))
        forget(now)
        now = after
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
