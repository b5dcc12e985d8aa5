"""Connected components of a graph given as an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearlog.session import durable


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is its component's smallest node.

    Alternates two steps until nothing changes, each an aggregate and a join: every node
    hands its smallest neighbour to its larger neighbours, then to its smaller ones. The
    edge table never grows, and it ends as stars around the roots. The state of each round
    is a table in the shared folder; only its row count and digest reach the driver.
    """
    state = durable(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    )
    seen = _digest(state)
    while True:
        state = durable(_to_smaller(_to_larger(state)))
        now = _digest(state)
        if now == seen:
            break
        seen = now
    return state.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
        state.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    )


def _digest(state: DataFrame) -> tuple:
    return tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first())


def _to_larger(state: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest node around it."""
    smallest = (
        state.select(F.col("high").alias("node"), "low")
        .union(state.select(F.col("low").alias("node"), F.col("low")))
        .groupBy("node").agg(F.min("low").alias("least"))
    )
    return (
        state.join(smallest, F.col("low") == F.col("node"))
        .select("high", F.col("least").alias("low"))
        .union(
            # a node that has smaller neighbours only keeps one link into its component
            smallest.where("least < node").select(F.col("node").alias("high"), F.col("least").alias("low"))
        )
        .distinct()
    )


def _to_smaller(state: DataFrame) -> DataFrame:
    """Links each smaller neighbour of a node, and the node, to the smallest of them."""
    smallest = state.groupBy("high").agg(F.min("low").alias("least")).withColumnRenamed("high", "node")
    return (
        state.join(smallest, F.col("high") == F.col("node"))
        .select(F.explode(F.array("low", "high")).alias("high"), F.col("least").alias("low"))
        .where("high <> low").distinct()
    )
