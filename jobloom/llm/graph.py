"""Connected components by edge contraction, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.session import settle


def renamed(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``df`` with ``column`` mapped through ``names`` (from, to); values without a name stay."""
    other = names.select(F.col("from").alias("_from"), F.col("to").alias("_to"))
    out = df.join(other, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column))
    return out.drop("_from", "_to")


def components(edges: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b) that aren't their component's root; root is one of its nodes.

    The first round takes the nodes in their own order, or with ``weights`` (node, w) the heaviest first, in which
    stars round their first node vanish at once;
    every later round puts them in a hashed order of its own. A round maps each to its first neighbour, if that comes before
    it, and contracts the edges under this map; a node's root is found by going through the rounds' maps in order.
    As the order is new in each round, long chains also lose a constant share of their nodes a round.
    Hot nodes only meet map-side minima. Null ends and loops are ignored.
    """
    edges = settle(edges.where("a <> b").select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    maps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        if maps or weights is None:
            rank = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c) if maps else F.lit(0), c)
            both = both.select("a", rank(F.col("a")).alias("ra"), rank(F.col("b")).alias("rb"))
        else:
            rank = weights.select("node", F.struct((-F.col("w")).alias("w"), F.col("node").alias("b")).alias("r"))
            both = both.join(rank.select(F.col("node").alias("a"), F.col("r").alias("ra")), "a")
            both = both.join(rank.select(F.col("node").alias("b"), F.col("r").alias("rb")), "b").select("a", "ra", "rb")
        low = both.groupBy("a").agg(F.min("rb").alias("low"), F.first("ra").alias("ra")).where("low < ra")
        down = low.select(F.col("a").alias("from"), F.col("low").getField("b").alias("to"))
        maps.append(settle(down))
        edges = settle(renamed(renamed(edges, "a", maps[-1]), "b", maps[-1]).where("a <> b").distinct())
    for names in maps:
        nodes = renamed(nodes, "root", names)
    return settle(nodes.where("node <> root"))
