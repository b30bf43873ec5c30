"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import few


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a long, b long)``; root is a node of the same component.

    Each round maps every node to that of itself and its neighbours whose hash is smallest, follows that map once
    more, and contracts the graph by it. Hashes leave no order of ids that makes long chains: the expected number of
    rounds grows with the logarithm of the largest component. Nothing is gathered on the driver; minima are
    pre-aggregated, and joins on a hub are equi-joins that adaptive execution can split.
    """
    edges = few(edges.where("a <> b").distinct())
    place = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("v"))
    turns = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(place(F.col("b"))).alias("m"))
        up = low.select("a", F.least(place(F.col("a")), F.col("m"))["v"].alias("p"))
        over = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
        turns.append(few(up.join(over, "p").select(F.col("a").alias("node"), F.col("q").alias("root"))))
        left, right = turns[-1].toDF("a", "ra"), turns[-1].toDF("b", "rb")
        edges = few(edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if not turns:
        return edges.toDF("node", "root")
    labels = turns[0]
    for step in turns[1:]:
        labels = labels.join(step.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return labels
