"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest
    node of its component.

    A round moves every larger neighbour of a node to the smallest one known
    there, then does the same among the smaller neighbours; edges become
    stars in a number of rounds that grows with the logarithm of the
    longest path.  Only yes or no reaches the driver each round.  Minima are
    written before they are joined, so a node with very many neighbours is
    split among tasks.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = written(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        # Stars: no node is both the end of an edge and the root of another, nor the end of two.
        ends = e.groupBy("a").agg(F.count("*").alias("k"))
        if ends.where("k > 1").isEmpty() and e.join(ends.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
    roots = e.select("b").distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
