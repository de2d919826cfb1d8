"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _hung(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation: neighbours of a node are hung on the least of them and it."""
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    met = both.join(least, both["a"] == least["n"])
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's least node) of all nodes with an edge to another one. edges: a, b, any direction.

    Each star operation is two shuffles of the edges, which never grow in number beyond nodes and edges together; the
    number of rounds follows the logarithm of the longest path.
    """
    now = written(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges")
    before = None
    while True:
        now = written(_hung(_hung(now, large=True), large=False), "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
