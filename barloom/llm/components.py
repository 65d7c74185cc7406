"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the smallest node that links reach.

    Each round points the larger neighbours of every node, then the smaller
    ones, at the smallest (Kiveris et al., "Connected components in MapReduce
    and beyond").  Neighbours are never gathered: a node's smallest is an
    aggregate that is joined back, so a node with very many links splits like
    any other join.  Rounds grow with the logarithm of the longest path.
    """
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    k = 0
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).where("u <> v").distinct()
        k += 1
        old, edges = edges, scratch.keep(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        del old
        flat = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and edges.join(edges.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty()
        if flat:
            tops = edges.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(tops)
