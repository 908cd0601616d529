"""Connected components of an edge table, by rounds of neighbour minima over written tables.

Each round sends every node's smallest neighbour to its larger neighbours and to itself (large
star), then links smaller neighbours to the smallest (small star). Rounds follow the logarithm
of the longest chain, and end when every node has one smaller neighbour that has none itself. Edges stay
distributed; the driver sees one row a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import drop, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a")
    if large:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().where("a <> b")
    return linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct().where("a <> b")


def _unsettled(edges: DataFrame) -> DataFrame:
    """Nodes with several smaller neighbours, or with both smaller and larger ones."""
    ends = edges.select(F.col("a").alias("node"), "b").union(edges.select(F.col("b").alias("node"), F.lit(None).cast(edges.schema["b"].dataType)))
    seen = ends.groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max(F.col("b").isNull()).alias("root"))
    return seen.where("low < high OR (low IS NOT NULL AND root)")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of ``edges`` (a, b) with the smallest node that it reaches."""
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while _unsettled(now).limit(1).count():
        before, now = now, written(_star(_star(now, True), False), "edges")
        drop(spark, before)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
