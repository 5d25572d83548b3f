"""Connected components by large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, saved


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Whether each node of distinct edges (a, b), b < a, is either a member with one centre or a centre."""
    return edges.select("a").union(edges.select("b").distinct()).groupBy("a").count().where("count > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b: bigint): node, label, the smallest node reachable, for all nodes that have an edge to another.

    In a large-star step every node hands its larger neighbours to its smallest one, in a small-star step its smaller ones;
    both keep what is connected. The result is reached when each node names one smaller node only and none that is named names one itself. Edges to a
    common smallest node are stars: a node with many neighbours has a row for each, aggregated before the shuffle.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        both = _both(now)
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = saved(small, "edges")
        discard(now)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
