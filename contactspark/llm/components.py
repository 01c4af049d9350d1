"""Connected components over a table of links between whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node in a link; ``root`` is the smallest node it reaches.

    Large-star and small-star rounds: every node's greater neighbours, then its smaller ones, are linked to its least
    neighbour, until a round changes nothing.  The least neighbours come from a partial aggregation and a join, so that a node
    with many neighbours needs no task of its own.  Each round is stored in the checkpoint folder.
    """
    edges = stored(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct())
    before = edges.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)") + F.col("v"))).first()
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "n")
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        joined = large.join(lowest, F.col("u") == F.col("n"))
        # each smaller neighbour, and the node itself, go to the least one
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select(
            "e.u", "e.v").where("u <> v").distinct()
        edges = stored(small)
        after = edges.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)") + F.col("v"))).first()
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
