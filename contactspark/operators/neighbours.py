"""Neighbourhood joins on the bin grid: a tolerance becomes extra equality keys, never a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactspark.functions.scalars import fdiv


def spread(df: DataFrame, tolerance: int, bin_size: int) -> DataFrame:
    """Each row at every shift of its two bins by at most ``tolerance`` bins."""
    steps = [d * bin_size for d in range(-tolerance, tolerance + 1)]
    shifts = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a in steps for b in steps])
    return df.withColumn("_shift", F.explode(shifts)).withColumns(
        {"bin_i": F.col("bin_i") + F.col("_shift.i"), "bin_j": F.col("bin_j") + F.col("_shift.j")}
    ).drop("_shift")


def neighbour_match(a: DataFrame, b: DataFrame, groups: list[str], tolerance: int, bin_size: int) -> DataFrame:
    """Rows of ``a`` with any row of ``b`` within the tolerance in the same group (a semi join)."""
    near = spread(b.select(*groups, "bin_i", "bin_j"), tolerance, bin_size)
    return a.join(near, [*groups, "bin_i", "bin_j"], "left_semi")


BLOCK = 64  # bins on a side of a block of the grid


def block_sums(
    queries: DataFrame, candidates: DataFrame, groups: list[str], value: str, name: str, tolerance: int, bin_size: int
) -> DataFrame:
    """``queries`` that have candidates around them, with the sum of the candidates' values as ``name``.

    Both sides are dealt once by group and block of ``BLOCK`` times ``BLOCK`` bins; a candidate within the tolerance of an edge also goes to
    the block behind it. The square sum is then two passes inside the block, along one bin and along the other, so nothing moves again
    and a candidate becomes twice (rather than squared) the shifts. A block holds a bounded part of the grid, however large a chromosome is.
    """
    span, reach = BLOCK * bin_size, tolerance * bin_size
    # a stated number keeps both deals alike: adaptive execution merges partitions of either side on its own otherwise
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = [*groups, "_block_i", "_block_j"]
    at = [*block, "bin_i", "bin_j"]

    def blocks(column: str, margin: int):
        return F.sequence(fdiv(F.col(column) - margin, span), fdiv(F.col(column) + margin, span))

    def moved(rows: DataFrame, column: str, own: str) -> DataFrame:
        shifted = rows.withColumn("_shift", F.explode(shifts)).withColumn(column, F.col(column) + F.col("_shift")).drop("_shift")
        return shifted.filter(fdiv(column, span) == F.col(own))

    shifts = F.array(*[F.lit(d * bin_size) for d in range(-tolerance, tolerance + 1)])
    rows = candidates.select(*groups, "bin_i", "bin_j", F.col(value).alias("_v"), F.explode(blocks("bin_i", reach)).alias("_block_i")).withColumn(
        "_block_j", F.explode(blocks("bin_j", reach))).repartition(parts, *block)
    along = moved(rows, "bin_i", "_block_i").groupBy(*at).agg(F.sum("_v").alias("_v"))
    across = moved(along, "bin_j", "_block_j").groupBy(*at).agg(F.sum("_v").alias("_v"))
    home = queries.withColumns({"_block_i": fdiv("bin_i", span), "_block_j": fdiv("bin_j", span)}).repartition(parts, *block)
    here = W.partitionBy(*at)
    met = home.withColumn("_asks", F.lit(True)).unionByName(across.withColumn("_near", F.lit(True)), allowMissingColumns=True)
    met = met.withColumns({name: F.sum("_v").over(here), "_near": F.max("_near").over(here)})
    return met.filter("_asks and _near").select(*queries.columns, name)


def neighbour_count(queries: DataFrame, candidates: DataFrame, groups: list[str], tolerance: int, bin_size: int) -> DataFrame:
    """Number of candidates in each query's neighbourhood, itself included; repeated coordinates are an error."""
    at = [*groups, "bin_i", "bin_j"]
    single = candidates.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_n", F.when(F.col("_n") == 1, F.col("_n")).otherwise(F.raise_error(F.lit("candidate coordinates repeat")).cast("long"))
    )
    if tolerance == 0:
        return queries.select(*at).join(single.select(*at), at, "left_semi").withColumn("neighbours", F.lit(1).cast("long"))
    return block_sums(queries.select(*at), single, groups, "_n", "neighbours", tolerance, bin_size)


def neighbour_sum(pairs: DataFrame, value: str, bin_size: int, tolerance: int = 1) -> DataFrame:
    """Sum of the available values around every pair, never across chromosomes."""
    return block_sums(pairs, pairs, ["chrom"], value, "neighbour_sum", tolerance, bin_size)
