"""Ordered computations over groups of any size.

A window function sorts a whole group in one task.  Where a group has a
geometric bound (a tile, a bin) that is right; where it has none, the functions
here range-partition the rows by group and order, keep that layout in the shared
checkpoint folder, and add the totals of earlier partitions as offsets.  A hot
group is then spread over as many tasks as its rows need.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def use_checkpoints(spark: SparkSession) -> None:
    """Point the session at its configured shared folder; a private one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(folder)


def measured_broadcasts(spark: SparkSession) -> None:
    """Let a join broadcast a side by its measured size only.

    Estimates from the plan take an exploded table for as small as its source, and a stored one for its compressed files: a pair table
    of millions of rows counts as a few kilobytes and would pass through the driver. Adaptive execution measures what was shuffled.
    """
    planned = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if planned != "-1":
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", planned)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the reliable checkpoint folder, lineage cut."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


def laid_out(df: DataFrame) -> DataFrame:
    """``checkpointed`` rows that keep the layout they were dealt in (``repartition``, order within partitions), so that later joins and sums by
    its keys move none of them. An adaptive plan forgets its layout when it is stored, so this step is planned without.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return checkpointed(df)
    finally:
        conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """Rows written once as Parquet to the shared checkpoint folder and read back; for wide tables that are read by column.

    The files go when the session's file system is closed.
    """
    spark = df.sparkSession
    use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def _names(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order]


def running_totals(
    df: DataFrame, groups: list[str], order: list[tuple[str, bool]], totals: dict[str, str], whole: dict[str, str] | None = None
) -> DataFrame:
    """Add cumulative sums, the current row included.

    ``order`` lists ``(column, descending)`` and must be unique within a group;
    ``totals`` maps a new column to the column it sums; ``whole`` maps a new
    column to the one whose sum over the entire group it carries.
    """
    whole = whole or {}
    laid = checkpointed(
        df.repartitionByRange(*[F.col(g) for g in groups], *_names(order)).withColumn("__part", F.spark_partition_id())
    )
    sums = laid.groupBy(*groups, "__part").agg(
        *[F.sum(c).alias(f"__s_{n}") for n, c in totals.items()], *[F.sum(c).alias(f"__w_{n}") for n, c in whole.items()]
    )
    before = W.partitionBy(*groups).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*groups)
    offsets = sums.select(
        *[F.col(g).alias(f"__g_{g}") for g in groups],
        F.col("__part").alias("__at"),
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in totals],
        *[F.sum(f"__w_{n}").over(every).alias(n) for n in whole],
    )
    on = F.col("__part") == F.col("__at")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    here = W.partitionBy(*groups, "__part").orderBy(*_names(order)).rowsBetween(W.unboundedPreceding, 0)
    joined = laid.join(offsets, on)
    return joined.select(
        *df.columns, *[(F.sum(c).over(here) + F.col(f"__o_{n}")).alias(n) for n, c in totals.items()], *whole
    )


def numbered(df: DataFrame, groups: list[str], order: list[tuple[str, bool]], name: str = "position", size: str | None = None):
    """Row numbers from 1 within each group; ``size`` names a column for the group's row count."""
    out = running_totals(
        df.withColumn("_one", F.lit(1).cast("long")), groups, order, {name: "_one"}, {size: "_one"} if size else None
    )
    return out.drop("_one")


def average_ranks(
    df: DataFrame, groups: list[str], value: str, name: str = "avg_rank", size: str | None = None, weight: str | None = None
) -> DataFrame:
    """Tie-averaged ascending rank of every distinct value: one row per (group, value). ``weight`` names the rows that a folded row stands for."""
    distinct = df.groupBy(*groups, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("ties"))
    ranked = running_totals(distinct, groups, [(value, False)], {"_upto": "ties"}, {size: "ties"} if size else None)
    return ranked.withColumn(name, F.col("_upto") - F.col("ties") + (F.col("ties") + 1) / 2.0).drop("_upto")
