"""Table readers and writers: pruned scans, block tables, partitioned outputs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from contactspark.functions.scalars import finite


def scan(spark: SparkSession, path: str, columns: list[str], split: str | None = None, tiles_below: int | None = None) -> DataFrame:
    """Named columns of a table, with the split and tile filters left to the scan."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.filter(F.col("split") == split)
    if tiles_below is not None:
        df = df.filter(F.col("tile_row") < tiles_below)
    return df.select(*columns)


def authorised_rows(cube: DataFrame, context: int, ids: DataFrame, values: list[str]) -> DataFrame:
    """One context's values for the authorised pair ids only; absent counts read as 0."""
    own = cube.filter(F.col("context_index") == context).select("pair_id", *values)
    return ids.select("pair_id").join(own, "pair_id", "left").fillna(0, values)


def read_blocks(df: DataFrame, members: list[str], width: int = 7) -> DataFrame:
    """A wide table of repeated column blocks, one per member, as rows; a block partly null is an error."""
    if len(df.columns) != width * len(members):
        raise ValueError("the table is not a whole number of blocks")
    names = ["chrom_i", "start_i", "end_i", "chrom_j", "start_j", "end_j", "probability"]
    kinds = ["string", "long", "long", "string", "long", "long", "double"]
    blocks = []
    for b, member in enumerate(members):
        cells = [F.col(f"`{c}`") for c in df.columns[b * width:(b + 1) * width]]
        filled = sum((c.isNotNull().cast("int") for c in cells[1:]), cells[0].isNotNull().cast("int"))
        marked = F.when(filled == width, F.lit(member)).when(filled == 0, F.lit("")).otherwise(
            F.raise_error(F.lit(f"partly empty row of {member}")).cast("string"))
        blocks.append(F.struct(marked.alias("member"), *[c.cast(k).alias(n) for c, k, n in zip(cells, kinds, names)]))
    return df.select(F.inline(F.array(*blocks))).filter("member <> ''")


def write_table(df: DataFrame, path: str, partitions: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """zstd Parquet (text columns become dictionaries by themselves), partitioned for pruning."""
    out = df.write.mode(mode).option("compression", "zstd")
    (out.partitionBy(*partitions) if partitions else out).parquet(path)


def write_routed(members: DataFrame, path: str, by: str = "cell_type", declared: dict[str, int] | None = None) -> None:
    """One folder per cell type, each record once; Spark splits a large folder into as many files as its size asks for.

    With ``declared`` totals per cell type (a short list), the writing job counts its own rows; another total, or a record of an
    undeclared or absent type, is an error after the write. The counts are taken behind the last shuffle, where a task that runs again counts once.
    """
    rows = members.hint("rebalance", F.col(by))
    seen = Observation()
    if declared is not None:
        counts = [F.count_if(F.col(by) == name).alias(f"n{i}") for i, name in enumerate(declared)]
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(path)
    if declared is not None:
        found = seen.get
        wrong = {name: found[f"n{i}"] for i, name in enumerate(declared) if found[f"n{i}"] != declared[name]}
        if wrong or found["rows"] != sum(declared.values()):
            raise ValueError(f"{found['rows']} records written, {sum(declared.values())} declared; totals that differ: {wrong}")


def read_routed(spark: SparkSession, path: str, output: str = "all_cells", by: str = "cell_type") -> DataFrame:
    """The records of one output; ``all_cells`` is all folders together."""
    df = spark.read.parquet(path)
    return df if output == "all_cells" else df.filter(F.col(by) == output)


def without_infinities(df: DataFrame) -> DataFrame:
    """Non-finite numbers as null, as reports store them."""
    return df.select(*[finite(f.name).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in df.schema.fields])


def write_metrics(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A metric table as csv, json or parquet."""
    out = without_infinities(df).write.mode("overwrite")
    out.option("header", True).csv(path) if fmt == "csv" else out.format(fmt).save(path)


def map_rows(values: DataFrame, cells: DataFrame, keys: tuple[str, ...] = ("output_id",)) -> DataFrame:
    """Values of pairs at every tile cell they occupy, upper triangle only; mirror on reading."""
    return values.join(cells, "pair_id").select(*keys, "grid_tile", "i", "j", *[c for c in values.columns if c not in keys])


def coverage_report(written: DataFrame, pairs: DataFrame, tiles: DataFrame, positive: list[str], at_least_zero: list[str] = ()) -> DataFrame:
    """Pairs missing, repeated or unknown per output, tiles missing, and values that break their sign rule."""
    seen = written.groupBy("output_id", "pair_id").agg(F.count(F.lit(1)).alias("_n"))
    marked = seen.join(pairs.select("pair_id", F.lit(True).alias("_known")), "pair_id", "left")
    total = pairs.agg(F.count(F.lit(1)).alias("_pairs"))
    wrong = F.lit(0).cast("long")
    for c in positive:
        wrong = wrong + F.coalesce(~(finite(c) > 0), F.lit(True)).cast("long")
    for c in at_least_zero:
        wrong = wrong + F.coalesce(~(finite(c) >= 0), F.lit(True)).cast("long")
    bad = written.groupBy("output_id").agg(F.sum(wrong).alias("bad_values"), F.count_distinct("tile_row").alias("tiles"))
    per = marked.groupBy("output_id").agg(
        F.count_if("_known").alias("_found"), F.count_if(F.col("_n") > 1).alias("repeated"), F.count_if(F.col("_known").isNull()).alias("unknown"))
    tile_total = tiles.select("tile_row").distinct().agg(F.count(F.lit(1)).alias("_tiles"))
    out = per.join(bad, "output_id").join(F.broadcast(total)).join(F.broadcast(tile_total))  # single rows
    out = out.select("output_id", (F.col("_pairs") - F.col("_found")).alias("missing"), "repeated", "unknown",
                     (F.col("_tiles") - F.col("tiles")).alias("missing_tiles"), "bad_values")
    clean = (F.col("missing") == 0) & (F.col("repeated") == 0) & (F.col("unknown") == 0) & (F.col("missing_tiles") == 0) & (F.col("bad_values") == 0)
    return out.withColumn("passed", clean)
