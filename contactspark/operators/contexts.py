"""Contexts, centroids, alignment of prediction tables, and the rollout of outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactspark.functions.draws import uniform
from contactspark.functions.scalars import finite


def fail_when(condition: Column, value: Column, message: str, kind: str) -> Column:
    return F.when(condition, F.raise_error(F.lit(message)).cast(kind)).otherwise(value)


def centroids(cells: DataFrame, dimensions: int, label: str = "cell_type", vector: str = "embedding") -> DataFrame:
    """Mean vector and number of cells per type; an empty label or a non-finite value is an error.

    One aggregate column per dimension: vectors are never exploded.
    """
    name = fail_when(F.col(label).isNull() | (F.trim(F.col(label).cast("string")) == ""), F.col(label).cast("string"), "empty cell type", "string")
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (F.size(vector) != dimensions)
    rows = cells.select(name.alias("cell_type"), fail_when(bad, F.col(vector), "bad vector", "array<float>").alias("_v"))
    means = [F.avg(F.col("_v")[d].cast("double")) for d in range(dimensions)]
    return rows.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_cells"), F.array(*means).alias("embedding"))


def pool_centroids(centroid: DataFrame, pools: DataFrame, dimensions: int) -> DataFrame:
    """Unweighted mean of the members' centroids per pool."""
    joined = pools.withColumnRenamed("member", "cell_type").join(centroid, "cell_type")
    return joined.groupBy("output_id").agg(F.array(*[F.avg(F.col("embedding")[d]) for d in range(dimensions)]).alias("embedding"))


def compare_centroids(a: DataFrame, b: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Largest, mean and root mean square difference; accepted when types and counts agree and the largest is in tolerance."""
    other = b.select("cell_type", F.col("n_cells").alias("_n"), F.col("embedding").alias("_e"))
    joined = a.join(other, "cell_type", "full_outer")
    same = F.coalesce(F.col("n_cells") == F.col("_n"), F.lit(False))
    gaps = joined.select(same.alias("_same"), F.explode_outer(F.zip_with("embedding", "_e", lambda x, y: F.abs(x - y))).alias("_d"))
    out = gaps.agg(F.max("_d").alias("max_abs"), F.avg("_d").alias("mean_abs"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmse"),
                   F.bool_and("_same").alias("_ok"))
    return out.select("max_abs", "mean_abs", "rmse", F.coalesce(F.col("_ok") & (F.col("max_abs") <= tolerance), F.lit(False)).alias("accepted"))


def contexts_with_centroids(contexts: DataFrame, centroid: DataFrame) -> DataFrame:
    """Contexts with their vectors; a missing vector or another cell count is an error."""
    c = centroid.select("cell_type", F.col("n_cells").alias("_n"), "embedding")
    joined = contexts.join(c, "cell_type", "left")
    wrong = F.col("embedding").isNull() | (F.col("_n") != F.col("n_cells"))
    return joined.withColumn("n_cells", fail_when(wrong, F.col("n_cells"), "context and centroid disagree", "bigint")).drop("_n")


def select_contexts(contexts: DataFrame, names: list[str]) -> DataFrame:
    """Listed contexts with their place in the list, all others with a null place; an absent or repeated name is an error."""
    if len(set(names)) != len(names):
        raise ValueError("context names repeat")
    listed = F.array(*[F.lit(n) for n in names])
    present = F.collect_set("cell_type").over(W.partitionBy())  # one row per context
    absent = F.size(F.array_except(listed, present)) > 0
    place = F.array_position(listed, F.col("cell_type")) - 1
    place = F.when(place >= 0, place)
    return contexts.withColumn("place", fail_when(absent, place, "listed context is absent", "bigint"))


def align_by_pair_id(parts: list[DataFrame], ids: DataFrame, value: str) -> DataFrame:
    """Prediction files as one table that covers exactly the given ids, once each, with finite values."""
    every = parts[0].select("pair_id", value)
    for part in parts[1:]:
        every = every.unionByName(part.select("pair_id", value))
    once = every.groupBy("pair_id").agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias(value))
    joined = once.join(ids.select("pair_id", F.lit(True).alias("_want")), "pair_id", "full_outer")
    wrong = F.col("_n").isNull() | (F.col("_n") > 1) | F.col("_want").isNull() | finite(value).isNull()
    return joined.select("pair_id", fail_when(wrong, F.col(value), "predictions do not cover the pairs", "double").alias(value))


def alignment_report(parts: list[DataFrame], ids: DataFrame, value: str) -> DataFrame:
    """The same check as counts."""
    every = parts[0].select("pair_id", value)
    for part in parts[1:]:
        every = every.unionByName(part.select("pair_id", value))
    once = every.groupBy("pair_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(finite(value).isNull()).alias("_bad"))
    joined = once.join(ids.select("pair_id", F.lit(True).alias("_want")), "pair_id", "full_outer")
    return joined.agg(F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_n") > 1).alias("repeated"),
                      F.count_if(F.col("_want").isNull()).alias("unknown"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("not_finite"))


def fine_to_coarse(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """Fine probability: that of its coarse pair times its share within it; a missing coarse pair is an error."""
    joined = fine.join(coarse.select("coarse_id", F.col("probability").alias("_p")), "coarse_id", "left")
    value = F.col("_p") * F.col("within")
    return joined.withColumn("probability", fail_when(F.col("_p").isNull(), value, "no coarse pair", "double")).drop("_p")


def rotated_outputs(outputs: list[str]) -> dict[str, str]:
    """Each output's swapped control: the next one in the configured order."""
    return {o: outputs[(n + 1) % len(outputs)] for n, o in enumerate(outputs)}


def permuted_outputs(outputs: DataFrame, seed: int) -> DataFrame:
    """A seeded derangement: outputs in hash order, each paired with the next, so none keeps itself."""
    w = W.orderBy(uniform(seed, "output_id"), "output_id")  # a short configured list
    every = W.partitionBy()
    placed = outputs.select("output_id").withColumns({"_r": F.row_number().over(w), "_n": F.count(F.lit(1)).over(every)})
    nxt = placed.select((F.col("_r") - 1).alias("_to"), F.col("output_id").alias("control_id"))
    size = fail_when(F.col("_n") < 2, F.col("_n"), "a permutation needs two outputs", "bigint")
    return placed.withColumn("_to", F.col("_r") % size).join(nxt, "_to").select("output_id", "control_id")


def attach_control(deltas: DataFrame, control: DataFrame, name: str = "control_delta") -> DataFrame:
    """Deltas of the control output beside each output's own (``control`` maps output_id to control_id)."""
    other = deltas.select(F.col("output_id").alias("control_id"), "pair_id", F.col("delta").alias(name))
    return deltas.join(control, "output_id").join(other, ["control_id", "pair_id"]).drop("control_id")


def rollout(contexts: DataFrame, pools: list[tuple[str, list[str]]], checks: DataFrame, unpooled: list[str]) -> DataFrame:
    """The accepted topology and calibration behind every output.

    ``checks`` holds ``output_id, power, calibration, concordance, extension`` (booleans).
    An accepted context stands for itself; otherwise it falls back to the first pool, in
    configured order, that holds it and passes power and calibration; otherwise to
    ``shared``.  Contexts of the unpooled list fall back only with power of their own.
    """
    order = {pool: n for n, (pool, _) in enumerate(pools)}
    listed = F.array(*[F.struct(F.lit(p).alias("pool"), F.lit(n).alias("n"), F.array(*[F.lit(m) for m in members]).alias("members"))
                       for n, (p, members) in enumerate(pools)])
    c = checks.select("output_id", *[F.coalesce(x, F.lit(False)).alias(x) for x in ("power", "calibration", "concordance", "extension")])
    usable = c.filter("power and calibration").select(F.col("output_id").alias("pool"), F.col("extension").alias("pool_extension"))
    names = contexts.select(F.col("cell_type").alias("output_id"))
    options = names.withColumn("_o", F.explode_outer(F.filter(listed, lambda p: F.array_contains(p["members"], F.col("output_id")))))
    best = options.select("output_id", F.col("_o.pool").alias("pool"), F.col("_o.n").alias("n")).join(usable, "pool").groupBy("output_id").agg(
        F.min(F.struct("n", "pool", "pool_extension")).alias("_b"))
    joined = names.join(c, "output_id", "left").fillna(False, ["power", "calibration", "concordance", "extension"]).join(best, "output_id", "left")
    blocked = F.col("output_id").isin(unpooled) & ~F.col("power")
    pool = F.when(~blocked, F.col("_b.pool"))
    own = F.col("extension")
    source = F.when(own, F.col("output_id")).otherwise(F.coalesce(pool, F.lit("shared")))
    delta = F.when(own, F.col("output_id")).when(pool.isNotNull() & F.col("_b.pool_extension"), pool)
    context_rows = joined.select(
        "output_id", F.lit("context").alias("output_type"), source.alias("topology_source"), source.alias("calibration_source"),
        delta.alias("delta_source"), F.when(own, "context").when(pool.isNotNull(), "pooled").otherwise("shared").alias("claim_scope"),
        F.when(~own, F.col("power") & F.col("concordance")).alias("context_extension_eligible"))
    pool_names = F.array(*[F.lit(p) for p in order]) if order else F.array().cast("array<string>")
    pool_rows = c.filter(F.array_contains(pool_names, F.col("output_id")) & F.col("power") & F.col("calibration")).select(
        "output_id", F.lit("pool").alias("output_type"), F.when(F.col("extension"), F.col("output_id")).otherwise("shared").alias("topology_source"),
        F.col("output_id").alias("calibration_source"), F.when(F.col("extension"), F.col("output_id")).alias("delta_source"),
        F.when(F.col("extension"), "pool").otherwise("shared").alias("claim_scope"), F.lit(None).cast("boolean").alias("context_extension_eligible"))
    shared = contexts.agg(F.lit("shared").alias("output_id")).select(
        "output_id", F.lit("shared").alias("output_type"), F.lit("shared").alias("topology_source"), F.lit("shared").alias("calibration_source"),
        F.lit(None).cast("string").alias("delta_source"), F.lit("shared").alias("claim_scope"), F.lit(None).cast("boolean").alias("context_extension_eligible"))
    return shared.unionByName(pool_rows).unionByName(context_rows)


def eligible_outputs(power: DataFrame, concordance: DataFrame) -> DataFrame:
    """Outputs that passed both gates."""
    return power.filter("passed").select("output_id").join(concordance.filter("passed").select("output_id"), "output_id")


def count_passed(checks: DataFrame, groups: tuple[str, ...] = ("output_type",)) -> DataFrame:
    return checks.groupBy(*groups).agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("outputs"))


def library_sets(cells: DataFrame) -> DataFrame:
    """Cells per type and the libraries they come from."""
    return cells.groupBy("cell_type").agg(
        F.count_distinct("barcode").alias("cells"), F.array_join(F.array_sort(F.collect_set("library_id")), ",").alias("libraries"))
