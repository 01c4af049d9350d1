"""Loop catalogs: collapsing calls, member consensus, family support, labels on the pair universe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.operators.neighbours import spread
from contactspark.sources.text import map_bedpe

PAIR = ["chrom", "bin_i", "bin_j"]
MODES = {"exact": 0, "anchor_tolerance_10kb": 1}


def collapse_calls(calls: DataFrame, low: int = 250_000, high: int = 1_000_000, source_bin: int = 5_000, bin_size: int = 10_000) -> DataFrame:
    """Best probability per bin pair and member after flooring to the grid."""
    mapped = map_bedpe(calls, low, high, source_bin, bin_size, ("member", "probability"))
    return mapped.groupBy(*PAIR, "member").agg(F.max("probability").alias("probability"))


def member_consensus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Calls in both catalogs; a catalog that repeats a call is an error."""
    keys = [*PAIR, "member"]

    def single(df: DataFrame) -> DataFrame:
        once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in df.columns if c not in keys])
        checked = F.when(F.col("_n") == 1, F.col("member")).otherwise(F.raise_error(F.lit("repeated member call")).cast("string"))
        return once.withColumn("member", checked).drop("_n")

    return single(a).join(single(b.select(*keys)), keys)


def catalog_support(calls: DataFrame, families: DataFrame) -> DataFrame:
    """Members behind each family loop: their number, their sorted names, their share of the family."""
    sizes = families.groupBy("output_id").agg(F.count(F.lit(1)).alias("family_member_count"))
    joined = calls.select(*PAIR, "member").distinct().join(families, "member")
    out = joined.groupBy(F.col("output_id").alias("family"), *PAIR).agg(
        F.count_distinct("member").alias("member_support"), F.array_join(F.array_sort(F.collect_set("member")), ",").alias("source_members"))
    return out.join(sizes.withColumnRenamed("output_id", "family"), "family").withColumn(
        "member_fraction", F.col("member_support") / F.col("family_member_count"))


def catalog_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Calls per member in each catalog, shared calls and shares; a share of no calls is null."""
    keys = [*PAIR, "member"]
    both = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    per = both.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    out = per.groupBy("member").agg(
        F.sum("_a").alias("calls_a"), F.sum("_b").alias("calls_b"), F.sum(F.col("_a") * F.col("_b")).alias("shared_calls"))
    return out.withColumns({
        "share_of_a": F.when(F.col("calls_a") > 0, F.col("shared_calls") / F.col("calls_a")),
        "share_of_b": F.when(F.col("calls_b") > 0, F.col("shared_calls") / F.col("calls_b")),
    })


def spread_loops(loops: DataFrame, tolerance: int, bin_size: int) -> DataFrame:
    """Loops at every shift within the tolerance; shifts off the chromosome start or out of order are dropped."""
    return spread(loops, tolerance, bin_size).filter("bin_i >= 0 and bin_j > bin_i")


def loop_labels(pairs: DataFrame, loops: DataFrame, tolerance: int, bin_size: int, name: str = "label") -> DataFrame:
    """Whether any loop lies on the pair (or within the tolerance)."""
    hits = spread_loops(loops.select(*PAIR), tolerance, bin_size).distinct().withColumn(name, F.lit(True))
    return pairs.join(hits, PAIR, "left").fillna(False, [name])


def support_to_pairs(pairs: DataFrame, catalog: DataFrame, tolerance: int, bin_size: int) -> DataFrame:
    """Best member fraction per family on each pair; pairs without any are left out (their support is 0)."""
    near = spread_loops(catalog.select("family", *PAIR, "member_fraction"), tolerance, bin_size)
    # the join deals rows by pair, and so does the sum behind it: shifted loops move once
    met = pairs.select("pair_id", *PAIR).join(near, PAIR)
    return met.groupBy(*PAIR, "pair_id", "family").agg(F.max("member_fraction").alias("support")).select("family", "pair_id", "support")


def support_pair_counts(pairs: DataFrame, catalog: DataFrame, bin_size: int) -> DataFrame:
    """Labelled pairs per mode and family."""
    parts = [support_to_pairs(pairs, catalog, tol, bin_size).withColumn("mode", F.lit(mode)) for mode, tol in MODES.items()]
    return parts[0].unionByName(parts[1]).filter("support > 0").groupBy("mode", "family").agg(F.count(F.lit(1)).alias("pairs"))


def direction_pairs(support: DataFrame, probabilities: DataFrame, first: str, second: str) -> DataFrame:
    """Pairs whose support differs between two families, the label (first is larger) and the log probability difference.

    ``probabilities`` holds ``pair_id, p_a, p_b``.  ``exclusive`` marks support in one family only.
    """
    wide = support.filter(F.col("family").isin(first, second)).groupBy("pair_id").agg(
        F.coalesce(F.max(F.when(F.col("family") == first, F.col("support"))), F.lit(0.0)).alias("_a"),
        F.coalesce(F.max(F.when(F.col("family") == second, F.col("support"))), F.lit(0.0)).alias("_b"))
    rows = wide.filter("_a <> _b and (_a > 0 or _b > 0)").join(probabilities, "pair_id")
    tiny = F.lit(1e-300)
    return rows.withColumns({
        "label": F.col("_a") > F.col("_b"), "exclusive": (F.col("_a") > 0) != (F.col("_b") > 0),
        "delta": F.log(F.greatest("p_a", tiny)) - F.log(F.greatest("p_b", tiny)),
    }).drop("_a", "_b")
