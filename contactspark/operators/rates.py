"""Distance curves, expected counts, conditional likelihoods and centred scores.

Fits read training rows only and are applied to all rows.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactspark.functions.scalars import col

LEAST_EXPOSURE = 1e-12


def distance_curve(pairs: DataFrame, counts: DataFrame, contexts: int, split: str = "train") -> DataFrame:
    """Events and exposure per distance over training pairs with positive exposure; two distances at least."""
    events = counts.groupBy("pair_id").agg(F.sum("full_count").alias("_y"))
    rows = pairs.filter((F.col("split") == split) & (F.col("exposure") > 0)).join(events, "pair_id", "left")
    curve = rows.groupBy("distance_bin").agg(
        F.coalesce(F.sum("_y"), F.lit(0)).alias("event_count"), (F.sum("exposure") * contexts).alias("exposure_opportunity"))
    rate = F.log((F.col("event_count") + 0.5) / (F.col("exposure_opportunity") + 0.5))
    enough = F.count(F.lit(1)).over(W.partitionBy()) >= 2  # one row per distance
    return curve.withColumn("raw_log_rate", F.when(enough, rate).otherwise(F.raise_error(F.lit("one distance only")).cast("double")))


def isotonic_offset(curve: DataFrame) -> DataFrame:
    """Weighted decreasing fit of the raw log rate, minus the log of its weighted mean rate."""
    weighted = curve.withColumn("_w", F.greatest("exposure_opportunity", F.lit(1.0)))
    vector = VectorAssembler(inputCols=["distance_bin"], outputCol="_x").transform(weighted)
    model = IsotonicRegression(isotonic=False, featuresCol="_x", labelCol="raw_log_rate", weightCol="_w", predictionCol="_fit").fit(vector)
    fit = model.transform(vector)
    every = W.partitionBy()  # one row per distance
    norm = F.log(F.sum(F.col("_w") * F.exp("_fit")).over(every) / F.sum("_w").over(every))
    return fit.withColumn("normalization_log_rate", norm).withColumn("distance_offset", F.col("_fit") - F.col("normalization_log_rate")).drop("_x", "_fit", "_w")


def attach_offset(pairs: DataFrame, offsets: DataFrame) -> DataFrame:
    """Every pair's distance must have an offset."""
    joined = pairs.join(offsets.select("distance_bin", F.col("distance_offset").alias("_d")), "distance_bin", "left")
    found = F.coalesce("_d", F.raise_error(F.concat(F.lit("no offset for distance "), F.col("distance_bin").cast("string"))).cast("double"))
    return joined.withColumn("distance_offset", found).drop("_d")


def fixed_oe(df: DataFrame, groups: list[str], count: str, reference: str, split: str = "train") -> DataFrame:
    """Log observed over expected; expected is the mean reference per distance over training candidates, zeros included.

    Null where the expected value is absent or 0; a curve of zeros is an error.
    """
    curve = df.filter(F.col("split") == split).groupBy(*groups, "distance_bin").agg(F.avg(reference).alias("expected"))
    floor = F.min(F.when(F.col("expected") > 0, F.col("expected"))).over(W.partitionBy(*groups))  # one row per distance
    curve = curve.withColumn("epsilon", F.coalesce(floor, F.raise_error(F.lit("training curve is entirely zero")).cast("double")))
    score = F.log((F.col(count) + F.col("epsilon")) / (F.col("expected") + F.col("epsilon")))
    return df.join(curve, [*groups, "distance_bin"], "left").withColumn("oe", F.when(F.col("expected") > 0, score))


def simple_oe(df: DataFrame, count: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """Count over the mean at the same distance; 0 where that mean is 0. The means, one row per distance, go to the rows."""
    means = df.groupBy(*groups, "distance_bp").agg(F.avg(count).alias("_m"))
    return df.join(F.broadcast(means), [*groups, "distance_bp"]).withColumn("oe", F.when(F.col("_m") > 0, F.col(count) / F.col("_m")).otherwise(0.0)).drop("_m")


def fixed_baseline(df: DataFrame, count: str, split: str = "train") -> DataFrame:
    """Expected counts from exposure and distance alone, scaled so that training sums agree."""
    raw = F.greatest("exposure", F.lit(LEAST_EXPOSURE)) * F.exp("distance_offset")
    train = F.col("split") == split
    sums = df.agg(F.sum(F.when(train, F.col(count))).alias("_y"), F.sum(F.when(train, raw)).alias("_r"))
    scale = sums.select(F.when((F.col("_r") > 0) & (F.col("_y") > 0), F.col("_y") / F.col("_r")).otherwise(
        F.raise_error(F.lit("no training counts to scale to")).cast("double")).alias("baseline_scale"))
    return df.join(F.broadcast(scale)).withColumn("baseline_mean", raw * F.col("baseline_scale"))  # a single row


def center_by_group(df: DataFrame, groups: list[str], score: str, name: str = "centered") -> DataFrame:
    """Score minus its group mean; groups are a tile and a distance, so a window is bounded."""
    return df.withColumn(name, F.col(score) - F.avg(score).over(W.partitionBy(*groups)))


def softmax_by_group(df: DataFrame, groups: list[str], eta: str, name: str = "probability") -> DataFrame:
    """exp(eta) over its group sum, shifted by the group maximum."""
    w = W.partitionBy(*groups)
    shifted = F.exp(F.col(eta) - F.max(eta).over(w))
    return df.withColumn("_e", shifted).withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def owner_band_probability(df: DataFrame, rate: str, outer: tuple[str, ...] = ()) -> DataFrame:
    """Share of a rate in its owner tile and band; a total that is not positive is an error."""
    total = F.sum(rate).over(W.partitionBy(*outer, "tile_row", "distance_band"))
    checked = F.when(total > 0, total).otherwise(F.raise_error(F.lit("rate total is not positive")).cast("double"))
    return df.withColumn("probability", F.col(rate) / checked)


def conditional_ll(df: DataFrame, groups: list[str], eta: str, count: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Conditional log likelihood of the counts given each group's total.

    Two aggregates (maximum, then shifted sum), so a group may be a whole chromosome and band.
    """
    top = df.groupBy(*groups).agg(F.max(eta).alias("_m"))
    sums = df.join(top, groups).groupBy(*groups, *keep).agg(
        F.sum(F.exp(col(eta) - F.col("_m"))).alias("_z"), F.max("_m").alias("_m"), F.sum(count).cast("double").alias("events"),
        F.sum(col(count) * col(eta)).alias("_ye"))
    ll = F.col("_ye") - F.col("events") * (F.log("_z") + F.col("_m"))
    return sums.select(*groups, *keep, "events", ll.alias("log_likelihood"), F.when(F.col("events") > 0, ll / F.col("events")).alias("log_likelihood_per_event"))


def likelihood_gain_pair(df: DataFrame, groups: list[str], count: str, p: str, q: str) -> DataFrame:
    """Per chromosome sums of ``y (log p - log q)`` and of ``y``: all that the gain and its bootstrap need."""
    def safe(c):
        return F.log(F.least(F.greatest(col(c), F.lit(1e-300)), F.lit(1.0)))

    return df.filter(F.col(count) > 0).groupBy(*groups, "chrom").agg(
        F.sum(F.col(count) * (safe(p) - safe(q))).alias("gain"), F.sum(count).cast("double").alias("events"))


def likelihood_gain_summary(per_chrom: DataFrame, groups: list[str]) -> DataFrame:
    out = per_chrom.groupBy(*groups).agg((F.sum("gain") / F.sum("events")).alias("gain_per_event"), F.sum("events").alias("events"))
    return out.withColumn("relative_probability", F.exp("gain_per_event"))
