"""Recovery studies: loops and enhancer-promoter pairs found by several score sources, band by band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.operators import catalog as C
from contactspark.operators import metrics as M
from contactspark.operators import rates as R
from contactspark.operators import resampling as B
from contactspark.operators import sampling as X
from contactspark.operators import topk as K
from contactspark.operators.neighbours import neighbour_sum
from contactspark.operators.ordered import checkpointed


def score_sources(pairs: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Scores in long form ``(source, value)``; ``sources`` maps a name to a column expression."""
    rows = F.array(*[F.struct(F.lit(n).alias("source"), F.expr(e).cast("double").alias("value")) for n, e in sources.items()])
    return pairs.select("*", F.inline(rows))


def with_count_scores(pairs: DataFrame, count: str, bin_size: int) -> DataFrame:
    """Observed over expected of the raw counts and its 3 by 3 neighbourhood sum."""
    rows = R.simple_oe(pairs, count).withColumnRenamed("oe", "raw_oe")
    return neighbour_sum(rows, "raw_oe", bin_size).withColumnRenamed("neighbour_sum", "smoothed_oe")


def recovery_table(labelled: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Classification and tie-aware top 1% per band and source of pairs with a boolean ``label``."""
    rows = score_sources(labelled, sources).select("pair_id", "distance_band", "source", "value", F.col("label").cast("int").alias("label"))
    keys = ["distance_band", "source"]
    top = K.topk_tie_aware(rows, keys, "value", "label", [0.01]).select(
        *keys, "k", F.col("precision").alias("top1_precision"), F.col("recall").alias("top1_recall"), F.col("enrichment").alias("top1_enrichment"))
    return M.classification(rows, keys, "value", "label").join(top, keys)


def loop_recovery(pairs: DataFrame, loops: DataFrame, sources: dict[str, str], bin_size: int) -> DataFrame:
    """The recovery table per match mode."""
    parts = [recovery_table(C.loop_labels(pairs, loops, tolerance, bin_size), sources).withColumn("mode", F.lit(mode)) for mode, tolerance in C.MODES.items()]
    return parts[0].unionByName(parts[1])


def zero_count_recovery(pairs: DataFrame, loops: DataFrame, sources: dict[str, str], count: str, bin_size: int) -> DataFrame:
    """The recovery table of exact loops over the pairs without a count on the A side, where the count itself tells nothing."""
    return recovery_table(C.loop_labels(pairs.filter(F.col(count) == 0), loops, 0, bin_size), sources)


def macro_bootstrap(
    labelled: DataFrame, sources: dict[str, str], model: str, metric: str, *, replicates: int, seed: int, groups: tuple[str, ...] = ("distance_band",), chance: float | None = None
) -> DataFrame:
    """Model minus every other source: mean over chromosomes of a metric's difference, and its chromosome bootstrap.

    Chromosomes without both classes are left out, and two are needed. The metric is computed once per source and chromosome. With
    ``chance`` the model is compared with that constant. One row per group and baseline.
    """
    rows = score_sources(labelled, sources).select(*groups, "chrom", "source", "value", F.col("label").cast("int").alias("_hit"))
    keys = [*groups, "chrom"]
    per = M.classification(rows, [*keys, "source"], "value", "_hit").filter(F.col(metric).isNotNull())
    own = per.filter(F.col("source") == model).select(*keys, F.col(metric).alias("_own"))
    if chance is None:
        other = per.filter(F.col("source") != model).select(*keys, F.col("source").alias("baseline"), F.col(metric).alias("_other"))
        both = own.join(other, keys)
    else:
        both = own.withColumns({"baseline": F.lit("chance"), "_other": F.lit(chance)})
    by = [*groups, "baseline"]
    out = B.chrom_bootstrap(both.withColumns({"_d": F.col("_own") - F.col("_other"), "_one": F.lit(1.0)}), by, "_d", "_one", replicates=replicates, seed=seed, minimum_chroms=2)
    return out.select(*by, "chroms", F.col("point").alias("macro_difference"), "lower", "median", "upper", F.coalesce((F.col("point") > 0) & (F.col("lower") > 0), F.lit(False)).alias("positive_lower_bound"))


def hard_matched(pairs: DataFrame, loops: DataFrame, count: str, shared: str, bin_size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Exact loops with one matched pair outside all loop neighbourhoods each, and how they were matched.

    The first table repeats ``pairs`` with ``label``, a negative as often as it was drawn; loops without a match are in neither class. The second counts
    tiers, distinct negatives and repeated ones per band.
    """
    marked = C.loop_labels(C.loop_labels(pairs, loops, 0, bin_size, "_loop"), loops, 1, bin_size, "_near")
    buckets = X.with_match_buckets(marked, count, shared)
    found = X.matched_negatives(buckets, "_loop", "_near", seed, strict=False)
    drawn = found.filter("negative_id is not null").select(F.inline(F.array(
        F.struct(F.col("pair_id"), F.lit(True).alias("label")), F.struct(F.col("negative_id").alias("pair_id"), F.lit(False).alias("label")))))
    tiers = found.join(pairs.select("pair_id", "distance_band"), "pair_id").groupBy("distance_band").agg(
        *[F.count_if(F.col("tier") == t).alias(t) for t in ("exact_10kb", "within_50kb", "within_band", "unmatched")],
        F.count_distinct("negative_id").alias("unique_negatives"), (F.count("negative_id") - F.count_distinct("negative_id")).alias("duplicate_negatives"))
    return pairs.join(drawn, "pair_id"), tiers


def matched_bootstrap(matched: DataFrame, sources: dict[str, str], model: str, *, replicates: int, seed: int) -> DataFrame:
    """Quantiles of resampled AUPRC and AUROC per band and source, and of the model's lead in AUPRC within the same replicate."""
    rows = score_sources(matched, sources).select("distance_band", "source", "chrom", "value", F.col("label").cast("int").alias("_hit"))
    each = B.resampled_classification(rows, ["distance_band", "source"], "value", "_hit", replicates=replicates, seed=seed)
    own = each.filter(F.col("source") == model).select("distance_band", "replicate", F.col("auprc").alias("_own"))
    lead = each.join(own, ["distance_band", "replicate"]).withColumn("lead", F.col("_own") - F.col("auprc"))
    return B.quantile_band(lead, ["distance_band", "source"], ["auprc", "auroc", "lead"])


def identity_table(directed: DataFrame, groups: list[str]) -> DataFrame:
    """AUROC, AP and direction accuracy of a log probability difference against support direction."""
    # both read rows and positives per distinct difference, which are found once
    folded = checkpointed(M.fold_scores(directed, groups, "delta", "label"))
    return M.classification_of(folded, groups, "delta").join(M.direction_accuracy_of(folded, groups, "delta"), groups)


def identity_support(directed: DataFrame, *, replicates: int, seed: int) -> DataFrame:
    """Per band: score range, pairs supported by one family only, AUROC less chance over chromosomes, and whether identity is supported.

    ``directed`` holds ``chrom, distance_band, label, exclusive, delta``.
    """
    lead = macro_bootstrap(directed, {"delta": "delta"}, "delta", "auroc", replicates=replicates, seed=seed, chance=0.5).drop("baseline", "median")
    whole = identity_table(directed, ["distance_band"]).select("distance_band", "auroc")
    spread = directed.groupBy("distance_band").agg(
        F.count_if("label").alias("first_pairs"), F.count_if(~F.col("label")).alias("second_pairs"), F.count_if("exclusive").alias("exclusive_pairs"),
        F.min("delta").alias("minimum"), F.percentile("delta", F.lit(0.5)).alias("median"), F.max("delta").alias("maximum"))
    return spread.join(whole, "distance_band").join(lead, "distance_band").withColumn("identity_supported", (F.col("auroc") > 0.5) & F.col("positive_lower_bound"))


def ep_recovery(pairs: DataFrame, labels: list[str], observed: str, family: str, shared: str) -> DataFrame:
    """Per enhancer label and band: classification of observed pairs, likelihood gain and top-share capture."""
    named = F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in labels]), lambda x: x.isNotNull())
    rows = pairs.withColumn("label", F.explode(named)).withColumn("hit", (F.col(observed) > 0).cast("int"))
    keys = ["label", "distance_band"]
    scores = M.classification(rows, keys, family, "hit")
    gain = R.likelihood_gain_summary(R.likelihood_gain_pair(rows, keys, observed, family, shared), keys).drop("events")
    capture = K.topk_capture(rows, keys, family, observed, [0.01]).select(*keys, "capture", F.col("enrichment").alias("capture_enrichment"))
    macro = M.macro_ap(rows, keys, "promoter_key", family, "hit").select(*keys, "eligible_keys", "macro_auprc")
    return scores.join(gain, keys, "left").join(capture, keys, "left").join(macro, keys, "left")
