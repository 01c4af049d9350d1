"""Classification, correlation, quantile and calibration metrics per group.

Scores are folded to distinct values with counts before anything is ordered, so
ties (a third of the rows may score 0) shrink the data instead of skewing it, and
the ordered part goes through ``ordered.running_totals``, which has no group bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactspark.functions.scalars import col, finite
from contactspark.operators.ordered import average_ranks, checkpointed, running_totals


def fold_scores(df: DataFrame, groups: list[str], score: str, label: str) -> DataFrame:
    """Rows ``_n`` and positives ``_p`` of every distinct score."""
    return df.groupBy(*groups, score).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("int")).cast("long").alias("_p"))


def _thresholds(folded: DataFrame, groups: list[str], score: str) -> DataFrame:
    """Per distinct score, descending: rows and positives at it and down to it, with group totals."""
    return running_totals(folded, groups, [(score, True)], {"_cn": "_n", "_cp": "_p"}, {"_rows": "_n", "_positives": "_p"})


def classification(df: DataFrame, groups: list[str], score: str, label: str) -> DataFrame:
    """Average precision, tie-corrected AUROC, prevalence and lift; metrics are null for one-class groups."""
    return classification_of(fold_scores(df, groups, score, label), groups, score)


def classification_of(folded: DataFrame, groups: list[str], score: str) -> DataFrame:
    """``classification`` from folded scores."""
    steps = _thresholds(folded, groups, score)
    negatives = F.col("_rows") - F.col("_positives")
    ap = F.sum(F.try_divide("_p", "_positives") * (F.col("_cp") / F.col("_cn")))
    wins = F.sum((F.col("_n") - F.col("_p")) * (F.col("_cp") - F.col("_p") + F.col("_p") / 2.0))
    out = steps.groupBy(*groups).agg(
        F.max("_rows").alias("candidates"), F.max("_positives").alias("positives"), ap.alias("_ap"), F.try_divide(wins, F.max(F.col("_positives") * negatives)).alias("_auc")
    )
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("candidates"))
    prevalence = F.col("positives") / F.col("candidates")
    return out.select(
        *groups, "candidates", "positives", prevalence.alias("prevalence"), F.when(both, F.col("_ap")).alias("auprc"),
        F.when(both, F.try_divide(F.col("_ap"), prevalence)).alias("auprc_lift"), F.when(both, F.col("_auc")).alias("auroc"),
    )


def precision_recall_points(df: DataFrame, groups: list[str], score: str, label: str) -> DataFrame:
    """Precision and recall at every distinct threshold."""
    return _thresholds(fold_scores(df, groups, score, label), groups, score).select(
        *groups, F.col(score).alias("threshold"), (F.col("_cp") / F.col("_cn")).alias("precision"),
        F.when(F.col("_positives") > 0, F.col("_cp") / F.col("_positives")).alias("recall"),
    )


def spearman(df: DataFrame, groups: list[str], x: str, y: str, name: str = "spearman") -> DataFrame:
    """Rank correlation with averaged ties; null when either side is constant.  Adds the row count."""
    return spearman_of(checkpointed(df.groupBy(*groups, x, y).agg(F.count(F.lit(1)).alias("_w"))), groups, x, y, name)


def spearman_of(pairs: DataFrame, groups: list[str], x: str, y: str, name: str = "spearman") -> DataFrame:
    """``spearman`` from distinct pairs of values with their rows ``_w``; read three times."""
    rx = average_ranks(pairs, groups, x, "_rx", "_n", "_w").select(*groups, x, "_rx", "_n")
    ry = average_ranks(pairs, groups, y, "_ry", weight="_w").select(*groups, y, "_ry")
    ranked = pairs.join(rx, [*groups, x]).join(ry, [*groups, y])
    dx, dy = F.col("_rx") - (F.col("_n") + 1) / 2.0, F.col("_ry") - (F.col("_n") + 1) / 2.0
    out = ranked.groupBy(*groups).agg(
        F.max("_n").alias("rows"), F.sum(F.col("_w") * dx * dy).alias("_xy"),
        F.sum(F.col("_w") * dx * dx).alias("_xx"), F.sum(F.col("_w") * dy * dy).alias("_yy"),
    )
    ok = (F.col("_xx") > 0) & (F.col("_yy") > 0)
    return out.select(*groups, "rows", F.when(ok, F.col("_xy") / F.sqrt(F.col("_xx")) / F.sqrt(F.col("_yy"))).alias(name))


def metric_bundle(
    df: DataFrame, groups: list[str], prediction: str, target: str, support: str, minimum_candidates: int = 100, minimum_supported: int = 1
) -> DataFrame:
    """Pearson, Spearman and AUPRC per group over rows finite in both columns.

    Groups below ``minimum_candidates`` are undefined with a reason; a group without rows has no line.
    """
    rows = df.withColumns({"_x": finite(prediction), "_y": finite(target), "_s": F.col(support).cast("boolean")})
    rows = rows.filter(F.col("_x").isNotNull() & F.col("_y").isNotNull()).select(*groups, "_x", "_y", "_s")
    base = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("candidate_count"), F.count_if("_s").alias("support_count"),
        F.when((F.stddev_pop("_x") > 0) & (F.stddev_pop("_y") > 0), F.corr("_x", "_y")).alias("pearson"),
    )
    # ranks and thresholds need the rows folded to distinct values only, so what is behind the rows runs twice, not five times
    folded = checkpointed(rows.groupBy(*groups, "_x", "_y").agg(F.count(F.lit(1)).alias("_w"), F.count_if("_s").alias("_h")))
    rho = spearman_of(folded, groups, "_x", "_y").drop("rows")
    scores = folded.groupBy(*groups, "_x").agg(F.sum("_w").alias("_n"), F.sum("_h").alias("_p"))
    ap = classification_of(scores, groups, "_x").select(*groups, "auprc")
    out = base.join(rho, groups, "left").join(ap, groups, "left")
    defined = F.col("candidate_count") >= minimum_candidates
    auprc_ok = defined & (F.col("support_count") >= minimum_supported) & (F.col("support_count") < F.col("candidate_count"))
    return out.select(
        *groups, defined.alias("defined"), "candidate_count", F.when(defined, F.col("pearson")).alias("pearson"),
        F.when(defined, F.col("spearman")).alias("spearman"), F.when(auprc_ok, F.col("auprc")).alias("auprc"),
        auprc_ok.alias("auprc_defined"), F.when(defined, F.col("support_count")).alias("support_count"),
        F.when(defined, F.col("support_count") / F.col("candidate_count")).alias("support_prevalence"),
        F.when(~defined, "insufficient_candidates").alias("reason"),
    )


def with_strata(df: DataFrame, distances: list[int], labels: list[str]) -> DataFrame:
    """Each row once per stratum it is in: exact distances and boolean anchor labels."""
    named = [F.when(F.col("distance_bp") == d, F.lit(f"distance_{d}")) for d in distances]
    named += [F.when(F.col(c), F.lit(c)) for c in labels]
    return df.withColumn("stratum", F.explode(F.filter(F.array(*named), lambda s: s.isNotNull())))


def strata_summary(bundles: DataFrame, required: list[str]) -> DataFrame:
    """Medians over contexts per stratum; a required stratum passes on a positive correlation and AUPRC gain."""
    gain = F.when(F.col("auprc_defined"), F.col("auprc") - F.col("support_prevalence"))
    out = bundles.groupBy("stratum").agg(
        F.percentile("pearson", F.lit(0.5)).alias("pearson"), F.percentile("spearman", F.lit(0.5)).alias("spearman"),
        F.percentile(gain, F.lit(0.5)).alias("auprc_gain"),
    )
    positive = F.coalesce(F.col("pearson") > 0, F.lit(False)) | F.coalesce(F.col("spearman") > 0, F.lit(False))
    return out.withColumn("required", F.col("stratum").isin(required)).withColumn(
        "passed", positive & F.coalesce(F.col("auprc_gain") > 0, F.lit(False)))


def macro_ap(df: DataFrame, groups: list[str], key: str, score: str, label: str, minimum: int = 20) -> DataFrame:
    """Mean and median AP over keys with enough candidates and both classes."""
    per = classification(df, [*groups, key], score, label).filter((F.col("candidates") >= minimum) & F.col("auprc").isNotNull())
    return per.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("eligible_keys"), F.sum("candidates").alias("eligible_candidates"),
        F.avg("auprc").alias("macro_auprc"), F.percentile("auprc", F.lit(0.5)).alias("median_auprc"),
    )


def per_chrom_metric_difference(df: DataFrame, groups: list[str], score_a: str, score_b: str, label: str, metric: str = "auprc") -> DataFrame:
    """Metric of A minus metric of B per chromosome with both classes."""
    keys = [*groups, "chrom"]
    both = df.select(*keys, F.col(label).alias("_l"), F.inline(F.array(
        F.struct(F.lit("a").alias("_side"), F.col(score_a).cast("double").alias("_v")),
        F.struct(F.lit("b").alias("_side"), F.col(score_b).cast("double").alias("_v")))))
    per = classification(both, [*keys, "_side"], "_v", "_l").filter(F.col(metric).isNotNull())
    return per.groupBy(*keys).agg(
        F.max(F.when(F.col("_side") == "a", F.col(metric))).alias("source_a"), F.max(F.when(F.col("_side") == "b", F.col(metric))).alias("source_b")
    ).withColumn("difference", F.col("source_a") - F.col("source_b"))


def direction_accuracy(df: DataFrame, groups: list[str], score: str, label: str) -> DataFrame:
    """Accuracy of ``score > 0`` for a boolean label, plain and averaged over the two classes."""
    hit = ((F.col(score) > 0) == F.col(label)).cast("double")
    return df.groupBy(*groups).agg(
        F.avg(hit).alias("direction_accuracy"),
        ((F.avg(F.when(F.col(label), hit)) + F.avg(F.when(~F.col(label), hit))) / 2).alias("balanced_direction_accuracy"),
    )


def direction_accuracy_of(folded: DataFrame, groups: list[str], score: str) -> DataFrame:
    """``direction_accuracy`` from folded scores."""
    up, others = F.col(score) > 0, F.col("_n") - F.col("_p")
    right_p, right_n = F.sum(F.when(up, F.col("_p")).otherwise(0)), F.sum(F.when(up, 0).otherwise(others))
    return folded.groupBy(*groups).agg(
        ((right_p + right_n) / F.sum("_n")).alias("direction_accuracy"),
        ((F.try_divide(right_p, F.sum("_p")) + F.try_divide(right_n, F.sum(others))) / 2).alias("balanced_direction_accuracy"))


def reliability(df: DataFrame, distances: list[int], model: str, target: str, half_a: str, half_b: str, minimum: int = 3) -> DataFrame:
    """Rank correlations per exact distance and chromosome: model with target, half with half."""
    rows = df.filter(F.col("distance_bp").isin(distances))
    keys = ["distance_bp", "chrom"]
    m = spearman(rows, keys, model, target, "model")
    r = spearman(rows, keys, half_a, half_b, "reliability").drop("rows")
    return m.join(r, keys).filter((F.col("rows") >= minimum) & F.col("model").isNotNull() & F.col("reliability").isNotNull())


def reliability_summary(per_chrom: DataFrame) -> DataFrame:
    def mean(c):
        return F.sum(F.col(c) * F.col("rows")) / F.sum("rows")

    out = per_chrom.groupBy("distance_bp").agg(mean("model").alias("model"), mean("reliability").alias("reliability"))
    out = out.withColumn("reliability_ceiling", F.sqrt(F.greatest("reliability", F.lit(0.0))))
    return out.withColumn("reliability_fraction", F.when(F.col("reliability_ceiling") > 0, F.col("model") / F.col("reliability_ceiling")))


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs, weight: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles as an array, found by order statistics instead of one task's memory.

    ``probs`` is a list, or a column expression over the group keys and ``distinct_values``; ``weight`` names the rows that a folded row
    stands for.
    """
    distinct = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    distinct = distinct.withColumn("_one", F.lit(1).cast("long"))
    run = running_totals(distinct, groups, [(value, False)], {"_c": "_n"}, {"_rows": "_n", "distinct_values": "_one"})
    wanted = F.array(*[F.lit(float(p)) for p in probs]) if isinstance(probs, (list, tuple)) else probs
    spots = run.select(
        *groups, F.col(value).alias("_v"), (F.col("_c") - F.col("_n")).alias("_first"), (F.col("_c") - 1).alias("_last"), "_rows", "distinct_values",
        F.transform(wanted, lambda p, i: F.struct(i.alias("i"), (p * (F.col("_rows") - 1)).alias("h"))).alias("_spots"),
    )
    def inside(at):
        return (at >= F.col("_first")) & (at <= F.col("_last"))

    # floor and ceiling positions; a tiny slack keeps p * (n - 1) from falling just short of a whole number
    low, high = (lambda s: F.floor(s["h"] + 1e-9)), (lambda s: F.ceil(s["h"] - 1e-9))
    hit = spots.withColumn("_s", F.explode(F.filter("_spots", lambda s: inside(low(s)) | inside(high(s)))))
    s = F.col("_s")
    part = hit.groupBy(*groups, s["i"].alias("_i"), s["h"].alias("_h"), "_rows", "distinct_values").agg(
        F.max(F.when(inside(F.floor(s["h"] + 1e-9)), F.col("_v"))).alias("_lo"), F.max(F.when(inside(F.ceil(s["h"] - 1e-9)), F.col("_v"))).alias("_hi"))
    value_at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.greatest(F.col("_h") - F.floor(F.col("_h") + 1e-9), F.lit(0.0))
    return part.groupBy(*groups).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", value_at.alias("v")))), lambda x: x["v"]).alias("quantiles"),
        F.max("_rows").alias("values"), F.max("distinct_values").alias("distinct_values"))


def exposure_deciles(pairs: DataFrame, exposure: str = "exposure") -> DataFrame:
    """Decile 0..9 of log exposure; edges come from positive training rows only (ten at least)."""
    train = pairs.filter("split = 'train'").withColumn("_x", finite(exposure)).filter("_x > 0").select(F.log("_x").alias("_x"))
    edges = exact_quantiles(train, [], "_x", [i / 10 for i in range(1, 10)])
    edges = edges.select(F.when(F.col("values") >= 10, F.col("quantiles")).otherwise(
        F.raise_error(F.lit("too few training exposures")).cast("array<double>")).alias("_edges"))
    value = F.log(F.greatest(F.col(exposure), F.lit(1e-12)))
    # one row of nine numbers, so its broadcast is bounded
    return pairs.join(F.broadcast(edges)).withColumn("exposure_decile", F.size(F.filter("_edges", lambda e: e <= value))).drop("_edges")


def calibration_slope(df: DataFrame, groups: list[str], observed: str, predicted: str, bins: int = 10) -> DataFrame:
    """Slope of log mean observed on log mean predicted over quantile bins of the prediction.

    Groups are outputs times bands: rows are folded to distinct predictions before they meet their group's edges, and the edges (one short
    list a group) go to the rows, as a join by so few keys would bring a whole output and band into one task.
    """
    df = checkpointed(df.groupBy(*groups, predicted).agg(
        F.count(F.lit(1)).alias("_w"), F.sum(observed).cast("double").alias("_sum"), F.count(observed).alias("_seen")))
    count = F.least(F.lit(bins), F.col("distinct_values").cast("int"))
    probs = F.transform(F.sequence(F.lit(0), count), lambda i: i / count)
    edges = exact_quantiles(df, groups, predicted, probs, "_w").select(*groups, "values", F.array_distinct("quantiles").alias("_edges"))
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 1, F.lit(1)))
    keys = [F.col(g) for g in groups]
    rows = df.join(F.broadcast(edges), groups) if groups else df.join(F.broadcast(edges))
    rows = rows.withColumn("_bin", F.size(F.filter(inner, lambda e: e < F.col(predicted))))
    means = rows.groupBy(*keys, "_bin").agg(
        (F.sum(F.col(predicted) * F.col("_w")) / F.sum(F.when(F.col(predicted).isNotNull(), F.col("_w")))).alias("_m"),
        (F.sum("_sum") / F.sum("_seen")).alias("_o"), F.max("values").alias("_n"), F.min(predicted).alias("_low"))
    epsilon = F.greatest(F.min("_m").over(W.partitionBy(*groups)), F.lit(1e-12))
    logs = means.withColumn("_e", epsilon).withColumns({"_x": F.log(F.col("_m") + F.col("_e")), "_z": F.log(F.col("_o") + F.col("_e"))})
    out = logs.groupBy(*keys).agg(
        F.regr_slope("_z", "_x").alias("_s"), F.count(F.lit(1)).alias("_k"), F.max("_n").alias("_n"), F.min("_low").alias("_low"))
    ok = (F.col("_k") >= 3) & (F.col("_n") >= bins) & (F.col("_low") > 0)
    return out.select(*groups, F.when(ok, F.col("_s")).alias("calibration_slope"))


def supported_context_coverage(counts: DataFrame, contexts: int, minimum: int, fraction: float) -> DataFrame:
    """Per label, contexts with enough supported candidates against the number required."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    required = max(1, -int(-(contexts * fraction) // 1))
    return counts.groupBy("label").agg(F.count_if(F.col("supported") >= minimum).alias("passing_contexts")).withColumn(
        "required_contexts", F.lit(required).cast("long")).withColumn("passed", F.col("passing_contexts") >= F.col("required_contexts"))


def bh_adjust(tests: DataFrame, p: str = "p_value", groups: tuple[str, ...] = ()) -> DataFrame:
    """False-discovery adjusted p values of a table of tests (outputs times bands, so small).

    A null p value is no test: it counts nowhere and stays null.
    """
    checked = tests.withColumn("_p", F.when(F.col(p).isNull() | F.col(p).between(0, 1), F.col(p)).otherwise(F.raise_error(F.lit("p outside [0, 1]")).cast("double")))
    w = W.partitionBy(*groups)
    raw = checked.withColumn("_r", F.row_number().over(w.orderBy(F.col("_p").asc_nulls_last()))).withColumn("_q", F.col("_p") * F.count("_p").over(w) / F.col("_r"))
    down = w.orderBy(F.col("_r").desc()).rowsBetween(W.unboundedPreceding, 0)
    return raw.withColumn("adjusted_p", F.when(F.col("_p").isNotNull(), F.least(F.min("_q").over(down), F.lit(1.0)))).drop("_p", "_r", "_q")


def best_epoch(history: DataFrame, groups: list[str], loss: str, epoch: str = "epoch") -> DataFrame:
    """The earliest epoch of least loss per group."""
    best = F.min(F.struct(loss, epoch)).alias("_b")
    return history.groupBy(*groups).agg(best).select(*groups, F.col(f"_b.{loss}"), F.col(f"_b.{epoch}"))


def one_se_selection(losses: DataFrame, order: list[str]) -> DataFrame:
    """The first candidate (in configured order) within one standard error of the best mean loss.

    ``losses`` holds ``feature, fold, loss, epoch_count``; a candidate without epochs gives a null epoch count.
    """
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("feature"))
    per = losses.groupBy("feature").agg(
        F.avg("loss").alias("mean_loss"), (F.stddev_samp("loss") / F.sqrt(F.count(F.lit(1)))).alias("standard_error"),
        F.percentile("epoch_count", F.lit(0.5)).alias("_epochs"),
    ).withColumn("_order", rank)
    w = W.partitionBy()  # one row per candidate
    best = F.min(F.struct("mean_loss", "_order", "standard_error")).over(w)
    marked = per.withColumn("_limit", best["mean_loss"] + best["standard_error"]).withColumn("_ok", F.col("mean_loss") <= F.col("_limit"))
    chosen = F.min(F.when(F.col("_ok"), F.col("_order"))).over(w)
    return marked.select(
        "feature", "mean_loss", "standard_error", F.col("_limit").alias("threshold"), (F.col("_order") == chosen).alias("selected"),
        F.when(F.col("_order") == chosen, F.rint("_epochs")).cast("long").alias("epoch_count"),
    )


def mass_allocation(df: DataFrame, groups: list[str], mask: str, observed: str, predicted: str) -> DataFrame:
    """A subset's share of pairs, observed and predicted mass, and the mass shares over the pair share."""
    def share(value):
        return F.try_divide(F.sum(F.when(F.col(mask), value).otherwise(0)), F.sum(value))

    out = df.groupBy(*groups).agg(
        F.count_if(mask).alias("subset_pairs"), F.count(F.lit(1)).alias("pairs"), share(F.lit(1)).alias("pair_share"),
        share(col(observed)).alias("observed_share"), share(col(predicted)).alias("predicted_share"),
    )
    return out.withColumns({
        "observed_enrichment": F.when(F.col("pair_share") > 0, F.col("observed_share") / F.col("pair_share")),
        "predicted_enrichment": F.when(F.col("pair_share") > 0, F.col("predicted_share") / F.col("pair_share")),
    })
