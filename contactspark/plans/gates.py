"""Pass or fail decisions: metric tables in, ``(…, check, passed)`` rows out.

Metric tables are short (outputs times bands), so everything here is a small aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def check_rows(table: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """One row per check; a check on a missing value fails."""
    rows = F.array(*[F.struct(F.lit(n).alias("check"), _known(c).alias("passed")) for n, c in checks.items()])
    return table.select(*keys, F.inline(rows))


def verdict(checks: DataFrame, keys: list[str], name: str = "passed") -> DataFrame:
    """All checks of a key together."""
    return checks.groupBy(*keys).agg(F.bool_and("passed").alias(name))


def expected_bands(table: DataFrame, keys: list[str], bands: list[str], band: str = "distance_band") -> DataFrame:
    """Every key with every configured band; an absent band is a row of nulls, so its checks fail."""
    grid = table.select(*keys).distinct().withColumn(band, F.explode(F.array(*[F.lit(b) for b in bands])))
    return grid.join(table.withColumn("_there", F.lit(True)), [*keys, band], "left")


def power_gate(summary: DataFrame, bootstrap: DataFrame, bands: list[str], *, coverage=0.8, chroms=10, enrichment=2.0) -> DataFrame:
    """Reproducibility per output and band: coverage, chromosomes, enrichment, bootstrap lower bound."""
    keys = ["output_id", "distance_band"]
    joined = summary.join(bootstrap.select(*keys, "lower"), keys, "left")
    full = expected_bands(joined, ["output_id"], bands)
    return check_rows(full, keys, {
        "complete": F.col("_there"), "coverage": F.col("k_weighted_evaluable_fraction") >= coverage, "chromosomes": F.col("chromosomes") >= chroms,
        "enrichment": F.col("enrichment_over_chance") >= enrichment, "bootstrap": F.col("lower") > 0})


def topology_gate(bands: DataFrame, distances: DataFrame, *, enrichment=2.0, ceiling=0.5, reliability=0.2) -> DataFrame:
    """Bands: likelihood, top share and recovery of the replicate ceiling; distances: positive and reliable correlation.

    ``bands`` holds ``distance_band, likelihood_lower, top1_enrichment, top1_lower, ceiling_fraction``;
    ``distances`` holds ``distance_bp, lower, reliability_fraction``.
    """
    band = check_rows(bands, [F.col("distance_band").alias("stratum")], {
        "likelihood": F.col("likelihood_lower") > 0, "top1_point": F.col("top1_enrichment") >= enrichment,
        "top1_bootstrap": F.col("top1_lower") > 1, "ceiling_fraction": F.col("ceiling_fraction") >= ceiling})
    exact = check_rows(distances, [F.col("distance_bp").cast("string").alias("stratum")], {
        "positive": F.col("lower") > 0, "reliability_fraction": F.col("reliability_fraction") >= reliability})
    return band.unionByName(exact)


def calibration_gate(metrics: DataFrame, *, ratio=(0.9, 1.1), slope=(0.8, 1.2)) -> DataFrame:
    """Per output and band: total ratio, slope, likelihood gain.  ``metrics`` holds those and ``gain_lower``."""
    return check_rows(metrics, ["output_id", "distance_band"], {
        "deviance": F.col("gain_lower") > 0, "total_ratio": F.col("observed_predicted_ratio").between(*ratio),
        "slope": F.col("calibration_slope").between(*slope)})


def concordance_gate(same: DataFrame, cross: DataFrame, power: DataFrame, bands: list[str]) -> DataFrame:
    """Own halves overlap more than own and thinned other contexts, in every band, for outputs that passed power."""
    keys = ["output_id", "distance_band"]
    joined = same.select(*keys, F.col("overlap_excess").alias("same_excess")).join(
        cross.select(*keys, F.col("overlap_excess").alias("cross_excess")), keys, "full_outer")
    full = expected_bands(joined, ["output_id"], bands)
    per = full.groupBy("output_id").agg(F.bool_and(_known(F.col("same_excess") > F.col("cross_excess"))).alias("_ok"))
    return per.join(power.select("output_id", F.col("passed").alias("_power")), "output_id", "left").select(
        "output_id", (F.col("_ok") & _known(F.col("_power"))).alias("passed"))


METRICS = ("likelihood", "top_contact")
COMPARISONS = ("onehot_vs_shared", "rna_vs_shared", "rna_vs_onehot", "rna_vs_swapped", "rna_vs_permuted")


def extension_gate(tests: DataFrame, bands: list[str] | None = None, *, fdr: float = 0.05) -> DataFrame:
    """Which context model an output may use.

    ``tests`` holds ``output_id, distance_band, metric, comparison, point, lower, adjusted_p`` with the five
    comparisons of the label and expression models.  Expression is preferred and must also
    beat the label model, the swapped and the permuted control, in every one of ``bands`` (those of
    the table if none are named) and in both metrics: a test that is absent fails.
    """
    keys = ["output_id", "distance_band", "metric", "comparison"]
    grid = tests.select("distance_band").distinct() if bands is None else tests.sparkSession.createDataFrame([(b,) for b in bands], "distance_band string")
    # short tables: outputs, bands, two metrics and five comparisons; an absent test is a row of nulls, which fails
    names = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(c).alias("comparison")) for m in METRICS for c in COMPARISONS])).alias("_n")
    full = tests.select("output_id").distinct().crossJoin(grid).select("output_id", "distance_band", names).select("output_id", "distance_band", "_n.metric", "_n.comparison")
    tests = full.join(tests, keys, "left")

    def all_of(comparison: str, rule: Column) -> Column:
        hit = F.col("comparison") == comparison
        return F.coalesce(F.bool_and(F.when(hit, _known(rule))), F.lit(False))

    primary = (F.col("adjusted_p") <= fdr) & (F.col("point") > 0)
    beyond = F.col("lower") > 0
    per = tests.groupBy("output_id").agg(
        all_of("onehot_vs_shared", primary).alias("onehot_passed"),
        (all_of("rna_vs_shared", primary) & all_of("rna_vs_onehot", beyond) & all_of("rna_vs_swapped", beyond) & all_of("rna_vs_permuted", beyond)).alias("rna_passed"))
    return per.withColumn("selected_mode", F.when(F.col("rna_passed"), "rna").when(F.col("onehot_passed"), "onehot")).withColumn(
        "accepted", F.col("selected_mode").isNotNull())


def sequence_gate(enrichments: DataFrame, correlations: DataFrame, likelihoods: DataFrame, ceilings: DataFrame, *, recovery=0.2, correlation=0.2) -> DataFrame:
    """Acceptance of a scored model from medians over contexts.

    ``enrichments``: context, distance_band, top_fraction, enrichment.  ``correlations``: context, distance_bp,
    pearson, spearman, auprc_gain.  ``likelihoods``: source, per_event (``model`` per context or a baseline).
    ``ceilings``: distance_band, ceiling.
    """
    med = enrichments.groupBy("distance_band", "top_fraction").agg(F.percentile("enrichment", F.lit(0.5)).alias("_m"))
    top = med.filter("top_fraction = 0.01D").join(ceilings, "distance_band", "right").select(
        F.concat(F.lit("top1_recovery_"), F.col("distance_band")).alias("check"), _known(F.col("_m") >= F.col("ceiling") * recovery).alias("passed"))
    above = med.agg(F.lit("all_fractions_above_chance").alias("check"), _known(F.bool_and(F.col("_m") > 1)).alias("passed"))
    c = correlations.groupBy("distance_bp").agg(*[F.percentile(x, F.lit(0.5)).alias(x) for x in ("pearson", "spearman", "auprc_gain")])
    either = _known(F.col("pearson") >= correlation) | _known(F.col("spearman") >= correlation)
    exact = c.agg(F.lit("exact_distance_correlation").alias("check"), _known(F.bool_and(either)).alias("passed"))
    gain = c.agg(F.lit("exact_distance_auprc_gain").alias("check"), _known(F.bool_and(_known(F.col("auprc_gain") > 0))).alias("passed"))
    model = F.avg(F.when(F.col("source") == "model", F.col("per_event")))
    best = F.max(F.when(F.col("source") != "model", F.col("per_event")))
    better = likelihoods.agg(F.lit("baseline_likelihood_improvement").alias("check"), _known(model > best).alias("passed"))
    return top.unionByName(above).unionByName(exact).unionByName(gain).unionByName(better)


def promotion_check(history: DataFrame, *, epochs: int = 3, improvement: float = 0.02) -> DataFrame:
    """Early promotion: the planned epochs are there and the rank loss of the best epoch beats the first by the share.

    ``history`` holds ``run, epoch, validation_loss, rank_loss`` with epochs from 0.
    """
    best = F.min_by("rank_loss", F.struct("validation_loss", "epoch"))
    first = F.min_by("rank_loss", "epoch")
    per = history.groupBy("run").agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"), best.alias("_best"))
    gain = (F.col("_first") - F.col("_best")) / F.when(F.col("_first") > 0, F.col("_first"))
    return check_rows(per, ["run"], {"epochs_completed": F.col("_n") == epochs, "rank_loss_improved": gain >= improvement})


def early_signal(enrichments: DataFrame, correlations: DataFrame, gains: DataFrame, *, correlation: float = 0.06) -> DataFrame:
    """The remaining promotion checks: enrichment above chance, its lower bounds, correlations, likelihood gain.

    ``enrichments``: distance_band, enrichment (per context); ``correlations``: distance_bp, pearson, spearman (per
    context); ``gains``: name, value, lower, with ``likelihood`` and one row per band.
    """
    med = enrichments.groupBy("distance_band").agg(F.percentile("enrichment", F.lit(0.5)).alias("_m"))
    top = med.select(F.concat(F.lit("top1_above_chance_"), F.col("distance_band")).alias("check"), _known(F.col("_m") > 1).alias("passed"))
    c = correlations.groupBy("distance_bp").agg(F.greatest(F.percentile("pearson", F.lit(0.5)), F.percentile("spearman", F.lit(0.5))).alias("_c"))
    exact = c.agg(F.lit("exact_distance_signal").alias("check"), _known(F.bool_and(_known(F.col("_c") >= correlation))).alias("passed"))
    lows = gains.filter("name <> 'likelihood'").agg(F.lit("top1_lower_bounds_positive").alias("check"), _known(F.bool_and(_known(F.col("lower") > 0))).alias("passed"))
    like = gains.filter("name = 'likelihood'").agg(
        F.lit("likelihood_improves_baseline").alias("check"), _known(F.bool_and(_known((F.col("value") > 0) & (F.col("lower") > 0)))).alias("passed"))
    return top.unionByName(exact).unionByName(lows).unionByName(like)


def paired_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean over contexts of the per-event likelihood difference between two models."""
    joined = a.select("context_index", F.col("per_event").alias("_a")).join(b.select("context_index", F.col("per_event").alias("_b")), "context_index")
    gap = F.col("_a") - F.col("_b")
    return joined.agg(F.avg(gap).alias("mean_difference"), F.count_if(gap > 0).alias("contexts_better"), F.count(F.lit(1)).alias("contexts"))


def prepared_checks(pairs: DataFrame, tiles: DataFrame, counts: DataFrame, *, bin_size: int, low: int, high: int, group_limit: int = 75) -> DataFrame:
    """Data checks of a prepared set: pair geometry, groups, splits, counts, exposure, offsets."""
    p = pairs.agg(
        F.bool_and((F.col("bin_i") % bin_size == 0) & (F.col("bin_j") % bin_size == 0)).alias("anchors_on_grid"),
        F.bool_and(F.col("bin_j") - F.col("bin_i") == F.col("distance_bp")).alias("distance_agrees"),
        F.bool_and(F.col("distance_bin") * bin_size == F.col("distance_bp")).alias("distance_bin_agrees"),
        (F.min("distance_bp") >= low).alias("minimum_distance"), (F.max("distance_bp") < high).alias("maximum_distance"),
        F.bool_and(F.col("distance_band").isNotNull()).alias("bands_complete"), (F.min("pair_id") == 0).alias("ids_from_zero"),
        F.bool_and(F.col("split").isin("train", "validation", "test")).alias("splits_known"),
        F.bool_and(F.coalesce(F.col("exposure") > 0, F.lit(False))).alias("exposure_positive"),
        F.bool_and(F.col("distance_offset").isNotNull()).alias("offsets_complete"),
        F.bool_and(F.col("boundary_margin_bins") >= 0).alias("margins_not_negative"))
    g = pairs.groupBy("tile_row", "distance_bin").agg(F.count(F.lit(1)).alias("_n")).agg((F.max("_n") <= group_limit).alias("group_size"))
    t = tiles.agg((F.count_distinct("tile_id") == F.count(F.lit(1))).alias("tile_ids_unique"),
                  F.bool_and(F.col("target_end") - F.col("target_start") == 1_000_000).alias("tile_spans"))
    c = counts.agg(F.bool_and(F.col("counts_a") + F.col("counts_b") == F.col("full_count")).alias("halves_recombine"),
                   F.bool_and(F.col("full_count") > 0).alias("counts_sparse"))
    e = counts.join(pairs.select("pair_id"), "pair_id", "left_anti").agg((F.count(F.lit(1)) == 0).alias("counts_in_universe"))
    parts = []
    for table in (p, g, t, c, e):
        parts.append(check_rows(table, [], {n: F.col(n) for n in table.columns}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def conservation_checks(
    pairs: DataFrame, tiles: DataFrame, sums: DataFrame, records: DataFrame, offsets: DataFrame, weights: DataFrame, *,
    splits: int, bin_size: int, low: int, high: int, bins: int = 100, overlaps: int = 6,
) -> DataFrame:
    """Checks across the stages of a prepared set: ids, anchors and tiles of one split, records against sums, halves, curve, feature weights.

    ``sums`` holds ``context_index, pair_id, full_count, a_by_split``; ``records`` one row per record (or ``n`` of them) with its
    ``context_index``; ``offsets`` one row per distance; ``weights`` the native shares of ``tile_row, bin``. An empty table fails its checks.
    """
    p = pairs.agg((F.max("distance_bp") == high - bin_size).alias("maximum_represented_distance"),
                  ((F.min("pair_id") == 0) & (F.max("pair_id") == F.count(F.lit(1)) - 1)).alias("ids_contiguous"))
    ids = pairs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("_n")).agg((F.max("_n") == 1).alias("ids_unique"))
    anchors = pairs.select("chrom", "split", F.explode(F.array("bin_i", "bin_j")).alias("bin")).groupBy("chrom", "bin").agg(
        (F.min("split") == F.max("split")).alias("_one")).agg(F.bool_and("_one").alias("anchors_in_one_split"))
    owners = pairs.join(tiles.select("tile_row", "split"), ["tile_row", "split"], "left_anti").agg((F.count(F.lit(1)) == 0).alias("tile_splits_kept"))
    halves = sums.agg(F.bool_and(F.size("a_by_split") == splits).alias("every_split_counted"),
                      F.bool_and(F.forall("a_by_split", lambda a: (a >= 0) & (a <= F.col("full_count")))).alias("all_halves_recombine"))
    known = sums.join(pairs.select("pair_id"), "pair_id", "left_anti").agg((F.count(F.lit(1)) == 0).alias("sums_in_universe"))
    each = F.sum("n") if "n" in records.columns else F.count(F.lit(1))
    totals = records.groupBy("context_index").agg(each.alias("_r")).join(
        sums.groupBy("context_index").agg(F.sum("full_count").alias("_s")), "context_index", "full_outer")  # one row per context
    stream = totals.agg(F.bool_and(F.col("_r").eqNullSafe(F.col("_s"))).alias("records_conserved"))
    before = F.lag("distance_offset").over(W.orderBy("distance_bin"))  # one row per distance
    curve = offsets.select("distance_bin", (F.col("distance_offset") - before).alias("_rise")).agg(
        F.bool_and(F.coalesce(F.col("_rise"), F.lit(0.0)) <= 1e-12).alias("curve_decreases"),
        ((F.min("distance_bin") == low // bin_size) & (F.max("distance_bin") == high // bin_size - 1)
         & (F.count(F.lit(1)) == (high - low) // bin_size)).alias("curve_covers_range"))
    shares = weights.groupBy("tile_row", "bin").agg(F.count(F.lit(1)).alias("_n"), F.sum("weight").alias("_w"))
    width = shares.groupBy("tile_row").agg(F.count(F.lit(1)).alias("_bins"), F.max("_n").alias("_n"), F.max(F.abs(F.col("_w") - 1)).alias("_off")).agg(
        (F.max("_n") <= overlaps).alias("feature_overlap_width"), (F.max("_off") < 1e-9).alias("feature_weights_whole"),
        F.bool_and(F.col("_bins") == bins).alias("feature_bins_per_tile"))
    out = None
    for table in (p, ids, anchors, owners, halves, known, stream, curve, width):
        rows = check_rows(table, [], {n: F.col(n) for n in table.columns})
        out = rows if out is None else out.unionByName(rows)
    return out


def tile_contract(tiles: DataFrame, contexts: DataFrame, membership: DataFrame, splits=("train", "validation", "test")) -> DataFrame:
    """Tables agree: unique tiles of one span in known splits, contexts numbered from 0, every cell in a known context."""
    t = tiles.agg((F.count_distinct("tile_id") == F.count(F.lit(1))).alias("unique_tile_ids"),
                  F.bool_and(F.col("target_end") - F.col("target_start") == 1_000_000).alias("target_span"),
                  F.bool_and(F.col("split").isin(list(splits))).alias("known_split"))
    c = contexts.agg(((F.min("context_index") == 0) & (F.max("context_index") == F.count(F.lit(1)) - 1) & (
        F.count_distinct("context_index") == F.count(F.lit(1)))).alias("contiguous_contexts"))
    orphan = membership.join(contexts, ["context_index", "cell_type"], "left_anti").agg((F.count(F.lit(1)) == 0).alias("cells_have_contexts"))
    twice = membership.groupBy("library_id", "dna_barcode").agg(F.count(F.lit(1)).alias("_n")).agg((F.max("_n") == 1).alias("unique_barcodes"))
    parts = [check_rows(x, [], {n: F.col(n) for n in x.columns}) for x in (t, c, orphan, twice)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
