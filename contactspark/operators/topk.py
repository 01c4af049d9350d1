"""Top-k selections.  Each tie rule is its own function: they differ and must not be mixed.

``groups`` with a geometric bound (tile, band) use window functions; the functions
named ``*_rows`` for whole outputs number rows through ``ordered`` and take any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactspark.functions.scalars import finite, fraction_k, hypergeom_any
from contactspark.operators.neighbours import neighbour_count, neighbour_match
from contactspark.operators.ordered import checkpointed, numbered, running_totals

SLICE = 0.004  # width of the slices around a cutoff, as a share of the group


def topk_hard(df: DataFrame, groups: list[str], score: str, fraction, row: str = "pair_id") -> DataFrame:
    """Exactly k rows; ties go to the earlier row.  Non-finite scores are no candidates.  Adds ``k, tied``."""
    rows = df.withColumn(score, finite(score)).filter(F.col(score).isNotNull())
    w = W.partitionBy(*groups)
    order = w.orderBy(F.col(score).desc(), F.col(row))
    at = {"_r": F.row_number().over(order), "_n": F.count(F.lit(1)).over(w), "_next": F.lead(score).over(order)}
    rows = rows.withColumns(at).withColumn("k", fraction_k("_n", fraction))
    tied = F.max(F.when((F.col("_r") == F.col("k")) & (F.col(score) == F.col("_next")), True).otherwise(False)).over(w)
    return rows.withColumn("tied", tied).filter("_r <= k").drop("_r", "_n", "_next")


def topk_inclusive(df: DataFrame, groups: list[str], score: str, fraction) -> DataFrame:
    """Every row that ties with the k-th is kept.  Adds ``k, tied``."""
    rows = df.withColumn(score, finite(score)).filter(F.col(score).isNotNull())
    w = W.partitionBy(*groups)
    at = {"_r": F.rank().over(w.orderBy(F.col(score).desc())), "_n": F.count(F.lit(1)).over(w)}
    rows = rows.withColumns(at).withColumn("k", fraction_k("_n", fraction)).filter("_r <= k")
    return rows.withColumn("tied", F.count(F.lit(1)).over(w) > F.col("k")).drop("_r", "_n")


def fractional_weight(rank, ties, k) -> Column:
    """Weight of a row in a top-k whose ties at the cutoff share the places left."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(k) - F.col(rank) + 1) / F.col(ties)))


def topk_fractional(df: DataFrame, groups: list[str], score: str, k: str, eligible: Column | None = None) -> DataFrame:
    """Weights that sum to k per group, shared evenly at the cutoff; groups with fewer eligible rows vanish.

    Only rows of positive weight are returned.
    """
    rows = df.withColumn("_v", finite(score)).filter(F.col("_v").isNotNull() & (eligible if eligible is not None else F.col("_v") > 0))
    w = W.partitionBy(*groups)
    rows = rows.withColumns({
        "_r": F.rank().over(w.orderBy(F.col("_v").desc())),
        "_t": F.count(F.lit(1)).over(W.partitionBy(*groups, "_v")),
        "_n": F.count(F.lit(1)).over(w),
    })
    return rows.filter(F.col("_n") >= F.col(k)).withColumn("weight", fractional_weight("_r", "_t", k)).filter(
        "weight > 0").drop("_v", "_r", "_t", "_n")


def topk_overlap(a: DataFrame, b: DataFrame, keys: list[str], sizes: DataFrame, item: str = "pair_id") -> DataFrame:
    """Overlap of two weighted selections per group against chance; only groups present in both count.

    ``sizes`` holds ``keys`` with ``candidate_count`` and ``k``.
    """
    shared = a.select(*keys, item, F.col("weight").alias("_a")).join(b.select(*keys, item, F.col("weight").alias("_b")), [*keys, item])
    dot = shared.groupBy(*keys).agg(F.sum(F.col("_a") * F.col("_b")).alias("_dot"))
    both = sizes.join(a.select(*keys).distinct(), keys, "left_semi").join(b.select(*keys).distinct(), keys, "left_semi")
    out = both.join(dot, keys, "left").withColumn("overlap", F.coalesce("_dot", F.lit(0.0)) / F.col("k"))
    out = out.withColumn("chance", F.col("k") / F.col("candidate_count"))
    return out.withColumns({
        "overlap_excess": F.col("overlap") - F.col("chance"),
        "enrichment_over_chance": F.when(F.col("chance") > 0, F.col("overlap") / F.col("chance")),
    }).drop("_dot")


def model_vs_target(df: DataFrame, groups: list[str], model: str, target: str, count: str, fraction: float) -> DataFrame:
    """Overlap of the model's top k with the target's; the target may pick only counted pairs, the model any."""
    w = W.partitionBy(*groups)
    rows = df.withColumn("candidate_count", F.count(F.lit(1)).over(w)).withColumn("k", fraction_k("candidate_count", fraction))
    sizes = rows.select(*groups, "candidate_count", "k").distinct()
    a = topk_fractional(rows, groups, target, "k", eligible=F.col(count) > 0)
    b = topk_fractional(rows, groups, model, "k", eligible=F.lit(True))
    return topk_overlap(a, b, groups, sizes)


def topk_overlap_neighbour(
    df: DataFrame, score_a: str, score_b: str, fractions: list[float], tolerance: int, bin_size: int, tie_mode: str = "hard",
    outer: tuple[str, ...] = (),
) -> DataFrame:
    """Per (band, tile) and fraction: directed hit rates within a tolerance, averaged, against exact chance.

    Only rows finite in both scores take part.  ``tie_mode`` is ``hard`` or ``inclusive``; a fractional mode
    has no set to match and is read as ``hard``.
    """
    groups = [*outer, "distance_band", "tile_row"]
    w = W.partitionBy(*groups)
    ready = df.withColumns({score_a: finite(score_a), score_b: finite(score_b)}).filter(
        F.col(score_a).isNotNull() & F.col(score_b).isNotNull())
    ready = ready.select(*groups, "chrom", "bin_i", "bin_j", "pair_id", score_a, score_b).withColumn("_size", F.count(F.lit(1)).over(w))
    cells = ready.filter("_size >= 2")

    # ranks serve every fraction, so the windows run once over the candidates and only selected rows go on
    def places(score, side):
        order = w.orderBy(F.col(score).desc(), F.col("pair_id"))
        return {f"_n{side}": F.row_number().over(order), f"_r{side}": F.rank().over(w.orderBy(F.col(score).desc())),
                f"_even{side}": F.coalesce(F.col(score) == F.lead(score).over(order), F.lit(False))}

    ranked = cells.withColumns({**places(score_a, "a"), **places(score_b, "b")})
    each = ranked.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions]))).withColumn("k", fraction_k("_size", "fraction"))
    keys = [*groups, "fraction"]
    by = "_r" if tie_mode == "inclusive" else "_n"
    sides = {f"_in{s}": F.col(f"{by}{s}") <= F.col("k") for s in "ab"}
    ties = {f"_tied{s}": (F.col(f"_n{s}") == F.col("k")) & F.col(f"_even{s}") for s in "ab"}
    picked = checkpointed(each.withColumns({**sides, **ties}).filter("_ina or _inb").select(
        *keys, "chrom", "bin_i", "bin_j", "pair_id", "_size", "_ina", "_inb", "_tieda", "_tiedb"))
    top_a = picked.filter("_ina").withColumnRenamed("_tieda", "tied")
    top_b = picked.filter("_inb").withColumnRenamed("_tiedb", "tied")
    near = [*keys, "chrom"]

    def directed(top, other, name):
        hits = neighbour_match(top, other, near, tolerance, bin_size).groupBy(*keys).agg(F.count(F.lit(1)).alias(f"hits_{name}"))
        size = top.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"size_{name}"), F.max("tied").alias(f"{name}_tied"), F.max("_size").alias("_size"))
        return size.join(hits, keys, "left").fillna(0, [f"hits_{name}"])

    both = directed(top_a, top_b, "a").join(directed(top_b, top_a, "b").drop("_size"), keys)
    # neighbourhood sizes depend on the group only, not on the fraction: counted once per selected pair
    wanted = picked.select(*groups, "chrom", "bin_i", "bin_j").distinct()
    sizes = neighbour_count(wanted, cells, [*groups, "chrom"], tolerance, bin_size)

    def chance(top, other, name):
        at = [*groups, "chrom", "bin_i", "bin_j"]
        drawn = both.select(*keys, F.col(f"size_{other}").alias("_drawn"))
        return top.join(sizes, at).join(drawn, keys).groupBy(*keys).agg(
            F.avg(hypergeom_any("_size", "neighbours", "_drawn")).alias(f"chance_{name}"))

    out = both.join(chance(top_a, "b", "a"), keys).join(chance(top_b, "a", "b"), keys)
    overlap = (F.col("hits_a") / F.col("size_a") + F.col("hits_b") / F.col("size_b")) / 2
    mean_chance = (F.col("chance_a") + F.col("chance_b")) / 2
    return out.select(
        *keys, F.col("_size").alias("candidate_count"), overlap.alias("overlap"), mean_chance.alias("chance"),
        F.when(mean_chance > 0, overlap / mean_chance).alias("enrichment"), "a_tied", "b_tied",
    )


def median_over_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Medians over tiles and the number of tiles tied at the cutoff."""
    return rows.groupBy(*keys).agg(
        F.percentile("overlap", F.lit(0.5)).alias("overlap"),
        F.percentile("chance", F.lit(0.5)).alias("chance_overlap"),
        F.percentile("enrichment", F.lit(0.5)).alias("enrichment_over_chance"),
        F.count(F.lit(1)).alias("candidate_tile_count"),
        F.count_if(F.col("a_tied")).alias("score_a_cutoff_tied_tiles"),
        F.count_if(F.col("b_tied")).alias("score_b_cutoff_tied_tiles"),
    )


def reversed_topk_rows(df: DataFrame, groups: list[str], score: str, fractions: list[float], sums: list[str], row: str = "pair_id"):
    """Top shares of whole outputs where ties go to the LATER row: per fraction, k and the sums within the top.

    Each group's scores are cut into slices by a few edges near its cutoffs (from a quantile sketch, which need not be exact: any edges give the same
    result). Rows and sums per slice are counted in place, and only the slice that a cutoff falls in, ties and all, is ordered.
    """
    near = sorted({min(max(1.0 - f + step, 0.0), 1.0) for f in fractions for step in (-SLICE, 0.0, SLICE)})
    g = [F.col(c) for c in groups]
    # one short list a group
    edges = df.groupBy(*g).agg(F.percentile_approx(score, near, 2000).alias("_edges"), F.count(F.lit(1)).alias("candidates"), *[F.sum(s).alias(f"total_{s}") for s in sums])
    edges = checkpointed(edges.select(*[F.col(c).alias(f"__g_{c}") for c in groups], "_edges", "candidates", *[f"total_{s}" for s in sums]))

    def to_rows(rows: DataFrame, side: DataFrame) -> DataFrame:
        on = F.lit(True)
        for c in groups:
            on = on & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
        return rows.join(F.broadcast(side), on) if groups else rows.crossJoin(F.broadcast(side))

    # a null score is below all others
    sliced = to_rows(df, edges).withColumn("_slice", F.when(F.col(score).isNull(), -1).otherwise(F.size(F.filter("_edges", lambda e: e <= F.col(score)))))
    per = sliced.groupBy(*g, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.max("candidates").alias("candidates"), *[F.sum(s).alias(s) for s in sums], *[F.max(f"total_{s}").alias(f"total_{s}") for s in sums])
    down = W.partitionBy(*g).orderBy(F.col("_slice").desc()).rowsBetween(W.unboundedPreceding, 0)  # a few slices a group
    each = checkpointed(per.withColumn("_upto", F.sum("_n").over(down)).withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions]))).withColumn(
        "k", fraction_k("candidates", "fraction")).withColumn("_left", F.col("k") - F.col("_upto") + F.col("_n")).filter("_left > 0"))
    whole = each.filter("_left >= _n").select(*g, "fraction", *sums)
    cut = each.filter("_left < _n").select(*[F.col(c).alias(f"__g_{c}") for c in groups], F.col("_slice").alias("__slice"), "fraction", "_left")
    inside = to_rows(sliced.select(*g, *dict.fromkeys([score, row, *sums]), "_slice"), cut.drop("fraction", "_left").distinct()).filter(F.col("_slice") == F.col("__slice"))
    ranked = numbered(inside.select(*g, "_slice", *dict.fromkeys([score, row, *sums])), [*groups, "_slice"], [(score, True), (row, True)], "_r")
    part = to_rows(ranked, cut).filter((F.col("_slice") == F.col("__slice")) & (F.col("_r") <= F.col("_left"))).select(*g, "fraction", *sums)
    # sums of slices keep nulls as sums of rows do
    sizes = each.select(*g, "fraction", "k", "candidates", *[F.col(f"total_{s}") for s in sums]).distinct()
    top = whole.unionByName(part).groupBy(*g, "fraction").agg(*[F.sum(s).alias(f"top_{s}") for s in sums])
    renamed = top.withColumnsRenamed({c: f"__g_{c}" for c in groups}).withColumnRenamed("fraction", "__f")
    on = F.col("fraction") == F.col("__f")
    for c in groups:
        on = on & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    return sizes.join(F.broadcast(renamed), on).select(*g, "fraction", "k", "candidates", *[f"top_{s}" for s in sums], *[f"total_{s}" for s in sums])


def topk_capture(df: DataFrame, groups: list[str], score: str, observed: str, fractions: list[float], row: str = "pair_id") -> DataFrame:
    """Share of the observed total that the top share of pairs holds, and its enrichment over that share."""
    out = reversed_topk_rows(df, groups, score, fractions, [observed], row)
    share = F.when(F.col(f"total_{observed}") > 0, F.col(f"top_{observed}") / F.col(f"total_{observed}"))
    return out.select(
        *groups, "fraction", "k", "candidates", share.alias("capture"), (share / (F.col("k") / F.col("candidates"))).alias("enrichment")
    )


def topk_precision(df: DataFrame, groups: list[str], score: str, label: str, fractions=(0.01, 0.02, 0.05), row: str = "pair_id"):
    """Precision, recall and enrichment of the top shares for a 0/1 label."""
    out = reversed_topk_rows(df, groups, score, list(fractions), [label], row)
    precision = F.col(f"top_{label}") / F.col("k")
    prevalence = F.col(f"total_{label}") / F.col("candidates")
    return out.select(
        *groups, "fraction", "k", precision.alias("precision"),
        F.when(F.col(f"total_{label}") > 0, F.col(f"top_{label}") / F.col(f"total_{label}")).alias("recall"),
        F.when(prevalence > 0, precision / prevalence).alias("enrichment"),
    )


def topk_tie_aware(df: DataFrame, groups: list[str], score: str, label: str, fractions=(0.01, 0.02, 0.05)) -> DataFrame:
    """Expected positives in the top share when ties at the cutoff are drawn at random.

    Works on distinct scores, so heavy ties shrink the data before the sort.
    """
    distinct = df.groupBy(*groups, score).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_p"))
    run = running_totals(
        distinct, groups, [(score, True)], {"_cn": "_n", "_cp": "_p"}, {"candidates": "_n", "positives": "_p"}
    )
    each = run.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions])))
    each = each.withColumn("k", fraction_k("candidates", "fraction"))
    at_cut = each.filter((F.col("_cn") >= F.col("k")) & (F.col("_cn") - F.col("_n") < F.col("k")))
    expected = F.col("_cp") - F.col("_p") + (F.col("k") - F.col("_cn") + F.col("_n")) * (F.col("_p") / F.col("_n"))
    prevalence = F.col("positives") / F.col("candidates")
    return at_cut.select(
        *groups, "fraction", "k", F.col(score).alias("threshold"), F.col("_n").alias("tie_size"), expected.alias("expected_positives"),
        (expected / F.col("k")).alias("precision"),
        F.when(F.col("positives") > 0, expected / F.col("positives")).alias("recall"),
        F.when(prevalence > 0, expected / F.col("k") / prevalence).alias("enrichment"),
    )
