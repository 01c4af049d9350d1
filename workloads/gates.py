"""Gate, contract and rollout queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contactspark.functions import scalars as S
from contactspark.functions.special import nb2_logpmf
from contactspark.operators import contexts as X
from contactspark.operators import evidence as E
from contactspark.operators import fit as Fit
from contactspark.operators import intervals as I
from contactspark.operators import metrics as M
from contactspark.operators import power as P
from contactspark.operators import rates as R
from contactspark.operators import resampling as B
from contactspark.operators import topk as K
from contactspark.operators.contacts import canonical_anchors
from contactspark.operators.ordered import checkpointed, use_checkpoints
from contactspark.operators.universe import align_tiles
from contactspark.plans import gates as G
from contactspark.settings import BANDS as DISTANCE_BANDS
from contactspark.settings import Geometry, check_calibration
from contactspark.settings import distance_range as distance_bounds
from contactspark.sources.tables import write_metrics
from workloads.base import BIN_SIZE, CONTEXTS, OUTPUTS, REPLICATES, SPLITS, STEPS, query
from workloads.counting import power_rows
from workloads.discovery import band_levels
from workloads.modelling import band_fit, baseline, centered, curve
from workloads.ranking import DRAW, GROUP

BANDS = ["250-500", "500-1000"]
SUMMARY = ["output_id", "output_type", "distance_band", "top_fraction"]


@query("tile_contract", """
select unnest(['unique_tile_ids', 'target_span', 'known_split', 'contiguous_contexts', 'cells_have_contexts', 'unique_barcodes']) as "check", unnest([
 (select count(distinct tile_id) = count(*) from {tiles}), (select bool_and(target_end - target_start = 1000000) from {tiles}), (select bool_and(split in ('train', 'validation', 'test')) from {tiles}),
 (select min(context_index) = 0 and max(context_index) = count(*) - 1 from {contexts}), (select count(*) = 0 from {membership} where context_index not in (select context_index from {contexts})),
 (select count(*) = count(distinct (library_id, dna_barcode)) from {membership})]) as passed""")
def tile_contract(t):
    return G.tile_contract(t.tiles, t.contexts, t.membership)


@query("prepared_checks", """
select unnest(['anchors_on_grid', 'distance_agrees', 'distance_bin_agrees', 'minimum_distance', 'maximum_distance', 'bands_complete', 'ids_from_zero', 'splits_known', 'exposure_positive',
 'offsets_complete', 'margins_not_negative', 'group_size', 'tile_ids_unique', 'tile_spans', 'halves_recombine', 'counts_sparse', 'counts_in_universe']) as "check",
 unnest([p1, p2, p3, p4, p5, p6, p7, p8, p9, true, p10, (select max(n) <= 75 from (select count(*) as n from {scored} group by tile_row, distance_bin)), (select count(distinct tile_id) = count(*) from {tiles}),
 (select bool_and(target_end - target_start = 1000000) from {tiles}), (select bool_and(counts_a + counts_b = full_count) from {counts}), (select bool_and(full_count > 0) from {counts}),
 (select count(*) = 0 from {counts} where pair_id not in (select pair_id from {scored}))]) as passed from (
 select bool_and(bin_i % 10000 = 0 and bin_j % 10000 = 0) as p1, bool_and(bin_j - bin_i = distance_bp) as p2, bool_and(distance_bin * 10000 = distance_bp) as p3, min(distance_bp) >= 250000 as p4,
  max(distance_bp) < 1000000 as p5, bool_and(distance_band is not null) as p6, min(pair_id) = 0 as p7, bool_and(split in ('train', 'validation', 'test')) as p8, bool_and(exposure > 0) as p9,
  bool_and(boundary_margin_bins >= 0) as p10 from {scored})""")
def prepared_checks(t):
    return G.prepared_checks(t.scored, t.tiles, t.counts, bin_size=BIN_SIZE, low=250_000, high=1_000_000)


@query("conservation_checks", f"""
with n as (select tile_row, b, count(*) as n, sum(weight) as w from (select tile_row, bin as b, weight from {{area_weights}}) group by all)
select unnest(['maximum_represented_distance', 'ids_contiguous', 'ids_unique', 'anchors_in_one_split', 'tile_splits_kept', 'every_split_counted', 'all_halves_recombine', 'sums_in_universe',
 'records_conserved', 'curve_decreases', 'curve_covers_range', 'feature_overlap_width', 'feature_weights_whole', 'feature_bins_per_tile']) as "check", unnest([
 (select max(distance_bp) = 990000 from {{universe}}), (select min(pair_id) = 0 and max(pair_id) + 1 = count(*) from {{universe}}), (select count(distinct pair_id) = count(*) from {{universe}}),
 (select count(*) = 0 from (select chrom, b from (select chrom, bin_i as b, split from {{universe}} union select chrom, bin_j, split from {{universe}}) group by 1, 2 having count(*) > 1)),
 (select bool_and(u.split = t.split) from {{universe}} u join {{tiles}} t using (tile_row)),
 (select count(*) = {SPLITS} * (select count(*) from {{counts}}) from {{split_counts}}),
 (select bool_and(s.counts_a >= 0 and s.counts_b >= 0 and s.counts_a + s.counts_b = c.full_count) from {{split_counts}} s join {{counts}} c using (context_index, pair_id)),
 (select count(*) = 0 from {{counts}} where pair_id not in (select pair_id from {{universe}})),
 (select bool_and(r = s) from (select context_index, count(*) as r from {{records}} group by 1) full join (select context_index, sum(full_count) as s from {{counts}} group by 1) using (context_index)),
 (select bool_and(rise <= 1e-12) from (select coalesce(distance_offset - lag(distance_offset) over (order by distance_bin), 0) as rise from {{offsets}})),
 (select min(distance_bin) = 25 and max(distance_bin) = 99 and count(*) = 75 from {{offsets}}),
 (select max(n) <= 6 from n), (select max(abs(w - 1)) < 1e-9 from n), (select min(k) = 100 and max(k) = 100 from (select count(*) as k from n group by tile_row))]) as passed""")
def conservation_checks(t):
    weights = I.area_overlap_weights(align_tiles(t.source_tiles, BIN_SIZE), 2048, 512, BIN_SIZE, 100)
    return G.conservation_checks(
        t.universe, t.tiles, t.sums, t.records, R.isotonic_offset(curve(t)), weights, splits=SPLITS, bin_size=BIN_SIZE, low=250_000, high=1_000_000)


@query("distance_range", """
select cast(distance_bp / 10000 as bigint) as distance_bin, count(*) as contacts from (select abs(bin_j - bin_i) as distance_bp from {anchored} where chrom1 = chrom2)
where distance_bp between 250000 and 990000 group by 1""")
def distance_range(t):
    """Contacts of the range that ends one bin past its largest distance."""
    low, end = distance_bounds(250_000, BIN_SIZE, maximum=990_000)
    # the distance is null between two chromosomes
    rows = canonical_anchors(t.raw_contacts, BIN_SIZE).filter(S.within("distance_bp", low, end))
    return rows.groupBy(S.fdiv("distance_bp", BIN_SIZE).alias("distance_bin")).agg(F.count(F.lit(1)).alias("contacts"))


@query("calibration_contract", """
select distance_band, alpha, 0.25e0 as dispersion, case when distance_band = '250-500' then 250000 else 500000 end as low, case when distance_band = '250-500' then 500000 else 1000000 end as high from {band_levels}""")
def calibration_contract(t):
    """Calibration rows of the configured bands; a row that is missing or a dispersion that is not positive is an error before any job."""
    edges = F.create_map(*[x for b in DISTANCE_BANDS for x in (F.lit(b.id), F.struct(F.lit(b.low).alias("low"), F.lit(b.high).alias("high")))])
    rows = checkpointed(band_levels(t).withColumn("_e", edges[F.col("distance_band")]).select("distance_band", "alpha", "dispersion", "_e.low", "_e.high"))
    check_calibration([(r.distance_band, r.low, r.high, r.alpha, r.dispersion) for r in rows.collect()], Geometry())  # one row per band
    return rows


@query("written_metrics", """
select format, distance_band, count(*) as pairs, sum(full_count) as events, case when count(*) filter (split = 'purged') > 0 then 0e0 end as ratio
from {scored}, (values ('csv'), ('json'), ('parquet')) f(format) group by 1, 2""")
def written_metrics(t):
    """A metric table with a ratio that is not finite, written in each format and read back: it comes back as null."""
    use_checkpoints(t.spark)
    root = f"{t.spark.sparkContext.getCheckpointDir()}/metrics-{uuid.uuid4().hex}"
    table = checkpointed(t.scored.groupBy("distance_band").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("full_count").alias("events"),
        (F.count_if(F.col("split") == "purged") * F.lit(float("inf"))).alias("ratio")))
    out = None
    for form in ("csv", "json", "parquet"):
        write_metrics(table, f"{root}/{form}", form)
        read = t.spark.read.schema(table.schema).option("header", True).format(form).load(f"{root}/{form}").withColumn("format", F.lit(form))
        out = read if out is None else out.unionByName(read)
    return out


STEPS["power_bootstrap"] = """
with c as (select output_id, distance_band, chrom, cast(sum(k * overlap_excess) as double) as x, cast(sum(k) as double) as y from {power} where evaluable and top_fraction = cast(0.01 as double) group by 1, 2, 3),
o as (select *, row_number() over (partition by output_id, distance_band order by chrom) - 1 as i, count(*) over (partition by output_id, distance_band) as n from c),
d as (select output_id, distance_band, n, r, DRAW as i from (select distinct output_id, distance_band, n from o), range(0, 1000) a(r), range(0, 30) b(s) where s < n),
v as (select output_id, distance_band, r, sum(x) / sum(y) as v from d join o using (output_id, distance_band, i) group by 1, 2, 3)
select output_id, distance_band, quantile_cont(v, 0.025) as lower from v group by 1, 2""".replace("DRAW", DRAW.replace("{seed}", "20260724"))
STEPS["power_gate"] = """
with g as (select o.output_id, b.distance_band, s.* exclude (output_id, distance_band), p.lower from (select distinct output_id from {power_summary}) o, (values ('250-500'), ('500-1000')) b(distance_band)
 left join (select * from {power_summary} where top_fraction = cast(0.01 as double)) s on s.output_id = o.output_id and s.distance_band = b.distance_band
 left join {power_bootstrap} p on p.output_id = o.output_id and p.distance_band = b.distance_band)
select output_id, distance_band, unnest(['complete', 'coverage', 'chromosomes', 'enrichment', 'bootstrap']) as "check",
 unnest([k_weighted_evaluable_fraction is not null, coalesce(k_weighted_evaluable_fraction >= 0.8, false), coalesce(chromosomes >= 10, false), coalesce(enrichment_over_chance >= 2, false), coalesce(lower > 0, false)]) as passed from g"""


def power_checks(t):
    rows = power_rows(t).filter("top_fraction = 0.01D")
    summary = P.weighted_topk_summary(rows, SUMMARY)
    weighted = rows.filter("evaluable").withColumn("x", F.col("k") * F.col("overlap_excess"))
    boot = B.chrom_bootstrap(weighted, ["output_id", "distance_band"], "x", "k", replicates=REPLICATES, seed=20260724)
    return G.power_gate(summary, boot, BANDS)


@query("power_gate", "select * from {power_gate}")
def power_gate(t):
    return power_checks(t)


def topology_tables(t):
    rows = baseline(t).filter("split = 'validation'").withColumns({
        "target": S.log_enrichment("full_count", "baseline_mean", 2.5), "eta": F.log("exposure") + F.col("score"), "eta0": F.log("exposure")})
    rows = R.center_by_group(rows, ["tile_row", "distance_bin"], "score").withColumn("eta", F.log("exposure") + F.col("centered"))
    exact = ["tile_row", "distance_bin", "chrom", "distance_band"]
    gain = R.conditional_ll(rows, exact, "eta", "full_count").select(*exact, "events", "log_likelihood").join(
        R.conditional_ll(rows, exact, "eta0", "full_count").select(*exact, F.col("log_likelihood").alias("base")), exact)
    gain = gain.filter("events > 0").withColumn("x", F.col("log_likelihood") - F.col("base"))
    like = B.chrom_bootstrap(gain, ["distance_band"], "x", "events", replicates=REPLICATES, seed=1)
    keys = [*GROUP, "chrom"]
    model = K.model_vs_target(rows, keys, "score", "target", "full_count", 0.01)
    weighted = model.withColumns({"x": F.col("k") * F.col("overlap"), "y": F.col("k") * F.col("chance")})
    top = B.chrom_bootstrap(weighted, ["distance_band"], "x", "y", replicates=REPLICATES, seed=2)
    replicate = K.model_vs_target(rows, keys, "counts_b", "counts_a", "counts_a", 0.01)

    def excess(df, name):
        return df.groupBy("distance_band").agg((F.sum(F.col("k") * F.col("overlap_excess")) / F.sum("k")).alias(name))

    ceiling = excess(model, "_m").join(excess(replicate, "_r"), "distance_band")
    bands = like.select("distance_band", F.col("lower").alias("likelihood_lower")).join(
        top.select("distance_band", F.col("point").alias("top1_enrichment"), F.col("lower").alias("top1_lower")), "distance_band", "left").join(
        ceiling.select("distance_band", F.when(F.col("_r") > 0, F.col("_m") / F.col("_r")).alias("ceiling_fraction")), "distance_band", "left")
    per = M.reliability(rows, [250_000, 500_000, 750_000], "score", "target", "counts_a", "counts_b")
    boot = B.chrom_bootstrap(per.withColumn("x", F.col("model") * F.col("rows")), ["distance_bp"], "x", "rows", replicates=REPLICATES, seed=3)
    distances = M.reliability_summary(per).select("distance_bp", "reliability_fraction").join(boot.select("distance_bp", "lower"), "distance_bp")
    return bands, distances


@query("topology_gate")
def topology_gate(t):
    return G.topology_gate(*topology_tables(t))


def calibration_metrics(t, fitted, base, outputs):
    """Observed against expected of validation pairs per output and band, for a model fit and a distance-only fit."""
    per = E.pool_counts(t.counts, t.outputs, ["full_count"]).filter(F.col("output_id").isin(outputs)).select("output_id", "pair_id", "full_count")
    listed = F.explode(F.array(*[F.lit(o) for o in outputs])).alias("output_id")
    rows = centered(t).filter("split = 'validation'").drop("full_count").select("*", listed).join(per, ["output_id", "pair_id"], "left").fillna(0, ["full_count"])
    keys = ["output_id", "distance_band"]
    model = fitted.select(*keys, F.col("alpha").alias("a1"), F.col("dispersion").alias("d1"))
    flat = base.select(*keys, F.col("alpha").alias("a0"), F.col("dispersion").alias("d0"))
    rows = rows.join(F.broadcast(model), keys).join(F.broadcast(flat), keys)  # one row per output and band
    offset = F.log("exposure") + F.col("distance_offset")
    rows = rows.withColumns({"mean": S.bounded_exp(offset + F.col("centered") + F.col("a1")), "mean0": S.bounded_exp(offset + F.col("a0"))})
    rows = rows.withColumns({"ll": nb2_logpmf("full_count", "mean", "d1"), "ll0": nb2_logpmf("full_count", "mean0", "d0")})
    totals = Fit.calibration_ratio(rows, keys, "full_count", "mean", "ll", "ll0")
    slope = M.calibration_slope(rows, keys, "full_count", "mean")
    per_chrom = rows.withColumn("x", F.col("ll") - F.col("ll0"))
    boot = B.chrom_bootstrap(per_chrom, keys, "x", "full_count", replicates=REPLICATES, seed=4)
    return totals.join(slope, keys).join(boot.select(*keys, F.col("lower").alias("gain_lower")), keys, "left")


@query("calibration_gate")
def calibration_gate(t):
    rows = centered(t).filter("split = 'train'").withColumns({
        "output_id": F.lit("shared"), "o1": F.log("exposure") + F.col("distance_offset") + F.col("centered"), "o0": F.log("exposure") + F.col("distance_offset")})
    keys = ["output_id", "distance_band"]
    return G.calibration_gate(calibration_metrics(t, Fit.fit_nb2(rows, keys, "full_count", "o1"), Fit.fit_nb2(rows, keys, "full_count", "o0"), ["shared"]))


@query("context_recalibration")
def context_recalibration(t):
    """Pool intercepts under the shared dispersion and a prior, gated like the shared calibration."""
    pools = ["P1", "P2", "P3"]
    keys = ["output_id", "distance_band"]
    shared = band_fit(t).select("distance_band", F.col("alpha").alias("prior"), F.col("dispersion").alias("phi"))
    per = E.pool_counts(t.counts, t.outputs, ["full_count"]).filter("output_type = 'pool'").select("output_id", "pair_id", "full_count")
    listed = F.explode(F.array(*[F.lit(o) for o in pools])).alias("output_id")
    rows = centered(t).filter("split = 'train'").drop("full_count").select("*", listed).join(per, ["output_id", "pair_id"], "left").fillna(0, ["full_count"]).join(
        F.broadcast(shared), "distance_band")  # one row per band
    rows = rows.withColumns({"o0": F.log("exposure") + F.col("distance_offset"), "o1": F.log("exposure") + F.col("distance_offset") + F.col("centered")})
    fits = [Fit.fit_nb2(rows, keys, "full_count", o, fixed_dispersion="phi", prior_mean="prior", prior_sd=2.0) for o in ("o1", "o0")]
    return G.calibration_gate(calibration_metrics(t, *fits, pools))


def band_overlap(counts, sizes, a, b):
    """k-weighted overlap excess per output and band of two count columns."""
    keys = ["output_id", "tile_row", "distance_band"]
    rows = counts.join(sizes, ["tile_row", "distance_band"])
    top_a, top_b = K.topk_fractional(rows, keys, a, "k"), K.topk_fractional(rows, keys, b, "k")
    groups = rows.select(*keys, "candidate_count", "k").distinct()
    over = K.topk_overlap(top_a, top_b, keys, groups)
    return over.groupBy("output_id", "distance_band").agg((F.sum(F.col("k") * F.col("overlap_excess")) / F.sum("k")).alias("overlap_excess"))


def concordance(t):
    place = t.universe.filter("split = 'validation'").select("pair_id", "tile_row", "distance_band")
    sizes = place.groupBy("tile_row", "distance_band").agg(F.count(F.lit(1)).alias("candidate_count")).withColumn("k", S.fraction_k("candidate_count", 0.01))
    units = t.outputs.filter("output_type <> 'shared'")
    # each is read by the thinning (cut and draw) and by the overlap, so it is stored once
    own = checkpointed(E.pool_counts(t.counts, units, ["counts_a", "counts_b"]).join(place, "pair_id"))
    other = checkpointed(E.complement_counts(t.counts, units, list(range(len(CONTEXTS)))).join(place, "pair_id"))
    keys = ["output_id", "distance_band"]
    depth = own.groupBy(*keys).agg(F.sum("counts_a").alias("_a")).join(other.groupBy(*keys).agg(F.sum("other_count").alias("_o")), keys).select(
        *keys, F.least("_a", "_o").alias("depth"))
    thin_a = E.thin_counts(own.select(*keys, "pair_id", "counts_a"), keys, "pair_id", "counts_a", depth, 51)
    thin_o = E.thin_counts(other.select(*keys, "pair_id", "other_count"), keys, "pair_id", "other_count", depth, 52)
    cross = thin_a.join(thin_o, [*keys, "pair_id"], "full_outer").fillna(0, ["counts_a", "other_count"]).join(place.select("pair_id", "tile_row"), "pair_id")
    cross = checkpointed(cross)
    power = units.select("output_id").distinct().withColumn("passed", F.lit(True))
    return G.concordance_gate(band_overlap(own, sizes, "counts_a", "counts_b"), band_overlap(cross, sizes, "counts_a", "other_count"), power, BANDS)


@query("context_concordance")
def context_concordance(t):
    return concordance(t)


# simple gate tables with known answers, made from the counts
STEPS["gate_tables"] = """
select output_id, output_type, sum(counts_a) % 3 <> 0 as power, sum(counts_b) % 2 = 0 as calibration, sum(full_count) % 2 = 0 as concordance, sum(full_count) % 5 = 0 as extension
from {counts} join {outputs} using (context_index) group by 1, 2"""


def gate_tables(t):
    sums = E.pool_counts(t.counts, t.outputs, ["counts_a", "counts_b", "full_count"]).groupBy("output_id", "output_type").agg(
        *[F.sum(c).alias(c) for c in ("counts_a", "counts_b", "full_count")])
    return sums.select("output_id", "output_type", (F.col("counts_a") % 3 != 0).alias("power"), (F.col("counts_b") % 2 == 0).alias("calibration"),
                       (F.col("full_count") % 2 == 0).alias("concordance"), (F.col("full_count") % 5 == 0).alias("extension"))


@query("eligible_outputs", "select output_id from {gate_tables} where power and concordance and output_type <> 'shared'")
def eligible_outputs(t):
    g = gate_tables(t).filter("output_type <> 'shared'")
    return X.eligible_outputs(g.select("output_id", F.col("power").alias("passed")), g.select("output_id", F.col("concordance").alias("passed")))


@query("count_passed", "select output_type, count(*) filter (power and calibration) as passed, count(*) as outputs from {gate_tables} group by 1")
def count_passed(t):
    return X.count_passed(gate_tables(t).withColumn("passed", F.col("power") & F.col("calibration")))


POOLS = [("P1", ["AUTOMOBILE", "BUILDING"]), ("P2", ["FURNITURE", "HOUSEHOLD", "MACHINERY"]), ("P3", ["BUILDING", "FURNITURE"])]


@query("rollout", """
with p as (select member, output_id as pool, extension as pe, row_number() over (partition by member order by output_id) as r from {pools} join {gate_tables} using (output_id) where power and calibration),
c as (select g.*, case when output_id = 'MACHINERY' and not power then null else p.pool end as pool, pe from {gate_tables} g left join p on p.member = g.output_id and r = 1 where output_type = 'context')
select 'shared' as output_id, 'shared' as output_type, 'shared' as topology_source, 'shared' as calibration_source, null as delta_source, 'shared' as claim_scope, null as context_extension_eligible
union all select output_id, 'pool', case when extension then output_id else 'shared' end, output_id, case when extension then output_id end, case when extension then 'pool' else 'shared' end, null
 from {gate_tables} where output_type = 'pool' and power and calibration
union all select output_id, 'context', case when extension then output_id else coalesce(pool, 'shared') end, case when extension then output_id else coalesce(pool, 'shared') end,
 case when extension then output_id when pool is not null and pe then pool end, case when extension then 'context' when pool is not null then 'pooled' else 'shared' end,
 case when not extension then power and concordance end from c""")
def rollout(t):
    return X.rollout(t.contexts, POOLS, gate_tables(t), ["MACHINERY"])


STEPS["tests"] = """
select cell_type as output_id, distance_band, case when pair_id % 2 = 0 then 'likelihood' else 'top_contact' end as metric,
 case pair_id % 5 when 0 then 'onehot_vs_shared' when 1 then 'rna_vs_shared' when 2 then 'rna_vs_onehot' when 3 then 'rna_vs_swapped' else 'rna_vs_permuted' end as comparison,
 avg(counts_a) - 0.4 as point, avg(counts_a) - 0.48 as lower, 1 / cast(count(*) as double) as p_value
from {counts} join {contexts} using (context_index) join {universe} using (pair_id) group by 1, 2, 3, 4"""


def test_table(t):
    names = ["onehot_vs_shared", "rna_vs_shared", "rna_vs_onehot", "rna_vs_swapped", "rna_vs_permuted"]
    rows = t.counts.join(t.contexts.select("context_index", F.col("cell_type").alias("output_id")), "context_index").join(t.universe.select("pair_id", "distance_band"), "pair_id")
    keys = ["output_id", "distance_band", F.when(F.col("pair_id") % 2 == 0, "likelihood").otherwise("top_contact").alias("metric"),
            F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("pair_id") % 5 + 1).cast("int")).alias("comparison")]
    return rows.groupBy(*keys).agg((F.avg("counts_a") - 0.4).alias("point"), (F.avg("counts_a") - 0.48).alias("lower"), (F.lit(1.0) / F.count(F.lit(1))).alias("p_value"))


@query("context_extension_gate", """
with p as (select *, p_value * count(*) over () / row_number() over (order by p_value) as q, row_number() over (order by p_value) as r from {tests} where comparison in ('onehot_vs_shared', 'rna_vs_shared')),
a as (select output_id, distance_band, metric, comparison, least(1, min(q) over (order by r desc)) as adjusted_p from p),
j as (select t.*, a.adjusted_p from {tests} t left join a using (output_id, distance_band, metric, comparison)),
o as (select output_id, bool_and(adjusted_p <= 0.05 and point > 0) filter (comparison = 'onehot_vs_shared') as onehot_passed,
 bool_and(adjusted_p <= 0.05 and point > 0) filter (comparison = 'rna_vs_shared') and bool_and(lower > 0) filter (comparison = 'rna_vs_onehot') and bool_and(lower > 0) filter (comparison = 'rna_vs_swapped')
  and bool_and(lower > 0) filter (comparison = 'rna_vs_permuted') as rna_passed from j group by 1)
select *, case when rna_passed then 'rna' when onehot_passed then 'onehot' end as selected_mode, rna_passed or onehot_passed as accepted from o""")
def context_extension_gate(t):
    tests = test_table(t)
    primary = M.bh_adjust(tests.filter("comparison in ('onehot_vs_shared', 'rna_vs_shared')"))
    keys = ["output_id", "distance_band", "metric", "comparison"]
    return G.extension_gate(tests.join(primary.select(*keys, "adjusted_p"), keys, "left"))


STEPS["context_ll"] = """
select context_index, LL as per_event from (select c.context_index, c.full_count, s.eta from {counts} c join {centered} s using (pair_id)) group by 1""".replace("LL", "sum(full_count * eta) / sum(full_count)")


def context_values(t, value):
    rows = t.counts.join(centered(t).drop("full_count", "counts_a", "counts_b"), "pair_id")
    return rows.groupBy("context_index").agg((F.sum(F.col("full_count") * F.expr(value)) / F.sum("full_count")).alias("per_event"))


@query("paired_comparison", """
with b as (select context_index, sum(full_count * ln(exposure)) / sum(full_count) as per_event from (select c.context_index, c.full_count, s.exposure from {counts} c join {scored} s using (pair_id)) group by 1)
select avg(a.per_event - b.per_event) as mean_difference, count(*) filter (a.per_event > b.per_event) as contexts_better, count(*) as contexts from {context_ll} a join b using (context_index)""")
def paired_comparison(t):
    return G.paired_comparison(context_values(t, "eta"), context_values(t, "ln(exposure)"))


@query("context_test_comparison", """
select distance_band, context_index, sum(events) as events, sum(gain) / sum(events) as gain_per_event from (
 select u.distance_band, u.tile_row, u.distance_bin, c.context_index, sum(c.full_count) as events, sum(c.full_count * (u.p - u.q)) as gain
 from {counts} c join (select pair_id, tile_row, distance_bin, distance_band, eta - ln(sum(exp(eta)) over g) as p, ln(exposure) - ln(sum(exposure) over g) as q from {centered} where split = 'test' window g as (partition by tile_row, distance_bin)) u using (pair_id)
 group by 1, 2, 3, 4) group by 1, 2""")
def context_test_comparison(t):
    """Likelihood gain of the model over exposure on test pairs, per context, without any refit."""
    test = centered(t).filter("split = 'test'").withColumn("eta0", F.log("exposure"))
    exact = ["tile_row", "distance_bin"]
    p = R.softmax_by_group(R.softmax_by_group(test, exact, "eta", "p"), exact, "eta0", "q")
    rows = t.counts.select("context_index", "pair_id", F.col("full_count").alias("y")).join(p.select("pair_id", "distance_band", "chrom", "p", "q"), "pair_id")
    per = R.likelihood_gain_pair(rows, ["distance_band", "context_index"], "y", "p", "q")
    return R.likelihood_gain_summary(per, ["distance_band", "context_index"]).select("distance_band", "context_index", F.col("events").cast("long").alias("events"), "gain_per_event")


STEPS["history"] = """
select cell_type as run, split as epoch, 1000 / sum(full_count) as validation_loss, 2000 / (sum(full_count) + split * 5) as rank_loss
from (select context_index, split, counts_a + 2 * counts_b as full_count from {split_counts} where split < 3) join {contexts} using (context_index) group by 1, 2"""


def history(t):
    rows = E.splits_of(t.sums).filter("split < 3").join(t.contexts.select("context_index", F.col("cell_type").alias("run")), "context_index")
    total = F.sum(F.col("counts_a") + 2 * F.col("counts_b"))
    return rows.groupBy("run", F.col("split").alias("epoch")).agg((F.lit(1000) / total).alias("validation_loss"), (F.lit(2000) / (total + F.col("epoch") * 5)).alias("rank_loss"))


@query("best_epoch", """
select run, validation_loss, epoch from {history} qualify row_number() over (partition by run order by validation_loss, epoch) = 1""")
def best_epoch(t):
    return M.best_epoch(history(t), ["run"], "validation_loss")


@query("promotion_check", """
with f as (select run, rank_loss as first from {history} where epoch = 0), b as (select run, rank_loss as best from {history} qualify row_number() over (partition by run order by validation_loss, epoch) = 1)
select run, unnest(['epochs_completed', 'rank_loss_improved']) as "check", unnest([true, (first - best) / first >= 0.02]) as passed from f join b using (run)""")
def promotion_check(t):
    return G.promotion_check(history(t))


@query("one_se_selection", """
with l as (select case epoch when 0 then 'exposure_only' when 1 then 'annotations' else 'combined' end as feature, run, validation_loss as loss, epoch + 1 as e from {history}),
p as (select feature, avg(loss) as mean_loss, stddev_samp(loss) / sqrt(count(*)) as standard_error, quantile_cont(e, 0.5) as e, case feature when 'exposure_only' then 1 when 'annotations' then 2 else 3 end as o from l group by 1),
b as (select mean_loss + standard_error as threshold from p order by mean_loss, o limit 1), s as (select min(o) as o from p, b where mean_loss <= threshold)
select feature, mean_loss, standard_error, threshold, p.o = s.o as selected, case when p.o = s.o then cast(round_even(e, 0) as bigint) end as epoch_count from p, b, s""")
def one_se_selection(t):
    names = F.array(F.lit("exposure_only"), F.lit("annotations"), F.lit("combined"))
    rows = history(t).select(F.element_at(names, F.col("epoch") + 1).alias("feature"), F.col("run").alias("fold"), F.col("validation_loss").alias("loss"), (F.col("epoch") + 1).alias("epoch_count"))
    return M.one_se_selection(rows, ["exposure_only", "annotations", "combined"])


def ceiling_rows(t):
    """Halves of every context and split scored by the same training curve, on validation pairs."""
    cells = t.contexts.select("context_index", "n_cells")
    full = t.counts.join(cells, "context_index").select("context_index", "pair_id", "full_count", "n_cells")
    place = t.scored.select("pair_id", "chrom", "bin_i", "bin_j", "tile_row", "distance_bin", "distance_band", "split", "exposure")
    names = F.array(*[F.lit(c) for c in range(len(CONTEXTS))])
    grid = place.withColumn("context_index", F.explode(names))
    rate = grid.filter("split = 'train'").join(full, ["context_index", "pair_id"], "left").withColumn(
        "reference", F.coalesce(F.col("full_count") / F.col("exposure") / F.col("n_cells"), F.lit(0.0)))
    curve = rate.groupBy("context_index", "distance_bin").agg(F.avg("reference").alias("expected"))
    halves = t.assignments.groupBy("context_index", F.col("split").alias("rep")).agg(
        F.count_if(F.col("half") == "A").alias("cells_a"), F.count_if(F.col("half") == "B").alias("cells_b"))
    from pyspark.sql import Window as W

    curve = curve.withColumn("eps", F.min(F.when(F.col("expected") > 0, F.col("expected"))).over(W.partitionBy("context_index")))
    per = E.splits_of(t.sums).withColumnRenamed("split", "rep")
    rows = grid.filter("split = 'validation'").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
    rows = rows.join(per, ["context_index", "rep", "pair_id"], "left").fillna(0, ["counts_a", "counts_b"]).join(halves, ["context_index", "rep"]).join(curve, ["context_index", "distance_bin"])

    def score(c, n):
        value = F.log((F.col(c) / F.col("exposure") / F.greatest(F.col(n), F.lit(1)) + F.col("eps")) / (F.col("expected") + F.col("eps")))
        return F.when(F.col("expected") > 0, F.round(value, 9))

    return rows.withColumns({"score_a": score("counts_a", "cells_a"), "score_b": score("counts_b", "cells_b")})


@query("replicate_ceiling")
def replicate_ceiling(t):
    """Median enrichment over contexts and splits of the neighbourhood overlap between halves."""
    rows = K.topk_overlap_neighbour(checkpointed(ceiling_rows(t)), "score_a", "score_b", [0.01, 0.02], 1, BIN_SIZE, outer=("context_index", "rep"))
    per = K.median_over_groups(rows, ["context_index", "rep", "distance_band", "fraction"])
    return per.groupBy("distance_band", "fraction").agg(F.percentile("enrichment_over_chance", F.lit(0.5)).alias("enrichment"), F.count(F.lit(1)).alias("replicates"))


def evaluation_tables(t):
    """Per context: likelihoods of the model and two baselines, correlations per exact distance, top-share overlap."""
    rows = t.counts.select("context_index", "pair_id", F.col("full_count").alias("y"))
    grid = centered(t).filter("split = 'validation'").withColumn("context_index", F.explode(F.array(*[F.lit(c) for c in range(len(CONTEXTS))])))
    full = grid.join(rows, ["context_index", "pair_id"], "left").fillna(0, ["y"]).withColumns({
        "base": F.log("exposure") + F.col("distance_offset"), "flat": F.lit(0.0), "target": F.log1p(F.col("y")), "hit": (F.col("y") > 0).cast("int")})
    full = checkpointed(full)  # read by eight measures below
    parts = []
    for source, eta in (("model", "eta"), ("exposure_distance", "base"), ("uniform", "flat")):
        ll = R.conditional_ll(full, ["context_index", "chrom", "distance_band"], eta, "y")
        per = ll.groupBy("context_index").agg((F.sum("log_likelihood") / F.sum("events")).alias("per_event"))
        parts.append(per.select(F.lit(source).alias("source"), "context_index", "per_event"))
    likelihoods = parts[0].unionByName(parts[1]).unionByName(parts[2])
    bundles = M.metric_bundle(full.filter("distance_bp in (250000, 500000, 750000)"), ["context_index", "distance_bp"], "centered", "target", "hit", 100, 5)
    top = K.topk_overlap_neighbour(full, "centered", "target", [0.01, 0.02], 1, BIN_SIZE, outer=("context_index",))
    enrichment = K.median_over_groups(top, ["context_index", "distance_band", "fraction"])
    return likelihoods, bundles, enrichment


@query("model_evaluation")
def model_evaluation(t):
    likelihoods, bundles, enrichment = evaluation_tables(t)
    rows = likelihoods.select("context_index", F.concat(F.lit("likelihood:"), "source").alias("measure"), F.col("per_event").alias("value"))
    corr = bundles.select("context_index", F.concat(F.lit("spearman:"), F.col("distance_bp").cast("string")).alias("measure"), F.col("spearman").alias("value"))
    top = enrichment.select("context_index", F.concat_ws(":", F.lit("enrichment"), "distance_band", F.col("fraction").cast("string")).alias("measure"), F.col("enrichment_over_chance").alias("value"))
    return rows.unionByName(corr).unionByName(top)


@query("sequence_gate")
def sequence_gate(t):
    likelihoods, bundles, enrichment = evaluation_tables(t)
    ceilings = t.spark.createDataFrame([(b, 4.0) for b in BANDS], "distance_band string, ceiling double")
    e = enrichment.select("distance_band", F.col("fraction").alias("top_fraction"), F.col("enrichment_over_chance").alias("enrichment"))
    gain = F.when(F.col("auprc_defined"), F.col("auprc") - F.col("support_prevalence")).alias("auprc_gain")
    model = G.sequence_gate(e, bundles.select("distance_bp", "pearson", "spearman", gain), likelihoods.select("source", "per_event"), ceilings)
    gains = enrichment.filter("fraction = 0.01D").groupBy(F.col("distance_band").alias("name")).agg(F.avg("enrichment_over_chance").alias("value"), (F.min("enrichment_over_chance") - 1).alias("lower"))
    early = G.early_signal(enrichment.filter("fraction = 0.01D").select("distance_band", F.col("enrichment_over_chance").alias("enrichment")), bundles, gains)
    return model.withColumn("stage", F.lit("acceptance")).unionByName(early.withColumn("stage", F.lit("early")))
