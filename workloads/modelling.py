"""Distance curves, likelihoods, count-model fits, control sampling and their losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactspark.functions import scalars as S
from contactspark.functions.special import nb2_logpmf
from contactspark.operators import evidence as E
from contactspark.operators import fit as Fit
from contactspark.operators import metrics as M
from contactspark.operators import rates as R
from contactspark.operators import sampling as X
from workloads.base import CONTEXTS, STEPS, drawn, query

STEPS["curve"] = """
select distance_bin, cast(sum(full_count) as bigint) as event_count, sum(exposure) * 5 as exposure_opportunity,
 ln((sum(full_count) + 0.5) / (sum(exposure) * 5 + 0.5)) as raw_log_rate from {scored} where split = 'train' and exposure > 0 group by 1"""


def curve(t):
    return R.distance_curve(t.scored.drop("full_count"), t.counts, len(CONTEXTS))


@query("distance_curve", "select * from {curve}")
def distance_curve(t):
    return curve(t)


# decreasing fit by its closed form: the smallest, over starts, of the largest mean to any end
STEPS["offsets"] = """
with w as (select *, greatest(exposure_opportunity, 1) as w from {curve}),
m as (select a.distance_bin as lo, b.distance_bin as hi, (select sum(w * raw_log_rate) / sum(w) from w where distance_bin between a.distance_bin and b.distance_bin) as v from w a join w b on a.distance_bin <= b.distance_bin),
f as (select w.*, (select min(best) from (select lo, max(v) as best from m where lo <= w.distance_bin and hi >= w.distance_bin group by lo)) as fit from w)
select distance_bin, event_count, exposure_opportunity, raw_log_rate, fit - ln(sum(w * exp(fit)) over () / sum(w) over ()) as distance_offset,
 ln(sum(w * exp(fit)) over () / sum(w) over ()) as normalization_log_rate from f"""


@query("isotonic_offset", "select * from {offsets}")
def isotonic_offset(t):
    return R.isotonic_offset(curve(t))


@query("fixed_oe", """
with e as (select distance_bin, avg(full_count / exposure) as expected from {scored} where split = 'train' group by 1),
f as (select *, min(case when expected > 0 then expected end) over () as eps from e)
select pair_id, expected, case when expected > 0 then ln((counts_a / exposure + eps) / (expected + eps)) end as oe from {scored} left join f using (distance_bin) where split = 'validation'""")
def fixed_oe(t):
    rows = t.scored.withColumns({"a": F.col("counts_a") / F.col("exposure"), "r": F.col("full_count") / F.col("exposure")})
    return R.fixed_oe(rows, [], "a", "r").filter("split = 'validation'").select("pair_id", "expected", "oe")


@query("simple_oe", """
select pair_id, case when avg(full_count) over (partition by distance_bp) > 0 then full_count / avg(full_count) over (partition by distance_bp) else 0 end as oe from {scored}""")
def simple_oe(t):
    return R.simple_oe(t.scored, "full_count").select("pair_id", "oe")


STEPS["baseline"] = """
select *, exposure * exp(distance_offset) * (select sum(full_count) / sum(exposure * exp(distance_offset)) from {scored} where split = 'train') as baseline_mean from {scored}"""


def baseline(t):
    return R.fixed_baseline(t.scored, "full_count")


@query("fixed_baseline", "select pair_id, baseline_mean from {baseline}")
def fixed_baseline(t):
    return baseline(t).select("pair_id", "baseline_mean")


@query("log_enrichment", "select pair_id, ln(full_count + 2.5) - ln(baseline_mean + 2.5) as enrichment from {baseline}")
def log_enrichment(t):
    return baseline(t).select("pair_id", S.log_enrichment("full_count", "baseline_mean", 2.5).alias("enrichment"))


STEPS["centered"] = """
select *, score - avg(score) over (partition by tile_row, distance_bin) as centered, ln(exposure) + score - avg(score) over (partition by tile_row, distance_bin) as eta from {scored}"""


def centered(t):
    rows = R.center_by_group(t.scored, ["tile_row", "distance_bin"], "score")
    return rows.withColumn("eta", F.log("exposure") + F.col("centered"))


@query("center_by_group", "select pair_id, centered from {centered}")
def center_by_group(t):
    return centered(t).select("pair_id", "centered")


@query("softmax_by_group", "select pair_id, exp(eta) / sum(exp(eta)) over (partition by tile_row, distance_bin) as probability from {centered}")
def softmax_by_group(t):
    return R.softmax_by_group(centered(t), ["tile_row", "distance_bin"], "eta").select("pair_id", "probability")


@query("log_rate", """
select pair_id, ln(exposure) + distance_offset + centered + 0.25 as log_rate, exp(ln(exposure) + distance_offset + centered + 0.25) * 2 as expected_count from {centered}""")
def log_rate(t):
    rows = centered(t).withColumn("log_rate", S.log_rate("exposure", "distance_offset", "centered", F.lit(0.25)))
    return rows.select("pair_id", "log_rate", (S.bounded_exp("log_rate") * 2).alias("expected_count"))


@query("owner_band_probability", """
select pair_id, exp(eta) / sum(exp(eta)) over (partition by tile_row, distance_band) * 1000000 as per_million from {centered}""")
def owner_band_probability(t):
    return R.owner_band_probability(centered(t).withColumn("rate", F.exp("eta")), "rate").select("pair_id", (F.col("probability") * 1_000_000).alias("per_million"))


LL = """
select {g}, cast(sum(full_count) as double) as events, sum(full_count * eta) - sum(full_count) * ln(sum(exp(eta))) as log_likelihood,
 case when sum(full_count) > 0 then (sum(full_count * eta) - sum(full_count) * ln(sum(exp(eta)))) / sum(full_count) end as log_likelihood_per_event from {centered} group by all"""


@query("conditional_ll", LL.replace("{g}", "chrom, distance_band"))
def conditional_ll(t):
    return R.conditional_ll(centered(t), ["chrom", "distance_band"], "eta", "full_count")


@query("conditional_ll_exact_distance", LL.replace("{g}", "tile_row, distance_bin"))
def conditional_ll_exact_distance(t):
    return R.conditional_ll(centered(t), ["tile_row", "distance_bin"], "eta", "full_count")


@query("likelihood_gain", """
with p as (select *, exp(eta) / sum(exp(eta)) over g as p, exposure / sum(exposure) over g as q from {centered} window g as (partition by tile_row, distance_band))
select distance_band, sum(full_count * (ln(p) - ln(q))) / sum(full_count) as gain_per_event, cast(sum(full_count) as double) as events,
 exp(sum(full_count * (ln(p) - ln(q))) / sum(full_count)) as relative_probability from p group by 1""")
def likelihood_gain(t):
    rows = R.owner_band_probability(centered(t).withColumn("rate", F.exp("eta")), "rate").withColumnRenamed("probability", "p")
    rows = R.owner_band_probability(rows, "exposure").withColumnRenamed("probability", "q")
    return R.likelihood_gain_summary(R.likelihood_gain_pair(rows, ["distance_band"], "full_count", "p", "q"), ["distance_band"])


@query("nb2_logpmf", """
select pair_id, lgamma(full_count + 4) - lgamma(4) - lgamma(full_count + 1) + 4 * (ln(4) - ln(4 + baseline_mean)) + full_count * (ln(baseline_mean) - ln(4 + baseline_mean)) as log_probability from {baseline}""")
def nb2(t):
    return baseline(t).select("pair_id", nb2_logpmf("full_count", "baseline_mean", F.lit(0.25)).alias("log_probability"))


def band_fit(t):
    rows = t.scored.filter("split = 'train'").withColumn("offset", F.log("exposure") + F.col("distance_offset"))
    return Fit.fit_nb2(rows, ["distance_band"], "full_count", "offset")


@query("fit_nb2")
def fit_nb2(t):
    return band_fit(t)


@query("fit_nb2_fixed_dispersion")
def fit_nb2_fixed(t):
    """Per output with the shared dispersion and a prior on the intercept."""
    shared = band_fit(t).select("distance_band", F.col("alpha").alias("prior"), F.col("dispersion").alias("phi"))
    per = E.pool_counts(t.counts, t.outputs, ["full_count"]).filter("output_type = 'pool'")
    listed = F.explode(F.array(F.lit("P1"), F.lit("P2"), F.lit("P3"))).alias("output_id")
    train = t.scored.filter("split = 'train'").select("pair_id", "distance_band", (F.log("exposure") + F.col("distance_offset")).alias("offset"), listed)
    rows = train.join(per.select("output_id", "pair_id", "full_count"), ["output_id", "pair_id"], "left").fillna(0, ["full_count"])
    rows = rows.join(F.broadcast(shared), "distance_band")  # one row per band
    return Fit.fit_nb2(rows, ["output_id", "distance_band"], "full_count", "offset", fixed_dispersion="phi", prior_mean="prior", prior_sd=2.0)


@query("fit_gamma_poisson")
def fit_gamma_poisson(t):
    return Fit.fit_gamma_poisson(baseline(t).filter("split = 'train'"), ["distance_band"], "full_count", "baseline_mean")


@query("calibration_ratio", """
with m as (select *, baseline_mean * (0.5 + score) as model from {baseline}),
l as (select *, lgamma(full_count + 4) - lgamma(4) - lgamma(full_count + 1) + 4 * (ln(4) - ln(4 + model)) + full_count * (ln(model) - ln(4 + model)) as ll,
 lgamma(full_count + 4) - lgamma(4) - lgamma(full_count + 1) + 4 * (ln(4) - ln(4 + baseline_mean)) + full_count * (ln(baseline_mean) - ln(4 + baseline_mean)) as ll0 from m)
select distance_band, sum(full_count) / sum(model) as observed_predicted_ratio, (sum(ll) - sum(ll0)) / greatest(sum(full_count), 1) as gain_per_event from l group by 1""")
def calibration_ratio(t):
    rows = baseline(t).withColumn("model", F.col("baseline_mean") * (F.lit(0.5) + F.col("score")))
    rows = rows.withColumns({"ll": nb2_logpmf("full_count", "model", F.lit(0.25)), "ll0": nb2_logpmf("full_count", "baseline_mean", F.lit(0.25))})
    return Fit.calibration_ratio(rows, ["distance_band"], "full_count", "model", "ll", "ll0")


# cumulative probabilities of each distinct mean under dispersion 1/4, by the mass function
STEPS["mean_cdf"] = """
with m as (select distinct baseline_mean as mu from {baseline}),
p as (select mu, k, exp(lgamma(k + 4) - lgamma(4) - lgamma(k + 1) + 4 * (ln(4) - ln(4 + mu)) + k * (ln(mu) - ln(4 + mu))) as p
  from m, range(0, (select cast(60 + 40 * max(mu) as bigint) from m)) r(k))
select mu, k, sum(p) over (partition by mu order by k) as cdf from p"""


@query("nb2_interval", """
with q as (select mu, min(k) filter (cdf >= 0.025) as lower, min(k) filter (cdf >= 0.975) as upper from {mean_cdf} group by 1)
select pair_id, baseline_mean, lower, upper from {baseline} join q on mu = baseline_mean""")
def nb2_interval(t):
    rows = baseline(t).withColumn("phi", F.lit(0.25))
    return Fit.nb2_interval(rows, "baseline_mean", "phi").select("pair_id", "baseline_mean", "lower", "upper")


@query("simulate_counts", f"""
with u as (select pair_id, baseline_mean, {drawn(17, "pair_id")} as u from {{baseline}})
select pair_id, count(*) filter (cdf < u) as simulated_count from u join {{mean_cdf}} on mu = baseline_mean group by 1""")
def simulate_counts(t):
    rows = baseline(t).withColumn("phi", F.lit(0.25))
    return Fit.simulate_counts(rows, "baseline_mean", "phi", 17, ["pair_id"]).select("pair_id", "simulated_count")


def sampled_pairs(t):
    return M.exposure_deciles(t.scored).withColumn("anchor_class", F.col("bin_i") / 10000 % 3)


def positives(t):
    return t.counts.select("context_index", "pair_id", F.col("full_count").alias("event_count"), (F.col("reproduced_splits") / 20.0).alias("support_weight"))


STEPS["sampled_pairs"] = """
with e as (select quantile_cont(ln(exposure), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from {scored} where split = 'train')
select s.*, len(list_filter(q, lambda x : x <= ln(exposure))) as decile, (bin_i / 10000) % 3 as class from {scored} s, e"""
STEPS["drawn_controls"] = f"""
with p as (select pair_id, chrom, distance_band, split, distance_bin, decile, class, row_number() over b - 1 as bp, count(*) over (partition by chrom, distance_band, split) as bs,
  row_number() over m - 1 as mp, count(*) over (partition by chrom, distance_bin, decile, class, split) as ms from {{sampled_pairs}}
  window b as (partition by chrom, distance_band, split order by pair_id), m as (partition by chrom, distance_bin, decile, class, split order by pair_id)),
s as (select c.context_index, p.*, slot, slot >= 4 and ms > 1 as fine from {{counts}} c join p using (pair_id), range(0, 8) r(slot)),
d as (select *, cast(floor({drawn(23, "context_index", "pair_id", "slot")} * (case when fine then ms else bs end - 1)) as bigint) as drawn from s),
e as (select *, drawn + cast(drawn >= case when fine then mp else bp end as int) as place from d),
f as (select e.*, p.pair_id as control_id, p.distance_bin as cd, p.decile as cq, p.class as cc from e join p on p.chrom = e.chrom and p.distance_band = e.distance_band and p.split = e.split and p.bp = e.place where not fine
  union all select e.*, p.pair_id, p.distance_bin, p.decile, p.class from e join p on p.chrom = e.chrom and p.distance_bin = e.distance_bin and p.decile = e.decile and p.class = e.class and p.split = e.split and p.mp = e.place where fine)
select context_index, pair_id, slot, control_id, cast(fine as int) as component,
  case when ms > 1 then 0.5 / (bs - 1) + case when cd = distance_bin and cq = decile and cc = class then 0.5 / (ms - 1) else 0 end else 1 / (bs - 1) end as proposal from f"""


def drawn_controls(t):
    return X.draw_controls(positives(t), sampled_pairs(t), 4, 4, seed=23)


@query("draw_controls", "select context_index, pair_id, slot, control_id, component, proposal * 1000 as proposal_per_mille from {drawn_controls}")
def draw_controls(t):
    return drawn_controls(t).withColumn("proposal_per_mille", F.col("proposal") * 1000).drop("proposal")


@query("control_groups", """
select pair_id as positive_pair_id, context_index, string_agg(control_id, ',' order by slot) as controls, string_agg(component, ',' order by slot) as components,
  sum(proposal) * 1000 as proposals_per_mille from {drawn_controls} group by 1, 2""")
def control_groups(t):
    """The lists of every positive, as text."""
    groups = X.control_groups(drawn_controls(t))
    total = F.aggregate("event_proposal_probabilities", F.lit(0.0), lambda a, x: a + x) * 1000
    return groups.select("positive_pair_id", "context_index", F.array_join(F.col("event_control_pair_ids").cast("array<string>"), ",").alias("controls"),
                         F.array_join(F.col("event_proposal_components").cast("array<string>"), ",").alias("components"), total.alias("proposals_per_mille"))


STEPS["positives"] = "select context_index, pair_id, reproduced_splits / 20 as weight from {counts}"


@query("rank_controls", f"""
with z as (select w.context_index, w.tile_row, w.distance_band, w.split, u.pair_id, row_number() over g - 1 as place, count(*) over (partition by w.context_index, w.tile_row, w.distance_band, w.split) as n
  from (select distinct context_index, tile_row, distance_band, split from {{positives}} join {{universe}} using (pair_id)) w join {{universe}} u using (tile_row, distance_band, split)
  where not exists (select 1 from {{counts}} c where c.context_index = w.context_index and c.pair_id = u.pair_id)
  window g as (partition by w.context_index, w.tile_row, w.distance_band, w.split order by u.pair_id)),
k as (select distinct context_index, tile_row, distance_band, split, n from z),
s as (select p.*, u.tile_row, u.distance_band, u.split, slot, k.n, cast(floor({drawn(29, "context_index", "pair_id", "slot")} * k.n) as bigint) as place
  from {{positives}} p join {{universe}} u using (pair_id) left join k using (context_index, tile_row, distance_band, split), range(0, 4) r(slot))
select s.context_index, s.pair_id, slot, coalesce(z.pair_id, s.pair_id) as control_id, case when z.pair_id is not null then weight else 0 end as support_weight
from s left join z using (context_index, tile_row, distance_band, split, place)""")
def rank_controls(t):
    return X.rank_controls(positives(t), t.universe, t.counts, 4, seed=29)


@query("resample_rank_controls", f"""
with w as (select p.*, u.tile_row, u.distance_band, u.split from {{positives}} p join {{universe}} u using (pair_id) where weight > 0),
l as (select g.context_index, g.tile_row, g.distance_band, g.split, u.pair_id, w.weight from (select distinct context_index, tile_row, distance_band, split from w) g
  join {{universe}} u using (tile_row, distance_band, split) left join w on w.context_index = g.context_index and w.pair_id = u.pair_id),
z as (select *, row_number() over (partition by context_index, tile_row, distance_band, split order by pair_id) - 1 as place, count(*) over (partition by context_index, tile_row, distance_band, split) as n
  from l where weight is null),
o as (select *, row_number() over (partition by context_index, tile_row, distance_band, split order by weight, pair_id) - 1 as place,
  rank() over (partition by context_index, tile_row, distance_band, split order by weight) - 1 as lower from l where weight > 0),
s as (select w.*, slot, coalesce(k.n, 0) as zeros, o.lower, case when coalesce(k.n, 0) > 0 and (slot < 2 or o.lower = 0) then 'zero' when o.lower > 0 then 'lower' end as pool
  from w join o using (context_index, pair_id) left join (select distinct context_index, tile_row, distance_band, split, n from z) k on k.context_index = w.context_index and k.tile_row = w.tile_row
    and k.distance_band = w.distance_band and k.split = w.split, range(0, 4) r(slot)),
d as (select *, cast(floor({drawn(31, "context_index", "pair_id", "slot")} * case pool when 'zero' then zeros else lower end) as bigint) as place from s),
b as (select 'zero' as pool, context_index, tile_row, distance_band, split, place, pair_id from z union all select 'lower', context_index, tile_row, distance_band, split, place, pair_id from o)
select d.context_index, d.pair_id, slot, coalesce(b.pair_id, d.pair_id) as control_id, d.pool, case when b.pair_id is not null then d.weight else 0 end as support_weight
from d left join b using (context_index, tile_row, distance_band, split, pool, place)""")
def resample_rank_controls(t):
    support = positives(t).filter("support_weight > 0").select("context_index", "pair_id", "support_weight")
    return X.resample_rank_controls(positives(t), t.scored, support, 4, seed=31)


def matched_text(pairs: str, label: str, near: str, seed: int) -> str:
    """DuckDB text of the matched negatives of ``pairs``; ``label`` and ``near`` are conditions on its columns."""
    return f"""
with r as (select *, rank() over (partition by distance_band order by score) + (count(*) over (partition by distance_band, score) - 1) / 2 as rank, count(*) over (partition by distance_band) as size from {pairs}),
m as (select pair_id, distance_band as band, chrom, distance_bp, distance_bp // 50000 as d50, least(counts_a, 3) as bucket, cast(least(floor(rank / (size + 1) * 10), 9) as bigint) as decile, {label} as label, {near} as near from r),
n as (select *, row_number() over a - 1 as pa, count(*) over (partition by band, chrom, bucket, decile, distance_bp) as na, row_number() over b - 1 as pb, count(*) over (partition by band, chrom, bucket, decile, d50) as nb,
  row_number() over c - 1 as pc, count(*) over (partition by band, chrom, bucket, decile) as nc from m where not near
  window a as (partition by band, chrom, bucket, decile, distance_bp order by pair_id), b as (partition by band, chrom, bucket, decile, d50 order by pair_id), c as (partition by band, chrom, bucket, decile order by pair_id)),
s as (select m.*, a.na, b.nb, c.nc, {drawn(seed, "m.pair_id")} as u from m left join (select distinct band, chrom, bucket, decile, distance_bp, na from n) a using (band, chrom, bucket, decile, distance_bp)
  left join (select distinct band, chrom, bucket, decile, d50, nb from n) b using (band, chrom, bucket, decile, d50) left join (select distinct band, chrom, bucket, decile, nc from n) c using (band, chrom, bucket, decile) where label)
select s.pair_id, n.pair_id as negative_id, 'exact_10kb' as tier from s join n on s.na is not null and n.band = s.band and n.chrom = s.chrom and n.bucket = s.bucket and n.decile = s.decile and n.distance_bp = s.distance_bp and n.pa = floor(u * s.na)
union all select s.pair_id, n.pair_id, 'within_50kb' from s join n on s.na is null and s.nb is not null and n.band = s.band and n.chrom = s.chrom and n.bucket = s.bucket and n.decile = s.decile and n.d50 = s.d50 and n.pb = floor(u * s.nb)
union all select s.pair_id, n.pair_id, 'within_band' from s join n on s.na is null and s.nb is null and s.nc is not null and n.band = s.band and n.chrom = s.chrom and n.bucket = s.bucket and n.decile = s.decile and n.pc = floor(u * s.nc)
union all select s.pair_id, null, 'unmatched' from s where s.nc is null"""


@query("matched_negatives", matched_text("{scored}", "counts_b >= 2", "counts_b >= 1", 37))
def matched_negatives(t):
    rows = X.with_match_buckets(t.scored, "counts_a", "score").withColumns({"label": F.col("counts_b") >= 2, "near": F.col("counts_b") >= 1})
    return X.matched_negatives(rows, "label", "near", seed=37, strict=False)


@query("thin_counts", f"""
with p as (select output_id, pair_id, cast(sum(counts_b) as bigint) as n from {{counts}} join {{outputs}} using (context_index) group by 1, 2 having sum(counts_b) > 0),
d as (select output_id, cast(sum(n) as bigint) // 3 as depth from p group by 1), e as (select output_id, pair_id, unnest(range(1, n + 1)) as event from p),
r as (select *, row_number() over (partition by output_id order by {drawn(41, "output_id", "pair_id", "event")}, pair_id, event) as r from e)
select output_id, pair_id, count(*) as counts_b from r join d using (output_id) where r <= depth group by 1, 2""")
def thin_counts(t):
    per = E.pool_counts(t.counts, t.outputs, ["counts_b"]).filter("counts_b > 0").select("output_id", "pair_id", "counts_b")
    depth = per.groupBy("output_id").agg(F.floor(F.sum("counts_b") / 3).alias("depth"))
    return E.thin_counts(per, ["output_id"], "pair_id", "counts_b", depth, seed=41)


@query("pack_groups", f"""
with g as (select tile_row || ':' || distance_bin as group_key, count(*) as rows from {{universe}} group by 1),
w as (select greatest(4096 - coalesce(max(rows) filter (rows <= 4096), 0), 1) as width from g),
o as (select *, sum(case when rows > 4096 then 0 else rows end) over k as upto, count(*) filter (rows > 4096) over k as large from g
  window k as (order by {drawn(43, "group_key")}, group_key rows unbounded preceding))
select group_key, rows, cast(case when rows > 4096 then -large else (upto - rows) // width end as bigint) as batch from o, w""")
def pack_groups(t):
    sizes = t.universe.groupBy(F.concat_ws(":", "tile_row", "distance_bin").alias("group_key")).agg(F.count(F.lit(1)).alias("rows"))
    return X.pack_groups(sizes, 4096, 43, "group_key")


@query("group_codes", """
select pair_id, dense_rank() over (order by tile_row, distance_bin) - 1 as group_code from {universe}""")
def group_codes(t):
    return X.group_codes(t.universe.select("pair_id", "tile_row", "distance_bin"), ["tile_row", "distance_bin"]).select("pair_id", "group_code")


@query("group_pools", """
select pair_id, row_number() over (partition by chrom, distance_band, split order by pair_id) - 1 as position,
 count(*) over (partition by chrom, distance_band, split) as pool_size from {universe}""")
def group_pools(t):
    return X.group_pools(t.universe, ["chrom", "distance_band", "split"], bounded=False).select("pair_id", "position", "pool_size")


# a fixed control list per positive, so that losses have an oracle: the pairs 1, 8 and 27 places on
STEPS["control_lists"] = """
select c.context_index, c.pair_id as positive_pair_id, c.full_count as event_count, c.reproduced_splits / 20 as support_weight, slot,
 (c.pair_id + slot * slot * slot) % n as control_id, (slot + 1) / 50000 as proposal
from {counts} c, (select count(*) as n from {universe}), (values (1), (2), (3)) s(slot)"""


def control_lists(t):
    total = t.universe.agg(F.count(F.lit(1)).alias("n"))
    ids = F.array(*[((F.col("pair_id") + s**3) % F.col("n")) for s in (1, 2, 3)])
    rows = positives(t).join(F.broadcast(total))  # a single row
    return rows.select("context_index", F.col("pair_id").alias("positive_pair_id"), ids.alias("event_control_pair_ids"),
                       F.array(*[F.lit((s + 1) / 50000) for s in (1, 2, 3)]).alias("event_proposal_probabilities"))


@query("controls_join", """
select context_index, positive_pair_id, slot - 1 as slot, control_id as pair_id, proposal, s.score, p.score as positive_score
from {control_lists} join {scored} s on s.pair_id = control_id join {scored} p on p.pair_id = positive_pair_id""")
def controls_join(t):
    return X.controls_join(control_lists(t), t.scored)


@query("event_loss", """
with l as (select context_index, positive_pair_id, max(event_count) as w, ln(sum(exp(s.score - ln(proposal))) / 3 + exp(max(p.score))) - max(p.score) as loss
 from {control_lists} join {scored} s on s.pair_id = control_id join {scored} p on p.pair_id = positive_pair_id group by 1, 2)
select context_index, sum(loss * w) / sum(w) as event_loss, cast(sum(w) as bigint) as events from l group by 1""")
def event_loss(t):
    return X.event_loss(X.event_losses(X.controls_join(control_lists(t), t.scored), positives(t)), ("context_index",))


@query("rank_loss", """
with l as (select context_index, positive_pair_id, max(support_weight) as w, avg(ln(1 + exp(s.score - p.score))) as l
 from {control_lists} join {scored} s on s.pair_id = control_id join {scored} p on p.pair_id = positive_pair_id group by 1, 2)
select context_index, sum(l * w) / sum(w) as rank_loss, sum(w) as support from l group by 1""")
def rank_loss(t):
    lists = control_lists(t).select("context_index", F.col("positive_pair_id").alias("pair_id"), F.explode("event_control_pair_ids").alias("control_id"))
    rows = lists.join(positives(t).select("context_index", "pair_id", "support_weight"), ["context_index", "pair_id"])
    return X.rank_loss(rows, t.scored, ("context_index",))


@query("normalizer_audit", """
with p as (select *, sum(exp(score)) over (partition by chrom, distance_band, split) as z from {scored}),
e as (select c.context_index, positive_pair_id, abs(ln(sum(exp(s.score) / proposal) / 3) - ln(max(p.z) - exp(max(p.score)))) as e
 from {control_lists} c join {scored} s on s.pair_id = control_id join p on p.pair_id = positive_pair_id group by 1, 2)
select context_index, count(*) as audited, quantile_cont(e, 0.5) as median_error, quantile_cont(e, 0.95) as p95_error from e group by 1""")
def normalizer_audit(t):
    return X.normalizer_audit(X.controls_join(control_lists(t), t.scored), t.scored)
