"""Top-k, neighbourhood, ranking-metric and bootstrap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactspark.functions import scalars as S
from contactspark.operators import metrics as M
from contactspark.operators import neighbours as N
from contactspark.operators import ordered as O
from contactspark.operators import resampling as R
from contactspark.operators import topk as K
from workloads.base import BIN_SIZE, REPLICATES, STEPS, query

GROUP = ["tile_row", "distance_band"]
STEPS["ranked"] = """
select *, count(*) over g as n, cast(greatest(1, ceil(count(*) over g * cast(0.02 as double))) as bigint) as k,
  row_number() over (g order by score desc, pair_id) as rn, rank() over (g order by score desc) as rk,
  count(*) over (partition by tile_row, distance_band, score) as ties from {scored} window g as (partition by tile_row, distance_band)"""


@query("topk_hard", """
select tile_row, distance_band, pair_id, k, coalesce((select true from (select 1) where t.tied), false) as tied from
 (select *, exists (select 1 from {ranked} b where b.tile_row = a.tile_row and b.distance_band = a.distance_band and b.rn = a.k + 1
   and b.score = (select c.score from {ranked} c where c.tile_row = a.tile_row and c.distance_band = a.distance_band and c.rn = a.k)) as tied
  from {ranked} a where rn <= k) t""")
def topk_hard(t):
    return K.topk_hard(t.scored, GROUP, "score", 0.02).select(*GROUP, "pair_id", "k", "tied")


@query("topk_inclusive", """
select tile_row, distance_band, pair_id, k, count(*) over (partition by tile_row, distance_band) > k as tied from {ranked} where rk <= k""")
def topk_inclusive(t):
    return K.topk_inclusive(t.scored, GROUP, "score", 0.02).select(*GROUP, "pair_id", "k", "tied")


@query("topk_fractional", """
select tile_row, distance_band, pair_id, k, case when rk + ties - 1 <= k then cast(1 as double) else (k - rk + 1) / ties end as weight from {ranked} where rk <= k""")
def topk_fractional(t):
    rows = t.scored.join(t.scored.groupBy(*GROUP).agg(S.fraction_k(F.count(F.lit(1)), 0.02).alias("k")), GROUP)
    return K.topk_fractional(rows, GROUP, "score", "k", eligible=F.lit(True)).select(*GROUP, "pair_id", "k", "weight")


STEPS["counted"] = """select *, cast(full_count > 0 as int) as hit from {scored}"""


def counted(t):
    return t.scored.withColumn("hit", (F.col("full_count") > 0).cast("int"))


STEPS["reversed"] = """
select *, row_number() over (partition by distance_band order by score desc, pair_id desc) as rn, count(*) over (partition by distance_band) as n from {counted}"""


@query("topk_capture", """
select distance_band, f as fraction, k, n as candidates, top / total as capture, (top / total) / (k / n) as enrichment from (
 select distance_band, f, max(n) as n, cast(greatest(1, ceil(max(n) * f)) as bigint) as k, sum(full_count) as total,
  sum(case when rn <= greatest(1, ceil(n * f)) then full_count else 0 end) as top
 from {reversed}, (values (cast(0.01 as double)), (cast(0.05 as double))) v(f) group by 1, 2)""")
def topk_capture(t):
    return K.topk_capture(t.scored, ["distance_band"], "score", "full_count", [0.01, 0.05])


@query("topk_precision", """
select distance_band, f as fraction, k, top / k as "precision", top / total as recall, (top / k) / (total / n) as enrichment from (
 select distance_band, f, max(n) as n, cast(greatest(1, ceil(max(n) * f)) as bigint) as k, sum(hit) as total,
  sum(case when rn <= greatest(1, ceil(n * f)) then hit else 0 end) as top
 from {reversed}, (values (cast(0.01 as double)), (cast(0.02 as double)), (cast(0.05 as double))) v(f) group by 1, 2)""")
def topk_precision(t):
    return K.topk_precision(counted(t), ["distance_band"], "score", "hit")


@query("topk_tie_aware", """
with c as (select distance_band, f, count(*) as n, sum(hit) as p, cast(greatest(1, ceil(count(*) * f)) as bigint) as k from {counted},
  (values (cast(0.01 as double)), (cast(0.02 as double)), (cast(0.05 as double))) v(f) group by 1, 2),
cut as (select c.*, (select score from {reversed} r where r.distance_band = c.distance_band and r.rn = c.k) as threshold from c),
e as (select cut.*, (select count(*) from {counted} s where s.distance_band = cut.distance_band and s.score = threshold) as tie_size,
  (select coalesce(sum(hit), 0) from {counted} s where s.distance_band = cut.distance_band and s.score > threshold) as above_p,
  (select count(*) from {counted} s where s.distance_band = cut.distance_band and s.score > threshold) as above_n,
  (select avg(hit) from {counted} s where s.distance_band = cut.distance_band and s.score = threshold) as tie_mean from cut)
select distance_band, f as fraction, k, threshold, tie_size, above_p + (k - above_n) * tie_mean as expected_positives,
 (above_p + (k - above_n) * tie_mean) / k as "precision", (above_p + (k - above_n) * tie_mean) / p as recall,
 (above_p + (k - above_n) * tie_mean) / k / (p / n) as enrichment from e""")
def topk_tie_aware(t):
    return K.topk_tie_aware(counted(t), ["distance_band"], "score", "hit")


STEPS["neighbour_tops"] = """
with v as (select *, count(*) over g as n from {scored} where split = 'validation' window g as (partition by tile_row, distance_band)),
r as (select *, cast(greatest(1, ceil(n * f)) as bigint) as k, row_number() over (partition by tile_row, distance_band, f order by score desc, pair_id) as ra,
  row_number() over (partition by tile_row, distance_band, f order by score2 desc, pair_id) as rb,
  lead(score) over (partition by tile_row, distance_band, f order by score desc, pair_id) as next_a,
  lead(score2) over (partition by tile_row, distance_band, f order by score2 desc, pair_id) as next_b
  from v, (values (cast(0.01 as double)), (cast(0.02 as double))) w(f) where n >= 2)
select * from r where ra <= k or rb <= k"""
STEPS["neighbour_overlap"] = """
with sized as (select t.pair_id, any_value(t.tile_row) as tile_row, count(*) as neighbours from (select distinct pair_id, tile_row, distance_band, bin_i, bin_j from {neighbour_tops}) t
  join {scored} s on s.split = 'validation' and s.tile_row = t.tile_row and s.distance_band = t.distance_band
   and abs(s.bin_i - t.bin_i) <= 10000 and abs(s.bin_j - t.bin_j) <= 10000 group by 1),
a as (select *, 1 - case when n - k < neighbours then 0 else exp((select sum(ln((n - k - i) / (n - i))) from range(0, neighbours) x(i))) end as chance,
   exists (select 1 from {neighbour_tops} b where b.rb <= b.k and b.f = t.f and b.tile_row = t.tile_row and b.distance_band = t.distance_band
    and abs(b.bin_i - t.bin_i) <= 10000 and abs(b.bin_j - t.bin_j) <= 10000) as hit from {neighbour_tops} t join sized using (pair_id) where ra <= k),
b as (select *, 1 - case when n - k < neighbours then 0 else exp((select sum(ln((n - k - i) / (n - i))) from range(0, neighbours) x(i))) end as chance,
   exists (select 1 from {neighbour_tops} a where a.ra <= a.k and a.f = t.f and a.tile_row = t.tile_row and a.distance_band = t.distance_band
    and abs(a.bin_i - t.bin_i) <= 10000 and abs(a.bin_j - t.bin_j) <= 10000) as hit from {neighbour_tops} t join sized using (pair_id) where rb <= k),
ga as (select distance_band, tile_row, f, max(n) as n, avg(cast(hit as int)) as o, avg(chance) as c, coalesce(bool_or(ra = k and score = next_a), false) as tied from a group by 1, 2, 3),
gb as (select distance_band, tile_row, f, avg(cast(hit as int)) as o, avg(chance) as c, coalesce(bool_or(rb = k and score2 = next_b), false) as tied from b group by 1, 2, 3)
select distance_band, tile_row, f as fraction, n as candidate_count, (ga.o + gb.o) / 2 as overlap, (ga.c + gb.c) / 2 as chance,
  ((ga.o + gb.o) / 2) / ((ga.c + gb.c) / 2) as enrichment, ga.tied as a_tied, gb.tied as b_tied from ga join gb using (distance_band, tile_row, f)"""


def overlap_rows(t):
    return K.topk_overlap_neighbour(t.scored.filter("split = 'validation'"), "score", "score2", [0.01, 0.02], 1, BIN_SIZE)


@query("topk_overlap_neighbour", "select * from {neighbour_overlap}")
def topk_overlap_neighbour(t):
    return overlap_rows(t)


@query("median_over_groups", """
select distance_band, fraction, median(overlap) as overlap, median(chance) as chance_overlap, median(enrichment) as enrichment_over_chance,
  count(*) as candidate_tile_count, count(*) filter (a_tied) as score_a_cutoff_tied_tiles, count(*) filter (b_tied) as score_b_cutoff_tied_tiles
from {neighbour_overlap} group by 1, 2""")
def median_over_groups(t):
    return K.median_over_groups(overlap_rows(t), ["distance_band", "fraction"])


STEPS["model_target"] = """
with s as (select *, ln(full_count + 2) - ln(exposure + 2) as target, count(*) over (partition by tile_row, distance_band) as n from {scored}),
g as (select tile_row, distance_band, max(n) as n, cast(greatest(1, ceil(max(n) * cast(0.01 as double))) as bigint) as k from s group by 1, 2),
a as (select s.*, k, rank() over w as r, count(*) over (partition by s.tile_row, s.distance_band, target) as t, count(*) over (partition by s.tile_row, s.distance_band) as m
  from s join g using (tile_row, distance_band) where full_count > 0 window w as (partition by s.tile_row, s.distance_band order by target desc)),
b as (select s.*, k, rank() over w as r, count(*) over (partition by s.tile_row, s.distance_band, score) as t
  from s join g using (tile_row, distance_band) window w as (partition by s.tile_row, s.distance_band order by score desc)),
ok as (select distinct tile_row, distance_band from a where m >= k)
select g.tile_row, g.distance_band, g.n as candidate_count, g.k, coalesce(d, 0) / g.k as overlap, g.k / g.n as chance,
  coalesce(d, 0) / g.k - g.k / g.n as overlap_excess, (coalesce(d, 0) / g.k) / (g.k / g.n) as enrichment_over_chance
from g join ok using (tile_row, distance_band) left join (select a.tile_row, a.distance_band,
  sum(greatest(0, least(1, (a.k - a.r + 1) / a.t)) * greatest(0, least(1, (b.k - b.r + 1) / b.t))) as d
  from a join b using (pair_id) group by 1, 2) using (tile_row, distance_band)"""


@query("model_vs_target", "select * from {model_target}")
def model_vs_target(t):
    rows = t.scored.withColumn("target", S.log_enrichment("full_count", "exposure", 2.0))
    return K.model_vs_target(rows, GROUP, "score", "target", "full_count", 0.01)


@query("neighbour_match", """
select a.pair_id from {scored} a where a.full_count >= 3 and exists (select 1 from {scored} b where b.chrom = a.chrom and b.score > 0.95
 and abs(b.bin_i - a.bin_i) <= 10000 and abs(b.bin_j - a.bin_j) <= 10000)""")
def neighbour_match(t):
    return N.neighbour_match(t.scored.filter("full_count >= 3"), t.scored.filter("score > 0.95D"), ["chrom"], 1, BIN_SIZE).select("pair_id")


@query("neighbour_count", """
select a.chrom, a.bin_i, a.bin_j, count(*) as neighbours from {universe} a join {universe} b on a.chrom = b.chrom
 and b.bin_i in (a.bin_i - 10000, a.bin_i, a.bin_i + 10000) and b.bin_j in (a.bin_j - 10000, a.bin_j, a.bin_j + 10000) group by all""")
def neighbour_count(t):
    return N.neighbour_count(t.universe, t.universe, ["chrom"], 1, BIN_SIZE)


@query("neighbour_sum", """
select a.pair_id, cast(sum(b.full_count) as bigint) as neighbour_sum from {scored} a join {scored} b on a.chrom = b.chrom
 and b.bin_i in (a.bin_i - 10000, a.bin_i, a.bin_i + 10000) and b.bin_j in (a.bin_j - 10000, a.bin_j, a.bin_j + 10000) group by all""")
def neighbour_sum(t):
    return N.neighbour_sum(t.scored, "full_count", BIN_SIZE).select("pair_id", "neighbour_sum")


@query("average_rank", """
select distance_band, score, count(*) as ties, min(r) + (count(*) - 1) / 2 as avg_rank from
(select *, rank() over (partition by distance_band order by score) as r from {scored}) group by 1, 2""")
def average_rank(t):
    return O.average_ranks(t.scored, ["distance_band"], "score")


@query("matched_buckets", """
select pair_id, least(full_count, 3) as raw_bucket, least(cast(floor((r + (ties - 1) / 2) / (n + 1) * 10) as bigint), 9) as score_decile,
 cast(floor(distance_bp / 50000) as bigint) as distance_50kb from (select *, rank() over (partition by distance_band order by score) as r,
 count(*) over (partition by distance_band, score) as ties, count(*) over (partition by distance_band) as n from {scored})""")
def matched_buckets(t):
    from contactspark.operators.sampling import with_match_buckets

    return with_match_buckets(t.scored, "full_count", "score").select("pair_id", "raw_bucket", "score_decile", "distance_50kb")


STEPS["thresholds"] = """
select distance_band, chrom, score, n, p, sum(n) over w as cn, sum(p) over w as cp, sum(n) over g as tn, sum(p) over g as tp from
(select distance_band, chrom, score, count(*) as n, sum(hit) as p from {counted} group by 1, 2, 3)
window g as (partition by distance_band, chrom), w as (partition by distance_band, chrom order by score desc)"""


@query("classification_metrics", """
select distance_band, chrom, cast(max(tn) as bigint) as candidates, cast(max(tp) as bigint) as positives, max(tp) / max(tn) as prevalence,
 sum(p / tp * (cp / cn)) as auprc, sum(p / tp * (cp / cn)) / (max(tp) / max(tn)) as auprc_lift,
 sum((n - p) * (cp - p + p / 2)) / max(tp * (tn - tp)) as auroc from {thresholds} group by 1, 2""")
def classification_metrics(t):
    return M.classification(counted(t), ["distance_band", "chrom"], "score", "hit")


@query("precision_recall_points", """
select distance_band, chrom, score as threshold, cp / cn as "precision", cp / tp as recall from {thresholds}""")
def precision_recall_points(t):
    return M.precision_recall_points(counted(t), ["distance_band", "chrom"], "score", "hit")


def bundled(t):
    return counted(t).withColumn("target", F.log(F.col("full_count") + 1.0))


BUNDLE = """
with r as (select {g}, score as x, ln(full_count + 1) as y, hit, rank() over (partition by {g} order by score) as rx, count(*) over (partition by {g}, score) as tx,
  rank() over (partition by {g} order by full_count) as ry, count(*) over (partition by {g}, full_count) as ty from SOURCE),
b as (select {g}, count(*) as n, sum(hit) as s, corr(x, y) as pearson, corr(rx + (tx - 1) / 2, ry + (ty - 1) / 2) as spearman from r group by all),
t as (select {g}, x, count(*) as n, sum(hit) as p from r group by all),
c as (select {g}, p, sum(n) over (partition by {g} order by x desc) as cn, sum(p) over (partition by {g} order by x desc) as cp, sum(p) over (partition by {g}) as tp from t),
ap as (select {g}, sum(p / tp * (cp / cn)) as ap from c group by all)
select {g}, n >= 100 as defined, n as candidate_count, case when n >= 100 then pearson end as pearson, case when n >= 100 then spearman end as spearman,
  case when n >= 100 and s >= 20 and s < n then ap end as auprc, n >= 100 and s >= 20 and s < n as auprc_defined,
  case when n >= 100 then cast(s as bigint) end as support_count, case when n >= 100 then s / n end as support_prevalence,
  case when n < 100 then 'insufficient_candidates' end as reason from b join ap using ({g})"""


@query("metric_bundle", BUNDLE.replace("{g}", "chrom, distance_bp").replace("SOURCE", "{counted} where distance_bp in (250000, 500000, 750000)"))
def metric_bundle(t):
    rows = bundled(t).filter("distance_bp in (250000, 500000, 750000)")
    return M.metric_bundle(rows, ["chrom", "distance_bp"], "score", "target", "hit", 100, 20)


STEPS["stratified"] = """
select *, 'distance_' || cast(distance_bp as varchar) as stratum from {counted} where distance_bp in (250000, 500000, 750000)
union all select *, 'near' from {counted} where bin_i % 70000 = 0 union all select *, 'far' from {counted} where bin_j % 110000 = 0"""
STEPS["strata_bundles"] = BUNDLE.replace("{g}", "chrom, stratum").replace("SOURCE", "{stratified}")


@query("stratified_bundle", """
select stratum, median(pearson) as pearson, median(spearman) as spearman, median(case when auprc_defined then auprc - support_prevalence end) as auprc_gain,
 stratum in ('near') as required, (coalesce(median(pearson) > 0, false) or coalesce(median(spearman) > 0, false))
 and coalesce(median(case when auprc_defined then auprc - support_prevalence end) > 0, false) as passed from {strata_bundles} group by 1""")
def stratified_bundle(t):
    rows = bundled(t).withColumns({"near": F.col("bin_i") % 70000 == 0, "far": F.col("bin_j") % 110000 == 0})
    rows = M.with_strata(rows, [250_000, 500_000, 750_000], ["near", "far"])
    return M.strata_summary(M.metric_bundle(rows, ["chrom", "stratum"], "score", "target", "hit", 100, 20), ["near"])


@query("macro_ap", """
with t as (select distance_band, tile_row, score, count(*) as n, sum(hit) as p from {counted} group by all),
c as (select *, sum(n) over w as cn, sum(p) over w as cp, sum(n) over g as tn, sum(p) over g as tp from t
  window g as (partition by distance_band, tile_row), w as (partition by distance_band, tile_row order by score desc)),
a as (select distance_band, tile_row, max(tn) as n, max(tp) as p, sum(p / tp * (cp / cn)) as ap from c group by 1, 2)
select distance_band, count(*) as eligible_keys, cast(sum(n) as bigint) as eligible_candidates, avg(ap) as macro_auprc, median(ap) as median_auprc
from a where n >= 20 and p > 0 and p < n group by 1""")
def macro_ap(t):
    return M.macro_ap(counted(t), ["distance_band"], "tile_row", "score", "hit")


STEPS["chrom_auroc"] = """
with u as (select distance_band, chrom, 'a' as side, score as v, hit from {counted} union all select distance_band, chrom, 'b', score2, hit from {counted}),
r as (select *, rank() over (partition by distance_band, chrom, side order by v) + (count(*) over (partition by distance_band, chrom, side, v) - 1) / 2 as r from u),
a as (select distance_band, chrom, side, (sum(r) filter (hit = 1) - sum(hit) * (sum(hit) + 1) / 2) / (sum(hit) * (count(*) - sum(hit))) as auc from r group by 1, 2, 3)
select distance_band, chrom, max(auc) filter (side = 'a') as source_a, max(auc) filter (side = 'b') as source_b,
  max(auc) filter (side = 'a') - max(auc) filter (side = 'b') as difference from a group by 1, 2"""


@query("per_chrom_metric_difference", "select * from {chrom_auroc}")
def per_chrom_metric_difference(t):
    return M.per_chrom_metric_difference(counted(t), ["distance_band"], "score", "score2", "hit", "auroc")


@query("direction_accuracy", """
select distance_band, avg(cast((counts_a > counts_b) = (score > 0.5) as int)) as direction_accuracy,
 (avg(cast(score > 0.5 as int)) filter (counts_a > counts_b) + avg(cast(score <= 0.5 as int)) filter (counts_a <= counts_b)) / 2 as balanced_direction_accuracy
from {scored} where counts_a <> counts_b group by 1""")
def direction_accuracy(t):
    rows = t.scored.filter("counts_a <> counts_b").withColumns({"label": F.col("counts_a") > F.col("counts_b"), "delta": F.col("score") - 0.5})
    return M.direction_accuracy(rows, ["distance_band"], "delta", "label")


STEPS["reliability"] = """
with r as (select distance_bp, chrom, rank() over (g order by score) + (count(*) over (partition by distance_bp, chrom, score) - 1) / 2 as m,
  rank() over (g order by full_count) + (count(*) over (partition by distance_bp, chrom, full_count) - 1) / 2 as t,
  rank() over (g order by counts_a) + (count(*) over (partition by distance_bp, chrom, counts_a) - 1) / 2 as a,
  rank() over (g order by counts_b) + (count(*) over (partition by distance_bp, chrom, counts_b) - 1) / 2 as b
  from {scored} where distance_bp in (250000, 500000, 750000) window g as (partition by distance_bp, chrom))
select distance_bp, chrom, count(*) as rows, corr(m, t) as model, corr(a, b) as reliability from r group by 1, 2
having count(*) >= 3 and isfinite(corr(m, t)) and isfinite(corr(a, b))"""


@query("exact_distance_reliability", """
with s as (select distance_bp, sum(model * rows) / sum(rows) as model, sum(reliability * rows) / sum(rows) as reliability from {reliability} group by 1)
select *, sqrt(greatest(reliability, 0)) as reliability_ceiling, case when reliability > 0 then model / sqrt(reliability) end as reliability_fraction from s""")
def exact_distance_reliability(t):
    return M.reliability_summary(M.reliability(t.scored, [250_000, 500_000, 750_000], "score", "full_count", "counts_a", "counts_b"))


@query("exposure_deciles", """
with e as (select quantile_cont(ln(exposure), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from {scored} where split = 'train')
select pair_id, len(list_filter(q, lambda x : x <= ln(exposure))) as exposure_decile from {scored}, e""")
def exposure_deciles(t):
    return M.exposure_deciles(t.scored).select("pair_id", "exposure_decile")


@query("exact_quantiles", """
select chrom, count(*) as values, count(distinct full_count + score) as distinct_values, quantile_cont(full_count + score, 0.25) as q25,
 quantile_cont(full_count + score, 0.5) as q50, quantile_cont(full_count + score, 0.975) as q975 from {scored} group by 1""")
def exact_quantiles(t):
    rows = t.scored.withColumn("v", F.col("full_count") + F.col("score"))
    q = M.exact_quantiles(rows, ["chrom"], "v", [0.25, 0.5, 0.975])
    return q.select("chrom", "values", "distinct_values", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q25", "q50", "q975"))])


@query("calibration_slope", """
with s as (select distance_band, full_count as y, exposure + score as m from {scored}),
e as (select distance_band, list_distinct(quantile_cont(m, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) as q from s group by 1),
b as (select distance_band, len(list_filter(q, lambda x : x < m)) as bin, avg(m) as m, avg(y) as y from s join e using (distance_band) group by distance_band, greatest(len(list_filter(q, lambda x : x < m)), 1), bin),
c as (select distance_band, greatest(bin, 1) as bin, avg(s.exposure + s.score) as m, avg(s.full_count) as y from
  (select s.*, len(list_filter(q, lambda x : x < exposure + score)) as bin from {scored} s join e using (distance_band)) s group by 1, 2),
d as (select *, min(m) over (partition by distance_band) as eps from c)
select distance_band, regr_slope(ln(y + eps), ln(m + eps)) as calibration_slope from d group by 1""")
def calibration_slope(t):
    rows = t.scored.withColumn("m", F.col("exposure") + F.col("score"))
    return M.calibration_slope(rows, ["distance_band"], "full_count", "m")


@query("supported_context_coverage", """
with s as (select distance_band as label, context_index, count(*) as supported from {counts} join {universe} using (pair_id) where reproduced_splits > 0 group by 1, 2)
select label, count(*) filter (supported >= 900) as passing_contexts, 3 as required_contexts, count(*) filter (supported >= 900) >= 3 as passed from s group by 1""")
def supported_context_coverage(t):
    rows = t.counts.filter("reproduced_splits > 0").join(t.universe.select("pair_id", F.col("distance_band").alias("label")), "pair_id")
    return M.supported_context_coverage(rows.groupBy("label", "context_index").agg(F.count(F.lit(1)).alias("supported")), 5, 900, 0.5)


@query("mass_allocation", """
select distance_band, count(*) filter (m) as subset_pairs, count(*) as pairs, count(*) filter (m) / count(*) as pair_share,
 sum(full_count) filter (m) / sum(full_count) as observed_share, sum(exposure) filter (m) / sum(exposure) as predicted_share,
 (sum(full_count) filter (m) / sum(full_count)) / (count(*) filter (m) / count(*)) as observed_enrichment,
 (sum(exposure) filter (m) / sum(exposure)) / (count(*) filter (m) / count(*)) as predicted_enrichment
from (select *, bin_i % 70000 = 0 as m from {scored}) group by 1""")
def mass_allocation(t):
    return M.mass_allocation(t.scored.withColumn("m", F.col("bin_i") % 70000 == 0), ["distance_band"], "m", "full_count", "exposure")


@query("bh_adjust", """
with p as (select chrom, distance_band, (abs(difference) * 37) % 1 as p_value from {chrom_auroc}),
r as (select *, row_number() over (order by p_value) as r, count(*) over () as m from p)
select chrom, distance_band, p_value, least(1, min(p_value * m / r) over (order by r desc)) as adjusted_p from r""")
def bh_adjust(t):
    tests = M.per_chrom_metric_difference(counted(t), ["distance_band"], "score", "score2", "hit", "auroc").select(
        "chrom", "distance_band", ((F.abs("difference") * 37) % 1).alias("p_value"))
    return M.bh_adjust(tests)


DRAW = "cast(floor(cast(cast('0x' || substr(md5('{seed}|' || cast(r as varchar) || '|' || cast(s as varchar)), 1, 13) as bigint) as double) / 4503599627370496 * n) as bigint)"
STEPS["ratio_bootstrap"] = """
with c as (select distance_band, chrom, cast(sum(k * overlap_excess) as double) as x, cast(sum(k) as double) as y from {model_target} join (select tile_row, chrom from {tiles}) using (tile_row) group by 1, 2),
o as (select *, row_number() over (partition by distance_band order by chrom) - 1 as i, count(*) over (partition by distance_band) as n from c),
d as (select distance_band, n, r, DRAW as i from (select distinct distance_band, n from o), range(0, 1000) a(r), range(0, 30) b(s) where s < n),
v as (select distance_band, r, sum(x) / sum(y) as v from d join o using (distance_band, i) group by 1, 2)
select v.distance_band, n as chroms, point, quantile_cont(v, 0.025) as lower, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.975) as upper,
 (1 + count(*) filter (v <= 0)) / 1001 as p_value from v join (select distance_band, count(*) as n, sum(x) / sum(y) as point from o group by 1) using (distance_band) group by 1, 2, 3
""".replace("DRAW", DRAW.replace("{seed}", "11"))


def excess_bootstrap(t):
    rows = t.scored.withColumn("target", S.log_enrichment("full_count", "exposure", 2.0))
    top = K.model_vs_target(rows, GROUP, "score", "target", "full_count", 0.01).join(t.tiles.select("tile_row", "chrom"), "tile_row")
    top = top.withColumn("x", F.col("k") * F.col("overlap_excess"))
    return R.chrom_bootstrap(top, ["distance_band"], "x", "k", replicates=REPLICATES, seed=11, lower=0.025)


@query("chrom_bootstrap_ratio", "select * from {ratio_bootstrap}")
def chrom_bootstrap_ratio(t):
    return excess_bootstrap(t)


@query("chrom_bootstrap_mean", """
with o as (select *, row_number() over (partition by distance_band order by chrom) - 1 as i, count(*) over (partition by distance_band) as n from {chrom_auroc}),
d as (select distance_band, n, r, DRAW as i from (select distinct distance_band, n from o), range(0, 1000) a(r), range(0, 30) b(s) where s < n),
v as (select distance_band, r, avg(difference) as v from d join o using (distance_band, i) group by 1, 2)
select v.distance_band, n as chroms, point, quantile_cont(v, 0.025) as lower, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.975) as upper
from v join (select distance_band, count(*) as n, avg(difference) as point from o group by 1) using (distance_band) group by 1, 2, 3
""".replace("DRAW", DRAW.replace("{seed}", "5")))
def chrom_bootstrap_mean(t):
    rows = M.per_chrom_metric_difference(counted(t), ["distance_band"], "score", "score2", "hit", "auroc")
    return R.chrom_bootstrap_mean(rows, ["distance_band"], "difference", replicates=REPLICATES, seed=5)


STEPS["uniforms"] = """
select context_index, pair_id, full_count, cast(cast('0x' || substr(md5('7|' || cast(context_index as varchar) || '|' || cast(pair_id as varchar)), 1, 13) as bigint) as double) / 4503599627370496 as u from {counts}"""


@query("cap_events", """
select context_index, pair_id, full_count from {uniforms} qualify row_number() over (partition by context_index order by u, pair_id) <= 1000""")
def cap_events(t):
    return R.cap_events(t.counts.select("context_index", "pair_id", "full_count"), ["context_index"], 1000, seed=7)


@query("first_n_per_context", """
select context_index, pair_id from {counts} qualify row_number() over (partition by context_index order by pair_id) <= 16""")
def first_n_per_context(t):
    return R.first_n(t.counts.select("context_index", "pair_id"), ["context_index"], "pair_id", 16)


@query("tile_order", """
select tile_id, cast(cast('0x' || substr(md5('3|1|' || tile_id), 1, 13) as bigint) as double) / 4503599627370496 as order_key from {tiles} order by 2, 1 limit 20""")
def tile_order(t):
    return R.tile_order(t.tiles, 3, 1, 20).select("tile_id", "order_key")


@query("sample_contexts", """
select tile_id, list_aggregate(list_sort(list(c)), 'string_agg', ',') as contexts from (select tile_id, c, row_number() over (partition by tile_id order by
 cast('0x' || substr(md5('3|1|' || tile_id || '|' || cast(c as varchar)), 1, 13) as bigint), c) as r from {tiles}, range(0, 5) x(c)) where r <= 3 group by 1""")
def sample_contexts(t):
    return R.sample_contexts(t.tiles, [0, 1, 2, 3, 4], 3, 1, 3).select("tile_id", F.array_join("context_indices", ",").alias("contexts"))


@query("verification_sample", """
with s as (select pair_id, score from {scored} order by cast('0x' || substr(md5('9|' || cast(pair_id as varchar)), 1, 13) as bigint), pair_id limit 1000)
select count(*) as rows, 0 as missing, cast(0 as double) as max_error, true as passed from s""")
def verification_sample(t):
    stored = R.verification_sample(t.scored.select("pair_id", "score"), ["pair_id"], 1000, 9)
    return R.verification_report(stored, t.scored, ["pair_id"], "score", 0.01)
