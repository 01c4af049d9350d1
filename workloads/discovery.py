"""Loop catalogs, contexts, maps, scoring and streaming queries."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from contactspark.functions import scalars as S
from contactspark.operators import catalog as C
from contactspark.operators import contacts as K
from contactspark.operators import contexts as X
from contactspark.operators import evidence as E
from contactspark.operators import maps as Map
from contactspark.operators import rates as R
from contactspark.operators import scoring as Sc
from contactspark.operators.ordered import use_checkpoints
from contactspark.plans import recovery as Rec
from contactspark.sources.text import parse_bedpe
from contactspark.streaming.ingest import counted as stream_counted
from contactspark.streaming.ingest import ingest_contacts_stream
from workloads.annotation import contact_lines, ep_table
from workloads.base import BIN_SIZE, CONTEXTS, OUTPUTS, SPLITS, STEPS, drawn, query
from workloads.modelling import centered

STEPS["calls"] = """
select chrom1 as chrom, p1 - p1 % 10000 as bin_i, p2 - p2 % 10000 as bin_j, cell_type as member, source, call_probability as probability from (
 select chrom1, least(pos1, pos2) - least(pos1, pos2) % 5000 as p1, greatest(pos1, pos2) - greatest(pos1, pos2) % 5000 as p2, cell_type, case when l % 2 = 0 then 'x' else 'y' end as source, call_probability
 from (select *, read_id % 10 as l from {raw_contacts}) r join {membership} using (library_id, dna_barcode) where chrom1 = chrom2 and q >= 30)
where p2 - p2 % 10000 - (p1 - p1 % 10000) >= 250000 and p2 - p2 % 10000 - (p1 - p1 % 10000) < 1000000"""


def raw_calls(t, source=None):
    m = t.raw_contacts.filter("chrom1 = chrom2 and q >= 30").join(t.membership.select("library_id", "dna_barcode", "cell_type"), ["library_id", "dna_barcode"])
    if source:
        m = m.filter("read_id % 10 % 2 = 0" if source == "x" else "read_id % 10 % 2 = 1")
    p1, p2 = S.floor_to("pos1", 5000), S.floor_to("pos2", 5000)
    return m.select(F.col("chrom1").alias("chrom_i"), p1.alias("start_i"), (p1 + 5000).alias("end_i"), F.col("chrom2").alias("chrom_j"), p2.alias("start_j"),
                    (p2 + 5000).alias("end_j"), F.col("cell_type").alias("member"), F.col("call_probability").alias("probability"))


@query("read_bedpe", "select distinct chrom, bin_i, bin_j, member from {calls}")
def read_bedpe(t):
    return parse_bedpe(raw_calls(t))


@query("read_loops8", "select chrom, bin_i, bin_j, max(probability) as probability from {calls} where bin_j - bin_i <= 990000 group by 1, 2, 3")
def read_loops8(t):
    from contactspark.sources.text import check_loops8

    c = C.collapse_calls(raw_calls(t)).groupBy("chrom", "bin_i", "bin_j").agg(F.max("probability").alias("probability"))
    lines = c.select(F.col("chrom").alias("chrom_i"), F.col("bin_i").alias("start_i"), (F.col("bin_i") + 10000).alias("end_i"), F.col("chrom").alias("chrom_j"),
                     F.col("bin_j").alias("start_j"), (F.col("bin_j") + 10000).alias("end_j"), "probability")
    return check_loops8(lines)


@query("collapse_calls", "select chrom, bin_i, bin_j, member, max(probability) as probability from {calls} group by 1, 2, 3, 4")
def collapse_calls(t):
    return C.collapse_calls(raw_calls(t))


STEPS["consensus"] = """
select chrom, bin_i, bin_j, member, max(probability) filter (source = 'x') as probability from {calls} group by 1, 2, 3, 4
having count(*) filter (source = 'x') > 0 and count(*) filter (source = 'y') > 0"""


def consensus(t):
    return C.member_consensus(C.collapse_calls(raw_calls(t, "x")), parse_bedpe(raw_calls(t, "y")))


@query("member_consensus", "select * from {consensus}")
def member_consensus(t):
    return consensus(t)


@query("catalog_overlap", """
with c as (select member, chrom, bin_i, bin_j, bool_or(source = 'x') as x, bool_or(source = 'y') as y from {calls} group by 1, 2, 3, 4)
select member, count(*) filter (x) as calls_a, count(*) filter (y) as calls_b, count(*) filter (x and y) as shared_calls,
 count(*) filter (x and y) / count(*) filter (x) as share_of_a, count(*) filter (x and y) / count(*) filter (y) as share_of_b from c group by 1""")
def catalog_overlap(t):
    return C.catalog_overlap(parse_bedpe(raw_calls(t, "x")), parse_bedpe(raw_calls(t, "y")))


STEPS["catalog"] = """
select output_id as family, chrom, bin_i, bin_j, count(distinct c.member) as member_support, string_agg(distinct c.member, ',' order by c.member) as source_members,
 (select count(*) from {pools} p where p.output_id = f.output_id) as family_member_count,
 count(distinct c.member) / (select count(*) from {pools} p where p.output_id = f.output_id) as member_fraction
from {calls} c join {pools} f on f.member = c.member group by 1, 2, 3, 4, f.output_id"""


def catalog(t):
    return C.catalog_support(parse_bedpe(raw_calls(t)), t.pools)


@query("catalog_support", "select * from {catalog}")
def catalog_support(t):
    return catalog(t)


STEPS["labelled"] = """
select s.*, exists (select 1 from {catalog} c where c.family = 'P1' and c.member_fraction = 1 and c.chrom = s.chrom and c.bin_i = s.bin_i and c.bin_j = s.bin_j) as exact,
 (s.chrom, s.bin_i, s.bin_j) in (select c.chrom, c.bin_i + a * 10000, c.bin_j + b * 10000 from {catalog} c, range(-1, 2) x(a), range(-1, 2) y(b) where c.family = 'P1' and c.member_fraction = 1) as near
from {scored} s"""


def full_loops(t):
    return catalog(t).filter("family = 'P1' and member_fraction = 1")


@query("loop_labels", "select pair_id, exact, near from {labelled}")
def loop_labels(t):
    rows = C.loop_labels(t.universe, full_loops(t), 0, BIN_SIZE, "exact")
    return C.loop_labels(rows, full_loops(t), 1, BIN_SIZE, "near").select("pair_id", "exact", "near")


STEPS["pair_support"] = """
select family, pair_id, max(member_fraction) as support from {universe} u join (select family, member_fraction, chrom, bin_i + a * 10000 as bin_i, bin_j + b * 10000 as bin_j
 from {catalog}, range(-1, 2) x(a), range(-1, 2) y(b)) c using (chrom, bin_i, bin_j) group by 1, 2"""


@query("support_to_pairs", "select * from {pair_support}")
def support_to_pairs(t):
    return C.support_to_pairs(t.universe, catalog(t), 1, BIN_SIZE)


@query("support_pair_counts", """
select 'anchor_tolerance_10kb' as mode, family, count(*) as pairs from {pair_support} where support > 0 group by 2
union all select 'exact', family, count(*) from {universe} join {catalog} using (chrom, bin_i, bin_j) group by 2""")
def support_pair_counts(t):
    return C.support_pair_counts(t.universe, catalog(t), BIN_SIZE)


STEPS["directed"] = """
with w as (select pair_id, coalesce(max(support) filter (family = 'P1'), 0) as a, coalesce(max(support) filter (family = 'P2'), 0) as b from {pair_support} where family in ('P1', 'P2') group by 1)
select w.pair_id, distance_band, a > b as label, (a > 0) <> (b > 0) as exclusive, ln(score + 0.01) - ln(score2 + 0.01) as delta from w join {scored} using (pair_id) where a <> b"""


def directed(t):
    support = C.support_to_pairs(t.universe, catalog(t), 1, BIN_SIZE)
    p = t.scored.select("pair_id", "distance_band", (F.col("score") + 0.01).alias("p_a"), (F.col("score2") + 0.01).alias("p_b"))
    return C.direction_pairs(support, p, "P1", "P2")


@query("exclusive_direction", "select pair_id, label, exclusive, delta from {directed}")
def exclusive_direction(t):
    return directed(t).select("pair_id", "label", "exclusive", "delta")


@query("family_identity", """
with r as (select *, rank() over (partition by distance_band order by delta) + (count(*) over (partition by distance_band, delta) - 1) / 2 as r from {directed}),
d as (select distance_band, delta, count(*) as n, count(*) filter (label) as p from {directed} group by 1, 2),
c as (select distance_band, p, sum(n) over w as cn, sum(p) over w as cp, sum(p) over (partition by distance_band) as tp from d window w as (partition by distance_band order by delta desc)),
ap as (select distance_band, sum(p / tp * (cp / cn)) as ap from c group by 1)
select distance_band, count(*) as candidates, count(*) filter (label) as positives, count(*) filter (label) / count(*) as prevalence, max(ap) as auprc, max(ap) / (count(*) filter (label) / count(*)) as auprc_lift,
 (sum(r) filter (label) - count(*) filter (label) * (count(*) filter (label) + 1) / 2) / (count(*) filter (label) * count(*) filter (not label)) as auroc,
 avg(cast((delta > 0) = label as int)) as direction_accuracy, (avg(cast(delta > 0 as int)) filter (label) + avg(cast(delta <= 0 as int)) filter (not label)) / 2 as balanced_direction_accuracy
from r join ap using (distance_band) group by 1""")
def family_identity(t):
    return Rec.identity_table(directed(t), ["distance_band"])


SOURCES = {"score": "score", "raw_oe": "raw_oe", "smoothed_oe": "smoothed_oe", "distance_only": "-distance_bp", "swapped": "score2"}
STEPS["loop_wide"] = """
with o as (select *, case when avg(counts_a) over (partition by distance_bp) > 0 then counts_a / avg(counts_a) over (partition by distance_bp) else 0 end as raw_oe from {labelled}),
s as (select o.pair_id, sum(n.raw_oe) as smoothed_oe from o join (select o.chrom, o.bin_i + a * 10000 as bin_i, o.bin_j + b * 10000 as bin_j, raw_oe from o, range(-1, 2) x(a), range(-1, 2) y(b)) n
  on n.chrom = o.chrom and n.bin_i = o.bin_i and n.bin_j = o.bin_j group by 1),
l as (select o.*, smoothed_oe from o join s using (pair_id))
select * replace (round(score, 9) as score, round(score2, 9) as score2, round(raw_oe, 9) as raw_oe, round(smoothed_oe, 9) as smoothed_oe) from l"""
STEPS["loop_long"] = """
select l.pair_id, l.chrom, l.distance_band, l.counts_a, l.exact, l.near, v.source, v.value from {loop_wide} l, unnest([{'source': 'score', 'value': score}, {'source': 'raw_oe', 'value': raw_oe},
 {'source': 'smoothed_oe', 'value': smoothed_oe}, {'source': 'distance_only', 'value': -distance_bp}, {'source': 'swapped', 'value': score2}]) x(v)"""
STEPS["loop_sources"] = """
select 'exact' as mode, distance_band, source, value, cast(exact as int) as hit from {loop_long} union all select 'anchor_tolerance_10kb', distance_band, source, value, cast(near as int) from {loop_long}"""


RECOVERY = """
with d as (select mode, distance_band, source, value, count(*) as n, sum(hit) as p from {loop_sources} group by 1, 2, 3, 4),
c as (select *, sum(n) over w as cn, sum(p) over w as cp, sum(n) over g as tn, sum(p) over g as tp from d window g as (partition by mode, distance_band, source), w as (partition by mode, distance_band, source order by value desc)),
m as (select mode, distance_band, source, max(tn) as n, max(tp) as p, sum(p / tp * (cp / cn)) as ap, sum((n - p) * (cp - p + p / 2)) / max(tp * (tn - tp)) as auc from c group by 1, 2, 3),
k as (select mode, distance_band, source, tp, tn, cast(greatest(1, ceil(tn * cast(0.01 as double))) as bigint) as k, cp - p + (ceil(tn * cast(0.01 as double)) - cn + n) * (p / n) as e from c where cn >= ceil(tn * cast(0.01 as double)) and cn - n < ceil(tn * cast(0.01 as double)))
select mode, distance_band, source, cast(m.n as bigint) as candidates, cast(m.p as bigint) as positives, m.p / m.n as prevalence, ap as auprc, ap / (m.p / m.n) as auprc_lift, auc as auroc, k,
 e / k as top1_precision, e / tp as top1_recall, (e / k) / (tp / tn) as top1_enrichment from m join k using (mode, distance_band, source)"""


def loop_pairs(t):
    rows = Rec.with_count_scores(t.scored, "counts_a", BIN_SIZE)
    # sums of neighbours come in any order: rounding keeps equal sums equal
    rows = rows.withColumns({"raw_oe": F.round("raw_oe", 9), "smoothed_oe": F.round("smoothed_oe", 9)})
    return rows.withColumns({"score": F.round("score", 9), "score2": F.round("score2", 9)})


@query("loop_recovery", RECOVERY)
def loop_recovery(t):
    return Rec.loop_recovery(loop_pairs(t), full_loops(t), SOURCES, BIN_SIZE)


@query("ep_recovery")
def ep_recovery(t):
    marks = ep_table(t).select("pair_id", "dELS", "pELS", "ELS", "promoter_key")
    rows = R.owner_band_probability(centered(t).withColumn("rate", F.exp("eta")), "rate").withColumnRenamed("probability", "family_p")
    rows = R.owner_band_probability(rows, "exposure").withColumnRenamed("probability", "shared_p").join(marks, "pair_id")
    return Rec.ep_recovery(rows, ["dELS", "pELS", "ELS"], "full_count", "family_p", "shared_p")


def cells(t):
    return t.embeddings.select(F.concat(F.lit("ct"), F.col("label").cast("string")).alias("cell_type"), "embedding")


STEPS["centroids"] = """
select 'ct' || cast(label as varchar) as cell_type, count(*) as n_cells, avg(cast(embedding[1] as double)) as e0, avg(cast(embedding[64] as double)) as e63 from {embeddings} group by 1"""


@query("centroids", "select * from {centroids}")
def centroids(t):
    return X.centroids(cells(t), 64).select("cell_type", "n_cells", F.col("embedding")[0].alias("e0"), F.col("embedding")[63].alias("e63"))


@query("pool_centroids", """
with c as (select label, avg(cast(embedding[1] as double)) as e0 from {embeddings} group by 1)
select 'L' || cast(label % 3 as varchar) as output_id, avg(e0) as e0 from c group by 1""")
def pool_centroids(t):
    c = X.centroids(cells(t), 64)
    pools = c.select(F.concat(F.lit("L"), (F.substring("cell_type", 3, 9).cast("int") % 3).cast("string")).alias("output_id"), F.col("cell_type").alias("member"))
    return X.pool_centroids(c, pools, 64).select("output_id", F.col("embedding")[0].alias("e0"))


@query("compare_centroids", """
select cast(0.00005 as double) as max_abs, cast(0.00005 as double) as mean_abs, cast(0.00005 as double) as rmse, count(*) > 0 as accepted from {embeddings}""")
def compare_centroids(t):
    c = X.centroids(cells(t), 64)
    return X.compare_centroids(c, c.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.00005))))


@query("contexts_with_centroids", """
select context_index, cell_type, n_cells, valid_pairs, n_cells / 2 as first_value from {contexts}""")
def contexts_with_centroids(t):
    vectors = t.contexts.select("cell_type", "n_cells", F.array(F.col("n_cells") / 2).alias("embedding"))
    return X.contexts_with_centroids(t.contexts, vectors).select("context_index", "cell_type", "n_cells", "valid_pairs", F.col("embedding")[0].alias("first_value"))


@query("select_contexts", """
select cell_type, n_cells, case cell_type when 'MACHINERY' then 0 when 'BUILDING' then 1 end as place from {contexts}""")
def select_contexts(t):
    return X.select_contexts(t.contexts, ["MACHINERY", "BUILDING"]).select("cell_type", "n_cells", "place")


@query("align_by_pair_id", "select pair_id, score from {scored} where split = 'validation'")
def align_by_pair_id(t):
    v = t.scored.filter("split = 'validation'")
    return X.align_by_pair_id([v.filter("pair_id % 2 = 0"), v.filter("pair_id % 2 = 1")], t.universe.filter("split = 'validation'"), "score")


@query("alignment_report", """
select count(*) filter (pair_id % 7 = 0) as missing, count(*) filter (pair_id % 10 = 1 and pair_id % 7 <> 0) as repeated, 0 as unknown,
 count(*) filter (score = 0 and pair_id % 7 <> 0) + count(*) filter (score = 0 and pair_id % 10 = 1 and pair_id % 7 <> 0) as not_finite from {scored}""")
def alignment_report(t):
    rows = t.scored.withColumn("score", F.when(F.col("score") == 0, F.lit(float("nan"))).otherwise(F.col("score"))).filter("pair_id % 7 <> 0")
    return X.alignment_report([rows, rows.filter("pair_id % 10 = 1")], t.universe, "score")


@query("fine_to_coarse", """
with p as (select pair_id, chrom, bin_i - bin_i % 50000 as ci, bin_j - bin_j % 50000 as cj, exposure from {scored})
select pair_id, (sum(exposure) over (partition by chrom, ci, cj) / sum(exposure) over ()) * (exposure / sum(exposure) over (partition by chrom, ci, cj)) * 1000000 as per_million from p""")
def fine_to_coarse(t):
    key = F.concat_ws(":", "chrom", S.floor_to("bin_i", 50_000).cast("string"), S.floor_to("bin_j", 50_000).cast("string"))
    rows = t.scored.select("pair_id", key.alias("coarse_id"), "exposure")
    sums = rows.groupBy("coarse_id").agg(F.sum("exposure").alias("mass"))
    total = sums.agg(F.sum("mass").alias("total"))
    coarse = sums.join(F.broadcast(total)).select("coarse_id", (F.col("mass") / F.col("total")).alias("probability"))  # a single row
    fine = rows.join(sums, "coarse_id").select("pair_id", "coarse_id", (F.col("exposure") / F.col("mass")).alias("within"))
    # small shares, so in millionths: six places are compared
    return X.fine_to_coarse(fine, coarse).select("pair_id", (F.col("probability") * 1_000_000).alias("per_million"))


def deltas(t):
    rows = t.counts.join(t.contexts.select("context_index", F.col("cell_type").alias("output_id")), "context_index")
    return rows.select("output_id", "pair_id", (F.col("counts_a") / F.col("full_count")).alias("delta"))


STEPS["deltas"] = """select cell_type as output_id, pair_id, counts_a / full_count as delta from {counts} join {contexts} using (context_index)"""


@query("rotated_control", """
select d.output_id, d.pair_id, d.delta, c.delta as control_delta from {deltas} d join {deltas} c on c.pair_id = d.pair_id and c.output_id =
 case d.output_id when 'AUTOMOBILE' then 'BUILDING' when 'BUILDING' then 'FURNITURE' when 'FURNITURE' then 'HOUSEHOLD' when 'HOUSEHOLD' then 'MACHINERY' else 'AUTOMOBILE' end""")
def rotated_control(t):
    turn = X.rotated_outputs(CONTEXTS)
    control = t.contexts.select(F.col("cell_type").alias("output_id")).withColumn(
        "control_id", F.create_map(*[F.lit(x) for kv in turn.items() for x in kv])[F.col("output_id")])
    return X.attach_control(deltas(t), control)


@query("permuted_control", """
with o as (select cell_type as output_id, row_number() over (order by cast('0x' || substr(md5('71|' || cell_type), 1, 13) as bigint), cell_type) as r, count(*) over () as n from {contexts})
select a.output_id, b.output_id as control_id, (select count(*) from {deltas} d where d.output_id = a.output_id) as pairs from o a join o b on b.r - 1 = a.r % a.n""")
def permuted_control(t):
    control = X.permuted_outputs(t.contexts.select(F.col("cell_type").alias("output_id")), 71)
    return control.join(deltas(t).groupBy("output_id").agg(F.count(F.lit(1)).alias("pairs")), "output_id")


@query("cell_type_libraries", """
select cell_type, count(distinct barcode) as cells, string_agg(distinct 'DNA' || substr(barcode, 4, 2), ',' order by 'DNA' || substr(barcode, 4, 2)) as libraries from {rna_long} group by 1""")
def cell_type_libraries(t):
    return X.library_sets(t.rna_long.withColumn("library_id", F.concat(F.lit("DNA"), F.substring("barcode", 4, 2))))


def simple_cells(t):
    """Shared counts of every pair as map cells of its owner tile."""
    rows = t.scored.join(t.tiles.select("tile_row", "target_start"), "tile_row")
    return rows.select("tile_row", "split", "distance_band", S.fdiv(F.col("bin_i") - F.col("target_start"), BIN_SIZE).alias("i"),
                       S.fdiv(F.col("bin_j") - F.col("target_start"), BIN_SIZE).alias("j"), F.col("full_count").alias("count"),
                       (F.col("full_count") / F.col("exposure")).alias("value"), "score")


STEPS["map_cells"] = """
select tile_row, s.split, cast((bin_i - target_start) / 10000 as bigint) as i, cast((bin_j - target_start) / 10000 as bigint) as j, full_count, full_count / exposure as value, score
from {scored} s join {tiles} t using (tile_row)"""
STEPS["expected"] = """select j - i as distance, sum(value) as sum_pixels, count(*) as n_pixels, sum(value) / count(*) as expected from {map_cells} where split = 'train' and value <> 0 group by 1"""


@query("map_expected", "select * from {expected}")
def map_expected(t):
    rows = simple_cells(t)
    return Map.map_expected(rows, t.tiles.filter("split = 'train'"))


@query("expected_table", """
with e as (select context_index, (bin_j - bin_i) / 10000 as distance, sum(full_count / exposure) as s, count(*) as n from (select c.context_index, c.full_count, s.exposure, s.bin_i, s.bin_j from {counts} c join {scored} s using (pair_id) where s.split = 'train') group by 1, 2)
select d.distance, c.context_index, coalesce(s, 0) as sum_pixels, coalesce(n, 0) as n_pixels, s / n as expected, min(s / n) over (partition by c.context_index) as epsilon, d.distance * 10000 as distance_bp
from range(0, 100) d(distance), range(0, 5) c(context_index) left join e on e.distance = d.distance and e.context_index = c.context_index""")
def expected_table(t):
    rows = t.counts.select("context_index", "pair_id", F.col("full_count").alias("c")).join(
        t.scored.select("pair_id", "tile_row", "split", "exposure", F.lit(0).cast("long").alias("i"), F.col("distance_bin").cast("long").alias("j")), "pair_id")
    rows = rows.withColumn("value", F.col("c") / F.col("exposure")).filter("split = 'train'")
    per = Map.map_expected(rows, t.tiles, ("context_index",))
    return Map.expected_table(per, list(range(5)), 100, BIN_SIZE)


STEPS["normalized"] = """
select tile_row, i, j, ln((value + (select min(expected) from {expected})) / (expected + (select min(expected) from {expected}))) as target, score from {map_cells} join {expected} on distance = j - i"""


@query("map_normalize", "select tile_row, i, j, target from {normalized}")
def map_normalize(t):
    rows = simple_cells(t)
    return Map.map_normalize(rows, Map.map_expected(rows, t.tiles.filter("split = 'train'")))


@query("map_errors", """
select tile_row, avg((score - target) * (score - target)) as mse, corr(score, target) as pearson, count(*) as pixels from {normalized} group by 1""")
def map_errors(t):
    rows = simple_cells(t)
    target = Map.map_normalize(rows, Map.map_expected(rows, t.tiles.filter("split = 'train'")))
    return Map.map_errors(target.join(rows.select("tile_row", "i", "j", "score"), ["tile_row", "i", "j"]), ["tile_row"], "score", "target")


@query("balanced_observed", """
with w as (select chrom, bin, 1 + (bin / 10000) % 5 as w from (select chrom, bin_i as bin from {pixels} where chrom = chrom2 union select chrom, bin_j from {pixels} where chrom = chrom2) where (bin / 10000) % 11 <> 0)
select tile_row, cast((p.bin_i - target_start) / 10000 as bigint) as i, cast((p.bin_j - target_start) / 10000 as bigint) as j, "count", "count" * a.w * b.w / 7 as observed
from {pixels} p left join w a on a.chrom = p.chrom and a.bin = p.bin_i left join w b on b.chrom = p.chrom and b.bin = p.bin_j
join {tiles} t on t.chrom = p.chrom and p.bin_i >= target_start and p.bin_j + 10000 <= target_end where p.chrom = p.chrom2""")
def balanced_observed(t):
    from workloads.counting import pixels

    per = pixels(t)
    bins = per.filter("chrom = chrom2").select("chrom", F.explode(F.array("bin_i", "bin_j")).alias("bin")).distinct()
    weights = bins.filter("cast(bin / 10000 as bigint) % 11 <> 0").select("chrom", "bin", (1 + S.fdiv("bin", BIN_SIZE) % 5).cast("double").alias("weight"))
    return Map.balanced_observed(per, weights, 7, t.tiles, BIN_SIZE)


STEPS["cis_pixels"] = """
select chrom1 as chrom, bin_i, bin_j, count(*) as c from {anchored} where chrom1 = chrom2 group by all"""
STEPS["balancing_bins"] = """
with e as (select chrom, bin_i as bin, c from {cis_pixels} union all select chrom, bin_j, c from {cis_pixels}),
r as (select chrom, bin, sum(c) as m, count(*) as nnz from e group by all), l as (select *, ln(m / quantile_cont(m, 0.5) over (partition by chrom)) as l from r),
g as (select *, quantile_cont(l, 0.5) over () as centre from l), d as (select *, quantile_cont(abs(l - centre), 0.5) over () as spread from g)
select chrom, bin, nnz >= 10 and l >= centre - 5 * spread as kept from d"""


def cis_pixels(t):
    return K.contacts_to_pixels(t.raw_contacts.filter("chrom1 = chrom2"), BIN_SIZE)


@query("ice_balance")
def ice_balance(t):
    return Map.ice_balance(cis_pixels(t))


@query("ice_marginals", """
select chrom, bin, kept, case when kept then cast(1 as double) end as marginal from {balancing_bins}""")
def ice_marginals(t):
    """Sums of the balanced pixels of each bin: one for every bin that is kept, to four places."""
    pixels = cis_pixels(t)
    w = Map.ice_balance(pixels, tolerance=1e-12)
    left, right = (w.select("chrom", F.col("bin").alias(f"bin_{c}"), F.col("weight").alias(f"w{c}")) for c in "ij")
    value = F.col("count") * F.col("wi") * F.col("wj")
    sums = pixels.select("chrom", "bin_i", "bin_j", "count").join(left, ["chrom", "bin_i"]).join(right, ["chrom", "bin_j"]).select(
        "chrom", F.explode(F.array("bin_i", "bin_j")).alias("bin"), value.alias("v")).groupBy("chrom", "bin").agg(F.sum("v").alias("v"))
    return w.join(sums, ["chrom", "bin"], "left").select("chrom", "bin", F.col("weight").isNotNull().alias("kept"), F.when(F.col("weight").isNotNull(), F.round("v", 4)).alias("marginal"))


@query("adaptive_smooth", """
with l as (select c.*, v as level, cast(floor(i / (2 ** v)) as bigint) as bi, cast(floor(j / (2 ** v)) as bigint) as bj from {map_cells} c, range(0, 5) x(v)),
b as (select tile_row, level, bi, bj, sum(full_count) as c, avg(value) as v from l group by 1, 2, 3, 4),
r as (select l.tile_row, l.i, l.j, l.level, c, v, row_number() over (partition by l.tile_row, l.i, l.j order by case when c >= 2 then l.level else 100 - l.level end) as n from l join b using (tile_row, level, bi, bj))
select tile_row, i, j, v as value, level from r where n = 1""")
def adaptive_smooth(t):
    rows = simple_cells(t).withColumnRenamed("value", "observed")
    return Map.adaptive_smooth(rows, 100)


def network(size: int, technical: int, hidden: int = 16, programs: int = 4, context: int = 5) -> dict:
    """Small fixed weights from a cosine rule, so that runs agree everywhere."""
    def table(rows, cols, shift):
        return np.cos(np.arange(rows * cols).reshape(rows, cols) * 0.7 + shift) / np.sqrt(cols)

    return {"layer1": {"w": table(hidden, size, 0.1), "b": np.zeros(hidden)}, "layer2": {"w": table(hidden, hidden, 0.2), "b": np.zeros(hidden)},
            "score": {"w": table(1, hidden, 0.3), "b": np.zeros(1)}, "technical": {"w": table(1, technical, 0.4)},
            "programs": {"w": table(programs, hidden, 0.5), "b": np.zeros(programs)}, "projection": {"w": table(programs, context, 0.6)}}


def network_inputs(t):
    rows = t.scored.select(
        "pair_id", "tile_row", "distance_bin", "distance_band", "split", "exposure", "distance_offset", "full_count",
        F.array("score", "score2").alias("pair_vector"), F.array("score", "exposure").alias("anchor_i"), F.array("score2", "exposure").alias("anchor_j"),
        F.array("score").alias("annotation_i"), F.array("score2").alias("annotation_j"), F.array("score").alias("pair_annotation"),
        F.array("exposure").alias("technical_i"), F.array("score").alias("technical_j"), F.col("score").alias("technical_pair"))
    return Sc.feature_columns(rows)


KEPT = ["pair_id", "tile_row", "distance_bin", "distance_band", "split", "exposure", "distance_offset"]


# error function at multiples of 1/512 by its series of positive terms, with slopes
STEPS["erf_grid"] = """
select n, coalesce(exp(-power(n / 512e0, 2)) * list_sum([exp((2 * k + 1) * ln(n / 512e0) - lgamma(k + 1.5e0)) for k in range(0, 220) if n > 0]), 0) as value,
  2 / sqrt(pi()) * exp(-power(n / 512e0, 2)) as slope from range(0, 3075) g(n)"""


def layer_text(values: str, size: int, shift: float, units: int = 16) -> str:
    """One layer: sums by the cosine weights, then the gate by the error function, interpolated on the grid."""
    return f"""
with w as (select r, [cos((r * {size} + c) * 0.7e0 + {shift}e0) / sqrt({size}) for c in range(0, {size})] as w from range(0, {units}) u(r)),
z as (select pair_id, r, list_inner_product(x, w) as z from {values} v, w),
e as (select *, least(abs(z / sqrt(2e0)), 6e0) * 512 as far from z),
f as (select e.*, far - floor(far) as u, a.value as v0, a.slope as s0, b.value as v1, b.slope as s1 from e join {{erf_grid}} a on a.n = cast(floor(far) as bigint) join {{erf_grid}} b on b.n = cast(floor(far) as bigint) + 1)
select pair_id, list(0.5e0 * z * (1 + sign(z) * ((1 + 2 * u) * (1 - u) * (1 - u) * v0 + u * u * (3 - 2 * u) * v1 + u * (1 - u) * ((1 - u) * s0 - u * s1) / 512)) order by r) as x from f group by 1"""


STEPS["network_inputs"] = """
select pair_id, [score, score2, score + score2, exposure + exposure, abs(score - score2), 0, score + score2, abs(score - score2), score] as x,
  [score, exposure + score, abs(exposure - score)] as technical from {scored}"""
STEPS["hidden1"] = layer_text("{network_inputs}", 9, 0.1)
STEPS["hidden2"] = layer_text("{hidden1}", 16, 0.2)
STEPS["network_scores"] = """
select pair_id, list_inner_product(h.x, [cos(c * 0.7e0 + 0.3e0) / 4 for c in range(0, 16)]) as residual_score,
  list_inner_product(technical, [cos(c * 0.7e0 + 0.4e0) / sqrt(3e0) for c in range(0, 3)]) as technical_offset, h.x as hidden
from {hidden2} h join {network_inputs} using (pair_id)"""
# intercepts that make training sums agree, with a dispersion of a quarter
STEPS["band_levels"] = """
select distance_band, ln(sum(full_count) / sum(exposure * exp(distance_offset))) as alpha from {scored} where split = 'train' group by 1"""


def band_levels(t):
    rows = t.scored.filter("split = 'train'").groupBy("distance_band").agg(
        F.log(F.sum("full_count") / F.sum(F.col("exposure") * F.exp("distance_offset"))).alias("alpha"))
    return rows.withColumn("dispersion", F.lit(0.25))


def bounds_text(table: str, mean: str) -> str:
    """Cumulative probabilities under dispersion 1/4: a fourth success after more than k failures is at most three in k + 4 trials."""
    return f"""
select *, len(list_filter(cdf, lambda c: c < 0.025e0)) as lower, len(list_filter(cdf, lambda c: c < 0.975e0)) as upper from (
 select *, [1 - (power(q, k + 4) + (k + 4) * p * power(q, k + 3) + (k + 4) * (k + 3) / 2 * p * p * power(q, k + 2) + (k + 4) * (k + 3) * (k + 2) / 6 * p * p * p * power(q, k + 1))
   for k in range(0, (select cast(40 + 12 * max({mean}) as bigint) from {table}))] as cdf
 from (select *, 4 / (4 + {mean}) as p, {mean} / (4 + {mean}) as q from {table}))"""


@query("score_pairs", "select pair_id, residual_score, technical_offset from {network_scores}")
def score_pairs(t):
    return Sc.score_pairs(network_inputs(t), network(9, 3), ["pair_id"])


@query("context_delta", """
with p as (select pair_id, [list_inner_product(hidden, [cos((p * 16 + c) * 0.7e0 + 0.5e0) / 4 for c in range(0, 16)]) for p in range(0, 4)] as v from {network_scores}),
k as (select context_index as k, cell_type as output_id, [cos((p * 5 + context_index) * 0.7e0 + 0.6e0) / sqrt(5e0) - list_avg([cos((p * 5 + o) * 0.7e0 + 0.6e0) / sqrt(5e0) for o in range(0, 5)])
  for p in range(0, 4)] as w from {contexts}),
d as (select pair_id, output_id, list_inner_product(v, w) / sqrt(list_inner_product(v, v)) as d from p, k)
select pair_id, tile_row, distance_bin, output_id, d - avg(d) over (partition by output_id, tile_row, distance_bin) as delta from d join {universe} using (pair_id)""")
def context_delta(t):
    scored = Sc.score_pairs(network_inputs(t), network(9, 3), KEPT, np.eye(5))
    return Sc.context_deltas(scored, CONTEXTS)


STEPS["sparse_rates"] = """
select *, rate / 4 as expected_count from (select pair_id, tile_row, distance_band,
  exp(ln(exposure) + distance_offset + residual_score - avg(residual_score) over (partition by tile_row, distance_bin) + alpha) as rate
  from {network_scores} join {scored} using (pair_id) join {band_levels} using (distance_band))"""


@query("predict_sparse", f"""
with b as ({bounds_text("{sparse_rates}", "expected_count")}),
u as (select *, {drawn(5, "tile_row", "pair_id")} as u from b)
select pair_id, expected_count, lower, upper, len(list_filter(cdf, lambda c: c < u)) as simulated_count,
  rate / sum(rate) over (partition by tile_row, distance_band) * 1000000 as per_million from u""")
def predict_sparse(t):
    scored = Sc.score_pairs(network_inputs(t), network(9, 3), KEPT)
    out = Sc.predict_sparse(scored, "residual_score", band_levels(t), depth=250_000, seed=5)
    return out.select("pair_id", "expected_count", "lower", "upper", "simulated_count", (F.col("probability") * 1_000_000).alias("per_million"))


STEPS["output_rates"] = """
select pair_id, tile_row, distance_band, delta, centered + delta as residual, exp(eta + distance_offset + delta + alpha) as rate
from {centered} join {band_levels} using (distance_band), (select unnest([0e0, 0.1e0]) as delta)"""


@query("export_rates", f"""
with b as (select *, rate / sum(rate) over (partition by delta, tile_row, distance_band) * 1000000 as per_million from ({bounds_text("{output_rates}", "rate")}))
select cell_type as output_id, pair_id, tile_row, distance_band, rate, lower, upper, residual, per_million
from b join {{contexts}} on delta = case when context_index = 1 then 0.1e0 else 0 end""")
def export_rates(t):
    rollout = t.contexts.select(F.col("cell_type").alias("output_id"), F.lit("shared").alias("calibration_source"),
                                F.when(F.col("context_index") < 2, F.col("cell_type")).alias("delta_source"))
    calibration = band_levels(t).withColumn("output_id", F.lit("shared"))
    full = t.universe.select("pair_id", F.inline(F.array(*[F.struct(F.lit(c).alias("output_id"), F.lit(n * 0.1).alias("delta")) for n, c in enumerate(CONTEXTS[:2])])))
    out = Sc.export_rates(t.scored, "score", full, rollout, calibration, CONTEXTS)
    return out.withColumn("per_million", F.col("probability") * 1_000_000).drop("probability")


@query("stream_ingest", """
select context_index, r.pair_id, count(*) as full_count from (
 select m.context_index, u.pair_id from {anchored} a join {membership} m using (library_id, dna_barcode) join {universe} u on a.chrom1 = u.chrom and a.bin_i = u.bin_i and a.bin_j = u.bin_j
 where a.chrom1 = a.chrom2 and read_id % 97 <> 0 and read_id % 89 <> 0 and read_id % 83 <> 0) r group by 1, 2""")
def stream_ingest(t):
    """Contacts written as text files, counted by the stream, equal to the batch count."""
    use_checkpoints(t.spark)
    root = os.path.join(t.spark.sparkContext.getCheckpointDir(), f"stream-{uuid.uuid4().hex}")
    # the library is in the file name, so each library is a folder of its own with a matching name
    lines = contact_lines(t).select("value", "file_name")
    for library in ("1", "2", "3", "4"):
        own = lines.filter(F.col("file_name") == f"GSM1_DNA_{library}_pairs.tsv.gz").select("value")
        own.write.mode("overwrite").text(f"{root}/in/lib=_DNA_{library}_")
    from contactspark.streaming import ingest

    q = ingest.ingest_contacts_stream(t.spark, f"{root}/in/*", f"{root}/out", f"{root}/log", t.membership, t.universe, BIN_SIZE, 2)
    q.awaitTermination()
    return stream_counted(t.spark, f"{root}/out").groupBy("context_index", "pair_id").agg(F.sum("n").alias("full_count"))
