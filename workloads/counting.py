"""Contacts, universe, evidence and reproducibility queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contactspark.functions import scalars as S
from contactspark.operators import contacts as C
from contactspark.operators import evidence as E
from contactspark.operators import power as P
from contactspark.operators import universe as U
from contactspark.operators.ordered import use_checkpoints
from contactspark.settings import BIN_SIZE, Geometry
from contactspark.sources.tables import read_routed, write_routed
from workloads.base import CONTEXTS, OUTPUTS, SPLITS, STEPS, query

CHROMS = [f"chr{n}" for n in range(1, 10)]  # chr10 plays the unknown chromosome


@query("canonical_anchors", """
select read_id, chrom1, chrom2, bin_i, bin_j, case when chrom1 = chrom2 then bin_j - bin_i end as distance_bp from {anchored}""")
def canonical_anchors(t):
    return C.canonical_anchors(t.raw_contacts, BIN_SIZE).select("read_id", "chrom1", "chrom2", "bin_i", "bin_j", "distance_bp")


@query("contact_filter", """
select case when m.cell_id is null then 'unmatched_barcode' when chrom1 <> chrom2 then 'trans'
    when chrom1 = 'chr10' then 'unknown_chrom' when a.bin_j - a.bin_i < 250000 or a.bin_j - a.bin_i >= 1000000 then 'distance'
    when u.pair_id is null then 'not_in_universe' else 'kept' end as reason, count(*) as contacts
from {anchored} a left join {membership} m using (library_id, dna_barcode)
left join {universe} u on u.chrom = a.chrom1 and u.bin_i = a.bin_i and u.bin_j = a.bin_j group by 1""")
def contact_filter(t):
    return C.exclusion_counts(C.classify(t.binned, t.membership, t.universe, CHROMS, 250_000, 1_000_000))


@query("assign_context", """
select context_index, cell_id, chrom1, chrom2, bin_i, bin_j, count(*) as n from {anchored} join {membership} using (library_id, dna_barcode)
group by all""")
def assign_context(t):
    return C.assign_context(t.binned, t.membership).select("context_index", "cell_id", "chrom1", "chrom2", "bin_i", "bin_j", "n")


@query("unmatched_barcodes", """
select library_id, count(*) as barcodes, cast(sum(n) as bigint) as contacts from
(select library_id, dna_barcode, count(*) as n from {raw_contacts} group by all) r
where not exists (select 1 from {membership} m where m.library_id = r.library_id and m.dna_barcode = r.dna_barcode) group by 1""")
def unmatched_barcodes(t):
    per = t.binned.groupBy(*C.CELL).agg(F.sum("n").alias("n")).join(t.membership, C.CELL, "left_anti")
    return per.groupBy("library_id").agg(F.count(F.lit(1)).alias("barcodes"), F.sum("n").alias("contacts"))


@query("restrict_to_universe", """
select u.pair_id is not null as hit, count(*) as contacts, count(distinct (a.chrom1, a.bin_i, a.bin_j)) as bin_pairs
from {anchored} a left join {universe} u on u.chrom = a.chrom1 and u.bin_i = a.bin_i and u.bin_j = a.bin_j
where chrom1 = chrom2 group by 1""")
def restrict_to_universe(t):
    hits, misses = C.restrict_to_universe(t.binned, t.universe)
    both = hits.withColumn("hit", F.lit(True)).drop("pair_id").unionByName(misses.withColumn("hit", F.lit(False)))
    per = both.groupBy("hit", "chrom", "bin_i", "bin_j").agg(F.sum("n").alias("n"))
    return per.groupBy("hit").agg(F.sum("n").alias("contacts"), F.count(F.lit(1)).alias("bin_pairs"))


STEPS["pixels"] = """
select chrom1 as chrom, chrom2, bin_i, bin_j, count(*) as "count" from {anchored} group by all"""


def pixels(t):
    return C.contacts_to_pixels(t.raw_contacts, BIN_SIZE)


@query("contacts_to_pixels", """select * from {pixels}""")
def contacts_to_pixels(t):
    return pixels(t)


@query("coarsen_pixels", """
select chrom, chrom2, bin_i - bin_i % 50000 as bin_i, bin_j - bin_j % 50000 as bin_j, cast(sum("count") as bigint) as "count" from {pixels} group by 1, 2, 3, 4""")
def coarsen_pixels(t):
    return C.coarsen_pixels(pixels(t), BIN_SIZE, 5)


@query("pixel_mass", """
select cast(sum(case when u.pair_id is not null then "count" else 0 end) as bigint) as universe_mass, cast(sum("count") as bigint) as total_mass
from {pixels} p left join {universe} u on p.chrom = u.chrom and p.chrom2 = u.chrom and p.bin_i = u.bin_i and p.bin_j = u.bin_j""")
def pixel_mass(t):
    return C.pixel_mass(pixels(t), t.universe)


@query("genome_key", """
with c as (select chrom, max(bin) as last from (select chrom1 as chrom, bin_i as bin from {anchored} union all select chrom2, bin_j from {anchored}) group by 1),
o as (select chrom, cast(coalesce(sum(last / 10000 + 1) over (order by cast(substr(chrom, 4) as int) rows between unbounded preceding and 1 preceding), 0) as bigint) as first_bin from c)
select least(a, b) as bin1_id, greatest(a, b) as bin2_id, "count" from (select o.first_bin + cast(bin_i / 10000 as bigint) as a, q.first_bin + cast(bin_j / 10000 as bigint) as b, "count"
  from {pixels} p join o on o.chrom = p.chrom join o q on q.chrom = p.chrom2)""")
def genome_key(t):
    from pyspark.sql import Window as W

    per = pixels(t)
    ends = F.inline(F.array(F.struct("chrom", F.col("bin_i").alias("bin")), F.struct(F.col("chrom2").alias("chrom"), F.col("bin_j").alias("bin"))))
    last = per.select(ends).groupBy("chrom").agg(F.max("bin").alias("last")).withColumn("k", S.chrom_number())
    before = W.orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    first = last.select("chrom", F.coalesce(F.sum(S.fdiv("last", BIN_SIZE) + 1).over(before), F.lit(0)).alias("first_bin"))
    return C.with_genome_bins(per, first, BIN_SIZE)


@query("genome_key_projection", """
select read_id, (off + i) * 100000 + off + j as genome_key from (
  select read_id, cast(substr(chrom1, 4) as int) * 10000 as off, cast(bin_i / 10000 as bigint) as i, cast(bin_j / 10000 as bigint) as j from {anchored})""")
def genome_key_projection(t):
    offsets = {f"chr{n}": n * 10_000 for n in range(1, 11)}
    a = C.canonical_anchors(t.raw_contacts, BIN_SIZE)
    return a.select("read_id", S.genome_key("chrom1", "bin_i", "bin_j", offsets, 100_000, BIN_SIZE).alias("genome_key"))


@query("route_contacts", """
select cell_type as output_id, library_id, chrom1, count(*) as contacts from {raw_contacts} join {membership} using (library_id, dna_barcode) group by all
union all select 'all_cells', library_id, chrom1, count(*) from {raw_contacts} join {membership} using (library_id, dna_barcode) group by all""")
def route_contacts(t):
    return C.route_contacts(t.raw_contacts, t.membership).groupBy("output_id", "library_id", "chrom1").agg(F.count(F.lit(1)).alias("contacts"))


@query("routed_tables", """
select cell_type as output_id, chrom1, count(*) as contacts, cast(sum(pos1) as bigint) as positions from {raw_contacts} join {membership} using (library_id, dna_barcode) group by all
union all select 'all_cells', chrom1, count(*), cast(sum(pos1) as bigint) from {raw_contacts} join {membership} using (library_id, dna_barcode) group by all""")
def routed_tables(t):
    """Member records written once by cell type against the declared totals, and every output read back."""
    use_checkpoints(t.spark)
    folder = f"{t.spark.sparkContext.getCheckpointDir()}/routed-{uuid.uuid4().hex}"
    members = t.raw_contacts.join(t.membership.select(*C.CELL, "cell_type"), C.CELL)
    declared = {r.cell_type: r.valid_pairs for r in t.contexts.select("cell_type", "valid_pairs").collect()}  # one row per context
    write_routed(members, folder, declared=declared)
    out = None
    for name in [*declared, "all_cells"]:
        rows = read_routed(t.spark, folder, name).groupBy("chrom1").agg(F.count(F.lit(1)).alias("contacts"), F.sum("pos1").alias("positions")).select(
            F.lit(name).alias("output_id"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("routed_totals", """
with r as (select cell_type as output_id, count(*) as routed from {raw_contacts} join {membership} using (library_id, dna_barcode) group by 1),
a as (select output_id, routed, valid_pairs as declared from r join {contexts} on output_id = cell_type)
select *, routed = declared as matches from a
union all select 'all_cells', cast(sum(routed) as bigint), cast(sum(declared) as bigint), sum(routed) = sum(declared) from a""")
def routed_totals(t):
    return C.routed_totals(t.raw_contacts, t.membership, t.contexts)


# the file's own cell type: wrong for one record in eleven
STEPS["typed_contacts"] = """
select r.*, case when read_id % 11 = 0 then 'OTHER' else cell_type end as cell_type
from {raw_contacts} r join {membership} using (library_id, dna_barcode)"""


def typed_contacts(t):
    types = t.membership.select(*C.CELL, "cell_type")
    return t.raw_contacts.join(types, C.CELL).withColumn(
        "cell_type", F.when(F.col("read_id") % 11 == 0, "OTHER").otherwise(F.col("cell_type")))


@query("route_family_half", """
select output_id as family, chrom1, chrom2, count(*) as contacts, cast(sum(pos1) as bigint) as sum_pos1, cast(sum(pos2) as bigint) as sum_pos2
from {typed_contacts} c join {assignments} a using (library_id, dna_barcode) join {pools} on member = a.cell_type
where split = 1 and half = 'B' and c.cell_type = a.cell_type group by all""")
def route_family_half(t):
    return C.route_family_half(typed_contacts(t), t.assignments, t.pools, 1).groupBy("family", "chrom1", "chrom2").agg(
        F.count(F.lit(1)).alias("contacts"), F.sum("pos1").alias("sum_pos1"), F.sum("pos2").alias("sum_pos2"))


@query("family_half_counts", """
select output_id as family, count(*) filter (half = 'A') as contacts_a, count(*) filter (half = 'B') as contacts_b
from {raw_contacts} join {assignments} a using (library_id, dna_barcode) join {pools} on member = a.cell_type where split = 1 group by 1""")
def family_half_counts(t):
    return C.family_half_counts(t.raw_contacts, t.assignments, t.pools, 1)


@query("cell_type_mismatches", """
select c.cell_type, m.cell_type as assigned_type, count(*) as contacts from {typed_contacts} c
join {membership} m using (library_id, dna_barcode) where c.cell_type <> m.cell_type group by all""")
def cell_type_mismatches(t):
    return C.cell_type_mismatches(typed_contacts(t), t.assignments)


@query("membership_contract", """
select context_index, n_cells, valid_pairs, n_cells as cells_found, valid_pairs as pairs_found, 0 as cells_off, true as passed from {contexts}""")
def membership_contract(t):
    return C.membership_contract(t.membership, t.contexts, t.binned)


@query("aligned_target_start", """
select tile_id, (input_start + 24288 + 5000) - (input_start + 24288 + 5000) % 10000 as target_start,
  (input_start + 24288 + 5000) - (input_start + 24288 + 5000) % 10000 + 1000000 as target_end,
  (input_start + 24288 + 5000) - (input_start + 24288 + 5000) % 10000 <> target_start as changed from {source_tiles}""")
def aligned_target_start(t):
    return U.align_tiles(t.source_tiles, BIN_SIZE).select("tile_id", "target_start", "target_end", "changed")


@query("align_tiles_report", """
select split, count(*) as tiles, count(*) filter ((input_start + 29288) - (input_start + 29288) % 10000 <> target_start) as changed_tiles
from {source_tiles} group by 1""")
def align_tiles_report(t):
    return U.alignment_report(U.align_tiles(t.source_tiles, BIN_SIZE))


@query("chromosome_fold", """select s_suppkey, s_suppkey % 10 % 5 as fold from {supplier}""")
def chromosome_fold(t):
    return t.tiles.select(F.col("tile_row").alias("s_suppkey"), S.chromosome_fold().alias("fold"))


@query("distance_bands", """
select case when d < 250000 then null when d < 500000 then '250-500' when d < 1000000 then '500-1000' end as distance_band, count(*) as contacts
from (select bin_j - bin_i as d from {anchored} where chrom1 = chrom2) group by 1""")
def distance_bands(t):
    cis = t.binned.filter("chrom1 = chrom2")
    return cis.groupBy(S.distance_band().alias("distance_band")).agg(F.sum("n").alias("contacts"))


@query("enumerate_pairs", """
select tile_id, distance_bin, count(*) as rows, cast(sum(bin_i) as bigint) as sum_i, cast(sum(bin_j) as bigint) as sum_j,
  cast(sum(boundary_margin_bins) as bigint) as margins from {tile_pairs} group by 1, 2""")
def enumerate_pairs(t):
    return U.enumerate_pairs(t.tiles, Geometry()).groupBy("tile_id", "distance_bin").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("bin_i").alias("sum_i"), F.sum("bin_j").alias("sum_j"),
        F.sum("boundary_margin_bins").alias("margins"))


@query("canonicalize", """select chrom, bin_i, bin_j, tile_id, boundary_margin_bins, split from {canonical}""")
def canonicalize(t):
    return U.canonical_pairs(t.tiles, Geometry()).select(
        "chrom", "bin_i", "bin_j", "tile_id", "boundary_margin_bins", "split")


@query("universe_report", """
select *, representations - canonical as duplicates_removed, canonical - kept as cross_split_removed from
(select (select count(*) from {tile_pairs}) as representations, (select count(*) from {canonical}) as canonical, (select count(*) from {universe}) as kept)""")
def universe_report(t):
    every = U.enumerate_pairs(t.tiles, Geometry())
    canonical = U.canonical_pairs(t.tiles, Geometry())
    return U.universe_report(every, canonical, U.purge_cross_split(canonical))


@query("conflicting_anchors", """select chrom, bin from {conflicts}""")
def conflicting_anchors(t):
    return U.conflicting_anchors(U.canonical_pairs(t.tiles, Geometry()))


@query("assign_pair_id", """select pair_id, chrom, bin_i, bin_j, distance_band, split, tile_row from {universe}""")
def assign_pair_id(t):
    return t.universe.select("pair_id", "chrom", "bin_i", "bin_j", "distance_band", "split", "tile_row")


@query("pair_table_checks", """
select unnest(['unique_id', 'unique_coordinates', 'ordered_anchors', 'contiguous_id']) as "check", unnest(
 (select [count(distinct pair_id) = count(*), count(distinct (chrom, bin_i, bin_j)) = count(*), bool_and(bin_i < bin_j),
  min(pair_id) = 0 and max(pair_id) = count(*) - 1] from {universe})) as passed""")
def pair_table_checks(t):
    return U.pair_table_checks(t.universe)


@query("split_counts_by_band", """select split, distance_band, count(*) as rows from {universe} group by 1, 2""")
def split_counts_by_band(t):
    return U.value_counts(t.universe, ["split", "distance_band"])


@query("tile_grid", """
select t.tile_row as grid_tile, cast((u.bin_i - t.target_start) / 10000 as bigint) as i, cast((u.bin_j - t.target_start) / 10000 as bigint) as j, pair_id
from {universe} u join {tiles} t on u.chrom = t.chrom and u.bin_i >= t.target_start and u.bin_j + 10000 <= t.target_end
union all select t.tile_row, cast((u.bin_j - t.target_start) / 10000 as bigint), cast((u.bin_i - t.target_start) / 10000 as bigint), pair_id
from {universe} u join {tiles} t on u.chrom = t.chrom and u.bin_i >= t.target_start and u.bin_j + 10000 <= t.target_end""")
def tile_grid(t):
    return U.mirrored(U.pair_tiles(t.universe, t.tiles, BIN_SIZE))


@query("evidence_counts", """select * from {counts}""")
def evidence_counts(t):
    return t.counts


@query("split_evidence", """select * from {split_counts}""")
def split_evidence(t):
    return E.splits_of(t.sums)


@query("evidence_conservation", """
select s as stream_mass, s as table_mass, s as pixel_mass, 0 as unbalanced, true as passed from (
  select count(*) as s from {anchored} a join {universe} u on u.chrom = a.chrom1 and u.bin_i = a.bin_i and u.bin_j = a.bin_j
  join {membership} using (library_id, dna_barcode) where chrom1 = chrom2)""")
def evidence_conservation(t):
    members = t.raw_contacts.filter("chrom1 = chrom2").join(t.membership.select(*C.CELL), C.CELL, "left_semi")
    mass = C.pixel_mass(C.contacts_to_pixels(members, BIN_SIZE), t.universe)
    return C.conservation(t.records, t.counts, mass)


@query("pool_counts", """
select output_id, output_type, pair_id, cast(sum(full_count) as bigint) as full_count, cast(sum(counts_a) as bigint) as counts_a,
  cast(sum(counts_b) as bigint) as counts_b from {counts} join {outputs} using (context_index) group by all""")
def pool_counts(t):
    return E.pool_counts(t.counts, t.outputs, ["full_count", "counts_a", "counts_b"])


@query("output_depths", """
select output_id, output_type, cast(sum(valid_pairs) as bigint) as depth, cast(sum(n_cells) as bigint) as n_cells
from {outputs} join {contexts} using (context_index) group by all""")
def output_depths(t):
    return E.output_depths(t.contexts, t.outputs)


@query("complement_counts", """
select o.output_id, pair_id, cast(sum(counts_b) as bigint) as other_count
from (select distinct output_id from {outputs}) o, {counts} c
where not exists (select 1 from {outputs} m where m.output_id = o.output_id and m.context_index = c.context_index)
group by all having sum(counts_b) > 0""")
def complement_counts(t):
    return E.complement_counts(t.counts, t.outputs, list(range(len(CONTEXTS))))


STEPS["midranks"] = """
select c.context_index, u.tile_row, u.distance_bin, c.pair_id, u.bin_i, counts_a, counts_b, n as group_size,
  case when counts_a > 0 then rank() over (partition by context_index, u.tile_row, u.distance_bin order by counts_a desc) end as ra,
  count(*) over (partition by context_index, u.tile_row, u.distance_bin, counts_a) as ta,
  count(*) filter (counts_a > 0) over (partition by context_index, u.tile_row, u.distance_bin) as pa,
  case when counts_b > 0 then rank() over (partition by context_index, u.tile_row, u.distance_bin order by counts_b desc) end as rb,
  count(*) over (partition by context_index, u.tile_row, u.distance_bin, counts_b) as tb,
  count(*) filter (counts_b > 0) over (partition by context_index, u.tile_row, u.distance_bin) as pb
from {counts} c join {universe} u using (pair_id)
join (select tile_row, distance_bin, count(*) as n from {universe} group by 1, 2) g using (tile_row, distance_bin) where n >= 2"""
STEPS["tops"] = """
select *, 1 - (ra - 1 + (ta - 1) / 2) / greatest(group_size - 1, 1) as ma, 1 - (rb - 1 + (tb - 1) / 2) / greatest(group_size - 1, 1) as mb,
  greatest(1, ceil(group_size * cast(0.02 as double))) as k from {midranks}"""


def placed_counts(t):
    return t.counts.join(t.universe.select("pair_id", "chrom", "tile_row", "distance_bin", "bin_i"), "pair_id")


@query("positive_midrank", """
select context_index, pair_id, ma as midrank, group_size from {tops} where ra is not null""")
def positive_midrank(t):
    return E.positive_midrank(placed_counts(t), "counts_a", t.universe).select("context_index", "pair_id", "midrank", "group_size")


STEPS["support"] = """
with m as (select a.context_index, a.pair_id as x, b.pair_id as y, least(a.ma, b.mb) as w
  from {tops} a join {tops} b on a.context_index = b.context_index and a.tile_row = b.tile_row and a.distance_bin = b.distance_bin
    and abs(a.bin_i - b.bin_i) <= 10000 where a.ra <= least(a.k, a.pa) and b.rb <= least(b.k, b.pb))
select context_index, pair_id, max(w) as primary_support from (select context_index, x as pair_id, w from m union all select context_index, y, w from m) group by 1, 2"""


@query("replicate_support", """select * from {support}""")
def replicate_support(t):
    return E.replicate_support(placed_counts(t), t.universe, bin_size=BIN_SIZE)


@query("support_tie_report", """
with g as (select context_index, tile_row, distance_bin, count(*) filter (ra <= least(k, pa)) as na, count(*) filter (rb <= least(k, pb)) as nb,
  max(pa) as pa, max(pb) as pb, max(k) as k from {tops} group by 1, 2, 3)
select context_index, count(*) as scored_groups, count(*) filter (na > least(k, pa) or nb > least(k, pb)) as cutoff_tie_groups
from g where pa > 0 and pb > 0 group by 1""")
def support_tie_report(t):
    return E.support_tie_report(placed_counts(t), t.universe)


def support_table(t):
    primary = E.replicate_support(placed_counts(t), t.universe, bin_size=BIN_SIZE)
    return t.counts.join(primary, ["context_index", "pair_id"], "left").fillna(0.0, ["primary_support"]).withColumn(
        "support_weight", S.combine_support("primary_support", "reproduced_splits", SPLITS))


STEPS["support_table"] = """
select c.*, coalesce(primary_support, 0) as primary_support,
  greatest(coalesce(primary_support, 0) * (0.5 + 0.5 * reproduced_splits / 20), reproduced_splits / 20) as support_weight
from {counts} c left join {support} using (context_index, pair_id)"""


@query("combine_support", """select context_index, pair_id, support_weight from {support_table}""")
def combine_support(t):
    return support_table(t).select("context_index", "pair_id", "support_weight")


@query("half_depths", """
with f as (select output_id as family, cast(sum(valid_pairs) filter (half = 'A') as bigint) as depth_a,
  cast(sum(valid_pairs) filter (half = 'B') as bigint) as depth_b
from {membership} m join {assignments} a using (library_id, dna_barcode) join {pools} on member = m.cell_type where split = 2 group by 1)
select *, depth_b / depth_a as b_per_a from f""")
def half_depths(t):
    return E.half_depths(t.membership, t.assignments, t.pools, 2)


@query("balanced_halves", "select context_index, cell_id, split, half from {assignments}")
def balanced_halves(t):
    return t.assignments.select("context_index", "cell_id", "split", "half")


@query("half_summary", """
select context_index, split, half, count(*) as cells, cast(sum(valid_pairs) as bigint) as valid_pairs
from {assignments} join (select library_id, dna_barcode, valid_pairs from {membership}) using (library_id, dna_barcode) group by 1, 2, 3""")
def half_summary(t):
    return E.half_summary(t.assignments, t.membership)


def output_split_counts(t):
    return E.pool_splits(t.sums, t.outputs, SPLITS)


STEPS["output_splits"] = """
select output_id, output_type, split, pair_id, cast(sum(counts_a) as bigint) as counts_a, cast(sum(counts_b) as bigint) as counts_b
from {split_counts} join {outputs} using (context_index) group by all"""
STEPS["power"] = """
with sizes as (select tile_row, distance_band, chrom, count(*) as n from {universe} group by all),
grid as (select o.output_id, o.output_type, s.split, z.*, f.f as top_fraction, cast(greatest(1, ceil(n * f)) as bigint) as k
  from (select distinct output_id, output_type from {outputs}) o, range(0, 20) s(split), sizes z,
  (values (cast(0.01 as double)), (cast(0.02 as double)), (cast(0.05 as double))) f(f)),
rows as (select c.*, u.tile_row, u.distance_band from {output_splits} c join {universe} u using (pair_id)),
a as (select output_id, split, tile_row, distance_band, pair_id, counts_a as v, row_number() over w as rn, rank() over w as r,
    count(*) over (partition by output_id, split, tile_row, distance_band, counts_a) as t, count(*) over (partition by output_id, split, tile_row, distance_band) as p
  from rows where counts_a > 0 window w as (partition by output_id, split, tile_row, distance_band order by counts_a desc)),
b as (select output_id, split, tile_row, distance_band, pair_id, counts_b as v, row_number() over w as rn, rank() over w as r,
    count(*) over (partition by output_id, split, tile_row, distance_band, counts_b) as t, count(*) over (partition by output_id, split, tile_row, distance_band) as p
  from rows where counts_b > 0 window w as (partition by output_id, split, tile_row, distance_band order by counts_b desc)),
ga as (select g.output_id, g.split, g.tile_row, g.distance_band, g.top_fraction, max(p) as p, max(case when rn = k then v end) as cut,
    max(case when rn = k then t end) as t, max(case when rn = k then (k - r + 1) / t end) as w
  from grid g join a using (output_id, split, tile_row, distance_band) group by all),
gb as (select g.output_id, g.split, g.tile_row, g.distance_band, g.top_fraction, max(p) as p, max(case when rn = k then v end) as cut,
    max(case when rn = k then t end) as t, max(case when rn = k then (k - r + 1) / t end) as w
  from grid g join b using (output_id, split, tile_row, distance_band) group by all),
dot as (select g.output_id, g.split, g.tile_row, g.distance_band, g.top_fraction,
    sum(least(1, greatest(0, (k - a.r + 1) / a.t)) * least(1, greatest(0, (k - b.r + 1) / b.t))) as d
  from grid g join a using (output_id, split, tile_row, distance_band)
  join b using (output_id, split, tile_row, distance_band, pair_id) group by all)
select g.output_id, output_type, g.split, chrom, g.tile_row, g.distance_band, g.top_fraction, n as candidate_count, k,
  coalesce(ga.p, 0) as positive_a, coalesce(gb.p, 0) as positive_b,
  greatest(k - coalesce(ga.p, 0), 0) / k as forced_zero_fraction_a, greatest(k - coalesce(gb.p, 0), 0) / k as forced_zero_fraction_b,
  ga.cut as cutoff_a, gb.cut as cutoff_b, ga.t as cutoff_tie_size_a, gb.t as cutoff_tie_size_b, ga.w as cutoff_weight_a, gb.w as cutoff_weight_b,
  coalesce(ga.p >= k and gb.p >= k, false) as evaluable,
  case when ga.p >= k and gb.p >= k then coalesce(d, 0) / k end as overlap,
  case when ga.p >= k and gb.p >= k then k / n end as chance,
  case when ga.p >= k and gb.p >= k then coalesce(d, 0) / k - k / n end as overlap_excess,
  case when ga.p >= k and gb.p >= k then (coalesce(d, 0) / k) / (k / n) end as enrichment_over_chance,
  case when ga.p >= k and gb.p >= k then null else 'positive_capacity_below_k' end as reason
from grid g left join ga using (output_id, split, tile_row, distance_band, top_fraction)
left join gb using (output_id, split, tile_row, distance_band, top_fraction)
left join dot using (output_id, split, tile_row, distance_band, top_fraction)"""
STEPS["power_summary"] = """
select output_id, output_type, distance_band, top_fraction, count(*) as rows, count(*) filter (evaluable) as evaluable_rows,
  coalesce(sum(k) filter (evaluable), 0) / sum(k) as k_weighted_evaluable_fraction,
  count(distinct chrom) filter (evaluable) as chromosomes,
  sum(k * overlap) / sum(k) filter (evaluable) as overlap, sum(k * chance) / sum(k) filter (evaluable) as chance,
  sum(k * overlap_excess) / sum(k) filter (evaluable) as overlap_excess, sum(k * overlap) / sum(k * chance) as enrichment_over_chance
from {power} group by all"""
FRACTIONS = [0.01, 0.02, 0.05]


def power_rows(t):
    return P.topk_overlap_exact(output_split_counts(t), t.universe, OUTPUTS, list(range(SPLITS)), FRACTIONS)


@query("topk_overlap_exact", "select * from {power}")
def topk_overlap_exact(t):
    return power_rows(t)


@query("reproducibility_summary", "select * from {power_summary}")
def reproducibility_summary(t):
    return P.weighted_topk_summary(power_rows(t), ["output_id", "output_type", "distance_band", "top_fraction"])
