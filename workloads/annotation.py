"""Line formats, intervals, sequence measures and pair annotations."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from contactspark.functions import scalars as S
from contactspark.functions import sequence as Q
from contactspark.operators import annotate as A
from contactspark.operators import intervals as I
from contactspark.operators import rates as R
from contactspark.operators.ordered import use_checkpoints
from contactspark.sources import tables as T
from contactspark.sources import text as X
from workloads.base import BIN_SIZE, OUTPUTS, STEPS, query

CHROMS = [f"chr{n}" for n in range(1, 11)]


def as_lines(df, *columns, sep="\t", file="x.tsv"):
    return df.select(F.concat_ws(sep, *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns]).alias("value"), F.lit(file).alias("file_name"))


def contact_lines(t):
    """Contacts as the text files hold them: a header, some short lines, one file per library, one stray file."""
    m = t.raw_contacts.join(t.membership.select("library_id", "dna_barcode", "cell_type"), ["library_id", "dna_barcode"], "left")
    full = F.concat_ws("\t", F.concat("dna_barcode", F.lit(":x")), "chrom1", F.col("pos1").cast("string"), "chrom2", F.col("pos2").cast("string"),
                       F.lit("."), F.lit("."), F.lit("."), F.coalesce("cell_type", F.lit("none")))
    value = F.when(F.col("read_id") % 97 == 0, F.concat(F.lit("#"), full)).when(F.col("read_id") % 89 == 0, F.col("dna_barcode")).otherwise(full)
    name = F.when(F.col("read_id") % 83 == 0, "stray.tsv.gz").otherwise(F.concat(F.lit("GSM1_DNA_"), F.substring("library_id", 5, 1), F.lit("_pairs.tsv.gz")))
    return m.select(value.alias("value"), name.alias("file_name"))


@query("read_contacts", """
select r.library_id, malformed, c.cell_type, count(*) as rows, cast(sum(case when malformed then 0 else pos1 end) as bigint) as sum_pos1 from
 (select *, read_id % 89 = 0 as malformed from {raw_contacts} where read_id % 97 <> 0 and read_id % 83 <> 0) r
 left join (select library_id as l, dna_barcode as b, cell_type from {membership} union all select null, null, null where false) m on m.l = r.library_id and m.b = r.dna_barcode
 left join lateral (select case when malformed then null else coalesce(m.cell_type, 'none') end as cell_type) c on true group by all""")
def read_contacts(t):
    return X.parse_contacts(contact_lines(t)).groupBy("library_id", "malformed", "cell_type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce("pos1", F.lit(0))).alias("sum_pos1"))


@query("read_bed", """
select chrom, count(*) as rows, cast(sum(start_bp) as bigint) as starts, cast(sum(end_bp) as bigint) as ends from
(select chrom, start_bp, case when label = 'other' then start_bp else end_bp end as end_bp from {intervals}) where end_bp > start_bp group by 1""")
def read_bed(t):
    rows = t.intervals.withColumn("e", F.when(F.col("label") == "other", F.col("start_bp")).otherwise(F.col("end_bp")))
    text = as_lines(rows, "chrom", "start_bp", "e", "label", sep="  ")
    heads = as_lines(rows.filter("is_gene"), F.lit("#"), "chrom").unionByName(as_lines(rows.filter("is_gene"), F.lit("track"), "chrom", sep=" "))
    return X.parse_bed(text.unionByName(heads)).groupBy("chrom").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("start_bp").alias("starts"), F.sum("end_bp").alias("ends"))


@query("read_labelled_bed", """
select chrom, label, count(*) as rows, cast(sum(end_bp - start_bp) as bigint) as width from {intervals} where label <> 'other' group by 1, 2""")
def read_labelled_bed(t):
    dots = [F.lit(".")] * 6
    text = as_lines(t.intervals, "chrom", "start_bp", "end_bp", *dots, "label")
    return X.parse_labelled_bed(text).groupBy("chrom", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("end_bp") - F.col("start_bp")).alias("width"))


STEPS["genes"] = """
select chrom, strand, case when strand = '-' then end_bp - 1 else start_bp end as tss from {intervals} where is_gene"""


def gene_starts(t):
    text = as_lines(t.intervals, "chrom", F.lit("src"), F.when(F.col("is_gene"), "gene").otherwise("exon"), (F.col("start_bp") + 1).cast("string"),
                    "end_bp", F.lit("."), "strand", F.lit("."), F.lit("id"))
    return X.parse_gtf_tss(text)


@query("read_gtf_tss", "select chrom, strand, tss from {genes}")
def read_gtf_tss(t):
    return gene_starts(t).select("chrom", "strand", "tss")


@query("read_bedgraph", "select chrom, count(*) as rows, sum(value) as total from {bedgraph} where chrom <> 'chr10' group by 1")
def read_bedgraph(t):
    text = as_lines(t.bedgraph, "chrom", "start_bp", "end_bp", "value")
    return X.parse_bedgraph(text, CHROMS[:9]).groupBy("chrom").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"))


@query("read_chrom_sizes", """
select 0 + cast(substr(chrom, 4) as bigint) - 1 as chrom_order, chrom, max(target_end) as size_bp from {tiles} group by chrom""")
def read_chrom_sizes(t):
    sizes = t.tiles.groupBy("chrom").agg(F.max("target_end").alias("size"))
    return X.parse_chrom_sizes(as_lines(sizes, "chrom", "size", F.lit("6")), CHROMS)


@query("sequence_bins", """
select chrom, bin_start + 1000 * i as bin_start, substr(seq, cast(1 + 1000 * i as int), 1000) as seq from {seqbins}, lateral (select unnest(range(0, cast(ceil(length(seq) / 1000) as bigint))) as i)
where length(seq) > 0""")
def sequence_bins(t):
    return X.sequence_bins(t.seqbins.withColumnRenamed("bin_start", "start_bp"), 1000)


@query("wide_counts", """
select barcode, 'DNA' || substr(barcode, 4, 2) as library_id, cell_type, gene, n from {rna_long} where gene in ('click', 'view', 'purchase')""")
def wide_counts(t):
    wide = t.rna_long.groupBy("barcode", "cell_type").pivot("gene", ["click", "error", "purchase", "signup", "view"]).agg(F.sum("n")).fillna(0)
    return X.parse_wide_counts(wide, ["view", "click", "purchase"])


@query("scan_columns_and_split", """
select pair_id, chrom, tile_row from {universe} where split = 'validation' and tile_row < 60""")
def scan_columns_and_split(t):
    use_checkpoints(t.spark)
    folder = os.path.join(t.spark.sparkContext.getCheckpointDir(), f"pairs-{uuid.uuid4().hex}")
    T.write_table(t.universe, folder, ("split",))
    return T.scan(t.spark, folder, ["pair_id", "chrom", "tile_row"], "validation", 60)


@query("authorised_rows", """
select u.pair_id, coalesce(counts_a, 0) as counts_a, coalesce(counts_b, 0) as counts_b from {universe} u left join
 (select * from {counts} where context_index = 2) c using (pair_id) where split = 'validation'""")
def authorised_rows(t):
    return T.authorised_rows(t.counts, 2, t.universe.filter("split = 'validation'"), ["counts_a", "counts_b"])


@query("interval_bins", """
select chrom, b * 10000 as bin_start, count(*) as intervals from {intervals}, lateral (select unnest(range(cast(floor(start_bp / 10000) as bigint), cast(floor((end_bp - 1) / 10000) as bigint) + 1)) as b) group by 1, 2""")
def interval_bins(t):
    return I.interval_bins(t.intervals, BIN_SIZE)


STEPS["mappability"] = """
select chrom, b * 10000 as bin_start, sum((least(end_bp, (b + 1) * 10000) - greatest(start_bp, b * 10000)) * value) / 10000 as value
from {bedgraph}, lateral (select unnest(range(cast(floor(start_bp / 10000) as bigint), cast(floor((end_bp - 1) / 10000) as bigint) + 1)) as b) group by 1, 2"""


@query("overlap_mean", "select * from {mappability}")
def overlap_mean(t):
    return I.overlap_mean(t.bedgraph, BIN_SIZE, CHROMS)


STEPS["area_weights"] = """
with t as (select tile_row, input_start, (input_start + 29288) - (input_start + 29288) % 10000 as ts from {source_tiles}),
b as (select tile_row, b as bin, ts + b * 10000 - input_start as s from t, range(0, 100) x(b))
select tile_row, bin, n as native, (least(s + 10000, (n + 1) * 2048) - greatest(s, n * 2048)) / 10000 as weight
from b, lateral (select unnest(range(cast(floor(s / 2048) as bigint), cast(floor((s + 9999) / 2048) as bigint) + 1)) as n)"""


@query("area_overlap_weights", "select * from {area_weights}")
def area_overlap_weights(t):
    from contactspark.operators.universe import align_tiles

    return I.area_overlap_weights(align_tiles(t.source_tiles, BIN_SIZE), 2048, 512, BIN_SIZE, 100)


STEPS["cells"] = """
select cast((vec_id - vec_id % 64) / 64 as bigint) as tile_row, vec_id % 8 as x, cast((vec_id % 64 - vec_id % 8) / 8 as bigint) as y, embedding as vector from {embeddings}"""


@query("resample_pair_features", """
with w as (select t as tile_row, b as bin, n as native, (least(b * 5 + 5, n * 2 + 2) - greatest(b * 5, n * 2)) / 5 as weight
  from (select distinct tile_row as t from {cells}), range(0, 3) x(b), range(0, 8) y(n) where n * 2 < b * 5 + 5 and n * 2 + 2 > b * 5),
p as (select a.tile_row, a.bin as i, b.bin as j, 0.5 * a.weight * b.weight as w, a.native as x, b.native as y from w a join w b on a.tile_row = b.tile_row and a.bin < b.bin),
q as (select * from p union all select tile_row, i, j, w, y, x from p)
select tile_row, i, j, sum(w * vector[1]) as c0, sum(w * vector[64]) as c63 from q join {cells} using (tile_row, x, y) group by 1, 2, 3""")
def resample_pair_features(t):
    cells = t.embeddings.select(S.fdiv("vec_id", 64).alias("tile_row"), (F.col("vec_id") % 8).alias("x"), S.fdiv(F.col("vec_id") % 64, 8).alias("y"), F.col("embedding").alias("vector"))
    tiles = cells.select("tile_row").distinct().select("tile_row", F.lit(0).alias("input_start"), F.lit(0).alias("target_start"))
    weights = I.area_overlap_weights(tiles, 2, 8, 5, 3)
    each = tiles.select("tile_row", F.inline(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a, b in ((0, 1), (0, 2), (1, 2))])))
    pairs = each.withColumn("pair_id", F.struct("tile_row", "i", "j"))
    out = I.resample_pair_features(pairs, weights, cells, 64)
    return out.select("pair_id.tile_row", "pair_id.i", "pair_id.j", F.col("vector")[0].alias("c0"), F.col("vector")[63].alias("c63"))


@query("windows_for_tiles", """
select distinct chrom, input_start as window_start, input_end as window_end, tile_row as window_id from {source_tiles}""")
def windows_for_tiles(t):
    w = t.source_tiles.select("chrom", F.col("input_start").alias("window_start"), F.col("input_end").alias("window_end"), F.col("tile_row").alias("window_id"))
    return I.windows_for_tiles([w.filter("window_id % 3 < 2"), w.filter("window_id % 3 > 0")], w)


STEPS["sequences"] = """
select chrom, bin_start, length(regexp_replace(translate(seq, 'acgt', 'ACGT'), '[^ACGT]', '', 'g')) / nullif(length(seq), 0) as valid_fraction,
 length(regexp_replace(translate(seq, 'acgt', 'ACGT'), '[^GC]', '', 'g')) / greatest(length(regexp_replace(translate(seq, 'acgt', 'ACGT'), '[^ACGT]', '', 'g')), 1) as gc,
 cast((length(seq) - length(replace(translate(seq, 'acgt', 'ACGT'), 'CA', ''))) / 2 + (length(seq) - length(replace(translate(seq, 'acgt', 'ACGT'), 'TT', ''))) / 2 as bigint) as sites,
 cast(length(seq) % 40 as double) as ctcf_score, case when length(seq) % 40 < 15 then 0 when length(seq) % 2 = 0 then 1 else -1 end as ctcf_orientation from {seqbins}"""


def sequences(t):
    n = F.length("seq")
    score, side = (n % 40).cast("double"), F.when(n % 2 == 0, 1).otherwise(-1)
    return t.seqbins.select("chrom", "bin_start", Q.valid_fraction("seq").alias("valid_fraction"), Q.gc_fraction("seq").alias("gc"),
                            Q.motif_count("seq", ("CA", "TT")).alias("sites"), score.alias("ctcf_score"), Q.ctcf_call(score, side).alias("ctcf_orientation"))


@query("sequence_features", "select * from {sequences}")
def sequence_features(t):
    return sequences(t)


_WIDTH = len(Q.CTCF_COUNTS)


def _strand(table) -> str:
    """DuckDB text of a window's score: one list of four weights per place."""
    return " + ".join(f"[{', '.join(f'{float(v)!r}::double' for v in row)}][{f'lead(c, {k}) over d' if k else 'c'}]" for k, row in enumerate(table))


@query("pwm_scan", f"""
with s as (select doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') as s from {{documents}}),
l as (select doc_id, unnest(string_split(s, '')) as b, unnest(range(0, length(s))) as i, length(s) as n from s where s <> ''),
w as (select doc_id, i, n, {_strand(Q.log_odds(Q.CTCF_COUNTS))} as f, {_strand(Q.log_odds(Q.CTCF_COUNTS)[::-1, ::-1])} as r
  from (select doc_id, i, n, instr('ACGT', b) as c from l) window d as (partition by doc_id order by i)),
m as (select doc_id, max(f) as f, max(r) as r from w where i <= n - {_WIDTH} group by 1)
select doc_id, greatest(f, r) as score, case when f is null then 0 when f >= r then 1 else -1 end as orientation from s left join m using (doc_id)""")
def pwm_scan(t):
    """Letters of the whole texts mapped to bases, so that long valid windows exist."""
    bases = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    scanned = t.documents.select("doc_id", Q.pwm_scan(bases).alias("m"))
    return scanned.select("doc_id", F.col("m.score").alias("score"), F.col("m.orientation").alias("orientation"))


def anchors(t):
    return A.anchor_table(sequences(t), I.tss_bins(gene_starts(t), BIN_SIZE), I.interval_bins(t.intervals.filter("label <> 'other'"), BIN_SIZE),
                          I.overlap_mean(t.bedgraph, BIN_SIZE, CHROMS))


STEPS["anchors"] = """
with tss as (select distinct chrom, tss - tss % 10000 as bin_start from {genes}),
ccre as (select distinct chrom, b * 10000 as bin_start from {intervals}, lateral (select unnest(range(cast(floor(start_bp / 10000) as bigint), cast(floor((end_bp - 1) / 10000) as bigint) + 1)) as b) where label <> 'other'),
k as (select chrom, bin_start from {sequences} union select * from tss union select * from ccre union select chrom, bin_start from {mappability})
select k.chrom, k.bin_start, s.valid_fraction, s.gc, s.sites, s.ctcf_score, coalesce(s.ctcf_orientation, 0) as ctcf_orientation, m.value as mappability,
 tss.chrom is not null as tss, ccre.chrom is not null as ccre
from k left join {sequences} s on s.chrom = k.chrom and s.bin_start = k.bin_start left join {mappability} m on m.chrom = k.chrom and m.bin_start = k.bin_start
left join tss on tss.chrom = k.chrom and tss.bin_start = k.bin_start left join ccre on ccre.chrom = k.chrom and ccre.bin_start = k.bin_start"""
STEPS["annotated"] = """
select u.*, i.mappability as map_i, j.mappability as map_j, i.valid_fraction as val_i, j.valid_fraction as val_j, i.sites as sites_i, j.sites as sites_j,
 coalesce(i.tss, false) as tss_i, coalesce(j.tss, false) as tss_j, coalesce(i.ccre, false) as ccre_i, coalesce(j.ccre, false) as ccre_j,
 coalesce(i.ctcf_orientation, 0) as ori_i, coalesce(j.ctcf_orientation, 0) as ori_j, i.gc as gc_i, j.gc as gc_j
from {universe} u left join {anchors} i on i.chrom = u.chrom and i.bin_start = u.bin_i left join {anchors} j on j.chrom = u.chrom and j.bin_start = u.bin_j"""


def annotated(t):
    return A.annotate_anchors(t.universe, anchors(t))


@query("annotate_anchors", """
select pair_id, map_i as mappability_i, val_j as valid_fraction_j, tss_i, ccre_j, ori_i as ctcf_orientation_i, gc_i is null as gc_missing_i, map_j is null as mappability_missing_j from {annotated}""")
def annotate_anchors(t):
    return annotated(t).select("pair_id", "mappability_i", "valid_fraction_j", "tss_i", "ccre_j", "ctcf_orientation_i", "gc_missing_i", "mappability_missing_j")


STEPS["eligible"] = """
select *, sqrt(greatest(map_i * map_j, cast('1e-12' as double))) * sqrt(greatest(val_i * val_j, cast('1e-6' as double))) * (1 + sites_i) * (1 + sites_j) as raw
from {annotated} where map_i >= 0.001 and map_j >= 0.001 and val_i >= 0.05 and val_j >= 0.05"""


def eligible(t):
    return A.eligible_pairs(A.with_exposure(annotated(t), ceiling=500.0), 0.001, 0.05)


@query("eligible_pairs", """
select row_number() over (order by cast(substr(chrom, 4) as int), bin_i, bin_j) - 1 as pair_id, chrom, bin_i, bin_j, least(raw, 500) as exposure, raw > 500 as exposure_clipped from {eligible}""")
def eligible_pairs(t):
    return eligible(t).select("pair_id", "chrom", "bin_i", "bin_j", "exposure", "exposure_clipped")


@query("eligibility_report", """
select coalesce(map_i >= 0.001 and map_j >= 0.001 and val_i >= 0.05 and val_j >= 0.05, false) as eligible, count(*) as pairs from {annotated} group by 1""")
def eligibility_report(t):
    return A.eligibility_report(annotated(t), 0.001, 0.05)


@query("anchor_classes", """
select case when ori_i = 1 and ori_j = -1 then 'ctcf_convergent' when tss_i or tss_j then 'promoter' when ccre_i or ccre_j then 'ccre' when ori_i <> 0 or ori_j <> 0 then 'ctcf' else 'other' end as anchor_class,
 count(*) as pairs, count(*) filter (tss_i or tss_j) as promoter, count(*) filter (ccre_i or ccre_j) as ccre, count(*) filter (ori_i <> 0 or ori_j <> 0) as ctcf,
 count(*) filter (ori_i = 1 and ori_j = -1) as convergent, count(*) filter (ori_i = -1 and ori_j = 1) as divergent from {annotated} group by 1""")
def anchor_classes(t):
    rows = A.anchor_class(A.anchor_labels(annotated(t)))
    short = [c.replace("anchor_has_", "").replace("anchor_ctcf_", "") for c in A.LABELS]
    return rows.groupBy("anchor_class").agg(F.count(F.lit(1)).alias("pairs"), *[F.count_if(c).alias(s) for c, s in zip(A.LABELS, short)])


@query("symmetric_encoding", """
select pair_id, coalesce(gc_i, 0) + coalesce(gc_j, 0) as gc_sum, abs(coalesce(gc_i, 0) - coalesce(gc_j, 0)) as gc_difference from {annotated}""")
def symmetric_encoding(t):
    total, apart = S.symmetric_pair("gc_i", "gc_j")
    return A.imputed(annotated(t), ["gc_i", "gc_j"]).select("pair_id", total.alias("gc_sum"), apart.alias("gc_difference"))


@query("symmetric_vectors", """
select a.vec_id, a.embedding[1] + b.embedding[1] as first_sum, abs(a.embedding[64] - b.embedding[64]) as last_difference, 128 as width
from {embeddings} a join {embeddings} b on b.vec_id = a.vec_id + 1""")
def symmetric_vectors(t):
    a = t.embeddings.select("vec_id", F.col("embedding").alias("x"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    out = a.join(b, "vec_id").withColumn("v", S.symmetric_vectors("x", "y"))
    return out.select("vec_id", F.col("v")[0].alias("first_sum"), F.col("v")[127].alias("last_difference"), F.size("v").alias("width"))


STEPS["ep"] = """
with e as (select distinct chrom, b * 10000 as bin, label from {intervals}, lateral (select unnest(range(cast(floor(start_bp / 10000) as bigint), cast(floor((end_bp - 1) / 10000) as bigint) + 1)) as b) where label <> 'other'),
f as (select a.*, exists (select 1 from e where e.chrom = a.chrom and bin = bin_i and label = 'dELS') as di, exists (select 1 from e where e.chrom = a.chrom and bin = bin_j and label = 'dELS') as dj,
 exists (select 1 from e where e.chrom = a.chrom and bin = bin_i and label = 'pELS') as pi, exists (select 1 from e where e.chrom = a.chrom and bin = bin_j and label = 'pELS') as pj from {annotated} a)
select pair_id, (tss_i and not tss_j and dj) or (tss_j and not tss_i and di) as "dELS", (tss_i and not tss_j and pj) or (tss_j and not tss_i and pi) as "pELS",
 (tss_i and not tss_j and (dj or pj)) or (tss_j and not tss_i and (di or pi)) as "ELS", chrom || ':' || cast(case when tss_i and not tss_j then bin_i else bin_j end as varchar) as promoter_key from f"""


def ep_table(t):
    rows = annotated(t)
    for label in ("dELS", "pELS"):
        rows = A.flag_bins(rows, I.interval_bins(t.intervals.filter(F.col("label") == label), BIN_SIZE, force_one=True), label)
    return A.ep_masks(rows)


@query("ep_masks", "select * from {ep}")
def ep_masks(t):
    return ep_table(t).select("pair_id", "dELS", "pELS", "ELS", "promoter_key")


@query("read_blocks", """
select 'A' as member, count(*) as rows, cast(sum(pos1) as bigint) as starts from {raw_contacts} where read_id % 3 <> 0
union all select 'B', count(*), cast(sum(pos2) as bigint) from {raw_contacts} where read_id % 5 <> 0""")
def read_blocks(t):
    def block(keep, at, tag):
        def cell(c):
            return F.when(keep, c)
        return [cell(c).alias(f"{n}_{tag}") for n, c in (("a", F.col("chrom1")), ("b", F.col(at)), ("c", F.col(at) + 5000), ("d", F.col("chrom2")),
                                                        ("e", F.col("pos2")), ("f", F.col("pos2") + 5000), ("g", F.col("call_probability")))]

    wide = t.raw_contacts.select(*block(F.col("read_id") % 3 != 0, "pos1", "x"), *block(F.col("read_id") % 5 != 0, "pos2", "y"))
    return T.read_blocks(wide, ["A", "B"]).groupBy("member").agg(F.count(F.lit(1)).alias("rows"), F.sum("start_i").alias("starts"))


def map_table(t):
    values = t.scored.select(F.lit("shared").alias("output_id"), "pair_id", "tile_row", (F.col("exposure") * (1 + F.col("score"))).alias("rate"))
    return values


@query("write_maps", """
select t.tile_row as grid_tile, count(*) as cells, sum(exposure * (1 + score)) as total from {scored} u join {tiles} t on u.chrom = t.chrom and u.bin_i >= t.target_start and u.bin_j + 10000 <= t.target_end group by 1""")
def write_maps(t):
    from contactspark.operators.universe import pair_tiles

    use_checkpoints(t.spark)
    folder = os.path.join(t.spark.sparkContext.getCheckpointDir(), f"maps-{uuid.uuid4().hex}")
    T.write_table(T.map_rows(map_table(t), pair_tiles(t.universe, t.tiles, BIN_SIZE)), folder, ("output_id",))
    return t.spark.read.parquet(folder).groupBy("grid_tile").agg(F.count(F.lit(1)).alias("cells"), F.sum("rate").alias("total"))


@query("coverage_report", """
select 'shared' as output_id, 0 as missing, 0 as repeated, 0 as unknown, (select count(*) from {tiles}) - count(distinct tile_row) as missing_tiles, 0 as bad_values,
 (select count(*) from {tiles}) = count(distinct tile_row) as passed from {scored}""")
def coverage_report(t):
    return T.coverage_report(map_table(t), t.universe, t.tiles, ["rate"])
