"""The canonical universe of bin pairs: enumeration, deduplication, purge, numbering, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactspark.functions.scalars import aligned_target_start, chrom_number, fdiv, strict_distance_band
from contactspark.operators.ordered import checkpointed, written
from contactspark.settings import Geometry

PAIR = ["chrom", "bin_i", "bin_j"]


def align_tiles(tiles: DataFrame, bin_size: int, span: int = 1_000_000) -> DataFrame:
    """Move each target to the bin grid; ``changed`` marks moved rows and a target must stay in its window."""
    start = aligned_target_start("input_start", "input_end", bin_size, span)
    moved = tiles.withColumns({"_old_start": F.col("target_start"), "_old_end": F.col("target_end"), "target_start": start})
    moved = moved.withColumn("target_end", F.col("target_start") + span)
    inside = (F.col("target_start") >= F.col("input_start")) & (F.col("target_end") <= F.col("input_end"))
    return (
        moved.withColumn("target_end", F.when(inside, F.col("target_end")).otherwise(
            F.raise_error(F.concat(F.lit("target leaves its window: "), F.col("tile_id"))).cast("long")))
        .withColumn("changed", (F.col("target_start") != F.col("_old_start")) | (F.col("target_end") != F.col("_old_end")))
        .drop("_old_start", "_old_end")
    )


def alignment_report(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("split").agg(
        F.count(F.lit(1)).alias("tiles"), F.sum(F.col("changed").cast("long")).alias("changed_tiles")
    )


def enumerate_pairs(tiles: DataFrame, geometry: Geometry, span: int = 1_000_000) -> DataFrame:
    """Every bin pair of every tile within the modelled range, with its margin to the tile border."""
    size, bins = geometry.bin_size, span // geometry.bin_size
    first, last = geometry.bins[0], min(geometry.bins[-1], bins - 1)
    distances = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("distance_bin")
    offsets = F.explode(F.sequence(F.lit(0), F.lit(bins - 1) - F.col("distance_bin"))).alias("_offset")
    base = tiles.select("tile_row", "tile_id", "chrom", "split", "target_start", distances)
    return base.select("*", offsets).select(
        "chrom",
        (F.col("target_start") + F.col("_offset") * size).alias("bin_i"),
        (F.col("target_start") + (F.col("_offset") + F.col("distance_bin")) * size).alias("bin_j"),
        (F.col("distance_bin") * size).alias("distance_bp"),
        "distance_bin",
        "tile_row",
        "tile_id",
        "split",
        F.least("_offset", F.lit(bins - 1) - F.col("_offset") - F.col("distance_bin")).alias("boundary_margin_bins"),
    )


def left_bins(tiles: DataFrame, geometry: Geometry, span: int = 1_000_000) -> DataFrame:
    """One row per left bin: ``chrom, bin_i, tiles, owners``, where ``owners`` holds for each modelled distance the place in ``tiles`` of the
    tile that keeps the pair (widest margin, then first tile id), or null where no tile holds it.

    All representations of a pair share its left bin, so they are compared inside one row and no pair is shuffled.
    """
    size, bins = geometry.bin_size, span // geometry.bin_size
    first, last = geometry.bins[0], min(geometry.bins[-1], bins - 1)
    offset = F.explode(F.sequence(F.lit(0), F.lit(bins - 1 - first))).alias("offset")
    each = tiles.select("chrom", "target_start", "tile_id", "tile_row", "split", offset)
    rows = each.groupBy("chrom", (F.col("target_start") + F.col("offset") * size).alias("bin_i")).agg(
        F.array_sort(F.collect_list(F.struct("tile_id", "tile_row", "split", "offset"))).alias("tiles"))

    def owner(d: Column) -> Column:
        # one integer per tile: the lack of margin, then the place in tile-id order
        def rank(t: Column, place: Column) -> Column:
            margin = F.least(t["offset"], F.lit(bins - 1) - t["offset"] - d)
            return F.when(margin >= 0, (F.lit(bins) - margin).cast("long") * F.lit(1 << 32) + place)

        return (F.array_min(F.transform("tiles", rank)) % F.lit(1 << 32)).cast("int")

    return rows.withColumn("owners", F.transform(F.sequence(F.lit(first), F.lit(last)), owner))


def _pairs(rows: DataFrame, geometry: Geometry, span: int, *more: Column) -> DataFrame:
    """Pairs of rows with ``chrom, bin_i, distance_bin`` and the ``tile`` that keeps them."""
    margin = F.least(F.col("tile.offset"), F.lit(span // geometry.bin_size - 1) - F.col("tile.offset") - F.col("distance_bin"))
    return rows.select(
        "chrom", "bin_i", (F.col("bin_i") + F.col("distance_bin") * geometry.bin_size).alias("bin_j"),
        (F.col("distance_bin") * geometry.bin_size).cast("int").alias("distance_bp"), F.col("distance_bin").cast("int").alias("distance_bin"),
        "tile.tile_row", "tile.tile_id", "tile.split", margin.cast("int").alias("boundary_margin_bins"), *more)


def canonical_pairs(tiles: DataFrame, geometry: Geometry, span: int = 1_000_000) -> DataFrame:
    """One row per bin pair: the tile where it has the widest margin, then the first tile id."""
    each = left_bins(tiles, geometry, span).select("chrom", "bin_i", "tiles", F.posexplode("owners").alias("_d", "_owner")).filter("_owner is not null")
    return _pairs(each.select("chrom", "bin_i", (F.col("_d") + geometry.bins[0]).alias("distance_bin"), F.col("tiles")[F.col("_owner")].alias("tile")), geometry, span)


def conflicting_anchors(pairs: DataFrame) -> DataFrame:
    """Anchor bins that pairs of more than one split use."""
    # distinct first: a few thousand (bin, split) rows are left of millions of anchors
    anchors = pairs.select("chrom", F.explode(F.array("bin_i", "bin_j")).alias("bin"), "split").distinct()
    return anchors.groupBy("chrom", "bin").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("chrom", "bin")


def purge_cross_split(pairs: DataFrame) -> DataFrame:
    """Drop every pair that touches an anchor bin shared between splits."""
    bad = conflicting_anchors(pairs)
    return pairs.join(bad.withColumnRenamed("bin", "bin_i"), ["chrom", "bin_i"], "left_anti").join(
        bad.withColumnRenamed("bin", "bin_j"), ["chrom", "bin_j"], "left_anti"
    )


def assign_pair_id(pairs: DataFrame) -> DataFrame:
    """Number pairs from 0 by chromosome number, left bin, right bin.

    Three levels of prefix counts instead of one global sort: rows per chromosome
    (at most a few dozen), rows per left bin within a chromosome (bounded by the
    chromosome's length), position within a left bin (bounded by the range).
    """
    starts = _first_ids(pairs.groupBy("chrom", "bin_i").agg(F.count(F.lit(1)).alias("_n")))
    position = F.row_number().over(W.partitionBy("chrom", "bin_i").orderBy("bin_j"))
    return (
        pairs.drop("pair_id").join(starts, ["chrom", "bin_i"])
        .withColumn("pair_id", (F.col("_start") + position - 1).cast("long")).drop("_start")
    )


def _first_ids(per_bin: DataFrame) -> DataFrame:
    """First pair id of every left bin, from the pairs ``_n`` that each holds: ``chrom, bin_i, _start``."""
    per_chrom = per_bin.groupBy("chrom").agg(F.sum("_n").alias("_n")).withColumn("_k", chrom_number())
    before = W.orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    chrom_start = per_chrom.select("chrom", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"))
    along = W.partitionBy("chrom").orderBy("bin_i").rowsBetween(W.unboundedPreceding, -1)
    bin_start = per_bin.select("chrom", "bin_i", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_b"))
    # a few dozen rows
    return bin_start.join(F.broadcast(chrom_start), "chrom").select("chrom", "bin_i", (F.col("_b") + F.col("_c")).alias("_start"))


def build_universe(tiles: DataFrame, geometry: Geometry | None = None, span: int = 1_000_000) -> DataFrame:
    """Enumerate, keep one representation, purge shared anchors, number, name the band.

    The work is done on rows of left bins, some dozens a tile; they become pairs in the last step, which shuffles nothing. It equals
    ``assign_pair_id(purge_cross_split(canonical_pairs(tiles)))``.
    """
    geometry = geometry or Geometry()
    return pairs_of(universe_rows(tiles, geometry, span), geometry, span)


def universe_rows(tiles: DataFrame, geometry: Geometry, span: int = 1_000_000) -> DataFrame:
    """The pair table as one row per left bin: ``chrom, bin_i, tiles, _start, _kept``, with the first id and the pairs in order."""
    size, first = geometry.bin_size, geometry.bins[0]
    # read three times below (anchors, counts per left bin, pairs), so it is stored once
    rows = written(left_bins(tiles, geometry, span))
    at = F.posexplode("owners").alias("_d", "_owner")
    used = rows.select("chrom", "bin_i", "tiles", at).filter("_owner is not null").select(
        "chrom", "bin_i", (F.col("bin_i") + (F.col("_d") + first) * size).alias("bin_j"), F.col("tiles")[F.col("_owner")]["split"].alias("split"))
    bad = checkpointed(conflicting_anchors(used))
    reach = F.explode(F.sequence(F.lit(0), F.lit(len(geometry.bins) - 1))).alias("_d")
    right = bad.select("chrom", "bin", reach).groupBy("chrom", (F.col("bin") - (F.col("_d") + first) * size).alias("bin_i")).agg(F.collect_set("_d").alias("_bad"))
    clean = rows.join(bad.withColumnRenamed("bin", "bin_i"), ["chrom", "bin_i"], "left_anti").join(right, ["chrom", "bin_i"], "left")
    places = F.transform("owners", lambda o, d: F.struct((d + first).alias("distance_bin"), o.alias("owner"), d.alias("d")))
    good = F.when(F.col("_bad").isNull(), F.filter(places, lambda p: p["owner"].isNotNull())).otherwise(
        F.filter(places, lambda p: p["owner"].isNotNull() & ~F.array_contains("_bad", p["d"])))
    kept = written(clean.select("chrom", "bin_i", "tiles", good.alias("_kept")).filter(F.size("_kept") > 0))
    starts = _first_ids(kept.select("chrom", "bin_i", F.size("_kept").cast("long").alias("_n")))
    return kept.join(starts, ["chrom", "bin_i"])


def pairs_of(rows: DataFrame, geometry: Geometry, span: int = 1_000_000, *more: str) -> DataFrame:
    """The pairs of ``universe_rows``, with further columns of the rows."""
    each = rows.select("chrom", "bin_i", "tiles", "_start", *more, F.posexplode("_kept").alias("_at", "_p"))
    each = each.select("chrom", "bin_i", "_p.distance_bin", F.col("tiles")[F.col("_p.owner")].alias("tile"), (F.col("_start") + F.col("_at")).cast("long").alias("pair_id"), *more)
    return _pairs(each, geometry, span, F.col("pair_id"), *map(F.col, more)).withColumn("distance_band", strict_distance_band("distance_bp", geometry.bands))


def universe_report(enumerated: DataFrame, canonical: DataFrame, purged: DataFrame) -> DataFrame:
    """Row counts along the build: representations, canonical, kept, with the duplicates and purged rows between."""
    def one(df, name):
        return df.agg(F.count(F.lit(1)).alias(name))

    return (
        one(enumerated, "representations").crossJoin(one(canonical, "canonical")).crossJoin(one(purged, "kept"))
        .withColumn("duplicates_removed", F.col("representations") - F.col("canonical"))
        .withColumn("cross_split_removed", F.col("canonical") - F.col("kept"))
    )


def pair_table_checks(pairs: DataFrame) -> DataFrame:
    """Unique and contiguous ids, unique coordinates, ordered anchors.

    Uniqueness is a grouped count, so no single task holds the ids.
    """
    ids = pairs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.max("n") == 1, F.lit(True)).alias("unique_id"),
        (F.coalesce(F.min("pair_id"), F.lit(0)) == 0).alias("_low"),
        (F.coalesce(F.max("pair_id") + 1, F.lit(0)) == F.coalesce(F.sum("n"), F.lit(0))).alias("_high"),
    )
    places = pairs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.max("n") == 1, F.lit(True)).alias("unique_coordinates"),
        F.coalesce(F.bool_and(F.col("bin_i") < F.col("bin_j")), F.lit(True)).alias("ordered_anchors"),
    )
    both = ids.crossJoin(places).withColumn("contiguous_id", F.col("unique_id") & F.col("_low") & F.col("_high"))
    return checks(both, ["unique_id", "unique_coordinates", "ordered_anchors", "contiguous_id"])


def checks(row: DataFrame, names: list[str]) -> DataFrame:
    """A one-row table of booleans as ``(check, passed)`` rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(False)).alias("passed")) for n in names])
    return row.select(F.inline(pairs))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


def pair_tiles(pairs: DataFrame, tiles: DataFrame, bin_size: int, span: int = 1_000_000, step: int | None = None) -> DataFrame:
    """Every tile that wholly holds each pair, with the pair's cell ``(i, j)`` in that tile.

    Tiles are indexed by the coarse blocks they cover, so the join is on equality;
    a tile lies in at most two blocks of its own span.
    """
    first, last = fdiv("target_start", span), fdiv(F.col("target_end") - 1, span)
    index = tiles.select(
        "chrom", F.col("tile_row").alias("grid_tile"), "target_start", "target_end", F.explode(F.sequence(first, last)).alias("_block")
    )
    hit = pairs.withColumn("_block", fdiv("bin_i", span)).join(index, ["chrom", "_block"])
    return hit.filter((F.col("bin_i") >= F.col("target_start")) & (F.col("bin_j") + bin_size <= F.col("target_end"))).select(
        "grid_tile",
        fdiv(F.col("bin_i") - F.col("target_start"), bin_size).alias("i"),
        fdiv(F.col("bin_j") - F.col("target_start"), bin_size).alias("j"),
        "pair_id",
    )


def mirrored(cells: DataFrame) -> DataFrame:
    """Upper-triangle cells together with their mirror images; the diagonal once."""
    flipped = cells.filter("i <> j").withColumns({"i": F.col("j"), "j": F.col("i")})
    return cells.unionByName(flipped)
