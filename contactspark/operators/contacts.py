"""Contact records: binning, routing to cell groups, filters with full accounting, pixel tables.

Records are summed to (cell, bin pair) first; every later join and shuffle then
carries counts, so one busy cell or one busy bin pair costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.functions.scalars import fdiv, floor_to

CELL = ["library_id", "dna_barcode"]
PAIR = ["chrom", "bin_i", "bin_j"]
REASONS = ("malformed", "unmatched_barcode", "trans", "unknown_chrom", "distance", "not_in_universe", "kept")


def canonical_anchors(contacts: DataFrame, bin_size: int) -> DataFrame:
    """Bin both ends and order them by (chromosome name, bin), each bin with its own chromosome.

    ``distance_bp`` is a bin multiple, null between two chromosomes.
    """
    left, right = floor_to("pos1", bin_size), floor_to("pos2", bin_size)
    cis = F.col("chrom1") == F.col("chrom2")
    swap = (F.col("chrom1") > F.col("chrom2")) | (cis & (left > right))
    return contacts.withColumns({
        "bin_i": F.when(swap, right).otherwise(left), "bin_j": F.when(swap, left).otherwise(right), "distance_bp": F.when(cis, F.abs(left - right)),
        "chrom1": F.when(swap, F.col("chrom2")).otherwise(F.col("chrom1")), "chrom2": F.when(swap, F.col("chrom1")).otherwise(F.col("chrom2")),
    })


def binned_contacts(contacts: DataFrame, bin_size: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Contacts summed per cell and bin pair: the first and only shuffle of raw records."""
    return (
        canonical_anchors(contacts, bin_size)
        .groupBy(*CELL, "chrom1", "chrom2", "bin_i", "bin_j", "distance_bp", *extra)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def repeated_barcodes(membership: DataFrame) -> DataFrame:
    """Barcodes listed more than once in one library; must be empty."""
    return membership.groupBy(*CELL).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def unique_cells(membership: DataFrame) -> DataFrame:
    """Cell, type and context per barcode; a barcode listed twice in a library is an error, as it would multiply records."""
    rows = membership.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_rows"), F.min(F.struct("cell_id", "cell_type", "context_index")).alias("_c"))
    once = F.when(F.col("_rows") == 1, F.col("_c.cell_id")).otherwise(F.raise_error(F.concat(F.lit("barcode listed twice: "), F.col("dna_barcode"))).cast("string"))
    return rows.select(*CELL, once.alias("cell_id"), "_c.cell_type", "_c.context_index")


def assign_context(binned: DataFrame, membership: DataFrame) -> DataFrame:
    """Keep the records of member cells and attach their cell type and context; a barcode listed twice is an error."""
    return binned.join(unique_cells(membership), CELL)


def classify(binned: DataFrame, membership: DataFrame, pairs: DataFrame, chroms: list[str], low: int, high: int) -> DataFrame:
    """Attach the first rule each record fails, or ``kept``.

    ``pairs`` is the candidate universe.  A null position marks a malformed record.
    """
    known = pairs.select(F.col("chrom").alias("chrom1"), "bin_i", "bin_j", F.lit(True).alias("_in_universe"))
    members = membership.select(*CELL, "cell_id", "cell_type", "context_index")
    joined = binned.join(members, CELL, "left").join(known, ["chrom1", "bin_i", "bin_j"], "left")
    bad = F.col("bin_i").isNull() | F.col("bin_j").isNull() | F.col("chrom1").isNull() | F.col("chrom2").isNull()
    reason = (
        F.when(bad, "malformed")
        .when(F.col("context_index").isNull(), "unmatched_barcode")
        .when(F.col("chrom1") != F.col("chrom2"), "trans")
        .when(~F.col("chrom1").isin(chroms), "unknown_chrom")
        .when((F.col("distance_bp") < low) | (F.col("distance_bp") >= high), "distance")
        .when(F.col("_in_universe").isNull(), "not_in_universe")
        .otherwise("kept")
    )
    return joined.withColumn("reason", reason).drop("_in_universe")


def exclusion_counts(classified: DataFrame) -> DataFrame:
    """Records per reason; every record counts once."""
    return classified.groupBy("reason").agg(F.sum("n").alias("contacts"))


def restrict_to_universe(binned: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(hits, misses)``: cis records whose bin pair is, or is not, in the universe."""
    cis = binned.filter("chrom1 = chrom2").withColumnRenamed("chrom1", "chrom").drop("chrom2")
    keys = pairs.select(*PAIR, "pair_id")
    return cis.join(keys, PAIR), cis.join(keys, PAIR, "left_anti")


def contacts_to_pixels(contacts: DataFrame, bin_size: int, groups: tuple[str, ...] = ()) -> DataFrame:
    """Counts per bin pair (``chrom`` and ``chrom2`` hold ``bin_i`` and ``bin_j``); their sum is the number of records read."""
    return (
        canonical_anchors(contacts, bin_size)
        .groupBy(*groups, F.col("chrom1").alias("chrom"), "chrom2", "bin_i", "bin_j")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def coarsen_pixels(pixels: DataFrame, bin_size: int, factor: int) -> DataFrame:
    """Sum pixels into bins ``factor`` times as wide."""
    if int(factor) != factor or factor < 1:
        raise ValueError("factor must be a whole number of at least 1")
    wide = bin_size * int(factor)
    return pixels.groupBy("chrom", "chrom2", floor_to("bin_i", wide).alias("bin_i"), floor_to("bin_j", wide).alias("bin_j")).agg(
        F.sum("count").alias("count")
    )


def pixel_mass(pixels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Total of the pixels whose bin pair is in the candidate set, which lies within chromosomes, and of all pixels."""
    keys = pairs.select(*PAIR, F.col("chrom").alias("chrom2"), F.lit(True).alias("_hit"))
    return pixels.join(keys, [*PAIR, "chrom2"], "left").agg(
        F.coalesce(F.sum(F.when(F.col("_hit"), F.col("count"))), F.lit(0)).cast("long").alias("universe_mass"),
        F.sum("count").cast("long").alias("total_mass"),
    )


def with_genome_bins(pixels: DataFrame, chrom_bins: DataFrame, bin_size: int) -> DataFrame:
    """Number bins over the whole genome: ``chrom_bins`` holds each chromosome's ``first_bin``."""
    second = chrom_bins.select(F.col("chrom").alias("chrom2"), F.col("first_bin").alias("_second"))
    a, b = F.col("first_bin") + fdiv("bin_i", bin_size), F.col("_second") + fdiv("bin_j", bin_size)
    return pixels.join(chrom_bins.select("chrom", "first_bin"), "chrom").join(second, "chrom2").select(
        F.least(a, b).alias("bin1_id"), F.greatest(a, b).alias("bin2_id"), "count")


def route_contacts(contacts: DataFrame, membership: DataFrame) -> DataFrame:
    """Every record of a member cell twice: under its cell type and under ``all_cells``.

    To store them, write the member records once by cell type (``tables.write_routed``).
    """
    routed = contacts.join(membership.select(*CELL, "cell_type"), CELL)
    return routed.withColumn("output_id", F.explode(F.array(F.col("cell_type"), F.lit("all_cells"))))


def routed_totals(contacts: DataFrame, membership: DataFrame, contexts: DataFrame) -> DataFrame:
    """Records routed per output against the declared valid pairs."""
    counts = (
        contacts.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).join(membership.select(*CELL, "cell_type"), CELL)
        .groupBy("cell_type").agg(F.sum("n").alias("routed"))
    )
    rows = contexts.select("cell_type", F.col("valid_pairs").alias("declared")).join(counts, "cell_type", "left")
    rows = rows.select(F.col("cell_type").alias("output_id"), F.coalesce("routed", F.lit(0)).alias("routed"), "declared")
    total = rows.agg(F.lit("all_cells").alias("output_id"), F.sum("routed").alias("routed"), F.sum("declared").alias("declared"))
    return rows.unionByName(total).withColumn("matches", F.col("routed") == F.col("declared"))


def route_family_half(contacts: DataFrame, assignments: DataFrame, families: DataFrame, split: int, half: str = "B") -> DataFrame:
    """Four-column records of one half of one split, under each family that holds the cell type.

    ``contacts`` carries the file's own ``cell_type``; rows that disagree with the
    assignment are dropped here and counted by ``cell_type_mismatches``.  A record without its
    four fields is an error, and so is a family without a single cell.
    """
    whole = F.col("chrom1").isNotNull() & F.col("pos1").isNotNull() & F.col("chrom2").isNotNull() & F.col("pos2").isNotNull()
    contacts = contacts.withColumn("chrom1", F.when(whole, F.col("chrom1")).otherwise(F.raise_error(F.lit("malformed record")).cast("string")))
    cells = assignments.filter((F.col("split") == split) & (F.col("half") == half)).select(
        *CELL, F.col("cell_type").alias("assigned_type")
    )
    groups = families.select(F.col("output_id").alias("family"), F.col("member").alias("assigned_type"))
    return (
        contacts.join(cells.join(filled_families(groups, cells), "assigned_type"), CELL)
        .filter(F.col("cell_type") == F.col("assigned_type"))
        .select("family", "chrom1", "pos1", "chrom2", "pos2")
    )


def filled_families(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows ``family, assigned_type``; a family none of whose types has a cell is an error."""
    types = cells.select("assigned_type").distinct().withColumn("_has", F.lit(1))
    held = groups.join(types, "assigned_type", "left").groupBy("family").agg(F.count("_has").alias("_cells"), F.collect_set("assigned_type").alias("_types"))
    name = F.when(F.col("_cells") > 0, F.col("family")).otherwise(F.raise_error(F.concat(F.lit("family without cells: "), F.col("family"))).cast("string"))
    return held.select(name.alias("family"), F.explode("_types").alias("assigned_type"))


def family_half_counts(contacts: DataFrame, assignments: DataFrame, families: DataFrame, split: int) -> DataFrame:
    """Records of halves A and B per family for one split, an empty half included as 0.

    Where records declare a cell type, those that disagree with the assignment are left out, as in ``route_family_half``.
    """
    declared = ["cell_type"] if "cell_type" in contacts.columns else []
    per_cell = contacts.groupBy(*CELL, *[F.col(c).alias("_declared") for c in declared]).agg(F.count(F.lit(1)).alias("n"))
    cells = assignments.filter(F.col("split") == split).select(*CELL, "cell_type", "half")
    if declared:
        per_cell = per_cell.join(cells, CELL).filter("_declared = cell_type").select(*CELL, "n")
    groups = families.select(F.col("output_id").alias("family"), F.col("member").alias("cell_type"))
    per_type = per_cell.join(cells, CELL).groupBy("cell_type", "half").agg(F.sum("n").alias("n"))
    return (
        groups.join(per_type, "cell_type", "left")
        .groupBy("family")
        .agg(
            F.coalesce(F.sum(F.when(F.col("half") == "A", F.col("n"))), F.lit(0)).alias("contacts_a"),
            F.coalesce(F.sum(F.when(F.col("half") == "B", F.col("n"))), F.lit(0)).alias("contacts_b"),
        )
    )


def cell_type_mismatches(contacts: DataFrame, assignments: DataFrame) -> DataFrame:
    """Records per (declared, assigned) cell type where the two differ."""
    cells = assignments.select(*CELL, F.col("cell_type").alias("assigned_type")).distinct()
    per_cell = contacts.groupBy(*CELL, "cell_type").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_cell.join(cells, CELL).filter(F.col("cell_type") != F.col("assigned_type"))
        .groupBy("cell_type", "assigned_type").agg(F.sum("n").alias("contacts"))
    )


def membership_contract(membership: DataFrame, contexts: DataFrame, binned: DataFrame) -> DataFrame:
    """Declared against found: cells and valid pairs per context, and cells whose records disagree."""
    per_cell = binned.groupBy(*CELL).agg(F.sum("n").alias("records"))
    found = (
        membership.join(per_cell, CELL, "left")
        .groupBy("context_index")
        .agg(
            F.count(F.lit(1)).alias("cells_found"),
            F.sum("valid_pairs").cast("long").alias("pairs_found"),
            F.sum(F.when(F.coalesce("records", F.lit(0)) != F.col("valid_pairs"), 1).otherwise(0)).cast("long").alias("cells_off"),
        )
    )
    out = contexts.select("context_index", "n_cells", "valid_pairs").join(found, "context_index", "full_outer")
    return out.withColumn(
        "passed",
        F.coalesce(
            (F.col("n_cells") == F.col("cells_found")) & (F.col("valid_pairs") == F.col("pairs_found")) & (F.col("cells_off") == 0),
            F.lit(False),
        ),
    )


def conservation(binned_in_universe: DataFrame, counts: DataFrame, pixels_in_universe: DataFrame) -> DataFrame:
    """Mass seen in the record pass, in the count table and in the pixel table; halves must recombine."""
    stream = binned_in_universe.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("stream_mass"))
    table = counts.agg(
        F.coalesce(F.sum("full_count"), F.lit(0)).cast("long").alias("table_mass"),
        F.coalesce(F.sum((F.col("counts_a") + F.col("counts_b") != F.col("full_count")).cast("long")), F.lit(0)).alias("unbalanced"),
    )
    mass = pixels_in_universe.select(F.col("universe_mass").alias("pixel_mass"))
    # three one-row tables, so the product is one row
    out = stream.crossJoin(table).crossJoin(mass)
    same = (F.col("stream_mass") == F.col("table_mass")) & (F.col("table_mass") == F.col("pixel_mass"))
    return out.withColumn("passed", same & (F.col("unbalanced") == 0))
