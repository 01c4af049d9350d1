"""Pseudoreplicate halves and the sparse evidence table (zero counts are implied)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactspark.functions.draws import uniform
from contactspark.functions.scalars import fdiv, fraction_k, within
from contactspark.operators.contacts import CELL, PAIR, canonical_anchors, unique_cells
from contactspark.operators.ordered import checkpointed, numbered


def balanced_halves(membership: DataFrame, splits: int, seed: int) -> DataFrame:
    """Split the cells of each context into two depth-balanced halves, ``splits`` times.

    Cells of a library are ordered by depth and taken in neighbouring pairs, a last odd
    cell by itself; each pair sends one cell to either half.  Pairs are turned in couples,
    numbered through all libraries of a context: the second of a couple is turned against
    the first, which an md5 bit of seed, split, context and couple turns.  The gap between
    the halves is then at most the sum of the libraries' depth ranges and odd cells,
    however many cells there are.
    """
    order = [("valid_pairs", True), ("cell_id", False)]
    keys = ["context_index", "library_id"]
    placed = numbered(membership.select(*CELL, "cell_id", "cell_type", "context_index", "valid_pairs"), keys, order, "_place")
    pairs = membership.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / 2).alias("_n"))
    before = W.partitionBy("context_index").orderBy("library_id").rowsBetween(W.unboundedPreceding, -1)  # one row per library
    first = pairs.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    pair = F.col("_first") + fdiv(F.col("_place") - 1, 2)
    rows = placed.join(first, keys).select("*", pair.alias("_pair"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"))
    turned = uniform(seed, "split", "context_index", fdiv("_pair", 2)) < 0.5
    second = (F.col("_place") % 2 == 0) != (F.col("_pair") % 2 == 1)
    return rows.select(*CELL, "cell_id", "cell_type", "context_index", "split", F.when(second != turned, "B").otherwise("A").alias("half"))


def half_summary(assignments: DataFrame, membership: DataFrame) -> DataFrame:
    """Cells and valid pairs per context, split and half."""
    depth = membership.select(*CELL, "valid_pairs")
    return assignments.join(depth, CELL).groupBy("context_index", "split", "half").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("valid_pairs").cast("long").alias("valid_pairs")
    )


def _with_half_mask(records: DataFrame, assignments: DataFrame, splits: int) -> DataFrame:
    """Attach each cell's halves as one integer: bit ``s`` is set when the cell is in half A of split ``s``."""
    if splits > 62:
        raise ValueError("at most 62 splits fit in one mask")
    bit = F.pow(F.lit(2.0), F.col("split")).cast("long")
    mask = assignments.groupBy(*CELL).agg(
        F.coalesce(F.sum(F.when(F.col("half") == "A", bit)), F.lit(0)).alias("_mask"), F.count(F.lit(1)).alias("_splits")
    )
    complete = F.when(F.col("_splits") == splits, F.col("_mask")).otherwise(
        F.raise_error(F.concat(F.lit("cell lacks a split: "), F.col("dna_barcode"))).cast("long"))
    return records.join(mask.withColumn("_mask", complete).drop("_splits"), CELL)


def cell_masks(membership: DataFrame, assignments: DataFrame, splits: int) -> DataFrame:
    """One row per cell: ``library_id, dna_barcode, context_index, _mask``; bit ``s`` is set when the cell is in half A of split ``s``."""
    return _with_half_mask(unique_cells(membership).select(*CELL, "context_index"), assignments, splits)


def pair_sums(contacts: DataFrame, cells: DataFrame, pairs: DataFrame, splits: int, *, bin_size: int, low: int, high: int) -> DataFrame:
    """``context_index, pair_id, full_count, a_by_split`` from raw records, and the pair's place: ``chrom, bin_i, distance_bin``.

    Records outside the distance range go at the scan.  Each is then given its context and halves from the one cell table and summed by
    context and bin pair: the only shuffle of records, with partial sums before it.  The sums meet the universe folded to its left bins
    (``left_bin_ids``), so no pair moves.  Two splits share one number (32 bits each) until they are read, which makes half the sums and
    narrower rows.
    """
    near = canonical_anchors(contacts, bin_size).filter(within("distance_bp", low, high)).join(cells, CELL)

    def bit(s: int) -> Column:
        return F.shiftright(F.col("_mask"), s).bitwiseAND(F.lit(1))

    packed = [F.sum(bit(s) + F.shiftleft(bit(s + 1), 32) if s + 1 < splits else bit(s)).alias(f"_s{s}") for s in range(0, splits, 2)]
    # none is null within the range; said here, or the join's checks for nulls would be moved down to the scan with all that is behind them
    pair = [F.coalesce(F.col(c), F.lit(none)).alias(n) for c, n, none in (("chrom1", "chrom", ""), ("bin_i", "bin_i", -1), ("bin_j", "bin_j", -1))]
    sums = near.groupBy("context_index", *pair).agg(F.count(F.lit(1)).alias("full_count"), *packed)
    # a pair's records in one context have to fit in 31 bits, so that no sum runs into its neighbour
    fits = F.when(F.col("full_count") < 1 << 31, F.col("full_count")).otherwise(F.raise_error(F.lit("pair with 2**31 records")).cast("long"))
    half = [F.shiftright(F.col(f"_s{s - s % 2}"), 32) if s % 2 else F.col(f"_s{s}").bitwiseAND(F.lit((1 << 32) - 1)) for s in range(splits)]
    found = sums.join(left_bin_ids(pairs, bin_size, high), PAIR[:2]).withColumn("pair_id", pair_id_of(bin_size, high)).filter(F.col("pair_id").isNotNull())
    place = ["chrom", "bin_i", fdiv(F.col("bin_j") - F.col("bin_i"), bin_size).cast("int").alias("distance_bin")]
    return found.select("context_index", "pair_id", fits.alias("full_count"), F.array(*half).alias("a_by_split"), *place)


def counts_by_left_bin(sums: DataFrame, primary: int = 0) -> DataFrame:
    """``chrom, bin_i, counts``: per left bin the shared counts of its seen pairs, by distance in bins.

    ``sums`` comes from ``pair_sums``. Seen pairs move once, dealt by left bin, and meet the pair table folded in the same way (``universe.universe_rows``), of
    which no pair moves. The number of parts is stated, as adaptive execution would merge folded rows into a few tasks that then make all pairs.
    """
    left = PAIR[:2]
    a = F.col("a_by_split")[primary]
    parts = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = sums.select(*left, "distance_bin", "full_count", a.alias("counts_a")).repartition(parts, *left)
    shared = seen.groupBy(*left, "distance_bin").agg(F.sum("full_count").alias("full_count"), F.sum("counts_a").alias("counts_a"))
    value = F.struct("full_count", "counts_a", (F.col("full_count") - F.col("counts_a")).alias("counts_b"))
    return shared.groupBy(*left).agg(F.map_from_entries(F.collect_list(F.struct("distance_bin", value))).alias("counts"))


WORD = 62  # distances held by one number


def _shift(name: str, value: Column, by: Column) -> Column:
    """Shift by a column; the Python functions take whole numbers only."""
    return F.call_function(name, value, by.cast("int"))


def left_bin_ids(pairs: DataFrame, bin_size: int, high: int) -> DataFrame:
    """Pairs nearer than ``high`` as one row per left bin: ``chrom, bin_i``, the first id and one bit per distance in bins.

    Needs the ids of ``universe.assign_pair_id``, which run without a gap along the right bins of a left bin. Gaps and wrong
    first or last ids are an error; another order between them is not noticed.
    """
    at = fdiv(F.col("bin_j") - F.col("bin_i"), bin_size).cast("int")
    near = (F.col("bin_j") >= F.col("bin_i")) & (F.col("bin_j") - F.col("bin_i") < high)
    words = [F.bit_or(F.when(fdiv(at, WORD) == w, _shift("shiftleft", F.lit(1).cast("long"), at % WORD)).otherwise(F.lit(0).cast("long"))) for w in range(high // bin_size // WORD + 1)]
    rows = pairs.filter(near).groupBy(*PAIR[:2]).agg(
        F.min("pair_id").alias("_first"), F.max("pair_id").alias("_last"), F.count(F.lit(1)).alias("_n"),
        F.min_by("pair_id", "bin_j").alias("_least"), F.max_by("pair_id", "bin_j").alias("_most"), *[w.alias(f"_d{i}") for i, w in enumerate(words)])
    held = sum((F.bit_count(f"_d{i}") for i in range(1, len(words))), F.bit_count("_d0"))
    whole = (F.col("_last") - F.col("_first") + 1 == F.col("_n")) & (held == F.col("_n")) & (F.col("_least") == F.col("_first")) & (F.col("_most") == F.col("_last"))
    return rows.select(*PAIR[:2], F.when(whole, F.col("_first")).otherwise(F.raise_error(F.lit("pair ids do not run along their left bin")).cast("long")).alias("_first"),
                       *[f"_d{i}" for i in range(len(words))])


def pair_id_of(bin_size: int, high: int) -> Column:
    """The id of ``bin_i, bin_j`` in a row with ``left_bin_ids``, null where the pair is not there: the first id and the bits below its own."""
    at = fdiv(F.col("bin_j") - F.col("bin_i"), bin_size).cast("int")
    place, word = at % WORD, fdiv(at, WORD)
    one, below, there = F.lit(1).cast("long"), F.lit(0), F.lit(False)
    for w in range(high // bin_size // WORD + 1):
        bits = F.col(f"_d{w}")
        mine = F.when(word > w, bits).when(word == w, bits.bitwiseAND(_shift("shiftleft", one, place) - 1)).otherwise(F.lit(0).cast("long"))
        below = below + F.bit_count(mine)
        there = there | ((word == w) & (_shift("shiftright", bits, place).bitwiseAND(one) == 1))
    return F.when(there, F.col("_first") + below)


def pool_splits(sums: DataFrame, outputs: DataFrame, splits: int) -> DataFrame:
    """Halves of every split per output: ``output_id, output_type, split, pair_id, counts_a, counts_b``.

    Outputs sum the arrays of their members; only the pooled arrays become rows.
    """
    half = [F.sum(F.col("a_by_split")[s]) for s in range(splits)]
    pooled = sums.join(outputs.select("output_id", "output_type", "context_index"), "context_index").groupBy("output_id", "output_type", "pair_id").agg(
        F.sum("full_count").alias("full_count"), F.array(*half).alias("a_by_split"))
    return pooled.select("output_id", "output_type", "pair_id", "full_count", F.posexplode("a_by_split").alias("split", "counts_a")).select(
        "output_id", "output_type", "split", "pair_id", "counts_a", (F.col("full_count") - F.col("counts_a")).alias("counts_b"))


def _half_sums(records: DataFrame, assignments: DataFrame, splits: int) -> DataFrame:
    masked = _with_half_mask(records, assignments, splits)
    sums = [F.sum(F.when(F.shiftright(F.col("_mask"), s).bitwiseAND(F.lit(1)) == 1, F.col("n")).otherwise(0)) for s in range(splits)]
    return masked.groupBy("context_index", "pair_id").agg(F.sum("n").alias("full_count"), F.array(*sums).alias("a_by_split"))


def evidence_counts(records: DataFrame, assignments: DataFrame, splits: int, primary: int = 0) -> DataFrame:
    """Counts per context and pair: all cells, halves of the primary split, and splits seen in both halves.

    ``records`` holds ``(library_id, dna_barcode, context_index, pair_id, n)``.  All
    splits are summed in one pass over one shuffle; rows do not multiply.
    """
    return counts_of(_half_sums(records, assignments, splits), primary)


def counts_of(wide: DataFrame, primary: int = 0) -> DataFrame:
    """Counts of all cells and of the primary split, and splits seen in both halves, from ``pair_sums``."""
    both = F.size(F.filter("a_by_split", lambda a: (a > 0) & (a < F.col("full_count"))))
    return wide.select(
        "context_index", "pair_id", "full_count",
        F.col("a_by_split")[primary].alias("counts_a"),
        (F.col("full_count") - F.col("a_by_split")[primary]).alias("counts_b"),
        both.cast("long").alias("reproduced_splits"),
    )


def split_counts(records: DataFrame, assignments: DataFrame, splits: int) -> DataFrame:
    """Halves of every split as rows ``(context_index, pair_id, split, counts_a, counts_b)``."""
    return splits_of(_half_sums(records, assignments, splits))


def splits_of(wide: DataFrame) -> DataFrame:
    """The same rows from ``pair_sums``."""
    return wide.select("context_index", "pair_id", "full_count", F.posexplode("a_by_split").alias("split", "counts_a")).select(
        "context_index", "pair_id", "split", "counts_a", (F.col("full_count") - F.col("counts_a")).alias("counts_b")
    )


def output_members(contexts: DataFrame, pools: DataFrame) -> DataFrame:
    """Contexts behind every output: ``shared`` holds all, each context holds itself, pools may overlap."""
    own = contexts.select(F.col("cell_type").alias("output_id"), F.lit("context").alias("output_type"), "context_index", "cell_type")
    shared = own.withColumns({"output_id": F.lit("shared"), "output_type": F.lit("shared")})
    pooled = pools.withColumnRenamed("member", "cell_type").join(contexts.select("cell_type", "context_index"), "cell_type").select(
        "output_id", F.lit("pool").alias("output_type"), "context_index", "cell_type"
    )
    return shared.unionByName(own).unionByName(pooled)


def pool_counts(counts: DataFrame, outputs: DataFrame, values: list[str], keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """Sum member counts into every output."""
    return counts.join(outputs.select("output_id", "output_type", "context_index"), "context_index").groupBy(
        "output_id", "output_type", *keys
    ).agg(*[F.sum(v).alias(v) for v in values])


def output_depths(contexts: DataFrame, outputs: DataFrame) -> DataFrame:
    return outputs.join(contexts.select("context_index", "valid_pairs", "n_cells"), "context_index").groupBy(
        "output_id", "output_type"
    ).agg(F.sum("valid_pairs").cast("long").alias("depth"), F.sum("n_cells").cast("long").alias("n_cells"))


def complement_counts(counts: DataFrame, outputs: DataFrame, contexts: list[int], value: str = "counts_b") -> DataFrame:
    """Per output, the counts of all configured contexts outside it; outputs that hold every context have none.

    The total of each pair minus the output's own part: rows are as many as pairs times outputs that leave something out.
    """
    configured = counts.filter((F.col(value) > 0) & F.col("context_index").isin(contexts))
    every = configured.groupBy("pair_id").agg(F.sum(value).alias("_total"))
    members = outputs.filter(F.col("context_index").isin(contexts)).select("output_id", "context_index").distinct()
    own = configured.join(members, "context_index").groupBy("output_id", "pair_id").agg(F.sum(value).alias("_own"))
    # a short list: one row per output
    partial = members.groupBy("output_id").agg(F.count(F.lit(1)).alias("_held")).filter(F.col("_held") < len(set(contexts))).select("output_id")
    listed = partial.agg(F.collect_set("output_id").alias("_ids"))
    rows = every.join(F.broadcast(listed)).select("pair_id", "_total", F.explode("_ids").alias("output_id"))
    return rows.join(own, ["output_id", "pair_id"], "left").select(
        "output_id", "pair_id", (F.col("_total") - F.coalesce("_own", F.lit(0))).alias("other_count")).filter("other_count > 0")


def _positions(counts: DataFrame, column: str, groups: list[str]) -> DataFrame:
    """Positive rows with rank, tie size and number of positives in their (bounded) group."""
    order = W.partitionBy(*groups).orderBy(F.col(column).desc())
    whole, ties = W.partitionBy(*groups), W.partitionBy(*groups, column)
    return counts.filter(F.col(column) > 0).withColumns(
        {"_rank": F.rank().over(order), "_ties": F.count(F.lit(1)).over(ties), "_positives": F.count(F.lit(1)).over(whole)}
    )


def group_sizes(pairs: DataFrame, groups: list[str]) -> DataFrame:
    return pairs.groupBy(*groups).agg(F.count(F.lit(1)).alias("group_size"))


def positive_midrank(counts: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    """Percentile of each positive count among all pairs of its tile and distance; ties share the middle.

    ``counts`` is sparse and carries ``tile_row, distance_bin``; zeros rank 0 and stay implied.
    """
    groups = ["context_index", "tile_row", "distance_bin"]
    ranked = _positions(counts, column, groups).join(group_sizes(pairs, groups[1:]), groups[1:]).filter("group_size >= 2")
    middle = F.col("_rank") - 1 + (F.col("_ties") - 1) / 2.0
    return ranked.withColumn("midrank", 1.0 - middle / F.greatest(F.col("group_size") - 1, F.lit(1))).select(
        *groups, "pair_id", "bin_i", F.col(column).alias("count"), "midrank", "_rank", "_ties", "_positives", "group_size"
    )


def _replicate_tops(counts: DataFrame, pairs: DataFrame, fraction: float) -> tuple[DataFrame, DataFrame]:
    def top(column):
        ranked = positive_midrank(counts, column, pairs)
        k = F.least(fraction_k("group_size", fraction), F.col("_positives"))
        return ranked.withColumn("_k", k).filter("_rank <= _k")

    return top("counts_a"), top("counts_b")


def replicate_support(counts: DataFrame, pairs: DataFrame, fraction: float = 0.02, bin_size: int = 10_000) -> DataFrame:
    """Support of a pair: best match with a top pair of the other half, at most one bin away.

    Both pairs lie at one exact distance, so a neighbour is a shift of both anchors
    by the same step and the join needs three keys per row.
    """
    groups = ["context_index", "tile_row", "distance_bin"]
    top_a, top_b = _replicate_tops(counts, pairs, fraction)
    left = top_a.select(*groups, F.col("pair_id").alias("pair_a"), F.col("midrank").alias("rank_a"),
                        F.explode(F.array(*[F.col("bin_i") + d * bin_size for d in (-1, 0, 1)])).alias("bin_i"))
    right = top_b.select(*groups, F.col("pair_id").alias("pair_b"), F.col("midrank").alias("rank_b"), "bin_i")
    matches = left.join(right, [*groups, "bin_i"]).withColumn("weight", F.least("rank_a", "rank_b"))
    return (
        matches.select("context_index", F.explode(F.array("pair_a", "pair_b")).alias("pair_id"), "weight")
        .groupBy("context_index", "pair_id").agg(F.max("weight").alias("primary_support"))
    )


def support_tie_report(counts: DataFrame, pairs: DataFrame, fraction: float = 0.02) -> DataFrame:
    """Per context, groups whose cutoff is tied in either half (both halves having a positive)."""
    groups = ["context_index", "tile_row", "distance_bin"]
    top_a, top_b = _replicate_tops(counts, pairs, fraction)

    def sizes(top, name):
        return top.groupBy(*groups).agg((F.count(F.lit(1)) > F.first("_k")).alias(name))

    both = sizes(top_a, "tied_a").join(sizes(top_b, "tied_b"), groups)
    return both.groupBy("context_index").agg(
        F.count(F.lit(1)).alias("scored_groups"), F.sum((F.col("tied_a") | F.col("tied_b")).cast("long")).alias("cutoff_tie_groups")
    )


def half_depths(membership: DataFrame, assignments: DataFrame, families: DataFrame, split: int) -> DataFrame:
    """Valid pairs of halves A and B per family for one split, and the factor from A to B."""
    cells = assignments.filter(F.col("split") == split).select(*CELL, "half").join(
        membership.select(*CELL, "cell_type", "valid_pairs"), CELL
    )
    per_type = cells.groupBy("cell_type", "half").agg(F.sum("valid_pairs").alias("v"))
    groups = families.select(F.col("output_id").alias("family"), F.col("member").alias("cell_type"))
    out = groups.join(per_type, "cell_type").groupBy("family").agg(
        F.sum(F.when(F.col("half") == "A", F.col("v")).otherwise(0)).cast("long").alias("depth_a"),
        F.sum(F.when(F.col("half") == "B", F.col("v")).otherwise(0)).cast("long").alias("depth_b"),
    )
    return out.withColumn("b_per_a", F.when(F.col("depth_a") > 0, F.col("depth_b") / F.col("depth_a")))


def thin_counts(counts: DataFrame, keys: list[str], item: str, value: str, depth: DataFrame, seed: int) -> DataFrame:
    """Draw ``depth`` events without replacement from each group's counts (``depth`` has the group keys).

    The events of a row have md5 draws; a group keeps its ``depth`` least ones, or all it has. Draws stay in an array
    inside their row: only their number per prefix (4096 a group, summed before the shuffle) leaves it, which finds the prefix that the
    total falls in, and then the events of that one prefix, which are ordered over many tasks. What moves besides is one number a row.
    """
    parts = 4096
    draws = F.transform(F.sequence(F.lit(1).cast("long"), F.col(value).cast("long")), lambda e: F.struct(uniform(seed, *keys, item, e).alias("_u"), e.alias("_event")))
    rows = counts.filter(F.col(value) > 0).select(*keys, item, draws.alias("_draws"))

    def prefix(draw: Column) -> Column:
        return F.floor(draw["_u"] * parts)

    per = rows.select(*keys, F.explode(F.transform("_draws", prefix)).alias("_prefix")).groupBy(*keys, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    run = W.partitionBy(*keys).orderBy("_prefix").rowsBetween(W.unboundedPreceding, 0)  # at most 4096 rows
    upto = per.withColumn("_upto", F.sum("_n").over(run)).join(depth.select(*keys, "depth"), keys)
    cut = upto.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("_upto") > F.col("depth"), F.col("_prefix"))), F.lit(parts)).alias("_cut"),
        (F.first("depth") - F.coalesce(F.max(F.when(F.col("_upto") <= F.col("depth"), F.col("_upto"))), F.lit(0))).alias("_left"))
    cut = checkpointed(cut)  # one row a group, read by both joins
    met = rows.join(cut, keys)
    whole = met.select(*keys, item, F.size(F.filter("_draws", lambda d: prefix(d) < F.col("_cut"))).cast("long").alias(value)).filter(F.col(value) > 0)
    edge = met.filter("_left > 0").select(*keys, item, "_left", F.inline(F.filter("_draws", lambda d: prefix(d) == F.col("_cut"))))
    some = numbered(edge, keys, [("_u", False), (item, False), ("_event", False)], "_r").filter("_r <= _left").select(*keys, item, F.lit(1).cast("long").alias(value))
    return whole.unionByName(some).groupBy(*keys, item).agg(F.sum(value).alias(value))
