"""Control sampling: pools become numbered positions, draws become hash positions, and a join picks the rows.

Pools are bounded (a chromosome and band, a tile and band, or finer), positions come
from windows over one pool or from prefix counts, and a draw never touches a pool's other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactspark.functions.draws import integer_below, uniform
from contactspark.functions.scalars import fdiv, softplus
from contactspark.operators.ordered import average_ranks, checkpointed, laid_out, numbered, running_totals

BLOCK = 16  # a block of pair ids holds two to this power


def with_match_buckets(pairs: DataFrame, count: str, score: str, groups: tuple[str, ...] = ("distance_band",)) -> DataFrame:
    """Raw count bucket (3 and more together), decile of the tie-averaged score rank, 50 kb distance bucket."""
    ranks = average_ranks(pairs, list(groups), score, "_rank", "_size").filter(F.col(score).isNotNull())
    decile = F.least(F.floor(F.col("_rank") / (F.col("_size") + 1) * 10), F.lit(9))
    # deciles rise with the score: the least score of each, ten a group at most, goes to the pairs
    least = ranks.groupBy(*groups, decile.alias("d")).agg(F.min(score).alias("s")).groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("s", "d"))).alias("_least"))
    rows = pairs.filter(F.col(score).isNotNull()).join(F.broadcast(least), list(groups))
    return rows.withColumns({
        "raw_bucket": F.least(F.col(count), F.lit(3)), "score_decile": F.element_at(F.filter("_least", lambda x: x["s"] <= F.col(score)), -1)["d"],
        "distance_50kb": fdiv("distance_bp", 50_000),
    }).drop("_least")


def group_pools(pairs: DataFrame, groups: list[str], bounded: bool = True) -> DataFrame:
    """Position of every pair in its pool (from 0, by pair id) and the pool's size."""
    if bounded:
        w = W.partitionBy(*groups)
        return pairs.select(*groups, "pair_id", (F.row_number().over(w.orderBy("pair_id")) - 1).cast("long").alias("position"),
                            F.count(F.lit(1)).over(w).alias("pool_size"))
    out = numbered(pairs.select(*groups, "pair_id"), groups, [("pair_id", False)], "_p", "pool_size")
    return out.select(*groups, "pair_id", (F.col("_p") - 1).alias("position"), "pool_size")


def group_codes(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """Dense group numbers in key order; the numbered table has one row per group."""
    keys = numbered(pairs.select(*groups).distinct(), [], [(g, False) for g in groups], "_c")
    return pairs.join(keys.withColumn("group_code", F.col("_c") - 1).drop("_c"), groups)


def _draw_position(size: Column, focal: Column, seed: int, *keys) -> Column:
    """Uniform position in a pool without the focal one: draw below size - 1 and step over it."""
    drawn = integer_below(size - 1, seed, *keys)
    return drawn + (drawn >= focal).cast("long")


BROAD = ["chrom", "distance_band", "split"]
MATCHED = ["chrom", "distance_bin", "exposure_decile", "anchor_class", "split"]


def draw_controls(positives: DataFrame, pairs: DataFrame, broad_count: int, matched_count: int, seed: int) -> DataFrame:
    """Controls per positive (``context_index, pair_id``), with replacement, never the focal pair.

    ``broad`` slots draw from the chromosome, band and split; ``matched`` slots from pairs
    alike in distance, exposure decile and class.  Without a matched peer all slots are
    broad.  ``proposal`` is the exact mixture probability of the drawn pair.
    """
    total = broad_count + matched_count
    keys = list(dict.fromkeys(BROAD + MATCHED))
    base = pairs.select("pair_id", *keys)
    broad = group_pools(base, BROAD, bounded=False).withColumnsRenamed({"position": "broad_pos", "pool_size": "broad_size"})
    matched = group_pools(base, MATCHED, bounded=False).withColumnsRenamed({"position": "matched_pos", "pool_size": "matched_size"})
    placed = base.join(broad.select("pair_id", "broad_pos", "broad_size"), "pair_id").join(
        matched.select("pair_id", "matched_pos", "matched_size"), "pair_id")
    focal = positives.join(placed, "pair_id").withColumn(
        "broad_size", F.when(F.col("broad_size") > 1, F.col("broad_size")).otherwise(F.raise_error(F.lit("pool holds only the focal pair")).cast("long")))
    slots = focal.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(total - 1)))).withColumn(
        "component", F.when((F.col("slot") >= broad_count) & (F.col("matched_size") > 1), 1).otherwise(0))
    ids = ("context_index", "pair_id", "slot")
    slots = slots.withColumn("position", F.when(F.col("component") == 1, _draw_position(F.col("matched_size"), F.col("matched_pos"), seed, *ids)).otherwise(
        _draw_position(F.col("broad_size"), F.col("broad_pos"), seed, *ids)))
    # the drawn pair is looked up by (pool, position); both pools are spread over all their positions
    control = placed.select(F.col("pair_id").alias("control_id"), *[F.col(k).alias(f"c_{k}") for k in keys], "broad_pos", "matched_pos")

    def look_up(rows: DataFrame, pool: list[str], at: str) -> DataFrame:
        right = control.withColumn("position", F.col(at)).drop("broad_pos", "matched_pos")
        on = [rows[k] == right[f"c_{k}"] for k in pool] + [rows["position"] == right["position"]]
        return rows.join(right, on).drop(right["position"])

    drawn = look_up(slots.filter("component = 0"), BROAD, "broad_pos").unionByName(look_up(slots.filter("component = 1"), MATCHED, "matched_pos"))
    mixed = F.col("matched_size") > 1
    inside = F.lit(True)
    for k in MATCHED:
        inside = inside & (F.col(k) == F.col(f"c_{k}"))
    share = F.lit(broad_count / total) / (F.col("broad_size") - 1) + F.when(inside, F.lit(matched_count / total) / (F.col("matched_size") - 1)).otherwise(0.0)
    proposal = F.when(mixed & F.lit(matched_count > 0), share).otherwise(1.0 / (F.col("broad_size") - 1))
    return drawn.select("context_index", "pair_id", "slot", "control_id", "component", proposal.alias("proposal"))


def control_groups(drawn: DataFrame) -> DataFrame:
    """The drawn controls as fixed-width lists, one row per positive."""
    packed = F.array_sort(F.collect_list(F.struct("slot", "control_id", "proposal", "component")))
    return drawn.groupBy("context_index", "pair_id").agg(packed.alias("_c")).select(
        F.col("pair_id").alias("positive_pair_id"), "context_index", F.transform("_c", lambda c: c["control_id"]).alias("event_control_pair_ids"),
        F.transform("_c", lambda c: c["proposal"]).alias("event_proposal_probabilities"),
        F.transform("_c", lambda c: c["component"]).alias("event_proposal_components"),
    )


LOCAL = ["tile_row", "distance_band", "split"]


def rank_controls(positives: DataFrame, pairs: DataFrame, counts: DataFrame, rank_count: int, seed: int) -> DataFrame:
    """Zero-count controls from the positive's tile, band and split.

    ``positives`` carries ``context_index, pair_id, support_weight``; without a zero the
    weight becomes 0 and every control is the focal pair itself.  A pool lies within one tile, so the pairs
    of a tile are folded into one row, and a context's row there holds its positives and counted pairs: pairs
    do not multiply by contexts, and the zeros of a pool are found inside its row.
    """
    groups = ["context_index", *LOCAL]
    place = pairs.select("pair_id", *LOCAL)
    members = place.groupBy(*LOCAL).agg(F.array_sort(F.collect_list("pair_id")).alias("_members"))
    # an event is a positive with its weight, a counted pair, or both
    events = positives.select("context_index", "pair_id", F.struct("pair_id", "support_weight").alias("_focal")).unionByName(
        counts.filter("full_count > 0").select("context_index", "pair_id"), allowMissingColumns=True)
    held = events.join(place, "pair_id").groupBy(*groups).agg(
        F.collect_list("_focal").alias("_focal"), F.collect_list(F.when(F.col("_focal").isNull(), F.col("pair_id"))).alias("_counted"))
    pools = held.filter(F.size("_focal") > 0).join(members, LOCAL, "left").select(
        "context_index", "_focal", F.array_except("_members", "_counted").alias("_zeros"))
    slots = pools.select("context_index", "_zeros", F.inline("_focal")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(rank_count - 1))))
    size = F.coalesce(F.size("_zeros"), F.lit(0))
    position = F.when(size > 0, integer_below(size, seed, "context_index", "pair_id", "slot"))
    picked = slots.withColumn("control_id", F.get("_zeros", position.cast("int")))
    return picked.select(
        "context_index", "pair_id", "slot", F.coalesce("control_id", "pair_id").alias("control_id"),
        F.when(F.col("control_id").isNotNull(), F.col("support_weight")).otherwise(0.0).alias("support_weight"))


def resample_rank_controls(positives: DataFrame, pairs: DataFrame, support: DataFrame, rank_count: int, seed: int) -> DataFrame:
    """Half the controls from pairs without support, the rest from pairs of strictly lower support, same tile and band.

    If one pool is empty the other fills all slots; if both are, the weight becomes 0 and
    the controls are the focal pair.  ``support`` holds ``context_index, pair_id, support_weight > 0``.  As for
    ``rank_controls`` the pairs of a tile are one row, and a context's row holds its positives and supported pairs.
    """
    place = pairs.select("pair_id", *LOCAL)
    groups = ["context_index", *LOCAL]
    members = place.groupBy(*LOCAL).agg(F.array_sort(F.collect_list("pair_id")).alias("_members"))
    # an event is a positive with its weight, a supported pair, or both
    events = positives.filter("support_weight > 0").select("context_index", "pair_id", F.struct("pair_id", "support_weight").alias("_focal")).unionByName(
        support.filter("support_weight > 0").select("context_index", "pair_id", F.struct(F.col("support_weight").alias("_s"), "pair_id").alias("_held")), allowMissingColumns=True)
    held = events.join(place, "pair_id").groupBy(*groups).agg(F.collect_list("_focal").alias("_focal"), F.array_sort(F.collect_list("_held")).alias("_held"))
    pools = held.filter(F.size("_focal") > 0).join(members, LOCAL).select(
        "context_index", "_focal", "_held", F.array_except("_members", F.transform("_held", lambda h: h["pair_id"])).alias("_zeros"))
    slots = pools.select("context_index", "_held", "_zeros", F.inline("_focal"))
    # held pairs are in order of support, so those below the focal pair come first; without a support of its own it has none
    own = F.get(F.filter("_held", lambda h: h["pair_id"] == F.col("pair_id")), F.lit(0))["_s"]
    slots = slots.withColumn("_own", own).withColumns({
        "lower_count": F.coalesce(F.size(F.filter("_held", lambda h: h["_s"] < F.col("_own"))), F.lit(0)).cast("long"), "zero_count": F.size("_zeros").cast("long")})
    slots = slots.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(rank_count - 1))))
    half = rank_count // 2
    use_zero = (F.col("zero_count") > 0) & ((F.col("slot") < half) | (F.col("lower_count") == 0))
    use_lower = (F.col("lower_count") > 0) & ~use_zero
    ids = ("context_index", "pair_id", "slot")
    slots = slots.withColumn("pool", F.when(use_zero, "zero").when(use_lower, "lower")).withColumn(
        "position", F.when(use_zero, integer_below("zero_count", seed, *ids)).when(use_lower, integer_below("lower_count", seed, *ids)).cast("int"))
    picked = slots.withColumn("control_id", F.when(F.col("pool") == "zero", F.get("_zeros", F.col("position"))).when(
        F.col("pool") == "lower", F.get("_held", F.col("position"))["pair_id"]))
    return picked.select(
        "context_index", "pair_id", "slot", F.coalesce("control_id", "pair_id").alias("control_id"), "pool",
        F.when(F.col("control_id").isNotNull(), F.col("support_weight")).otherwise(0.0).alias("support_weight"))


def matched_negatives(pairs: DataFrame, label: str, near: str, seed: int, groups: tuple[str, ...] = ("distance_band",), strict: bool = True) -> DataFrame:
    """One negative per positive, not near a loop, alike in group, chromosome, raw bucket and score decile.

    Tiers: same distance, same 50 kb, anything; the first that has a candidate is used. A positive without any is an error, or, if not
    ``strict``, a row of the tier ``unmatched`` without a negative. ``pairs`` comes from ``with_match_buckets``.

    Negatives move once: they are folded by class and block of ``2**16`` pair ids into lists of place and distance, and stored in that layout. Pools of all tiers
    are counted from the lists; prefix counts over the blocks of a pool tell in which list a drawn position is, and where in it.
    """
    common = [*groups, "chrom", "raw_bucket", "score_decile"]
    tiers = [("exact_10kb", [*common, "distance_bp"]), ("within_50kb", [*common, "distance_50kb"]), ("within_band", common)]
    packed = F.shiftleft(F.col("pair_id") % (1 << BLOCK), 32) + F.col("distance_bp")
    negatives = pairs.filter(~F.col(near)).select(*common, F.shiftright("pair_id", BLOCK).alias("_block"), packed.cast("long").alias("_p"))
    lists = laid_out(negatives.groupBy(*common, "_block").agg(F.sort_array(F.collect_list("_p")).alias("_list")))
    per = lists.select(*common, "_block", F.explode("_list").alias("_p")).groupBy(*common, "_block", F.col("_p").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("distance_bp")).agg(
        F.count(F.lit(1)).alias("_n"))
    per = checkpointed(per.withColumn("distance_50kb", fdiv("distance_bp", 50_000)))
    out = checkpointed(pairs.filter(F.col(label)).select("pair_id", *common, F.col("distance_bp").cast("int").alias("distance_bp"), "distance_50kb"))
    pools = []
    for name, keys in tiers:
        every, before = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # one row per block
        blocks = per.groupBy(*keys, "_block").agg(F.sum("_n").alias("_n")).withColumns({
            "_first": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_size": F.sum("_n").over(every),
            "_width": F.ceil(F.sum("_n").over(every) / F.count(F.lit(1)).over(every))})
        out = out.join(blocks.select(*keys, F.col("_size").alias(f"size_{name}"), F.col("_width").alias(f"width_{name}")).distinct(), keys, "left")
        # blocks are found by an equality: each stands in the cells of its pool that it reaches, as wide as the mean block
        cells = blocks.withColumn("_cell", F.explode(F.sequence(fdiv("_first", F.col("_width")), fdiv(F.col("_first") + F.col("_n") - 1, F.col("_width")))))
        pools.append((name, keys, cells.select(*keys, "_cell", "_block", "_first", "_n")))
    tier, size = F.lit(None).cast("string"), F.lit(None).cast("long")
    for name, _ in reversed(tiers):
        found = F.col(f"size_{name}").isNotNull()
        tier, size = F.when(found, name).otherwise(tier), F.when(found, F.col(f"size_{name}")).otherwise(size)
    none = F.raise_error(F.lit("no matched negative")).cast("string") if strict else F.lit("unmatched")
    out = out.withColumns({"tier": tier, "_size": size}).withColumn("tier", F.coalesce("tier", none)).withColumn(
        "position", integer_below("_size", seed, "pair_id"))
    out = checkpointed(out)

    def pick(name: str, keys: list[str], cells: DataFrame) -> DataFrame:
        drawn = out.filter(F.col("tier") == name).withColumn("_cell", fdiv("position", F.col(f"width_{name}"))).join(cells, [*keys, "_cell"])
        drawn = drawn.withColumn("_at", (F.col("position") - F.col("_first")).cast("int")).filter((F.col("_at") >= 0) & (F.col("_at") < F.col("_n")))
        distance = {"exact_10kb": F.col("distance_bp"), "within_50kb": F.col("distance_50kb")}.get(name)

        def alike(p: Column) -> Column:
            bp = p.bitwiseAND(F.lit((1 << 32) - 1))
            return (bp if name == "exact_10kb" else fdiv(bp, 50_000)) == distance

        found = F.get(F.col("_list") if distance is None else F.filter("_list", alike), F.col("_at"))
        drawn = drawn.select("pair_id", "tier", *common, "distance_bp", "distance_50kb", "_block", "_at")
        return drawn.join(lists, [*common, "_block"]).select("pair_id", (F.shiftleft("_block", BLOCK) + F.shiftright(found, 32)).alias("negative_id"), "tier")

    picked = [pick(*pool) for pool in pools]
    alone = out.filter("tier = 'unmatched'").select("pair_id", F.lit(None).cast("long").alias("negative_id"), "tier")
    return picked[0].unionByName(picked[1]).unionByName(picked[2]).unionByName(alone)


def pack_groups(sizes: DataFrame, maximum: int, seed: int, key: str) -> DataFrame:
    """Whole groups packed into batches of at most ``maximum`` rows, in a seeded order; a larger group is a batch of its own.

    A batch holds the groups whose start lies in one interval of the running size.  The interval is as wide as the maximum less the
    largest group that fits, so that no batch exceeds the maximum, and batches are found by prefix sums.
    """
    alone = F.col("rows") > maximum
    largest = sizes.filter(~alone).agg(F.max("rows").alias("_largest"))
    width = F.greatest(F.lit(maximum) - F.coalesce("_largest", F.lit(0)), F.lit(1))
    shuffled = sizes.join(F.broadcast(largest)).withColumns({"_u": uniform(seed, key), "_fits": F.when(alone, 0).otherwise(F.col("rows")), "_alone": alone.cast("long")})
    run = running_totals(shuffled, [], [("_u", False), (key, False)], {"_upto": "_fits", "_large": "_alone"})
    batch = F.when(F.col("_alone") == 0, fdiv(F.col("_upto") - F.col("_fits"), width)).otherwise(-F.col("_large"))
    return run.select(key, "rows", batch.cast("long").alias("batch"))


def controls_join(groups: DataFrame, scores: DataFrame) -> DataFrame:
    """Control lists as rows with the control's score and the positive's score."""
    rows = groups.select("context_index", "positive_pair_id", F.posexplode(F.arrays_zip("event_control_pair_ids", "event_proposal_probabilities")).alias("slot", "_c"))
    rows = rows.select("context_index", "positive_pair_id", "slot", F.col("_c.event_control_pair_ids").alias("pair_id"),
                       F.col("_c.event_proposal_probabilities").alias("proposal"))
    s = scores.select("pair_id", "score")
    focal = s.select(F.col("pair_id").alias("positive_pair_id"), F.col("score").alias("positive_score"))
    return rows.join(s, "pair_id").join(focal, "positive_pair_id")


def event_losses(joined: DataFrame, events: DataFrame) -> DataFrame:
    """Sampled softmax loss per positive: control scores carry minus log proposal and minus log of their number.

    ``events`` holds ``context_index, pair_id, event_count``.  Controls per positive are a fixed short list.
    """
    keys = ["context_index", "positive_pair_id"]
    adjusted = joined.withColumn("_z", F.col("score") - F.log("proposal"))
    per = adjusted.groupBy(*keys).agg(F.max("_z").alias("_m"), F.collect_list("_z").alias("_zs"), F.first("positive_score").alias("_p"))
    top = F.greatest("_m", "_p")
    pool = F.aggregate("_zs", F.lit(0.0), lambda a, z: a + F.exp(z - top)) / F.size("_zs")
    loss = F.log(pool + F.exp(F.col("_p") - top)) + top - F.col("_p")
    e = events.select("context_index", F.col("pair_id").alias("positive_pair_id"), "event_count")
    return per.select(*keys, loss.alias("loss")).join(e, keys)


def event_loss(losses: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    return losses.groupBy(*groups).agg(
        (F.sum(F.col("loss") * F.col("event_count")) / F.sum("event_count")).alias("event_loss"), F.sum("event_count").alias("events"))


def rank_loss(controls: DataFrame, scores: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Mean softplus of control minus positive score, weighted by support over all positives."""
    s = scores.select("pair_id", "score")
    joined = controls.join(s.withColumnsRenamed({"pair_id": "control_id", "score": "_c"}), "control_id").join(s, "pair_id")
    per = joined.groupBy(*groups, *[c for c in ("context_index", "pair_id") if c not in groups]).agg(
        F.avg(softplus(F.col("_c") - F.col("score"))).alias("_l"), F.max("support_weight").alias("_w"))
    return per.groupBy(*groups).agg((F.sum(F.col("_l") * F.col("_w")) / F.sum("_w")).alias("rank_loss"), F.sum("_w").alias("support"))


def normalizer_audit(joined: DataFrame, pairs: DataFrame, score: str = "score") -> DataFrame:
    """Error of each positive's sampled log normaliser against the exact one over its pool without itself.

    The exact value needs one sum per pool, from which the focal term is taken away.
    """
    pools = pairs.groupBy(*BROAD).agg(F.max(score).alias("_m"))
    sums = pairs.join(pools, BROAD).groupBy(*BROAD).agg(F.max("_m").alias("_m"), F.sum(F.exp(F.col(score) - F.col("_m"))).alias("_z"))
    keys = ["context_index", "positive_pair_id"]
    z = F.col("score") - F.log("proposal")
    per = joined.withColumn("_zz", z).groupBy(*keys).agg(
        F.max("_zz").alias("_top"), F.collect_list("_zz").alias("_zs"), F.first("positive_score").alias("_p"))
    sampled = F.log(F.aggregate("_zs", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("_top"))) / F.size("_zs")) + F.col("_top")
    place = pairs.select(F.col("pair_id").alias("positive_pair_id"), *BROAD)
    exact = F.log(F.col("_z") - F.exp(F.col("_p") - F.col("_m"))) + F.col("_m")
    errors = per.join(place, "positive_pair_id").join(sums, BROAD).select("context_index", F.abs(sampled - exact).alias("_e"))
    return errors.groupBy("context_index").agg(
        F.count(F.lit(1)).alias("audited"), F.percentile("_e", F.lit(0.5)).alias("median_error"), F.percentile("_e", F.lit(0.95)).alias("p95_error"))
