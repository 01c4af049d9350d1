"""Chromosome bootstraps and hash-seeded selections."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactspark.functions.draws import uniform
from contactspark.operators.ordered import running_totals


def chrom_bootstrap(
    rows: DataFrame, groups: list[str], numerator: str, denominator: str, *, replicates: int, seed: int,
    confidence: float = 0.975, lower: float | None = None, minimum_chroms: int = 1, chrom: str = "chrom",
) -> DataFrame:
    """Resample chromosomes with replacement; a replicate's value is the ratio of the two summed columns.

    Sums per chromosome are sufficient, so a group is one short array (its length is
    the number of chromosomes) and a replicate never touches the rows again.
    Returns ``chroms, point, lower, median, upper, p_value`` per group, null below ``minimum_chroms``.
    """
    sums = rows.groupBy(*groups, chrom).agg(F.sum(numerator).cast("double").alias("x"), F.sum(denominator).cast("double").alias("y"))
    arrays = sums.groupBy(*groups).agg(
        F.array_sort(F.collect_list(F.struct(F.col(chrom).alias("c"), "x", "y"))).alias("_s"),
        F.sum("x").alias("_x"), F.sum("y").alias("_y"),
    )
    each = arrays.select(*groups, "_s", "_x", "_y", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_r"))
    n = F.size("_s")

    def total(field: str) -> Column:
        def pick(acc, slot):
            draw = F.floor(uniform(seed, F.col("_r"), slot) * n).cast("int")
            return acc + F.get(F.col("_s"), draw).getField(field)

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), pick)

    values = each.withColumns({"_vx": total("x"), "_vy": total("y")}).withColumn(
        "_v", F.when((F.col("_vy") != 0) & (n >= minimum_chroms), F.col("_vx") / F.col("_vy")))
    low = 1.0 - confidence if lower is None else lower
    return values.groupBy(*groups).agg(
        F.max(n).cast("long").alias("chroms"),
        (F.max("_x") / F.when(F.max("_y") != 0, F.max("_y"))).alias("point"),
        F.percentile("_v", F.lit(low)).alias("lower"),
        F.percentile("_v", F.lit(0.5)).alias("median"),
        F.percentile("_v", F.lit(confidence)).alias("upper"),
        F.when(F.count("_v") > 0, (1.0 + F.count_if(F.col("_v") <= 0)) / (F.count("_v") + 1.0)).alias("p_value"),
    )


def chrom_bootstrap_mean(rows: DataFrame, groups: list[str], metric: str, *, replicates: int, seed: int) -> DataFrame:
    """Bootstrap of the mean of chromosome means; needs two chromosomes."""
    means = rows.filter(F.col(metric).isNotNull()).groupBy(*groups, "chrom").agg(F.avg(metric).alias("_m")).withColumn("_one", F.lit(1.0))
    return chrom_bootstrap(means, groups, "_m", "_one", replicates=replicates, seed=seed, minimum_chroms=2).drop("p_value")


def draw_weights(chroms: int, replicates: int, seed: int) -> np.ndarray:
    """How often each replicate draws each chromosome, ``chroms x replicates``; the draws are those of ``functions.draws``."""
    out = np.zeros((chroms, replicates))
    for r in range(replicates):
        for slot in range(chroms):
            u = int(hashlib.md5(f"{seed}|{r}|{slot}".encode()).hexdigest()[:13], 16) / 2.0 ** 52
            out[int(u * chroms), r] += 1
    return out


def resampled_classification(
    rows: DataFrame, groups: list[str], score: str, label: str, *, replicates: int, seed: int, chrom: str = "chrom"
) -> DataFrame:
    """Average precision and AUROC of every group in every replicate of a chromosome bootstrap: ``replicate, auprc, auroc``.

    Neither is a ratio of sums over chromosomes, so replicates cannot be made of per-chromosome values. Rows are folded to distinct scores with one
    count per chromosome; one ordered pass accumulates these counts, and a replicate's thresholds are weighted sums of them: a
    product of two small matrices per batch. All groups share the draws, so that differences between them can be taken within a replicate.
    Metrics are null in a replicate without both classes; rows without a chromosome are in none. The chromosomes of the table, bounded by the genome, are listed on the driver.
    """
    names = sorted(r[0] for r in rows.select(chrom).distinct().collect() if r[0] is not None) or [""]
    width = range(len(names))
    hit = F.col(label).cast("long")
    folded = rows.groupBy(*groups, score).agg(
        *[F.sum(F.when(F.col(chrom) == n, 1).otherwise(0)).alias(f"_n{i}") for i, n in enumerate(names)],
        *[F.sum(F.when(F.col(chrom) == n, hit).otherwise(0)).alias(f"_p{i}") for i, n in enumerate(names)])
    both = [f"{kind}{i}" for kind in "np" for i in width]
    run = running_totals(folded, groups, [(score, True)], {f"_c{b}": f"_{b}" for b in both}, {f"_t{b}": f"_{b}" for b in both})
    columns = ["_n", "_p", "_cn", "_cp", "_tn", "_tp"]
    packed = run.select(*groups, *[F.array(*[F.col(f"{c}{i}").cast("double") for i in width]).alias(c) for c in columns])
    weights = draw_weights(len(names), replicates, seed)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(groups, dropna=False, sort=False):
                n, p, cn, cp = (np.stack(part[c].to_list()) @ weights for c in columns[:4])
                tn, tp = (part[c].iloc[0] @ weights for c in columns[4:])
                with np.errstate(divide="ignore", invalid="ignore"):
                    precision = np.where(cn > 0, cp / cn, 0.0)
                yield pd.DataFrame({
                    **dict(zip(groups, key, strict=True)), "replicate": np.arange(replicates), "_ap": (p * precision).sum(axis=0),
                    "_wins": ((n - p) * (cp - p / 2)).sum(axis=0), "_pos": tp, "_neg": tn - tp})

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{g}` {kinds[g]}" for g in groups], "replicate long, _ap double, _wins double, _pos double, _neg double"])
    sums = packed.mapInPandas(partial, schema).groupBy(*groups, "replicate").agg(
        F.sum("_ap").alias("_ap"), F.sum("_wins").alias("_wins"), F.max("_pos").alias("_pos"), F.max("_neg").alias("_neg"))
    some = (F.col("_pos") > 0) & (F.col("_neg") > 0)
    return sums.select(*groups, "replicate", F.when(some, F.col("_ap") / F.col("_pos")).alias("auprc"), F.when(some, F.col("_wins") / F.col("_pos") / F.col("_neg")).alias("auroc"))


def quantile_band(replicates: DataFrame, groups: list[str], values: list[str], confidence: float = 0.975) -> DataFrame:
    """``<value>_lower, _median, _upper`` over the replicates of each group; nulls are left out."""
    points = (("lower", 1.0 - confidence), ("median", 0.5), ("upper", confidence))
    return replicates.groupBy(*groups).agg(*[F.percentile(v, F.lit(q)).alias(f"{v}_{name}") for v in values for name, q in points])


def cap_events(events: DataFrame, groups: list[str], limit: int, seed: int, item: str = "pair_id") -> DataFrame:
    """At most ``limit`` events per group, drawn without replacement by a hash order.

    A first cut by hash prefix keeps the ordered part small: prefixes below the one
    that crosses the limit are kept whole, only that one is ordered.
    """
    marked = events.withColumn("_u", uniform(seed, *groups, item)).withColumn("_prefix", F.floor(F.col("_u") * 4096))
    per = marked.groupBy(*groups, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    run = W.partitionBy(*groups).orderBy("_prefix").rowsBetween(W.unboundedPreceding, 0)  # at most 4096 rows
    cut = per.withColumn("_left", F.lit(limit) - F.sum("_n").over(run) + F.col("_n")).filter("_left > 0").select(*groups, "_prefix", "_n", "_left")
    joined = marked.join(cut, [*groups, "_prefix"])
    order = W.partitionBy(*groups, "_prefix").orderBy("_u", item)
    whole = joined.filter("_n <= _left")
    part = joined.filter("_n > _left").withColumn("_r", F.row_number().over(order)).filter("_r <= _left").drop("_r")
    return whole.unionByName(part).drop("_u", "_prefix", "_n", "_left")


def first_n(df: DataFrame, groups: list[str], order: str, limit: int) -> DataFrame:
    """The first rows of each group in ``order``; Spark cuts each partition to the limit before the shuffle."""
    w = W.partitionBy(*groups).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def tile_order(tiles: DataFrame, seed: int, epoch: int, limit: int) -> DataFrame:
    """The first ``limit`` tiles of a seeded permutation (the feature is the limit)."""
    return tiles.withColumn("order_key", uniform(seed, F.lit(epoch), "tile_id")).orderBy("order_key", "tile_id").limit(limit)


def sample_contexts(tiles: DataFrame, contexts: list[int], seed: int, epoch: int, k: int) -> DataFrame:
    """A k-subset of the configured contexts per tile, listed in order."""
    keyed = [F.struct(uniform(seed, F.lit(epoch), "tile_id", F.lit(c)).alias("u"), F.lit(c).alias("c")) for c in contexts]
    chosen = F.slice(F.array_sort(F.array(*keyed)), 1, k)
    return tiles.select("tile_id", F.array_sort(F.transform(chosen, lambda s: s["c"])).alias("context_indices"))


def verification_sample(df: DataFrame, keys: list[str], limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows in hash order, to be recomputed and compared."""
    return df.withColumn("_u", uniform(seed, *keys)).orderBy("_u", *keys).limit(limit).drop("_u")


def verification_report(stored: DataFrame, recomputed: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    other = recomputed.select(*keys, F.col(value).alias("_again"))
    error = F.abs(F.col(value) - F.col("_again"))
    return stored.join(other, keys, "left").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_again").isNull()).alias("missing"), F.max(error).alias("max_error"),
        F.coalesce(F.bool_and(F.coalesce(error <= tolerance, F.lit(False))), F.lit(False)).alias("passed"),
    )
