"""Resampled metrics, recovery tables, context extension and balancing on small tables with known answers."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from contactspark.operators import catalog, maps, metrics, resampling, sampling
from contactspark.plans import extension, recovery

SCHEMA = "g string, chrom string, score double, label int"


def plain_metrics(rows):
    """Average precision and AUROC by their definitions over (score, label) rows, ties at once."""
    positives, negatives = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    if not positives or not negatives:
        return None, None
    ap = seen = hits = 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        here = [y for v, y in rows if v == s]
        seen, hits = seen + len(here), hits + sum(here)
        ap += sum(here) / positives * hits / seen
    wins = sum((a > b) + (a == b) / 2 for a, y in rows if y for b, z in rows if not z)
    return ap, wins / positives / negatives


def test_resampled_metrics_by_repeating_rows(spark):
    draw = np.random.default_rng(5)
    rows = [(g, f"chr{draw.integers(4)}", float(draw.integers(6)), int(draw.random() < 0.3)) for g in "ab" for _ in range(60)] + [("c", "chr1", 1.0, 1)]
    got = {(r.g, r.replicate): r for r in resampling.resampled_classification(spark.createDataFrame(rows, SCHEMA), ["g"], "score", "label", replicates=20, seed=3).collect()}
    assert len(got) == 60
    chroms, weights = sorted({r[1] for r in rows}), resampling.draw_weights(4, 20, 3)
    assert (weights.sum(axis=0) == 4).all()
    for (g, r), row in got.items():
        repeated = [(s, y) for k, c, s, y in rows if k == g for _ in range(int(weights[chroms.index(c), r]))]
        want = plain_metrics(repeated)
        assert (row.auprc, row.auroc) == (None, None) if want[0] is None else np.allclose((row.auprc, row.auroc), want)


def test_resampled_metrics_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.lit("a").alias("g"), F.concat(F.lit("chr"), F.col("id") % 3).alias("chrom"), (F.col("id") % 37).cast("double").alias("score"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    one, many = ({r.replicate: (round(r.auprc, 12), round(r.auroc, 12)) for r in resampling.resampled_classification(
        df.repartition(n), ["g"], "score", "label", replicates=30, seed=1).collect()} for n in (1, 8))
    assert one == many
    assert resampling.resampled_classification(df.limit(0), ["g"], "score", "label", replicates=3, seed=1).count() == 0


def pair_rows():
    """Pairs of two chromosomes; exact loops score high on the first source, the second is constant."""
    out = []
    for k in range(240):
        loop = k % 12 == 0
        out.append((k, f"chr{k % 2}", 10_000 * (100 * k), 10_000 * (100 * k + 30), 300_000, "250-500", 0 if k % 3 else k % 7, 5.0 + k % 3 if loop else float(k % 5), 1.0))
    return out


PAIR_SCHEMA = "pair_id long, chrom string, bin_i long, bin_j long, distance_bp long, distance_band string, counts_a long, model double, flat double"


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(pair_rows(), PAIR_SCHEMA)


@pytest.fixture(scope="module")
def loops(pairs):
    return pairs.filter("pair_id % 12 = 0").select("chrom", "bin_i", "bin_j")


SOURCES = {"model": "model", "flat": "flat"}


def test_zero_counts_and_macro_bootstrap(pairs, loops):
    zero = {r.source: r for r in recovery.zero_count_recovery(pairs, loops, SOURCES, "counts_a", 10_000).collect()}
    rows = [(r[7], int(r[0] % 12 == 0)) for r in pair_rows() if r[6] == 0]
    assert zero["model"].candidates == len(rows) and np.isclose(zero["model"].auprc, plain_metrics(rows)[0])
    labelled = pairs.withColumn("label", F.col("pair_id") % 12 == 0)
    (got,) = recovery.macro_bootstrap(labelled, SOURCES, "model", "auprc", replicates=50, seed=1).collect()
    per = []
    for c in ("chr0", "chr1"):
        both = [[(r[i], int(r[0] % 12 == 0)) for r in pair_rows() if r[1] == c] for i in (7, 8)]
        values = [plain_metrics(b)[0] for b in both]
        if values[0] is not None:
            per.append(values[0] - values[1])
    assert got.baseline == "flat" and got.chroms == len(per)
    # all loops stand on one chromosome here: a single one gives a point, but no bootstrap
    assert len(per) == 1 and np.isclose(got.macro_difference, per[0]) and got.lower is None and not got.positive_lower_bound
    spread = labelled.withColumn("chrom", F.concat(F.lit("chr"), F.floor(F.col("pair_id") / 60)))
    (four,) = recovery.macro_bootstrap(spread, SOURCES, "model", "auprc", replicates=50, seed=1).collect()
    assert four.chroms == 4 and four.positive_lower_bound and four.lower <= four.macro_difference <= four.upper


def test_hard_matched_pairs(pairs, loops):
    matched, tiers = recovery.hard_matched(pairs, loops, "counts_a", "flat", 10_000, 7)
    (t,) = tiers.collect()
    assert t.exact_10kb + t.within_50kb + t.within_band + t.unmatched == 20
    rows = matched.collect()
    assert sum(r.label for r in rows) == sum(not r.label for r in rows) == 20 - t.unmatched
    assert all((r.pair_id % 12 == 0) == r.label for r in rows)
    assert t.unique_negatives + t.duplicate_negatives == 20 - t.unmatched
    band = {r.source: r for r in recovery.matched_bootstrap(matched, SOURCES, "model", replicates=40, seed=2).collect()}
    assert np.isclose(band["flat"].auroc_median, 0.5) and band["model"].lead_lower == band["model"].lead_upper == 0
    assert band["model"].auprc_lower > band["flat"].auprc_upper


def test_a_loop_without_any_match(spark, pairs):
    rows = sampling.with_match_buckets(pairs, "counts_a", "flat").withColumns({"label": F.col("pair_id") == 0, "near": F.lit(True)})
    (only,) = sampling.matched_negatives(rows, "label", "near", 1, strict=False).collect()
    assert tuple(only) == (0, None, "unmatched")
    with pytest.raises(PySparkException, match="no matched negative"):
        sampling.matched_negatives(rows, "label", "near", 1).collect()


def test_extension_prefers_a_model_that_beats_its_controls(spark):
    draw = np.random.default_rng(9)
    rows = []
    for unit, good in (("u", True), ("v", False)):
        for tile in range(12):
            for k in range(60):
                count = int(draw.poisson(0.4 + 3 * (k % 15 == 0)))
                right = 1.5 * (k % 15 == 0)
                noise = [float(round(x, 6)) for x in draw.normal(size=3) * 0.3]
                rows.append((unit, f"chr{tile % 4}", tile, 25 + k % 4, "250-500", 1.0, count, float(count), float(round(draw.normal() * 0.1, 6)), noise[0], right if good else noise[0], noise[1], noise[2]))
    df = spark.createDataFrame(rows, "output_id string, chrom string, tile_row long, distance_bin long, distance_band string, exposure double, count long, target double, shared double, onehot double, rna double, swapped double, permuted double")
    tests = extension.extension_tests(df, fraction=0.05, replicates=100, seed=4).cache()
    assert tests.count() == 20 and tests.filter("adjusted_p is not null").count() == 8
    got = {r.output_id: r for r in extension.context_extension(tests, ["250-500"]).collect()}
    assert got["u"].selected_mode == "rna" and got["u"].claim_scope == "rna_conditioned" and got["u"].failure_reason is None
    assert got["v"].selected_mode is None and got["v"].failure_reason and not got["v"].requires_rate_recalibration
    # a band that no test covers fails
    assert all(r.selected_mode is None for r in extension.context_extension(tests, ["250-500", "500-1000"]).collect())
    sure = extension.confirmed_on_test(extension.context_extension(tests, ["250-500"]), tests).collect()
    assert {(r.output_id, r.metric, r.confirmed) for r in sure} == {("u", "likelihood", True), ("u", "top_contact", True)}
    # the likelihood difference of one comparison by hand
    one = next(r for r in tests.collect() if (r.output_id, r.metric, r.comparison) == ("u", "likelihood", "rna_vs_shared"))
    groups = {}
    for r in rows:
        if r[0] == "u":
            groups.setdefault((r[2], r[3]), []).append(r)
    gain = events = 0
    for g in groups.values():
        y = np.array([r[6] for r in g])
        a, b = np.array([r[8] + r[10] for r in g]), np.array([r[8] for r in g])
        gain += (y * (a - b)).sum() - y.sum() * (np.log(np.exp(a).sum()) - np.log(np.exp(b).sum()))
        events += y.sum()
    assert np.isclose(one.point, gain / events)


def test_balancing_beyond_a_broadcast_moves_no_pixel_a_round(spark):
    """Weights are sent to blocks of bins; the pixels stay where they were dealt, in the order they were dealt in."""
    draw = np.random.default_rng(3)
    rows = [(c, 10 * i, 10 * j, float(draw.integers(1, 9))) for c in ("chr1", "chr2") for i in range(60) for j in range(i, min(60, i + 50), 3)]
    ends = spark.createDataFrame([(c, b, o, n) for c, i, j, n in rows for b, o in ((i, j), (j, i))], "chrom string, bin long, other long, c double")
    weights = {(c, 10 * i): float(draw.uniform(0, 2)) for c in ("chr1", "chr2") for i in range(60) if i % 7}
    table = spark.createDataFrame([(*k, w) for k, w in weights.items()], "chrom string, bin long, b double")
    want = {}
    for c, i, j, n in rows:
        for b, o in ((i, j), (j, i)):
            want[c, b] = want.get((c, b), 0.0) + n * weights.get((c, o), 0.0)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in before:
        spark.conf.set(k, "-1")
    try:
        for block_bp in (10, 130, 10_000):
            sums = maps._block_sums(ends, int(spark.conf.get("spark.sql.shuffle.partitions")), block_bp)(table)
            assert {(r.chrom, r.bin): r._m for r in sums.collect()} == pytest.approx(want)
        text = sums._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # the branch of the pixels reaches its join from the stored layout: no exchange and no sort above the scan that holds the counts
    left = text[text.index("SortMergeJoin [chrom"):]
    scan = next(line for line in left.splitlines() if "Scan ExistingRDD" in line and ",c#" in line)
    above = left[:left.index(scan)]
    assert "Exchange" not in above and "Sort [" not in above


def test_balanced_marginals_without_a_diagonal(spark):
    """Contacts far from the diagonal, where full corrections would swing; the shuffled way gives the same weights."""
    draw = np.random.default_rng(1)
    rows = [(c, 10 * i, 10 * j, int(draw.integers(1, 9))) for c in ("chr1", "chr2") for i in range(60) for j in range(i + 20, min(60, i + 50))]
    pixels = spark.createDataFrame(rows, "chrom string, bin_i long, bin_j long, count long")
    near = {(r.chrom, r.bin): r.weight for r in maps.ice_balance(pixels, tolerance=1e-10).collect()}
    far = {(r.chrom, r.bin): r.weight for r in maps.ice_balance(pixels, tolerance=1e-10, broadcast_bytes=0).collect()}
    assert near.keys() == far.keys() and all((near[k] is None) == (far[k] is None) and (near[k] is None or np.isclose(near[k], far[k])) for k in near)
    sums = {}
    for c, i, j, n in rows:
        for b in (i, j):
            sums[c, b] = sums.get((c, b), 0) + n * (near[c, i] or 0) * (near[c, j] or 0)
    kept = [sums[k] for k, w in near.items() if w is not None]
    assert len(kept) > 60 and np.allclose(kept, 1, atol=1e-3)
    assert maps.ice_balance(pixels.limit(0)).count() == 0


def test_identity_reads_directions_once(spark):
    directed = spark.range(4000).select(
        (F.col("id") % 3).cast("string").alias("distance_band"), (F.pmod(F.xxhash64("id"), F.lit(41)) / 10 - 2).alias("delta"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) < 2).alias("label"))
    directed = directed.unionByName(spark.createDataFrame([("one class", 0.5, True), ("one class", -0.5, True)], directed.schema))
    got = recovery.identity_table(directed, ["distance_band"])
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    plain = metrics.classification(directed.withColumn("l", F.col("label").cast("int")), ["distance_band"], "delta", "l").join(
        metrics.direction_accuracy(directed, ["distance_band"], "delta", "label"), "distance_band")
    want = {r.distance_band: r.asDict() for r in plain.collect()}
    assert len(want) == 4 and want["one class"]["balanced_direction_accuracy"] is None
    for r in got.collect():
        assert r.asDict() == {k: v if v is None or isinstance(v, str) else pytest.approx(v) for k, v in want[r.distance_band].items()}


def test_shifted_loops_are_dealt_once(spark):
    pairs = spark.createDataFrame([("c", i * 10, j * 10, i * 100 + j) for i in range(6) for j in range(i + 1, 9)], "chrom string, bin_i long, bin_j long, pair_id long")
    loops = spark.createDataFrame([("f", "c", 20, 50, 0.5), ("f", "c", 30, 50, 1.0), ("g", "c", 0, 80, 0.25)], "family string, chrom string, bin_i long, bin_j long, member_fraction double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.support_to_pairs(pairs, loops, 1, 10)
        exchanges = df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        got = {(r.family, r.pair_id): r.support for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert exchanges == 2  # pairs and shifted loops
    want = {}
    for f, i, j, v in (("f", 2, 5, 0.5), ("f", 3, 5, 1.0), ("g", 0, 8, 0.25)):
        for a in range(max(0, i - 1), i + 2):
            for b in range(j - 1, j + 2):
                if a < 6 and a < b < 9:
                    want[f, a * 100 + b] = max(v, want.get((f, a * 100 + b), 0))
    assert got == want
