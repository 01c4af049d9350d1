"""Special functions, count-model fits, motif scans, halves, thinning and control draws."""

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contactspark.functions import sequence, special
from contactspark.functions.draws import uniform
from contactspark.functions.scalars import hypergeom_any
from contactspark.operators import evidence, fit, maps, rates, resampling, sampling, scoring


def logpmf(y, mu, phi):
    s = 1 / phi
    return math.lgamma(y + s) - math.lgamma(s) - math.lgamma(y + 1) + s * math.log(s / (s + mu)) + (y * math.log(mu / (s + mu)) if y else 0.0)


def test_lgamma_and_pmf(spark):
    xs = [1e-3, 0.2, 1.0, 2.5, 17.0, 1234.5, 1e6]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", special.lgamma("x").alias("l"), special.digamma("x").alias("d")).collect():
        assert r.l == pytest.approx(math.lgamma(r.x), rel=1e-11, abs=1e-11)
        h = 1e-5 * r.x
        assert r.d == pytest.approx((math.lgamma(r.x + h) - math.lgamma(r.x - h)) / (2 * h), rel=1e-4, abs=1e-4)
    rows = [(0, 0.5, 0.3), (3, 2.0, 1.5), (40, 11.0, 0.01)]
    got = spark.createDataFrame(rows, "y int, m double, d double").select("y", "m", "d", special.nb2_logpmf("y", "m", "d").alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(logpmf(r.y, r.m, r.d), abs=1e-9)


@pytest.fixture(scope="module")
def nb_rows():
    rng = np.random.default_rng(3)
    parts = []
    for g, alpha, phi in (("a", 0.4, 0.5), ("b", -0.7, 1.6)):
        offset = np.round(rng.normal(0, 0.7, 3000), 2)
        mu = np.exp(offset + alpha)
        y = rng.negative_binomial(1 / phi, 1 / (1 + phi * mu))
        parts.append(pd.DataFrame({"g": g, "y": y, "o": offset}))
    return pd.concat(parts, ignore_index=True)


def test_fit_nb2_is_a_maximum(spark, nb_rows):
    got = fit.fit_nb2(spark.createDataFrame(nb_rows), ["g"], "y", "o").toPandas().set_index("g")
    for g, part in nb_rows.groupby("g"):
        a, d = got.loc[g, "alpha"], got.loc[g, "dispersion"]

        def total(alpha, phi):
            return sum(logpmf(y, math.exp(o + alpha), phi) for y, o in zip(part["y"], part["o"]))

        best = total(a, d)
        assert best == pytest.approx(got.loc[g, "log_likelihood"], rel=1e-9)
        for da, dd in ((0.02, 1), (-0.02, 1), (0, 1.03), (0, 0.97)):
            assert total(a + da, d * dd) < best
    assert got.loc["a", "dispersion"] == pytest.approx(0.5, abs=0.1)
    assert got.loc["b", "alpha"] == pytest.approx(-0.7, abs=0.1)


def test_fit_with_fixed_dispersion_and_prior(spark, nb_rows):
    df = spark.createDataFrame(nb_rows).withColumns({"phi": F.lit(0.5), "m": F.lit(5.0)})
    free = fit.fit_nb2(df, ["g"], "y", "o", fixed_dispersion="phi").toPandas().set_index("g")["alpha"]
    held = fit.fit_nb2(df, ["g"], "y", "o", fixed_dispersion="phi", prior_mean="m", prior_sd=0.01).toPandas().set_index("g")["alpha"]
    assert (held > free).all()
    with pytest.raises(ValueError):
        fit.fit_nb2(df, ["g"], "y", "o", prior_mean="m")


def test_gamma_poisson_shape(spark):
    rng = np.random.default_rng(5)
    mu = np.round(rng.uniform(0.5, 4, 4000), 2)
    y = rng.poisson(mu * rng.gamma(2.0, 0.5, 4000))
    got = fit.fit_gamma_poisson(spark.createDataFrame(pd.DataFrame({"y": y, "mu": mu})), [], "y", "mu").first()
    assert got["shape"] == pytest.approx(2.0, rel=0.2)


def test_nb_interval_and_draws(spark):
    rows = [(i, m, d) for i, (m, d) in enumerate([(0.01, 0.5), (3.0, 0.2), (250.0, 0.05), (5000.0, 0.3)])]
    df = spark.createDataFrame(rows, "pair_id long, m double, d double")
    for r in fit.nb2_interval(df, "m", "d", 0.9).collect():
        cdf, k = 0.0, 0
        found = []
        for goal in (0.05, 0.95):
            while cdf + math.exp(logpmf(k, r.m, r.d)) < goal:
                cdf += math.exp(logpmf(k, r.m, r.d))
                k += 1
            found.append(k)
        assert [r.lower, r.upper] == found
    many = spark.range(20000).select(F.col("id").alias("pair_id"), F.lit(3.0).alias("m"), F.lit(0.2).alias("d"))
    a = fit.simulate_counts(many.repartition(8), "m", "d", 9, ["pair_id"]).toPandas().sort_values("pair_id")
    b = fit.simulate_counts(many.coalesce(1), "m", "d", 9, ["pair_id"]).toPandas().sort_values("pair_id")
    assert (a["simulated_count"].to_numpy() == b["simulated_count"].to_numpy()).all()
    assert a["simulated_count"].mean() == pytest.approx(3.0, abs=0.1)
    assert a["simulated_count"].var() == pytest.approx(3 + 0.2 * 9, abs=0.3)


def test_hypergeom(spark):
    cases = [(10, 3, 2), (5, 5, 1), (9, 2, 8), (7, 0, 3), (100, 9, 12)]
    for r in spark.createDataFrame(cases, "n int, k int, d int").select("n", "k", "d", hypergeom_any("n", "k", "d").alias("p")).collect():
        assert r.p == pytest.approx(1 - math.comb(r.n - r.k, r.d) / math.comb(r.n, r.d))


def brute_scan(seq):
    forward = sequence.log_odds(sequence.CTCF_COUNTS)
    best = [-math.inf, -math.inf]
    for s in range(len(seq) - 18):
        window = seq[s:s + 19].upper()
        if any(c not in "ACGT" for c in window):
            continue
        plus = sum(forward[k]["ACGT".index(c)] for k, c in enumerate(window))
        back = [{"A": "T", "C": "G", "G": "C", "T": "A"}[c] for c in reversed(window)]
        minus = sum(forward[k]["ACGT".index(c)] for k, c in enumerate(back))
        best = [max(best[0], plus), max(best[1], minus)]
    return best


def test_pwm_scan_and_composition(spark):
    rng = np.random.default_rng(7)
    seqs = ["".join(rng.choice(list("ACGTacgtN"), 200, p=[0.17] * 4 + [0.075] * 4 + [0.02])) for _ in range(30)] + ["ACGT", "N" * 50, "", "GTACGTACATGcatg"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, s string")
    out = df.select("i", "s", sequence.pwm_scan("s").alias("m"), sequence.valid_fraction("s").alias("v"), sequence.gc_fraction("s").alias("g"), sequence.motif_count("s").alias("n"))
    for r in out.collect():
        plus, minus = brute_scan(r.s)
        if plus == -math.inf:
            assert r.m.score is None and r.m.orientation == 0
        else:
            assert r.m.score == pytest.approx(max(plus, minus)) and r.m.orientation == (1 if plus >= minus else -1)
        up = r.s.upper()
        good = sum(c in "ACGT" for c in up)
        assert r.v == (pytest.approx(good / len(up)) if up else None)
        assert r.g == pytest.approx(sum(c in "GC" for c in up) / max(good, 1))
        assert r.n == up.count("GTAC") + up.count("CATG")


def cells(spark, n=301):
    rows = [(f"DNA0{i % 3}", str(i), f"c{i:04d}", "T" if i % 5 else "U", int(i % 5 == 0), 10 + (i * 7919) % 991) for i in range(n)]
    return spark.createDataFrame(rows, "library_id string, dna_barcode string, cell_id string, cell_type string, context_index int, valid_pairs long")


def test_halves_are_balanced_disjoint_and_repeatable(spark):
    df = cells(spark)
    one = evidence.balanced_halves(df.repartition(1), 4, 11).toPandas()
    two = evidence.balanced_halves(df.repartition(8), 4, 11).toPandas()
    key = ["cell_id", "split"]
    pd.testing.assert_frame_equal(one.sort_values(key).reset_index(drop=True), two.sort_values(key).reset_index(drop=True))
    assert len(one) == 301 * 4 and not one.duplicated(key).any() and set(one["half"]) == {"A", "B"}
    depth = one.merge(df.toPandas()[["cell_id", "valid_pairs"]], on="cell_id")
    for _, part in depth.groupby(["context_index", "split"]):
        by = part.groupby("half")["valid_pairs"].sum()
        assert abs(by["A"] - by["B"]) < 0.05 * by.sum() + 1000
    patterns = one.sort_values(key).groupby("cell_id")["half"].agg("".join)
    assert patterns.nunique() > 4


def test_gap_does_not_grow_with_cells(spark):
    for n in (50, 3000):
        df = cells(spark, n)
        halves = evidence.balanced_halves(df, 6, 5).join(df.select("cell_id", "valid_pairs"), "cell_id").toPandas()
        for _, part in halves.groupby(["context_index", "split"]):
            by = part.groupby("half")["valid_pairs"].sum()
            assert abs(by["A"] - by["B"]) <= 3 * 2 * 1001


def test_quantiles_have_no_limit():
    one = np.array([1.0])
    assert fit._nb_quantile(one, one * 20_000, one - 1e-12)[0] > 200_000
    draw = np.random.default_rng(1)
    mean, dispersion, target = np.exp(draw.uniform(-3, 6, 60)), np.exp(draw.uniform(-5, 1, 60)), draw.uniform(0.01, 0.999, 60)
    for m, d, t, got in zip(mean, dispersion, target, fit._nb_quantile(mean, dispersion, target)):
        size, total, k = 1 / d, 0.0, -1
        while total < t:
            k += 1
            total += math.exp(math.lgamma(k + size) - math.lgamma(size) - math.lgamma(k + 1) + size * math.log(size / (size + m)) + k * math.log(m / (size + m)))
        assert got == k


def test_thinning_is_exact(spark):
    rows = [("hot", i, 1 + i % 9) for i in range(3000)] + [("small", i, 2) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, pair_id long, n long")
    depth = spark.createDataFrame([("hot", 5000), ("small", 10)], "g string, depth long")
    got = evidence.thin_counts(df, ["g"], "pair_id", "n", depth, 3).toPandas()
    assert got.groupby("g")["n"].sum().to_dict() == {"hot": 5000, "small": 10}
    merged = got.merge(df.toPandas(), on=["g", "pair_id"], suffixes=("", "_full"))
    assert (merged["n"] <= merged["n_full"]).all()
    # the least draws of all events, whatever the partitions; a depth beyond the total keeps everything, one of zero nothing
    events = sorted((int(hashlib.md5(f"3|hot|{i}|{e}".encode()).hexdigest()[:13], 16), i) for g, i, n in rows if g == "hot" for e in range(1, n + 1))
    assert got[got["g"] == "hot"].set_index("pair_id")["n"].to_dict() == Counter(i for _, i in events[:5000])
    single = evidence.thin_counts(df.coalesce(1), ["g"], "pair_id", "n", depth, 3).toPandas()
    assert set(map(tuple, single.to_numpy())) == set(map(tuple, got.to_numpy()))
    ends = spark.createDataFrame([("hot", 0), ("small", 99)], "g string, depth long")
    assert {(r.g, r.n) for r in evidence.thin_counts(df, ["g"], "pair_id", "n", ends, 3).collect()} == {("small", 2)}


def test_cap_is_exact_and_seeded(spark):
    df = spark.range(20000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.col("id").alias("pair_id"))
    a = resampling.cap_events(df.repartition(7), ["g"], 500, 1).toPandas()
    b = resampling.cap_events(df.coalesce(1), ["g"], 500, 1).toPandas()
    assert a.groupby("g").size().to_dict() == {0: 500, 1: 500}
    assert set(map(tuple, a.to_numpy())) == set(map(tuple, b.to_numpy()))


@pytest.fixture(scope="module")
def small_pairs(spark):
    rows = [(i, f"chr{1 + i % 2}", 30 + i % 4, "near" if i % 4 < 2 else "far", i % 3, "other", "train", i % 6, (i * 37 % 101) / 101.0) for i in range(400)]
    return spark.createDataFrame(rows, "pair_id long, chrom string, distance_bin int, distance_band string, exposure_decile int, anchor_class string, split string, tile_row long, score double")


def test_control_draws(spark, small_pairs):
    positives = small_pairs.filter("pair_id % 10 = 0").select(F.lit(0).alias("context_index"), "pair_id")
    drawn = sampling.draw_controls(positives, small_pairs, 6, 4, 5).toPandas()
    p = small_pairs.toPandas().set_index("pair_id")
    assert len(drawn) == 40 * 10 and (drawn["pair_id"] != drawn["control_id"]).all()
    for r in drawn.itertuples():
        a, b = p.loc[r.pair_id], p.loc[r.control_id]
        broad = p[(p.chrom == a.chrom) & (p.distance_band == a.distance_band)]
        match = broad[(broad.distance_bin == a.distance_bin) & (broad.exposure_decile == a.exposure_decile)]
        assert b.chrom == a.chrom and b.distance_band == a.distance_band
        if r.component == 1:
            assert r.control_id in match.index
        want = 0.6 / (len(broad) - 1) + (0.4 / (len(match) - 1) if r.control_id in match.index else 0)
        assert r.proposal == pytest.approx(want)
    again = sampling.draw_controls(positives.repartition(5), small_pairs.repartition(3), 6, 4, 5).toPandas()
    assert set(map(tuple, drawn.to_numpy())) == set(map(tuple, again.to_numpy()))


def test_lone_broad_pool_is_an_error(spark):
    one = spark.createDataFrame([(0, "chr1", 30, "near", 0, "other", "train")], "pair_id long, chrom string, distance_bin int, distance_band string, exposure_decile int, anchor_class string, split string")
    with pytest.raises(Exception, match="only the focal"):
        sampling.draw_controls(one.select(F.lit(0).alias("context_index"), "pair_id"), one, 2, 2, 1).collect()


def test_rank_controls(spark, small_pairs):
    counts = small_pairs.filter("pair_id % 3 = 0 or tile_row = 2").select(F.lit(0).alias("context_index"), "pair_id", F.lit(2).alias("full_count"))
    positives = counts.select("context_index", "pair_id", F.lit(0.5).alias("support_weight"))
    got = sampling.rank_controls(positives, small_pairs, counts, 3, 1).toPandas()
    p = small_pairs.toPandas().set_index("pair_id")
    counted = set(counts.toPandas()["pair_id"])
    for r in got.itertuples():
        if p.loc[r.pair_id, "tile_row"] in (0, 2, 3):  # every pair of these tiles is counted
            assert r.control_id == r.pair_id and r.support_weight == 0
        else:
            assert r.control_id not in counted and r.support_weight == 0.5
            assert p.loc[r.control_id, "tile_row"] == p.loc[r.pair_id, "tile_row"]


def test_rank_controls_do_not_multiply_pairs_by_contexts(spark, small_pairs):
    """A tile's pairs leave their table once, whatever the number of contexts, and the controls are those of a plain draw."""
    contexts = 7
    held = small_pairs.filter("pair_id % 3 = 0").select(F.explode(F.array(*[F.lit(c) for c in range(contexts)])).alias("context_index"), "pair_id")
    counts, positives = held.withColumn("full_count", F.lit(2)), held.withColumn("support_weight", F.lit(0.5))
    got = sampling.rank_controls(positives, small_pairs, counts, 3, 1)
    p = small_pairs.toPandas()
    zeros = p[p.pair_id % 3 != 0].groupby(["tile_row", "distance_band", "split"])["pair_id"].apply(sorted).to_dict()
    at = p.set_index("pair_id")[["tile_row", "distance_band", "split"]]
    rows = got.collect()
    assert len(rows) == 3 * contexts * held.filter("context_index = 0").count()
    for r in rows:
        pool = zeros.get(tuple(at.loc[r.pair_id]))
        u = int(hashlib.md5(f"1|{r.context_index}|{r.pair_id}|{r.slot}".encode()).hexdigest()[:13], 16) / 2**52
        assert (r.control_id, r.support_weight) == ((pool[int(u * len(pool))], 0.5) if pool else (r.pair_id, 0.0))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_error_function_on_both_sides_of_its_grid():
    x = np.concatenate([np.linspace(-7, 7, 20_001), [0.0, 6.0, -6.0, 1e-300, 40.0]])
    assert np.abs(scoring._erf(x) - [math.erf(v) for v in x]).max() < 1e-12


def test_scoring_takes_lists_without_an_object_per_row(spark):
    from workloads.discovery import network

    rows = [(i, [float(i % 7 + k) for k in range(9)], [0.5, float(i), 1.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "pair_id long, inputs array<double>, technical_inputs array<double>").repartition(3)
    scored = scoring.score_pairs(df, network(9, 3), ["pair_id"])
    assert "MapInArrow" in scored._jdf.queryExecution().optimizedPlan().toString()
    w = network(9, 3)
    for r in scored.collect():
        x = np.array(rows[r.pair_id][1])
        for name in ("layer1", "layer2"):
            z = w[name]["w"] @ x + w[name]["b"]
            x = 0.5 * z * (1 + np.array([math.erf(v / math.sqrt(2)) for v in z]))
        assert r.residual_score == pytest.approx(w["score"]["w"][0] @ x + w["score"]["b"][0], abs=1e-9)
        assert r.technical_offset == pytest.approx(w["technical"]["w"][0] @ np.array(rows[r.pair_id][2]))
    for bad in ([1.0] * 8, [1.0] * 8 + [None], [1.0] * 8 + [float("nan")], None):
        uneven = df.unionByName(spark.createDataFrame([(300, bad, [0.5, 1.0, 1.0])], df.schema)).coalesce(1)
        with pytest.raises(Exception, match="inputs must be"):
            scoring.score_pairs(uneven, w, ["pair_id"]).collect()


def test_resampled_controls_have_lower_support(spark, small_pairs):
    support = small_pairs.filter("pair_id % 2 = 0").select(F.lit(0).alias("context_index"), "pair_id", ((F.col("pair_id") % 5 + 1) / 5.0).alias("support_weight"))
    got = sampling.resample_rank_controls(support, small_pairs, support, 4, 1).toPandas()
    weight = support.toPandas().set_index("pair_id")["support_weight"].to_dict()
    assert set(got["pool"].dropna()) == {"zero", "lower"} or set(got["pool"].dropna()) == {"lower"}
    for r in got[got["support_weight"] > 0].itertuples():
        assert weight.get(r.control_id, 0.0) < weight[r.pair_id]


def test_isotonic_pools_and_single_distance_fails(spark):
    curve = spark.createDataFrame([(25, 10.0, 1.0, 1.0), (26, 20.0, 1.0, 3.0), (27, 5.0, 2.0, 0.0)], "distance_bin int, event_count double, exposure_opportunity double, raw_log_rate double")
    got = [r.distance_offset for r in rates.isotonic_offset(curve).orderBy("distance_bin").collect()]
    norm = math.log((2 * math.exp(2.0) + 2 * math.exp(0.0)) / 4)
    assert got == pytest.approx([2 - norm, 2 - norm, -norm])
    pairs = spark.createDataFrame([(0, 25, "train", 1.0)], "pair_id long, distance_bin int, split string, exposure double")
    with pytest.raises(Exception, match="one distance"):
        rates.distance_curve(pairs, spark.createDataFrame([(0, 1)], "pair_id long, full_count long"), 1).collect()


def test_balancing_evens_marginals(spark):
    rng = np.random.default_rng(2)
    n, visibility = 40, rng.uniform(0.5, 2.0, 40)
    rows = [("chr1", i * 10, j * 10, float(100 * visibility[i] * visibility[j] / (1 + abs(i - j)))) for i in range(n) for j in range(i, n)]
    pixels = spark.createDataFrame(rows, "chrom string, bin_i long, bin_j long, count double")
    w = maps.ice_balance(pixels, tolerance=1e-2).toPandas().set_index("bin")["weight"]
    marg = np.zeros(n)
    for _, i, j, c in rows:
        v = c * w[i] * w[j]
        marg[i // 10] += v
        marg[j // 10] += v
    assert marg.std() / marg.mean() < 0.15


def test_scores_are_symmetric_in_the_anchors(spark):
    def row(a, b):
        return (0, [0.3, 0.1], a, b, [0.2], [0.7], [0.5], [1.0], [2.0], 0.4)

    names = "pair_id long, pair_vector array<double>, anchor_i array<double>, anchor_j array<double>, annotation_i array<double>, annotation_j array<double>, pair_annotation array<double>, technical_i array<double>, technical_j array<double>, technical_pair double"
    from workloads.discovery import network

    df = spark.createDataFrame([row([1.0, 2.0], [3.0, 5.0]), row([3.0, 5.0], [1.0, 2.0])], names)
    out = scoring.score_pairs(scoring.feature_columns(df), network(9, 3), ["pair_id"], np.eye(5)).toPandas()
    assert out["residual_score"][0] == pytest.approx(out["residual_score"][1])
    deltas = np.stack(out["context_deltas"].to_numpy())
    assert deltas.sum(axis=1) == pytest.approx(np.zeros(2), abs=1e-9)
    off = scoring.score_pairs(scoring.feature_columns(df, "embeddings"), network(9, 3), ["pair_id"]).toPandas()
    assert off["technical_offset"].tolist() == [0.0, 0.0]


def test_bootstrap_edges(spark):
    df = spark.createDataFrame([("one", "chr1", 2.0), ("two", "chr1", 1.0), ("two", "chr2", 3.0), ("two", "chr2", None)], "g string, chrom string, m double")
    got = resampling.chrom_bootstrap_mean(df, ["g"], "m", replicates=200, seed=1).toPandas().set_index("g")
    assert pd.isna(got.loc["one", "lower"]) and got.loc["two", "point"] == 2.0
    assert got.loc["two", "lower"] == 1.0 and got.loc["two", "upper"] == 3.0


def test_matched_negatives_over_blocks_of_ids(spark, monkeypatch):
    """Tier and negative of every positive as by listing its pools in order of ids; no pool of all pairs is numbered."""
    def refuse(*args, **kwargs):
        raise AssertionError("pools are numbered")

    monkeypatch.setattr(sampling, "group_pools", refuse)
    draw = np.random.default_rng(9)
    rows = [(int(i * 7919), f"chr{i % 2}", "b", int(250_000 + 10_000 * draw.integers(0, 12)), int(draw.integers(0, 5)), float(draw.integers(0, 30)), bool(draw.random() < 0.1), bool(draw.random() < 0.4)) for i in range(1500)]
    pairs = spark.createDataFrame(rows, "pair_id long, chrom string, distance_band string, distance_bp int, n int, s double, label boolean, near boolean")
    marked = sampling.with_match_buckets(pairs, "n", "s")
    got = {r.pair_id: (r.negative_id, r.tier) for r in sampling.matched_negatives(marked, "label", "near", 5, strict=False).collect()}
    u = {r.pair_id: r.u for r in pairs.select("pair_id", uniform(5, "pair_id").alias("u")).collect()}
    data = marked.orderBy("pair_id").collect()
    ranks = pairs.toPandas()["s"].rank()
    decile = dict(zip([r[0] for r in rows], np.minimum(np.floor(ranks / 1501 * 10), 9)))
    assert {r.pair_id: r.score_decile for r in data} == decile
    assert len({r.pair_id >> 16 for r in data}) > 50
    for r in data:
        if not r.label:
            assert r.pair_id not in got
            continue
        alike = [x for x in data if not x.near and (x.chrom, x.raw_bucket, x.score_decile) == (r.chrom, r.raw_bucket, r.score_decile)]
        pools = [("exact_10kb", [x for x in alike if x.distance_bp == r.distance_bp]), ("within_50kb", [x for x in alike if x.distance_bp // 50_000 == r.distance_bp // 50_000]), ("within_band", alike)]
        tier, pool = next((p for p in pools if p[1]), ("unmatched", None))
        assert got[r.pair_id] == (pool[int(u[r.pair_id] * len(pool))].pair_id if pool else None, tier)
    assert {tier for _, tier in got.values()} >= {"exact_10kb", "within_50kb"}


def test_resampled_controls_do_not_multiply_pairs_by_contexts(spark, small_pairs):
    """Pools as in Python, for two contexts; pairs are folded by tile and no window orders them."""
    support = small_pairs.crossJoin(spark.createDataFrame([(0,), (1,)], "context_index int")).filter("(pair_id + context_index) % 3 = 0").select(
        "context_index", "pair_id", ((F.col("pair_id") % 5 + 1) / 5.0).alias("support_weight"))
    df = sampling.resample_rank_controls(support, small_pairs, support, 6, 1)
    assert "Window" not in df._jdf.queryExecution().sparkPlan().toString()
    draws = {(r.context_index, r.pair_id, r.slot): r.u for r in df.select("context_index", "pair_id", "slot", uniform(1, "context_index", "pair_id", "slot").alias("u")).collect()}
    place = {r.pair_id: (r.tile_row, r.distance_band, r.split) for r in small_pairs.collect()}
    held = {(r.context_index, r.pair_id): r.support_weight for r in support.collect()}
    got = df.collect()
    assert len(got) == 6 * len(held)
    for r in got:
        pool = sorted(p for p in place if place[p] == place[r.pair_id])
        own = held[r.context_index, r.pair_id]
        zeros = [p for p in pool if (r.context_index, p) not in held]
        lower = sorted((held[r.context_index, p], p) for p in pool if held.get((r.context_index, p), own) < own)
        u = draws[r.context_index, r.pair_id, r.slot]
        if zeros and (r.slot < 3 or not lower):
            want = (zeros[int(u * len(zeros))], "zero", own)
        else:
            want = (lower[int(u * len(lower))][1], "lower", own) if lower else (r.pair_id, None, 0.0)
        assert (r.control_id, r.pool, r.support_weight) == want
