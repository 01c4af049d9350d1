"""Steps that fold rows before they are joined by few keys, against the same on plain rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactspark.operators import evidence, metrics
from contactspark.operators.ordered import measured_broadcasts


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 4000
    x = np.round(0.01 + rng.random(n), 2)
    return spark.createDataFrame([("a" if i % 5 else "b", float(x[i]), float(rng.poisson(1 + 5 * x[i])), bool(rng.random() < x[i])) for i in range(n)],
                                 "g string, m double, y double, hit boolean").cache()



def test_calibration_slope_does_not_join_rows_by_group(spark, rows):
    measured_broadcasts(spark)
    got = metrics.calibration_slope(rows, ["g"], "y", "m")
    text = got._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin [g" not in text
    data = rows.toPandas()
    for r in got.collect():
        d = data[data.g == r.g]
        edges = np.unique(np.quantile(d.m, np.linspace(0, 1, 11)))
        at = np.searchsorted(edges[1:], d.m, side="left")
        means = d.groupby(at)[["m", "y"]].mean()
        eps = means.m.min()
        slope = np.polyfit(np.log(means.m + eps), np.log(means.y + eps), 1)[0]
        assert abs(slope - r.calibration_slope) < 1e-9


def test_metric_bundle_reads_its_rows_twice(spark, rows):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    counted = rows.mapInArrow(seen, rows.schema)
    out = {r.g: r for r in metrics.metric_bundle(counted, ["g"], "m", "y", "hit", 100, 20).collect()}
    assert reads.value == 2 * rows.count()
    data = rows.toPandas()
    for g, d in data.groupby("g"):
        assert abs(d.m.rank().corr(d.y.rank()) - out[g].spearman) < 1e-9
        assert out[g].support_count == d.hit.sum() and out[g].candidate_count == len(d)


def test_pair_ids_come_from_left_bins(spark):
    near = [(c, i * 10, i * 10 + d * 10, c) for c in ("chr1", "chr2") for i in range(40) for d in range(25, 100) if (i + d) % 7]
    pairs = spark.createDataFrame([(f"{c}", i, j, n) for n, (c, i, j, _) in enumerate(sorted(near))], "chrom string, bin_i long, bin_j long, pair_id long")
    asked = pairs.select("chrom", "bin_i", "bin_j", F.col("pair_id").alias("want")).unionByName(
        spark.createDataFrame([("chr1", 0, 70 * 10, None), ("chr3", 0, 300, None), ("chr1", 390, 390, None)], "chrom string, bin_i long, bin_j long, want long"))
    met = asked.join(evidence.left_bin_ids(pairs, 10, 1000), ["chrom", "bin_i"], "left").withColumn("got", evidence.pair_id_of(10, 1000))
    assert met.filter("not (got <=> want)").count() == 0 and met.count() == len(near) + 3
    broken = pairs.withColumn("pair_id", F.when(F.col("pair_id") > 50, F.col("pair_id") + 1).otherwise(F.col("pair_id")))
    with pytest.raises(Exception, match="run along"):
        evidence.left_bin_ids(broken, 10, 1000).collect()


def test_universe_is_not_shuffled_by_the_sums(spark):
    from workloads.base import Inputs

    t = Inputs(spark, "/root/testdata/sf0.001")
    sums = evidence.pair_sums(t.raw_contacts, evidence.cell_masks(t.membership, t.assignments, 20), t.universe, 20, bin_size=10_000, low=250_000, high=1_000_000)
    text = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in text and not re.search(r"bin_j#\d+L? = bin_j#", text)


class Caught(Exception):
    pass


def by_band(df) -> list[str]:
    """Joins of the plan that deal rows by output and band."""
    text = df._jdf.queryExecution().sparkPlan().toString()
    return re.findall(r"(?:SortMerge|ShuffledHash)Join \[(?:output_id#\d+, )?distance_band#\d+\]", text)


def test_fits_and_gates_do_not_deal_rows_by_band(spark, monkeypatch):
    """Two bands would be two tasks, whatever the size of the pair table."""
    from workloads import gates, modelling
    from workloads.base import Inputs

    measured_broadcasts(spark)
    seen = []
    bands = spark.createDataFrame([(b, "shared", 0.1, 0.5) for b in ("250-500", "500-1000")], "distance_band string, output_id string, alpha double, dispersion double")

    def fit(df, groups, *args, **kwargs):
        seen.append(df)
        return bands.select(*groups, "alpha", "dispersion")

    def ratio(df, *args):
        seen.append(df)
        raise Caught

    monkeypatch.setattr(modelling.Fit, "fit_nb2", fit)
    monkeypatch.setattr(gates.Fit, "calibration_ratio", ratio)
    t = Inputs(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(modelling, "band_fit", lambda t: bands.drop("output_id"))
    modelling.fit_nb2_fixed(t)
    with pytest.raises(Caught):
        gates.calibration_metrics(t, bands, bands, ["shared"])
    assert len(seen) == 2 and [by_band(df) for df in seen] == [[], []]


def test_exports_do_not_deal_rows_by_band(spark):
    from workloads import QUERIES

    for name in ("export_rates", "predict_sparse"):
        assert by_band(QUERIES[name](spark, "/root/testdata/sf0.001")) == []


def test_pairs_meet_their_counts_by_left_bin(spark):
    """The scored pair table: no pair moves to meet its counts, and the rows are those of a join by pair."""
    from workloads.base import Inputs

    t = Inputs(spark, "/root/testdata/sf0.001")
    text = t.scored._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"pair_id#\d+L? = pair_id#", text)
    shared = t.counts.groupBy("pair_id").agg(*[F.sum(c).alias(c) for c in ("full_count", "counts_a", "counts_b")])
    want = t.universe.join(shared, "pair_id", "left").fillna(0)
    got = t.scored.select(*want.columns)
    assert got.dtypes == want.dtypes and t.scored.columns[:len(want.columns)] == want.columns
    assert got.filter("full_count > 0").count() == shared.count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
