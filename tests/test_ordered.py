"""Ordered computations agree with pandas whatever the partitioning, with a hot group and heavy ties."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contactspark.operators import metrics, ordered, sampling, topk


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    n = 4000
    return pd.DataFrame({
        "g": np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n)), "id": np.arange(n),
        "score": np.where(rng.random(n) < 0.4, 0.0, rng.integers(0, 60, n) / 60), "label": (rng.random(n) < 0.3).astype(int)})


@pytest.mark.parametrize("parts", [1, 8])
def test_numbered_and_average_ranks(spark, frame, parts):
    df = spark.createDataFrame(frame).repartition(parts)
    got = ordered.numbered(df, ["g"], [("score", True), ("id", False)], "n", "size").toPandas().sort_values("id")
    want = frame.sort_values(["score", "id"], ascending=[False, True]).groupby("g").cumcount().add(1).sort_index()
    assert (got["n"].to_numpy() == want.to_numpy()).all()
    assert (got["size"].to_numpy() == frame.groupby("g")["id"].transform("size").to_numpy()).all()
    ranks = ordered.average_ranks(df, ["g"], "score").toPandas().set_index(["g", "score"])["avg_rank"]
    want = frame.assign(r=frame.groupby("g")["score"].rank()).groupby(["g", "score"])["r"].first()
    pd.testing.assert_series_equal(ranks.sort_index(), want.sort_index(), check_names=False)


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, v int")
    got = {(r.g, r.v): r.n for r in ordered.numbered(df, ["g"], [("v", False)], "n").collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", 1): 1}


def brute_ap_auc(labels, scores):
    order = sorted(set(scores), reverse=True)
    ap, seen = 0.0, 0
    total = labels.sum()
    for s in order:
        at = scores >= s
        gain = labels[scores == s].sum()
        ap += gain / total * labels[at].sum() / at.sum()
    pos, neg = scores[labels == 1], scores[labels == 0]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    return ap, auc


def test_classification(spark, frame):
    got = metrics.classification(spark.createDataFrame(frame), ["g"], "score", "label").toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        ap, auc = brute_ap_auc(part["label"].to_numpy(), part["score"].to_numpy())
        assert got.loc[g, "auprc"] == pytest.approx(ap)
        assert got.loc[g, "auroc"] == pytest.approx(auc)


def test_one_class_groups_are_null(spark):
    df = spark.createDataFrame([("p", 0.1, 1), ("p", 0.2, 1), ("n", 0.3, 0)], "g string, s double, y int")
    got = {r.g: (r.auprc, r.auroc) for r in metrics.classification(df, ["g"], "s", "y").collect()}
    assert got == {"p": (None, None), "n": (None, None)}


def test_spearman_and_quantiles(spark, frame):
    df = spark.createDataFrame(frame.assign(y=frame["score"] * 2 + frame["label"]))
    got = metrics.spearman(df, ["g"], "score", "y").toPandas().set_index("g")["spearman"]
    q = metrics.exact_quantiles(df, ["g"], "y", [0.0, 0.1, 0.5, 0.975, 1.0]).toPandas().set_index("g")["quantiles"]
    for g, part in frame.assign(y=frame["score"] * 2 + frame["label"]).groupby("g"):
        assert got[g] == pytest.approx(part["score"].rank().corr(part["y"].rank()))
        assert list(q[g]) == pytest.approx(list(np.quantile(part["y"], [0.0, 0.1, 0.5, 0.975, 1.0])))
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert metrics.spearman(flat, [], "x", "y").first()["spearman"] is None


def test_tie_rules_differ(spark):
    rows = [(i, s, y) for i, (s, y) in enumerate([(3.0, 1), (2.0, 0), (2.0, 1), (2.0, 0), (1.0, 1)])]
    df = spark.createDataFrame(rows, "pair_id long, score double, label int").withColumn("g", F.lit("g"))
    hard = topk.topk_hard(df, ["g"], "score", 0.4).toPandas()
    assert sorted(hard["pair_id"]) == [0, 1] and hard["tied"].all()
    assert sorted(topk.topk_inclusive(df, ["g"], "score", 0.4).toPandas()["pair_id"]) == [0, 1, 2, 3]
    weights = topk.topk_fractional(df.withColumn("k", F.lit(2)), ["g"], "score", "k").toPandas().set_index("pair_id")["weight"]
    assert weights.sum() == pytest.approx(2) and weights[1] == pytest.approx(1 / 3)
    late = topk.topk_precision(df, ["g"], "score", "label", [0.4]).first()
    assert late["precision"] == pytest.approx(0.5)  # pair 3, the later of the ties, is taken
    fair = topk.topk_tie_aware(df, ["g"], "score", "label", [0.4]).first()
    assert fair["expected_positives"] == pytest.approx(1 + 1 / 3) and fair["tie_size"] == 3
    assert topk.topk_fractional(df.withColumn("k", F.lit(6)), ["g"], "score", "k").count() == 0


def test_all_tied_and_single_row(spark):
    df = spark.createDataFrame([("t", i, 1.0) for i in range(4)] + [("one", 9, 5.0)], "g string, pair_id long, score double")
    got = topk.topk_hard(df, ["g"], "score", 0.5).toPandas()
    assert sorted(got["pair_id"]) == [0, 1, 9]
    nulls = spark.createDataFrame([("t", 1, float("nan")), ("t", 2, None), ("t", 3, 0.5)], "g string, pair_id long, score double")
    assert [r.pair_id for r in topk.topk_hard(nulls, ["g"], "score", 1.0).collect()] == [3]


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 1.0, 0.03]
    got = metrics.bh_adjust(spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p_value double")).toPandas().sort_values("i")["adjusted_p"]
    assert list(got) == pytest.approx([0.05, 0.05, 0.05, 1.0, 0.05])
    assert metrics.bh_adjust(spark.createDataFrame([], "i int, p_value double")).count() == 0
    got = metrics.bh_adjust(spark.createDataFrame([(i, v) for i, v in enumerate([*p, None])], "i int, p_value double")).toPandas().sort_values("i")["adjusted_p"]
    assert list(got)[:5] == pytest.approx([0.05, 0.05, 0.05, 1.0, 0.05]) and math.isnan(list(got)[5])


def test_pack_groups_keeps_groups_whole(spark):
    sizes = spark.createDataFrame([(f"g{i}", 1 + i % 7) for i in range(200)], "key string, rows long")
    got = sampling.pack_groups(sizes, 20, 3, "key").toPandas()
    assert len(got) == 200 and got["key"].is_unique
    assert got.groupby("batch")["rows"].sum().max() <= 20
    sevens = spark.createDataFrame([(f"g{i}", 7 if i else 50) for i in range(40)], "key string, rows long")
    got = sampling.pack_groups(sevens, 20, 3, "key").toPandas()
    assert sorted(got.groupby("batch")["rows"].sum())[-1] == 50 and sorted(got.groupby("batch")["rows"].sum())[-2] <= 20


def test_top_shares_order_only_the_slice_of_a_cutoff(spark, monkeypatch):
    """Top shares as by sorting each group in Python; ties, nulls, an infinite score and a null group included."""
    draw = random.Random(3)
    rows = [(g, float(draw.randrange(5)) if g == "tied" else draw.gauss(0, 1), i, draw.randrange(4)) for i in range(9000) for g in [("a", "tied", None)[i % 3]]]
    rows += [("a", None, 9001, 1), ("a", float("inf"), 9002, 2), ("one", 0.5, 9003, 3), ("none", None, 9004, 1)]
    df = spark.createDataFrame(rows, "g string, s double, pair_id long, y int")
    moved = []
    monkeypatch.setattr(topk, "numbered", lambda df, *more: (moved.append(df.count()), ordered.numbered(df, *more))[1], raising=False)
    got = {(r.g, r.fraction): r.asDict() for r in topk.reversed_topk_rows(df, ["g"], "s", [0.01, 0.05], ["y"]).collect()}
    assert moved and moved[0] < 3000 * 0.03 + 2 * 3000 / 5 + 10
    for g in ("a", "tied", None, "one", "none"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-math.inf if r[1] is None else r[1], r[1] is not None, r[2]), reverse=True)
        for f in (0.01, 0.05):
            k = max(1, math.ceil(len(mine) * f))
            assert got[g, f] == {"g": g, "fraction": f, "k": k, "candidates": len(mine), "top_y": sum(r[3] for r in mine[:k]), "total_y": sum(r[3] for r in mine)}
    assert len(got) == 10
