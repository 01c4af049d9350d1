"""Logarithms of whole numbers are rounded to nearest, so that ranks of their differences tie as elsewhere."""

import math
from decimal import Decimal, getcontext

from pyspark.sql import functions as F

from contactspark.functions import scalars as S
from contactspark.operators import topk


def test_whole_numbers_are_rounded_to_nearest(spark):
    getcontext().prec = 40
    numbers = [*range(1, 6000), *range(10_000, 2**40, 2**40 // 1500), 2**53 - 1]
    df = spark.createDataFrame([(float(n),) for n in numbers], "x double").coalesce(4)
    got = {int(r.x): r.y for r in df.select("x", S.correct_log("x").alias("y")).collect()}
    assert [n for n in numbers if got[n] != float(Decimal(n).ln())] == []
    assert math.log(3) == got[3]


def test_other_numbers(spark):
    df = spark.createDataFrame([(0.5,), (2.5,), (None,), (0.0,), (float("inf"),), (2.0**60,)], "x double")
    rows = df.select(S.correct_log("x").alias("y"), F.log("x").alias("z")).collect()
    assert [r.y for r in rows] == [r.z for r in rows]


def test_ties_of_the_target(spark):
    """Of counts 3 and 4 over exposures 1 and 2 (plus 2: 5/3 and 6/4) none tie; 1/1, 4/4 do, and 1/4 ties with 2/6 just where the doubles do."""
    pairs = [(0, 1, 4), (1, 2, 6), (2, 4, 7), (3, 1, 7), (4, 6, 7)]
    df = spark.createDataFrame(pairs, "pair_id long, full_count long, exposure long").withColumn("target", S.log_enrichment("full_count", "exposure", 2.0))
    expected = {p: math.log(c + 2) - math.log(e + 2) for p, c, e in pairs}
    assert {r.pair_id: r.target for r in df.collect()} == expected
    ranked = topk.topk_fractional(df.withColumns({"g": F.lit(1), "k": F.lit(3)}), ["g"], "target", "k", eligible=F.lit(True))
    ours = {r.pair_id: round(r.weight, 9) for r in ranked.collect()}
    order = sorted(expected.values(), reverse=True)
    theirs = {p: min(1.0, max(0.0, (3 - order.index(v)) / order.count(v))) for p, v in expected.items()}
    assert ours == {p: round(w, 9) for p, w in theirs.items() if w > 0}
