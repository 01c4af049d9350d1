"""Columns of the input that bear the operators' own names keep their values."""

import pytest
from llm_rows import PROSE
from pyspark.sql import functions as F

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
NAMES = ["__key", "__hash", "__nth", "__id", "__host", "__keys", "__split", "__lang", "__source", "__lines", "__dropped", "__HASH_"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_values_stay(spark, name, stage):
    rows = [(i, "\n".join([f"{PROSE} {i} in field {i * i}", "all pages have this line", f"{PROSE[::-1]} {i}"]), "en", "a") for i in range(12)]
    docs = spark.createDataFrame([*rows, (3, rows[3][1], "en", "a")], "doc_id long, text string, lang string, source string")
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in NAMES])
    out = stage(spark, docs, FOLDER)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) >= 1 and all(r[n] == f"{n}{r.doc_id}" for r in got for n in NAMES)
    if name == "near_duplicates":
        assert sorted(r.doc_id for r in got) == list(range(12))
    if name == "line_dedup":
        assert len(got) == 13 and all("all pages" not in r.text for r in got)
