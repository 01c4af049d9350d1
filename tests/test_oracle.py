"""Queries against DuckDB on the smallest tables: one per family, plus the contract of the registry."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from contactspark.fixtures import TABLES
from workloads.base import COLUMN_TYPES, TEXTS

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
NAMES = [
    "canonical_anchors", "contact_filter", "assign_pair_id", "evidence_counts", "pool_counts", "replicate_support", "topk_overlap_exact",
    "topk_hard", "topk_tie_aware", "classification_metrics", "exact_quantiles", "distance_curve", "conditional_ll", "interval_bins", "anchor_classes",
    "catalog_support", "support_to_pairs", "centroids", "map_normalize", "rollout", "stream_ingest", "tile_grid", "cap_events", "read_contacts",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = con.execute(entry.oracle_sql()[name])
    theirs_columns = [d[0] for d in cursor.description]
    assert sorted(theirs_columns) == columns
    at = [theirs_columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=str)
    assert ours == theirs


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "output_id"
    assert df.count() == 54


def test_registry_is_whole():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(COLUMN_TYPES) == set(TEXTS)
