"""No side of a join passes through the driver on an estimate from the plan."""

import pytest
from pyspark.sql import functions as F

from contactspark.operators.ordered import measured_broadcasts
from workloads import QUERIES
from workloads.base import Inputs

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def planned(spark):
    """Spark's own setting, restored afterwards."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "10485760")
    spark.conf.unset(names[1])
    yield spark
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_threshold_moves_to_measured_sizes(planned):
    measured_broadcasts(planned)
    measured_broadcasts(planned)
    assert planned.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    assert planned.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "10485760"


@pytest.mark.parametrize("name", ["annotate_anchors", "coverage_report", "map_errors"])
def test_pair_tables_are_not_broadcast_by_estimate(planned, name):
    text = plan(QUERIES[name](planned, FOLDER))
    assert "Join" in text
    # single rows are broadcast by name (coverage_report); no keyed join is
    assert "BroadcastHashJoin" not in text


def test_tables_built_outside_a_query_are_not_broadcast_by_estimate(planned):
    """As bench.py does: the pair table is asked for before any query has run."""
    t = Inputs(planned, FOLDER)
    assert planned.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    assert "BroadcastHashJoin" not in plan(t.raw_contacts) and "Join" in plan(t.raw_contacts)


def test_records_are_summed_to_cells_once(spark):
    """Tables made from the cell table read it stored, without the join of records behind it."""
    t = Inputs(spark, FOLDER)
    assert "Join" not in plan(t.membership) and "Join" not in plan(t.contexts)
    assert t.membership.count() == t.membership.select("library_id", "dna_barcode").distinct().count() > 0


def test_range_filters_stay_small_at_the_scan(spark):
    """A distance filter that reaches the record scan carries each adapter column a few times, not once per use of every use."""
    from contactspark.operators.evidence import cell_masks, pair_sums
    from contactspark.sources.text import parse_bedpe
    from workloads.discovery import raw_calls

    t = Inputs(spark, FOLDER)
    sums = pair_sums(t.raw_contacts, cell_masks(t.membership, t.assignments, 20), t.universe, 20, bin_size=10_000, low=250_000, high=1_000_000)
    for df in (sums, parse_bedpe(raw_calls(t)).join(t.universe, ["chrom", "bin_i", "bin_j"])):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in text.splitlines() if "+- Filter" in line and ("l_linenumber" in line or "l_quantity" in line)]
        assert [line.count("l_linenumber") < 30 for line in filters] == [True]
    # halves of every split, unpacked, against one sum per split
    a = t.assignments.filter("half = 'A'").join(t.raw_contacts.join(t.universe.select("chrom", "bin_i", "bin_j", "pair_id"), [
        F.col("chrom") == F.col("chrom1"), F.col("chrom") == F.col("chrom2"),
        F.least("pos1", "pos2") - F.least("pos1", "pos2") % 10_000 == F.col("bin_i"),
        F.greatest("pos1", "pos2") - F.greatest("pos1", "pos2") % 10_000 == F.col("bin_j")]), ["library_id", "dna_barcode"])
    want = {(r[0], r[1], r[2]): r[3] for r in a.groupBy("context_index", "pair_id", "split").count().collect()}
    got = {(r.context_index, r.pair_id, s): n for r in sums.collect() for s, n in enumerate(r.a_by_split) if n}
    assert got == want and want
