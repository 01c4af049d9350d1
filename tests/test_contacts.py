"""Contact operators on tiny tables: trans rows, broken input, gates with tests missing."""

import pytest

from contactspark.operators import contacts
from contactspark.plans import gates

CONTACT = "library_id string, dna_barcode string, chrom1 string, pos1 long, chrom2 string, pos2 long, cell_type string"
CELL = "library_id string, dna_barcode string, cell_id string, cell_type string, context_index int, split int, half string"


def test_trans_rows_keep_both_chromosomes(spark):
    df = spark.createDataFrame([("L", "1", "chr1", 15, "chr2", 5, "T"), ("L", "1", "chr2", 5, "chr1", 15, "T"), ("L", "1", "chr1", 25, "chr1", 3, "T")], CONTACT)
    got = {(r.chrom, r.bin_i, r.chrom2, r.bin_j): r["count"] for r in contacts.contacts_to_pixels(df, 10).collect()}
    assert got == {("chr1", 10, "chr2", 0): 2, ("chr1", 0, "chr1", 20): 1}
    distance = [r.distance_bp for r in contacts.canonical_anchors(df, 10).collect()]
    assert distance == [None, None, 20]
    wide = {(r.chrom, r.bin_i, r.chrom2, r.bin_j): r["count"] for r in contacts.coarsen_pixels(contacts.contacts_to_pixels(df, 10), 10, 2).collect()}
    assert wide == {("chr1", 0, "chr2", 0): 2, ("chr1", 0, "chr1", 20): 1}


def test_repeated_barcode_is_an_error(spark):
    cells = spark.createDataFrame([("L", "1", "a", "T", 0, 0, "A"), ("L", "1", "b", "T", 0, 0, "B")], CELL)
    binned = contacts.binned_contacts(spark.createDataFrame([("L", "1", "chr1", 15, "chr1", 5, "T")], CONTACT), 10)
    with pytest.raises(Exception, match="listed twice"):
        contacts.assign_context(binned, cells).collect()
    assert contacts.assign_context(binned, cells.filter("cell_id = 'a'")).count() == 1


def test_broken_records_and_empty_families(spark):
    cells = spark.createDataFrame([("L", "1", "a", "T", 0, 0, "B"), ("L", "2", "b", "U", 1, 0, "A")], CELL)
    families = spark.createDataFrame([("F", "T"), ("G", "U")], "output_id string, member string")
    good = ("L", "1", "chr1", 15, "chr1", 5, "T")
    df = spark.createDataFrame([good, ("L", "1", "chr1", 15, "chr1", 5, "X")], CONTACT)
    assert contacts.route_family_half(df, cells, families.filter("output_id = 'F'"), 0).count() == 1
    with pytest.raises(Exception, match="family without cells"):
        contacts.route_family_half(df, cells, families, 0).collect()
    with pytest.raises(Exception, match="malformed record"):
        contacts.route_family_half(spark.createDataFrame([good, ("L", "1", "chr1", None, "chr1", 5, "T")], CONTACT), cells, families.filter("output_id = 'F'"), 0).collect()
    counts = {r.family: (r.contacts_a, r.contacts_b) for r in contacts.family_half_counts(df, cells, families, 0).collect()}
    assert counts == {"F": (0, 1), "G": (0, 0)}


def test_extension_needs_every_test(spark):
    schema = "output_id string, distance_band string, metric string, comparison string, point double, lower double, adjusted_p double"
    full = [("a", b, m, c, 1.0, 1.0, 0.01) for b in ("x", "y") for m in gates.METRICS for c in gates.COMPARISONS]
    some = [("b", "x", "likelihood", "onehot_vs_shared", 1.0, 1.0, 0.01)]
    only = [("c", b, m, "onehot_vs_shared", 1.0, None, 0.01) for b in ("x", "y") for m in gates.METRICS]
    out = {r.output_id: (r.selected_mode, r.accepted) for r in gates.extension_gate(spark.createDataFrame(full + some + only, schema), ["x", "y"]).collect()}
    assert out == {"a": ("rna", True), "b": (None, False), "c": ("onehot", True)}
