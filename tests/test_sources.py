"""Line formats, their errors, writers, settings and the gates' tables."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactspark.functions import scalars
from contactspark.operators import contacts, contexts, intervals, maps, neighbours, universe
from contactspark.plans import gates
from contactspark.settings import BANDS, Band, Geometry, check_bands, check_calibration, check_strata, distance_range
from contactspark.sources import tables, text


def put(path, lines):
    with (gzip.open(path, "wt") if str(path).endswith("gz") else open(path, "w")) as f:
        f.write("\n".join(lines) + "\n")
    return str(path)


def test_contacts_file(spark, tmp_path):
    put(tmp_path / "x_DNA_3_y.tsv.gz", ["#head", "b1:q\tchr1\t10\tchr1\t20\t.\t.\t.\tT", "short\tline", "b2:q\tchr2\t5\tchr3\t7"])
    put(tmp_path / "other.tsv.gz", ["b9:q\tchr1\t1\tchr1\t2"])
    rows = text.read_contacts(spark, f"{tmp_path}/*.tsv.gz").orderBy("dna_barcode").collect()
    assert [(r.library_id, r.dna_barcode, r.pos2, r.cell_type, r.malformed) for r in rows] == [
        ("DNA03", None, None, None, True), ("DNA03", "b1", 20, "T", False), ("DNA03", "b2", 7, None, False)]


def test_interval_files(spark, tmp_path):
    bed = put(tmp_path / "a.bed", ["track x", "#c", "chr1 5 9 n", "chr1 9 9 n"])
    assert [tuple(r) for r in text.read_bed(spark, bed).collect()] == [("chr1", 5, 9)]
    with pytest.raises(Exception, match="fewer than three"):
        text.read_bed(spark, put(tmp_path / "b.bed", ["chr1 5"])).collect()
    ten = "chr1\t1\t5\t.\t.\t.\t.\t.\t.\t"
    got = text.read_labelled_bed(spark, put(tmp_path / "c.bed", [ten + "dELS", ten + "other"])).collect()
    assert [(r.start_bp, r.label) for r in got] == [(1, "dELS")]
    gtf = put(tmp_path / "g.gtf", ["#x", "chr1\ts\tgene\t11\t20\t.\t+\t.\ti", "chr1\ts\tgene\t11\t20\t.\t-\t.\ti", "chr1\ts\texon\t1\t2\t.\t+\t.\ti"])
    assert sorted(r.tss for r in text.read_gtf_tss(spark, gtf).collect()) == [10, 19]
    graph = put(tmp_path / "m.bedgraph", ["chr1 0 15 2.0", "chrUn 0 5 9"])
    got = intervals.overlap_mean(text.read_bedgraph(spark, graph, ["chr1"]), 10, ["chr1"]).orderBy("bin_start").collect()
    assert [(r.bin_start, r.value) for r in got] == [(0, 2.0), (10, 1.0)]


def test_loop_files(spark, tmp_path):
    good = put(tmp_path / "l.bedpe", ["chr1\t300000\t305000\tchr1\t5000\t10000", "chr1\t5000\t10000\tchr1\t305000\t310000", "chr1\t0\t5000\tchr1\t10000\t15000"])
    assert [tuple(r) for r in text.read_bedpe(spark, good, "m").collect()] == [("chr1", 0, 300000, "m")]
    for line, what in (("chr1\t0\t5000\tchr2\t300000\t305000", "trans"), ("chr1\t1\t5001\tchr1\t300000\t305000", "grid")):
        with pytest.raises(Exception, match=what):
            text.read_bedpe(spark, put(tmp_path / f"{what}.bedpe", [line]), "m").collect()
    loops = put(tmp_path / "l8", ["chr1\t0\t10000\tchr1\t990000\t1000000\t0.5\t3"])
    assert text.read_loops8(spark, loops, "f").first()["family"] == "f"
    with pytest.raises(Exception, match="breaks the format"):
        text.read_loops8(spark, put(tmp_path / "far", ["chr1\t0\t10000\tchr1\t1000000\t1010000\t0.5\t3"]), "f").collect()


def test_wide_counts(spark, tmp_path):
    path = put(tmp_path / "w.tsv.gz", ["barcode\tcell_type\tg1\tg2", "rna1_a\tT\t0\t4", "rna12_b\tU\t2\t1"])
    got = sorted((r.barcode, r.library_id, r.gene, r.n) for r in text.read_wide_counts(spark, path, ["g2", "g1"]).collect())
    assert got == [("rna12_b", "DNA12", "g1", 2), ("rna12_b", "DNA12", "g2", 1), ("rna1_a", "DNA01", "g2", 4)]
    with pytest.raises(ValueError, match="not in the table"):
        text.read_wide_counts(spark, path, ["g9"])
    with pytest.raises(ValueError, match="repeat"):
        text.read_wide_counts(spark, put(tmp_path / "d.tsv", ["barcode\tcell_type\tg1", "rna1_a\tT\t1", "rna1_a\tT\t1"]), ["g1"])
    with pytest.raises(Exception, match="another form"):
        text.read_wide_counts(spark, put(tmp_path / "e.tsv", ["barcode\tcell_type\tg1", "x_a\tT\t1"]), ["g1"]).collect()


def test_chrom_sizes_and_blocks(spark, tmp_path):
    fai = put(tmp_path / "s.fai", ["chr2\t50\t1", "chr1\t70\t1"])
    assert [tuple(r) for r in text.read_chrom_sizes(spark, fai, ["chr1", "chr2"]).orderBy("chrom_order").collect()] == [(0, "chr1", 70), (1, "chr2", 50)]
    with pytest.raises(Exception, match="no size"):
        text.read_chrom_sizes(spark, fai, ["chr1", "chr3"]).select(F.sum("size_bp")).collect()
    block = spark.createDataFrame([("chr1", 0, 5, "chr1", 9, 14, 0.5), (None,) * 7], "a string, b int, c int, d string, e int, f int, g double")
    assert tables.read_blocks(block, ["m"]).count() == 1
    partial = spark.createDataFrame([("chr1", None, 5, "chr1", 9, 14, 0.5)], block.schema)
    with pytest.raises(Exception, match="partly empty"):
        tables.read_blocks(partial, ["m"]).collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", float("inf"), 1), ("b", 2.0, 2)], "k string, v double, n int")
    tables.write_metrics(df, f"{tmp_path}/m", "json")
    rows = [json.loads(x) for p in (tmp_path / "m").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted((r["k"], r.get("v")) for r in rows) == [("a", None), ("b", 2.0)]
    tables.write_metrics(df, f"{tmp_path}/c", "csv")
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == 2
    tables.write_table(df, f"{tmp_path}/t", ("k",))
    assert tables.scan(spark, f"{tmp_path}/t", ["n"]).count() == 2
    assert "ReadSchema: struct<n:int>" in tables.scan(spark, f"{tmp_path}/t", ["n"])._jdf.queryExecution().toString()
    routed = spark.createDataFrame([("xy"[i % 2], "DNA01", str(i)) for i in range(50)], "cell_type string, library_id string, dna_barcode string")
    tables.write_routed(routed, f"{tmp_path}/r")
    assert tables.read_routed(spark, f"{tmp_path}/r").count() == 50
    assert tables.read_routed(spark, f"{tmp_path}/r", "x").count() == 25


def test_settings():
    assert list(Geometry().bins) == list(range(25, 100))
    assert distance_range(250_000, 10_000, maximum=990_000) == (250_000, 1_000_000)
    for bands in ((), (Band("a", 0, 5), Band("b", 6, 9)), (Band("a", 5, 5),), (Band("a", 0, 5), Band("a", 5, 9))):
        with pytest.raises(ValueError):
            check_bands(bands)
    with pytest.raises(ValueError):
        distance_range(5, 10, maximum=20)
    check_strata(["a"], ["b"], ["a", "b"])
    with pytest.raises(ValueError):
        check_strata(["a"], ["a"], ["a"])
    rows = [(b.id, b.low, b.high, 0.0, 0.1) for b in BANDS]
    check_calibration(rows, Geometry())
    with pytest.raises(ValueError):
        check_calibration([(*rows[0][:4], 0.0), rows[1]], Geometry())
    with pytest.raises(ValueError):
        check_calibration(rows[:1], Geometry())


def test_band_edges_and_errors(spark):
    df = spark.createDataFrame([(249_999,), (250_000,), (499_999,), (500_000,), (999_999,), (1_000_000,)], "distance_bp int")
    assert [r[0] for r in df.select(scalars.distance_band()).collect()] == [None, "250-500", "250-500", "500-1000", "500-1000", None]
    with pytest.raises(Exception, match="no band holds"):
        df.select(scalars.strict_distance_band()).collect()
    chroms = spark.createDataFrame([("chr7",), ("chrX",)], "chrom string")
    assert chroms.limit(1).select(scalars.chromosome_fold("chrom", 5)).first()[0] == 1
    with pytest.raises(Exception, match="not an autosome"):
        chroms.select(scalars.chromosome_fold("chrom", 5)).collect()
    with pytest.raises(ValueError):
        scalars.chromosome_fold("chrom", 1)


def test_target_start_rounds_half_up(spark):
    df = spark.createDataFrame([(5_000, 1_005_000), (0, 1_000_000), (4_999, 1_004_999)], "input_start long, input_end long")
    assert [r[0] for r in df.select(scalars.aligned_target_start()).collect()] == [10_000, 0, 0]
    with pytest.raises(Exception, match="shorter"):
        spark.createDataFrame([(0, 999_999)], "input_start long, input_end long").select(scalars.aligned_target_start()).collect()


def test_intervals_and_windows(spark):
    df = spark.createDataFrame([("c", 0, 10), ("c", 5, 25), ("c", 30, 30)], "chrom string, start_bp long, end_bp long")
    got = {r.bin_start: r.intervals for r in intervals.interval_bins(df, 10).collect()}
    assert got == {0: 2, 10: 1, 20: 1}
    assert {r.bin_start for r in intervals.interval_bins(df, 10, force_one=True).collect()} == {0, 10, 20, 30}
    tiles = spark.createDataFrame([(0, 0, 5)], "tile_row int, input_start long, target_start long")
    with pytest.raises(Exception, match="not covered"):
        intervals.area_overlap_weights(tiles, 2, 4, 5, 2).collect()
    w = spark.createDataFrame([("c", 0, 9, 1), ("c", 0, 9, 2)], "chrom string, window_start long, window_end long, window_id long")
    with pytest.raises(Exception, match="no single manifest"):
        intervals.windows_for_tiles([w], w).collect()


def test_neighbours(spark):
    def place(rows):
        return spark.createDataFrame(rows, "chrom string, bin_i long, bin_j long, v int")

    a, b = place([("c", 0, 50, 1), ("c", 20, 70, 2), ("d", 0, 50, 4)]), place([("c", 10, 60, 7)])
    assert {r.v for r in neighbours.neighbour_match(a, b, ["chrom"], 1, 10).collect()} == {1, 2}
    assert neighbours.neighbour_match(a, b, ["chrom"], 0, 10).count() == 0
    assert {r.chrom + str(r.bin_i): r.neighbours for r in neighbours.neighbour_count(a, a, ["chrom"], 2, 10).collect()} == {"c0": 2, "c20": 2, "d0": 1}
    with pytest.raises(Exception, match="repeat"):
        neighbours.neighbour_count(a, a.union(a), ["chrom"], 1, 10).collect()


def test_pair_checks_find_faults(spark):
    df = spark.createDataFrame([("chr1", 0, 30, 0), ("chr1", 0, 30, 2), ("chr1", 9, 9, 2)], "chrom string, bin_i long, bin_j long, pair_id long")
    assert not any(r.passed for r in universe.pair_table_checks(df).collect())
    with pytest.raises(ValueError):
        contacts.coarsen_pixels(df, 10, 1.5)


def test_alignment_and_contexts_raise(spark):
    ids = spark.createDataFrame([(0,), (1,)], "pair_id long")
    part = spark.createDataFrame([(0, 1.0)], "pair_id long, s double")
    for parts in ([part], [part, part], [part, spark.createDataFrame([(1, float("nan"))], "pair_id long, s double")]):
        with pytest.raises(Exception, match="do not cover"):
            contexts.align_by_pair_id(parts, ids, "s").collect()
    c = spark.createDataFrame([("T", 0, 3)], "cell_type string, context_index int, n_cells long")
    with pytest.raises(Exception, match="absent"):
        contexts.select_contexts(c, ["X"]).collect()
    with pytest.raises(Exception, match="disagree"):
        contexts.contexts_with_centroids(c, c.withColumns({"n_cells": F.lit(4), "embedding": F.array(F.lit(1.0))})).collect()
    outs = spark.createDataFrame([(f"o{i}",) for i in range(7)], "output_id string")
    pairs = contexts.permuted_outputs(outs, 3).collect()
    assert len(pairs) == 7 and all(r.output_id != r.control_id for r in pairs) and len({r.control_id for r in pairs}) == 7


def test_rollout_order(spark):
    c = spark.createDataFrame([("a",), ("b",), ("z",)], "cell_type string")
    checks = spark.createDataFrame(
        [("P1", True, False, True, False), ("P2", True, True, True, True), ("P3", True, True, True, False), ("b", True, True, True, True)],
        "output_id string, power boolean, calibration boolean, concordance boolean, extension boolean")
    got = {r.output_id: r for r in contexts.rollout(c, [("P1", ["a"]), ("P2", ["a", "z"]), ("P3", ["a"])], checks, ["z"]).collect()}
    assert got["a"].topology_source == "P2" and got["a"].delta_source == "P2" and got["a"].claim_scope == "pooled"
    assert got["b"].topology_source == "b" and got["z"].topology_source == "shared"
    assert "P1" not in got and got["P3"].topology_source == "shared" and got["shared"].output_type == "shared"


def test_gates_fail_on_missing_values(spark):
    summary = spark.createDataFrame([("s", "near", 0.9, 12, 3.0)], "output_id string, distance_band string, k_weighted_evaluable_fraction double, chromosomes int, enrichment_over_chance double")
    boot = spark.createDataFrame([("s", "near", 0.1)], "output_id string, distance_band string, lower double")
    got = {(r.distance_band, r.check): r.passed for r in gates.power_gate(summary, boot, ["near", "far"]).collect()}
    assert all(v for (b, _), v in got.items() if b == "near") and not any(v for (b, _), v in got.items() if b == "far")
    cal = spark.createDataFrame([("s", "near", 0.1, 1.05, None)], "output_id string, distance_band string, gain_lower double, observed_predicted_ratio double, calibration_slope double")
    assert {r.check: r.passed for r in gates.calibration_gate(cal).collect()} == {"deviance": True, "total_ratio": True, "slope": False}


def test_block_sums_across_block_edges(spark):
    draw = np.random.default_rng(5)
    edge = 10 * neighbours.BLOCK
    spots = sorted({(int(a), int(b)) for a, b in zip(draw.integers(edge // 10 - 6, edge // 10 + 6, 90) * 10, draw.integers(2 * edge // 10 - 6, 2 * edge // 10 + 6, 90) * 10)})
    rows = [(c, i, j, None if n % 7 == 0 else float(n)) for c in "ab" for n, (i, j) in enumerate(spots) if c == "a" or n % 2]
    df = spark.createDataFrame(rows, "chrom string, bin_i long, bin_j long, v double")
    for tolerance in (1, 3):
        got = {(r.chrom, r.bin_i, r.bin_j): (r.v, r.neighbour_sum) for r in neighbours.neighbour_sum(df, "v", 10, tolerance).collect()}
        assert len(got) == len(rows)
        for chrom, i, j, v in rows:
            near = [w for c, a, b, w in rows if c == chrom and abs(a - i) <= 10 * tolerance and abs(b - j) <= 10 * tolerance and w is not None]
            assert got[chrom, i, j] == (v, sum(near) if near else None)
    plan = neighbours.neighbour_sum(df, "v", 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # one for either side, none between the passes


def test_adaptive_smooth_against_plain_python(spark):
    draw = np.random.default_rng(6)
    side = 37
    rows = [(t, i, j, int(draw.poisson(0.3)), float(draw.random())) for t in (0, 1) for i in range(side) for j in range(side) if draw.random() < 0.8]
    df = spark.createDataFrame(rows, "tile_row int, i long, j long, count long, observed double")
    got = {(r.tile_row, r.i, r.j): (r.level, r.value) for r in maps.adaptive_smooth(df, side, cutoff=3.0).collect()}
    for t, i, j, *_ in rows:
        for level in range(4):  # 37, 19, 10 and 5 blocks wide
            block = [r for r in rows if r[0] == t and r[1] >> level == i >> level and r[2] >> level == j >> level]
            if sum(r[3] for r in block) >= 3:
                break
        value = sum(r[4] for r in block) / len(block)
        assert got[t, i, j][0] == level and abs(got[t, i, j][1] - value) < 1e-9
    plan = maps.adaptive_smooth(df, side)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_conservation_checks_find_every_fault(spark):
    """A whole set passes; a broken one fails just the checks that its fault concerns."""
    kinds = {
        "pairs": "pair_id long, chrom string, bin_i long, bin_j long, distance_bp long, tile_row int, split string", "tiles": "tile_row int, split string",
        "sums": "context_index int, pair_id long, full_count long, a_by_split array<long>", "records": "context_index int, n long",
        "offsets": "distance_bin long, distance_offset double", "weights": "tile_row int, bin int, native int, weight double"}
    good = {
        "pairs": [(0, "c", 0, 20, 20, 0, "train"), (1, "c", 0, 30, 30, 0, "train"), (2, "d", 0, 20, 20, 1, "test")], "tiles": [(0, "train"), (1, "test")],
        "sums": [(0, 0, 3, [1, 3]), (1, 2, 2, [0, 1])], "records": [(0, 3), (1, 1), (1, 1)],
        "offsets": [(2, -1.0), (3, -1.5)], "weights": [(t, b, n, 0.5) for t in (0, 1) for b in (0, 1) for n in (0, 1)]}

    def failed(**broken):
        made = {k: spark.createDataFrame(broken.get(k, rows), kinds[k]) for k, rows in good.items()}
        checks = gates.conservation_checks(**made, splits=2, bin_size=10, low=20, high=40, bins=2, overlaps=2).collect()
        assert len(checks) == 14
        return {r.check for r in checks if not r.passed}

    pairs, sums, weights = good["pairs"], good["sums"], good["weights"]
    assert failed() == set()
    assert failed(pairs=[*pairs, (2, "d", 50, 90, 40, 1, "test")], sums=[*sums, (1, 9, 0, [0])], offsets=[(2, -1.0), (3, -0.5)], weights=weights[1:]) == {
        "maximum_represented_distance", "ids_contiguous", "ids_unique", "sums_in_universe", "every_split_counted", "curve_decreases", "feature_weights_whole"}
    assert failed(pairs=[*pairs[:2], (2, "c", 0, 30, 30, 1, "test")], sums=[(0, 0, 3, [1, 4]), (1, 2, 2, [0, 1])], records=[(0, 3), (1, 1)],
                  offsets=[(2, -1.0)], weights=[*weights, (0, 1, 2, 0.0)]) == {
        "anchors_in_one_split", "all_halves_recombine", "records_conserved", "curve_covers_range", "feature_overlap_width"}
    assert failed(tiles=[(0, "train"), (1, "train")], records=[(0, 3), (1, 2), (2, 1)], weights=[r for r in weights if r[:2] != (1, 1)]) == {
        "tile_splits_kept", "records_conserved", "feature_bins_per_tile"}


def test_routing_counts_what_it_writes(spark, tmp_path):
    rows = [("a", i) for i in range(50)] + [("b", i) for i in range(3)]
    df = spark.createDataFrame(rows, "cell_type string, v long").repartition(5)
    tables.write_routed(df, str(tmp_path / "whole"), declared={"a": 50, "b": 3})
    assert tables.read_routed(spark, str(tmp_path / "whole"), "a").count() == 50
    assert tables.read_routed(spark, str(tmp_path / "whole")).count() == 53
    with pytest.raises(ValueError, match="'b': 2"):
        tables.write_routed(df.filter("not (cell_type = 'b' and v = 1)"), str(tmp_path / "lost"), declared={"a": 50, "b": 3})
    with pytest.raises(ValueError, match="54 records"):
        tables.write_routed(df.union(spark.createDataFrame([(None, 1)], df.schema)), str(tmp_path / "untyped"), declared={"a": 50, "b": 3})
