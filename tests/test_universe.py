"""The pair table from rows of left bins, against its steps one by one and against a plain enumeration."""

from contactspark.operators import universe as U
from contactspark.settings import Band, Geometry

SCHEMA = "tile_row long, tile_id string, chrom string, target_start long, target_end long, split string"
GEOMETRY = Geometry(10, (Band("near", 20, 50), Band("far", 50, 90)))
TILES = [
    (7, "t7", "chr2", 0, 100, "train"), (3, "t3", "chr2", 50, 150, "train"), (5, "t5", "chr2", 70, 170, "test"),
    (1, "t1", "chr10", 400, 500, "test"), (2, "t2", "chr10", 400, 500, "test"), (4, "t4", "chr1", 1000, 1100, "validation"),
]


def plain():
    """Chosen tile of every pair that is left, in order."""
    best = {}
    for row, name, chrom, start, _, split in TILES:
        for i in range(10):
            for j in range(i + 2, min(i + 9, 10)):
                rank = (-min(i, 9 - j), name)
                key = (chrom, start + 10 * i, start + 10 * j)
                if key not in best or rank < best[key][0]:
                    best[key] = (rank, row, split)
    splits = {}
    for (chrom, i, j), (_, _, split) in best.items():
        for b in (i, j):
            splits.setdefault((chrom, b), set()).add(split)
    kept = {k: v for k, v in best.items() if all(len(splits[k[0], b]) == 1 for b in k[1:])}
    order = sorted(kept, key=lambda k: (int(k[0][3:]), *k[1:]))
    return [(n, *k, kept[k][1], -kept[k][0][0]) for n, k in enumerate(order)], len(best)


def test_universe_equals_plain_enumeration(spark):
    tiles = spark.createDataFrame(TILES, SCHEMA)
    rows, canonical = plain()
    assert U.canonical_pairs(tiles, GEOMETRY, 100).count() == canonical > len(rows)
    got = U.build_universe(tiles, GEOMETRY, 100)
    assert [tuple(r) for r in got.select("pair_id", "chrom", "bin_i", "bin_j", "tile_row", "boundary_margin_bins").orderBy("pair_id").collect()] == rows
    stepwise = U.assign_pair_id(U.purge_cross_split(U.canonical_pairs(tiles, GEOMETRY, 100)))
    assert sorted(map(tuple, got.drop("distance_band").select(*stepwise.columns).collect())) == sorted(map(tuple, stepwise.collect()))


def test_no_pair_is_shuffled(spark):
    """The last step explodes rows of left bins; nothing behind it is an exchange."""
    df = U.build_universe(spark.createDataFrame(TILES, SCHEMA), GEOMETRY, 100)
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    explode = next(n for n, line in enumerate(lines) if "Generate posexplode" in line)
    assert not any("Exchange" in line for line in lines[:explode])
