"""Registry of queries over the test tables, each with its DuckDB text where one exists."""

from __future__ import annotations

import json
from functools import cached_property, partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactspark.fixtures import TABLES, VIEWS, Tables, references
from contactspark.operators import contacts as C
from contactspark.operators import evidence as E
from contactspark.operators import universe as U
from contactspark.operators.ordered import measured_broadcasts, written
from contactspark.settings import BIN_SIZE, Geometry

QUERIES: dict = {}
TEXTS: dict[str, str] = {}
STORED: dict[tuple[str, str], DataFrame] = {}
# DuckDB texts of intermediate tables, written apart from the Spark code
STEPS: dict[str, str] = {}

CONTEXTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
OUTPUTS = [("shared", "shared"), *[(c, "context") for c in CONTEXTS], ("P1", "pool"), ("P2", "pool"), ("P3", "pool")]
SPLITS = 20
HALVES_SEED = 20260724
REPLICATES = 1000  # of every bootstrap


class Inputs(Tables):
    """Adapter views plus the tables the library derives from them; joins broadcast by measured size, whoever asks for a table."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder)
        measured_broadcasts(spark)

    @cached_property
    def membership(self) -> DataFrame:
        """The cell table, summed from all records; stored once, as halves, masks, contexts and depths all read it."""
        key = (self.spark.sparkContext.applicationId, self.folder + "#membership")
        if key not in STORED:
            STORED[key] = written(self.__getattr__("membership"))
        return STORED[key]

    @cached_property
    def universe(self) -> DataFrame:
        """The pair table, stored once per session and data folder, as a pipeline would store it."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in STORED:
            STORED[key] = written(U.pairs_of(self.universe_rows, Geometry()))
        return STORED[key]

    @cached_property
    def universe_rows(self) -> DataFrame:
        """The pair table folded to its left bins, stored likewise."""
        key = (self.spark.sparkContext.applicationId, self.folder + "#rows")
        if key not in STORED:
            STORED[key] = written(U.universe_rows(self.tiles, Geometry()))
        return STORED[key]

    @cached_property
    def assignments(self) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder + "#halves")
        if key not in STORED:
            STORED[key] = written(E.balanced_halves(self.membership, SPLITS, HALVES_SEED))
        return STORED[key].select("context_index", "cell_type", "cell_id", "library_id", "dna_barcode", "split", "half")

    @cached_property
    def binned(self) -> DataFrame:
        return C.binned_contacts(self.raw_contacts, BIN_SIZE)

    @cached_property
    def records(self) -> DataFrame:
        hits, _ = C.restrict_to_universe(self.binned, self.universe)
        return C.assign_context(hits, self.membership)

    @cached_property
    def counts(self) -> DataFrame:
        return E.counts_of(self.sums)

    @cached_property
    def sums(self) -> DataFrame:
        """Counts per context and pair with the halves of every split, from raw records; stored once like the pair table."""
        key = (self.spark.sparkContext.applicationId, self.folder + "#sums")
        if key not in STORED:
            cells = E.cell_masks(self.membership, self.assignments, SPLITS)
            STORED[key] = written(E.pair_sums(self.raw_contacts, cells, self.universe, SPLITS, bin_size=BIN_SIZE, low=250_000, high=1_000_000))
        return STORED[key]

    @cached_property
    def outputs(self) -> DataFrame:
        return E.output_members(self.contexts, self.pools)

    @cached_property
    def counted(self) -> DataFrame:
        """The pair table with the shared counts, stored likewise; both meet by left bin, before pairs are made, so no pair moves."""
        key = (self.spark.sparkContext.applicationId, self.folder + "#counted")
        if key not in STORED:
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            rows = self.universe_rows.repartition(parts, "chrom", "bin_i").join(E.counts_by_left_bin(self.sums), ["chrom", "bin_i"], "left")
            pairs = U.pairs_of(rows, Geometry(), 1_000_000, "counts").withColumn("_c", F.try_element_at("counts", F.col("distance_bin")))
            counts = [F.coalesce(F.col(f"_c.{c}"), F.lit(0).cast("long")).alias(c) for c in ("full_count", "counts_a", "counts_b")]
            STORED[key] = written(pairs.select("pair_id", *[c for c in self.universe.columns if c != "pair_id"], *counts))
        return STORED[key]

    @cached_property
    def scored(self) -> DataFrame:
        """Universe with a simple exposure, two scores full of ties, and the shared counts."""
        i, j = (F.col("bin_i") / BIN_SIZE).cast("long"), (F.col("bin_j") / BIN_SIZE).cast("long")
        return self.counted.withColumns({
            "exposure": (F.lit(1) + (i + 3 * j) % 7).cast("double"),
            "score": ((i * 37 + j * 101) % 211) / F.lit(211.0),
            "score2": ((i * 53 + j * 29) % 97) / F.lit(97.0),
            "distance_offset": -F.log(F.col("distance_bin").cast("double")),
        })


# uniform number of a seeded draw, as ``functions.draws`` makes it
DRAWN = "cast('0x' || substr(md5({text}), 1, 13) as bigint) / 4503599627370496.0"


def drawn(seed: int, *keys: str) -> str:
    """DuckDB text of ``functions.draws.uniform`` over the named columns."""
    return DRAWN.replace("{text}", f"'{seed}|' || " + " || '|' || ".join(keys))


STEPS["assignments"] = f"""
with n as (select context_index, library_id, (count(*) + 1) // 2 as pairs from {{membership}} group by all),
f as (select *, cast(coalesce(sum(pairs) over (partition by context_index order by library_id rows between unbounded preceding and 1 preceding), 0) as bigint) as first from n),
p as (select m.*, row_number() over (partition by context_index, library_id order by valid_pairs desc, cell_id) as place from {{membership}} m),
u as (select p.*, first + (place - 1) // 2 as pair, s.split from p join f using (context_index, library_id), range(0, {SPLITS}) s(split))
select context_index, cell_type, cell_id, library_id, dna_barcode, cast(split as int) as split,
  case when ((place % 2 = 0) <> (pair % 2 = 1)) <> ({DRAWN.replace("{text}", f"'{HALVES_SEED}|' || split || '|' || context_index || '|' || pair // 2")} < 0.5) then 'B' else 'A' end as half
from u"""
STEPS["tile_pairs"] = """
select chrom, target_start + o * 10000 as bin_i, target_start + (o + d) * 10000 as bin_j, d * 10000 as distance_bp, d as distance_bin,
  tile_row, tile_id, split, least(o, 99 - o - d) as boundary_margin_bins
from {tiles}, (select range as d from range(25, 100)), (select range as o from range(0, 75)) where o + d < 100"""
STEPS["canonical"] = """
select * from {tile_pairs} qualify row_number() over (partition by chrom, bin_i, bin_j order by boundary_margin_bins desc, tile_id) = 1"""
STEPS["conflicts"] = """
select chrom, bin from (select chrom, bin_i as bin, split from {canonical} union all select chrom, bin_j, split from {canonical})
group by chrom, bin having count(distinct split) > 1"""
STEPS["universe"] = """
select *, row_number() over (order by cast(substr(chrom, 4) as int), bin_i, bin_j) - 1 as pair_id,
  case when distance_bp < 500000 then '250-500' else '500-1000' end as distance_band
from {canonical} p
where not exists (select 1 from {conflicts} c where c.chrom = p.chrom and c.bin in (p.bin_i, p.bin_j))"""
STEPS["anchored"] = """
select * exclude (chrom1, chrom2, b1, b2, turned), case when turned then chrom2 else chrom1 end as chrom1, case when turned then chrom1 else chrom2 end as chrom2,
  case when turned then b2 else b1 end as bin_i, case when turned then b1 else b2 end as bin_j
from (select *, pos1 - pos1 % 10000 as b1, pos2 - pos2 % 10000 as b2, chrom1 > chrom2 or chrom1 = chrom2 and pos1 - pos1 % 10000 > pos2 - pos2 % 10000 as turned from {raw_contacts})"""
STEPS["records"] = """
select m.context_index, m.cell_type, a.library_id, a.dna_barcode, u.pair_id
from {anchored} a join {membership} m using (library_id, dna_barcode)
join {universe} u on a.chrom1 = u.chrom and a.bin_i = u.bin_i and a.bin_j = u.bin_j where a.chrom1 = a.chrom2"""
STEPS["split_counts"] = """
select r.context_index, r.pair_id, s.split, count(*) filter (s.half = 'A') as counts_a, count(*) filter (s.half = 'B') as counts_b
from {records} r join {assignments} s using (library_id, dna_barcode) group by all"""
STEPS["counts"] = """
select context_index, pair_id, max(counts_a + counts_b) as full_count, max(counts_a) filter (split = 0) as counts_a,
  max(counts_b) filter (split = 0) as counts_b, count(*) filter (counts_a > 0 and counts_b > 0) as reproduced_splits
from {split_counts} group by all"""
STEPS["outputs"] = """
select 'shared' as output_id, 'shared' as output_type, context_index, cell_type from {contexts}
union all select cell_type, 'context', context_index, cell_type from {contexts}
union all select output_id, 'pool', context_index, cell_type from {pools} join {contexts} on member = cell_type"""
STEPS["scored"] = """
select u.*, coalesce(full_count, 0) as full_count, coalesce(counts_a, 0) as counts_a, coalesce(counts_b, 0) as counts_b,
  cast(1 + (cast(bin_i / 10000 as bigint) + 3 * cast(bin_j / 10000 as bigint)) % 7 as double) as exposure,
  ((cast(bin_i / 10000 as bigint) * 37 + cast(bin_j / 10000 as bigint) * 101) % 211) / cast(211 as double) as score,
  ((cast(bin_i / 10000 as bigint) * 53 + cast(bin_j / 10000 as bigint) * 29) % 97) / cast(97 as double) as score2,
  -ln(distance_bin) as distance_offset
from {universe} u left join (select pair_id, cast(sum(full_count) as bigint) as full_count, cast(sum(counts_a) as bigint) as counts_a,
  cast(sum(counts_b) as bigint) as counts_b from {counts} group by all) c using (pair_id)"""


def duckdb_text(body: str) -> str:
    """The text with every step and view it needs as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in references(text):
            if name in TABLES or name in order:
                continue
            inner = STEPS.get(name) or VIEWS[name]
            need(inner)
            if name not in order:
                order.append(name)

    def plain(text: str) -> str:
        text = text.replace("{S}", "varchar")
        for name in references(text):
            text = text.replace("{" + name + "}", name)
        return text.strip()

    need(body)
    if not order:
        return plain(body)
    parts = ",\n".join(f"{n} as materialized ({plain(STEPS.get(n) or VIEWS[n])})" for n in order)
    return f"with {parts}\nselect * from ({plain(body)}) body"


# column types of each text's result, found by ``python -m workloads.column_types``
_TYPES = Path(__file__).with_name("column_types.json")
COLUMN_TYPES: dict[str, dict[str, str]] = json.loads(_TYPES.read_text()) if _TYPES.exists() else {}
# moves exact halves of the last place off the rounding edge, the same way in both engines
_OFF_EDGE = 3.1e-8


def compared(name: str, text: str) -> str:
    """The text with doubles rounded and whole numbers as bigint, as ``rounded`` does in Spark."""
    changes = []
    for column, kind in COLUMN_TYPES.get(name, {}).items():
        if kind in ("DOUBLE", "FLOAT"):
            changes.append(f'round(cast("{column}" as double) + {_OFF_EDGE}, 6) + 0 as "{column}"')
        elif kind in ("INTEGER", "SMALLINT", "TINYINT", "HUGEINT"):
            changes.append(f'cast("{column}" as bigint) as "{column}"')
    return f"select * replace ({', '.join(changes)}) from ({text}) q" if changes else text


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as bigint: what the two engines are compared on."""
    out = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        column = F.col(f"`{field.name}`")
        if kind in ("double", "float"):
            # adding 0.0 turns -0.0 into 0.0
            column = F.round(column.cast("double") + F.lit(_OFF_EDGE), places) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            column = column.cast("long")
        out.append(column.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB text over tables, views and steps."""

    def register(make):
        QUERIES[name] = partial(_run, make)
        if sql is not None:
            TEXTS[name] = sql
        return make

    return register


def _run(make, spark: SparkSession, folder: str) -> DataFrame:
    return rounded(make(Inputs(spark, folder)))


def oracle() -> dict[str, str]:
    """Every text as DuckDB runs it, with comparable column types."""
    return {name: compared(name, duckdb_text(text)) for name, text in TEXTS.items()}
