"""Adapter views: the test tables read as contact data.

Each text is valid in both Spark and DuckDB once ``{S}`` is replaced by the
engine's text type; ``{name}`` stands for a table or another view.  The genome
grows with the data: one tile per supplier, ten chromosomes, a tile every
500 kb, about 600 contacts per tile at every scale factor.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "raw_contacts": """
select l_orderkey * 10 + l_linenumber as read_id,
  'DNA' || lpad(cast(1 + o_custkey % 4 as {S}), 2, '0') as library_id,
  cast(o_custkey as {S}) as dna_barcode,
  'chr' || cast(1 + l_suppkey % 10 as {S}) as chrom1,
  case when l_returnflag = 'R' then p + sep else p end as pos1,
  'chr' || cast(1 + (case when l_linenumber = 7 then l_suppkey + 1 else l_suppkey end) % 10 as {S}) as chrom2,
  case when l_returnflag = 'R' then p else p + sep end as pos2,
  l_tax * 10 as call_probability, l_quantity as q
from (
  select l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_tax, l_quantity, o_custkey,
    cast((l_suppkey - l_suppkey % 10) / 10 as bigint) * 500000
      + case when l_linenumber <= 2 then (l_partkey % 8) * 70000 + l_orderkey % 9000
             else (l_partkey * 7919 + l_orderkey * 13) % 600000 end as p,
    case when l_linenumber <= 2 then 260000 + (l_partkey % 7) * 60000
         else 200000 + ((l_orderkey * 7919 + l_linenumber * 104729) % 1000)
                     * ((l_orderkey * 7919 + l_linenumber * 104729) % 1000) end as sep
  from {lineitem} join {orders} on l_orderkey = o_orderkey) x""",
    "membership": """
select library_id, dna_barcode, library_id || '_' || dna_barcode as cell_id, c_mktsegment as cell_type,
  case c_mktsegment when 'AUTOMOBILE' then 0 when 'BUILDING' then 1 when 'FURNITURE' then 2
    when 'HOUSEHOLD' then 3 else 4 end as context_index,
  count(*) as valid_pairs
from {raw_contacts} join {customer} on dna_barcode = cast(c_custkey as {S})
where c_custkey % 10 <> 0
group by library_id, dna_barcode, c_mktsegment""",
    "contexts": """
select cell_type, context_index, count(*) as n_cells, cast(sum(valid_pairs) as bigint) as valid_pairs
from {membership} group by cell_type, context_index""",
    "tiles": """
select s_suppkey as tile_row, 't' || lpad(cast(s_suppkey as {S}), 6, '0') as tile_id,
  'chr' || cast(1 + s_suppkey % 10 as {S}) as chrom,
  cast((s_suppkey - s_suppkey % 10) / 10 as bigint) * 500000 as target_start,
  cast((s_suppkey - s_suppkey % 10) / 10 as bigint) * 500000 + 1000000 as target_end,
  case when s_suppkey % 10 < 6 then 'train'
       when s_suppkey % 10 = 6 then case when (s_suppkey - s_suppkey % 10) % 100 < 50 then 'train' else 'validation' end
       when s_suppkey % 10 = 7 then 'validation'
       when s_suppkey % 10 = 8 then case when (s_suppkey - s_suppkey % 10) % 100 < 50 then 'validation' else 'test' end
       else 'test' end as split
from {supplier}""",
    "source_tiles": """
select s_suppkey as tile_row, 't' || lpad(cast(s_suppkey as {S}), 6, '0') as tile_id,
  'chr' || cast(1 + s_suppkey % 10 as {S}) as chrom,
  cast((s_suppkey - s_suppkey % 10) / 10 as bigint) * 500000 + 1000 * (s_suppkey % 7) as input_start,
  cast((s_suppkey - s_suppkey % 10) / 10 as bigint) * 500000 + 1000 * (s_suppkey % 7) + 1048576 as input_end,
  cast((s_suppkey - s_suppkey % 10) / 10 as bigint) * 500000 + 1000 * (s_suppkey % 7) + 24288 as target_start,
  cast((s_suppkey - s_suppkey % 10) / 10 as bigint) * 500000 + 1000 * (s_suppkey % 7) + 1024288 as target_end,
  case when s_suppkey % 10 < 7 then 'train' when s_suppkey % 10 < 9 then 'validation' else 'test' end as split
from {supplier}""",
    "intervals": """
select 'chr' || cast(1 + p_partkey % 10 as {S}) as chrom,
  cast((p_partkey - p_partkey % 10) / 10 as bigint) * 25000 + p_size * 400 as start_bp,
  cast((p_partkey - p_partkey % 10) / 10 as bigint) * 25000 + p_size * 900 + 200 as end_bp,
  case p_size % 3 when 0 then 'dELS' when 1 then 'pELS' else 'other' end as label,
  case when p_partkey % 4 < 2 then '-' else '+' end as strand, p_size % 5 = 0 as is_gene
from {part}""",
    "bedgraph": """
select 'chr' || cast(1 + o_orderkey % 10 as {S}) as chrom,
  cast((o_orderkey - o_orderkey % 10) / 10 as bigint) * 4000 as start_bp,
  cast((o_orderkey - o_orderkey % 10) / 10 as bigint) * 4000 + 3000 as end_bp,
  case when ((o_orderkey - o_orderkey % 10) / 10) % 40 < 8 then cast(0 as double)
       else (o_orderkey * 53 % 100) / cast(100 as double) end as value
from {orders}""",
    "seqbins": """
select 'chr' || cast(1 + doc_id % 10 as {S}) as chrom,
  cast((doc_id - doc_id % 10) / 10 as bigint) * 10000 as bin_start, text as seq
from {documents}""",
    "rna_long": """
select 'rna' || lpad(cast(1 + user_id % 4 as {S}), 2, '0') || '_' || cast(user_id as {S}) as barcode,
  'ct' || cast(user_id % 5 as {S}) as cell_type, event_type as gene, count(*) as n
from {events} group by user_id, event_type""",
    "pools": """
select * from (values ('P1', 'AUTOMOBILE'), ('P1', 'BUILDING'), ('P2', 'FURNITURE'), ('P2', 'HOUSEHOLD'),
  ('P2', 'MACHINERY'), ('P3', 'BUILDING'), ('P3', 'FURNITURE')) v(output_id, member)""",
}


def references(text: str) -> list[str]:
    """Names of the tables and views a text reads, in order of appearance."""
    return list(dict.fromkeys(n for n in re.findall(r"\{(\w+)\}", text) if n != "S"))


class Tables:
    """Raw tables and adapter views of one data folder, each built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            make = lambda: self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        elif name in VIEWS:
            text = VIEWS[name].replace("{S}", "string")
            make = lambda: self.spark.sql(text, **{n: getattr(self, n) for n in references(text)})
        else:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]
