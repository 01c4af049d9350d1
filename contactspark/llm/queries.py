"""The corpus queries: each runs one operator over its whole table.  DuckDB texts stand beside those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactspark.llm import (
    decontaminate, html_text, language_id, line_dedup, lm_scoring, packing, personal_data, prefix_trie, quality_classifier, quality_rules, simhash, spelling,
    token_counts,
)
from contactspark.llm.common import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(make):
        QUERIES[name] = make
        if sql:
            ORACLES[name] = sql
        return make
    return register


# Each page's lines once, by host; a line that exceeds a tenth of the host's distinct pages goes, unless nothing else is left.
LINE_SQL = r"""
with d as (select doc_id, source, text, row_number() over () as r from documents),
l as (select r, source, text, trim(u.x, E' \t\n\x0b\f\r') as line, u.i from d, unnest(string_split(text, chr(10))) with ordinality u(x, i)),
n as (select source, line, count(distinct text) as n from l where line <> '' group by all),
p as (select source, count(distinct text) as pages from d where text is not null group by all),
b as (select n.source, line from n join p on n.source is not distinct from p.source where n >= 5 and n > 0.1 * pages),
s as (select l.r, count(*) filter (l.line <> '') as n_lines, count(*) filter (b.line is not null) as gone
  from l left join b on l.source is not distinct from b.source and l.line = b.line group by all),
k as (select l.r, string_agg(u.x, chr(10) order by u.i) as left_text from (select r, text, source from d) l, unnest(string_split(l.text, chr(10))) with ordinality u(x, i)
  where not exists (select 1 from b where b.source is not distinct from l.source and b.line = trim(u.x, E' \t\n\x0b\f\r')) group by all)
select d.doc_id, coalesce(s.n_lines, 0) as n_lines, case when s.gone > 0 and s.gone < s.n_lines then s.gone else 0 end as n_dropped,
  case when s.gone > 0 and s.gone < s.n_lines then k.left_text else d.text end as text
from d left join s using (r) left join k using (r)"""


@query("op1_line_dedup", LINE_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines that are boilerplate on their site (``source``)."""
    out = line_dedup.drop_boilerplate(table(spark, folder, "documents"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), "text")


@query("op2_lm_scoring")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-entropy difference of every document; the target is what ``labels`` calls good."""
    good = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.scored(table(spark, folder, "documents"), good)


@query("op3_decontaminate")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, one row per document and item."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


@query("op4_quality_classifier")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.counted(table(spark, folder, "documents"))


@query("op6_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


RULES_SQL = r"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select r, doc_id, lang, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select r, i, md5(array_to_string(w[i:i+7], ' ')) as g from w, unnest(range(1, len(w) - 6)) u(i)),
a as (select r, i, lead(i) over (partition by r order by i) as nx from (select r, i, count(*) over (partition by r, g) as c from g) where c > 1),
c as (select r, cast(sum(least(8, coalesce(nx - i, 8))) as bigint) as n_repeat_words from a group by r),
s as (select r, doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(l) as n_lines
  from w left join c using (r)),
t as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  case when n_words > 0 then 1000 * n_symbols // n_words else 0 end as m1, case when n_words > 0 then 1000 * word_chars // n_words else 0 end as m2,
  case when n_lines > 0 then 1000 * n_dup_lines // n_lines else 0 end as m3, case when n_words > 0 then 1000 * n_repeat_words // n_words else 0 end as m4 from s),
m as (select lang, source, u.m, u.v - u.v % cast(pow(2, greatest(length(bin(cast(u.v as bigint))) - 6, 0)) as bigint) as b from t,
  unnest([{'m': 1, 'v': m1}, {'m': 2, 'v': m2}, {'m': 3, 'v': m3}, {'m': 4, 'v': m4}]) x(u) where not base_failed),
k as (select lang, source, m, b, count(*) as n from m group by all),
q as (select lang, source, m, min(b) filter (4 * upto >= total) as q1, min(b) filter (4 * upto >= 3 * total) as q3, max(total) as docs from (
  select *, sum(n) over (partition by lang, source, m order by b) as upto, sum(n) over (partition by lang, source, m) as total from k) group by all),
ql as (select lang, m, min(b) filter (4 * upto >= total) as q1, min(b) filter (4 * upto >= 3 * total) as q3 from (
  select *, sum(n) over (partition by lang, m order by b) as upto, sum(n) over (partition by lang, m) as total
  from (select lang, m, b, sum(n) as n from k group by all)) group by all),
f as (select q.lang, q.source, q.m,
  (docs * (q.q1 - 3 * (q.q3 - q.q1) - z) + 20 * (ql.q1 - 3 * (ql.q3 - ql.q1) - z)) / cast(docs + 20 as double) as low,
  (docs * (q.q3 + 3 * (q.q3 - q.q1) + z) + 20 * (ql.q3 + 3 * (ql.q3 - ql.q1) + z)) / cast(docs + 20 as double) as high
  from q join ql on q.lang is not distinct from ql.lang and q.m = ql.m join (values (1, 100), (2, 1500), (3, 300), (4, 150)) v(m, z) on q.m = v.m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not exists (select 1 from f where f.lang is not distinct from t.lang and f.source is not distinct from t.source and (
    f.m = 1 and m1 > high or f.m = 2 and (m2 > high or m2 < low) or f.m = 3 and m3 > high or f.m = 4 and m4 > high)) as kept
from t"""


@query("op7_quality_rules", RULES_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_simhash")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.groups(stored(simhash.with_fingerprints(table(spark, folder, "documents"))))
    return found.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op9_html_text")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(table(spark, folder, "pages"))


@query("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.predicted(table(spark, folder, "documents"))


@query("op11_prefix_trie")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations"))


@query("op12_spelling")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


@query("op13_personal_data")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The counts and the digest are those of the fixed patterns; ``spans`` also has what the model adds."""
    found = personal_data.with_spans(table(spark, folder, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == kind)).cast("long").alias(f"n_{personal_data.KINDS[kind]}")

    counts = map(count, range(len(personal_data.KINDS)))
    return found.select("doc_id", *counts, F.sha2(personal_data.listed(F.col("base")), 256).alias("base_sha256"), personal_data.listed(F.concat("base", "added")).alias("spans"))
