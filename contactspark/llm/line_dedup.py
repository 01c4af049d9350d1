"""Boilerplate lines by their frequency within a site.

For each host, the share of its pages that contain a line is compared with a ratio; lines above it are dropped
from that host's pages.  Exact copies of a page count as one page, so that a group of copies is not
taken for a template.  A page that consists of such lines alone is left whole: what surrounds no
content is the content, and copies are the business of near-duplicate removal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactspark.llm.common import SPACES, columns_of, let, small_side, stored, unused

RATIO = 0.1  # of a host's distinct pages
MIN_PAGES = 5  # a line on fewer pages of a host is no boilerplate, however small the host


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(SPACES))


def _key(line: Column) -> Column:
    """128 bits for a line without its outer white space."""
    return F.struct(F.xxhash64(_bare(line)).alias("a"), F.xxhash64(F.lit("line"), _bare(line)).alias("b"))


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per host that has boilerplate: ``host, keys`` (hashes of its lines).

    Each line of ``keys`` is on more than ``ratio`` of the pages, so a host has at most its mean number of
    lines a page divided by ``ratio``, whatever its size.  A null host is a host of its own.
    """
    read = columns_of(docs, source="string", text="string").where(F.col("text").isNotNull()).select("source", "text", F.xxhash64("text").alias("page"))
    pages = read.groupBy("source").agg(F.count_distinct("page").alias("pages")).withColumnRenamed("source", "of")
    own = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.length(_bare(x)) > 0), _key))
    lines = read.select("source", "page", F.explode(own).alias("key")).groupBy("source", "key").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= min_pages)
    return lines.join(pages, F.col("source").eqNullSafe(F.col("of"))).where(F.col("n") > ratio * F.col("pages")).groupBy(
        F.col("source").alias("host")).agg(F.collect_set("key").alias("keys"))


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with ``text`` rid of boilerplate lines and ``n_chars``, where there is one, counted anew; all rows stay.

    Two columns come last: lines that are not blank, and those dropped (``__lines`` and ``__dropped``, or the like if those are taken).  A null text stays null, an empty one empty;
    other lines, blank ones included, keep their order.
    """
    host, keys, split_lines, gone, n_lines = unused(docs, "__host", "__keys", "__split", "__dropped", "__lines")
    found = stored(boilerplate(docs, ratio, min_pages).select(F.col("host").alias(host), F.col("keys").alias(keys)))
    near = small_side(found, 24 * F.size(keys) + 64)
    have = set(docs.columns)
    text = (F.col("text") if "text" in have else F.lit(None)).cast("string")
    source = (F.col("source") if "source" in have else F.lit(None)).cast("string")

    def of(lines: Column) -> Column:
        blank = F.filter(lines, lambda x: F.length(_bare(x)) > 0)
        left = F.filter(lines, lambda x: (F.length(_bare(x)) == 0) | ~F.array_contains(keys, _key(x)))
        return let(F.struct(F.size(blank).alias("n"), left.alias("left")), lambda s: F.struct(
            s["n"].cast("long").alias("lines"), (F.size(lines) - F.size(s["left"])).cast("long").alias("gone"), s["left"].alias("left")))

    split = let(F.split(text, "\n"), of)
    marked = docs.join(near, source.eqNullSafe(F.col(host)), "left").withColumn(split_lines, F.when(
        F.col(keys).isNotNull(), split).otherwise(let(F.split(text, "\n"), lambda x: F.struct(
            F.size(F.filter(x, lambda y: F.length(_bare(y)) > 0)).cast("long").alias("lines"), F.lit(0).cast("long").alias("gone"), x.alias("left")))))
    some = (F.col(f"{split_lines}.gone") > 0) & (F.col(f"{split_lines}.gone") < F.col(f"{split_lines}.lines"))
    out = marked.withColumn(gone, F.when(some, F.col(f"{split_lines}.gone")).otherwise(F.lit(0)).cast("long")).withColumn(
        n_lines, F.when(text.isNull(), F.lit(0)).otherwise(F.col(f"{split_lines}.lines")).cast("long")).withColumn(
        "text", F.when(some, F.array_join(f"{split_lines}.left", "\n")).otherwise(text))
    if "n_chars" in have:
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns, n_lines, gone)
