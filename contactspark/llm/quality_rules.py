"""Quality rules with thresholds learned from the corpus: one quantile sketch per language, source and measure.

The sketch is a histogram over buckets that keep six significant binary digits of a
per-mille measure, so its error is at most one part in 32.  Two sketches merge by adding
counts: partial aggregation merges them before the shuffle, and sketches of the sources
of a language merge to the sketch of that language.  A document is rejected if a measure
lies outside the fences of its language and source.

Everything here is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactspark.llm.common import columns_of, let, small_side, stored, unused, words_of

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Measure:
    """A per-mille measure; ``slack`` widens its fences, ``both`` fences it from below as well."""

    name: str
    slack: int
    both: bool = False


MEASURES = (Measure("symbol_rate", 100), Measure("word_length", 1500, True), Measure("dup_line_rate", 300), Measure("repeat_rate", 150))
SPREADS = 3  # a fence lies so many quartile distances outside the quartile
PRIOR_DOCS = 20  # documents that the fences of the whole language count as, beside those of the source


def _repeated_words(words: Column) -> Column:
    """Words covered by windows that occur twice or more in the text, the first one included.

    Windows are compared by their 64-bit hash.  Only texts that hold a repeated one sort their windows.
    """

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - at, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    def repeated_starts(hashes: Column) -> Column:
        def pick(ordered: Column) -> Column:
            again = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False))
                             | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)))
            return F.array_sort(F.transform(again, lambda x: x["at"]))

        return let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))), pick)

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(repeated_starts(h), covered)).otherwise(F.lit(0)))

    return let(words, lambda w: F.when(F.size(w) >= WINDOW, of(w)).otherwise(F.lit(0))).cast("long")


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of every whole text, with the base verdict.

    Null and blank texts have no words: all counts are 0 and the base rule fails.
    Rows that repeat are kept as they are.  ``text_hash`` tells rows of one id apart.
    """
    read = columns_of(docs, doc_id="long", text="string", lang="string", source="string")
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    counted = read.withColumn("words", words_of(F.col("text"))).select(
        "doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"),
        let(F.col("words"), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated_words(w).alias("n_repeat_words"),
        )).alias("w"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        let(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )).alias("l"),
    )
    return counted.select("doc_id", "lang", "source", "text_hash", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines").withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def measures() -> dict[str, Column]:
    def per_mille(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.expr(f"1000 * {a} div {b}")).otherwise(F.lit(0)).cast("long")

    return {
        "symbol_rate": per_mille("n_symbols", "n_words"), "word_length": per_mille("word_chars", "n_words"),
        "dup_line_rate": per_mille("n_dup_lines", "n_lines"), "repeat_rate": per_mille("n_repeat_words", "n_words"),
    }


def bucket(value: Column) -> Column:
    """A whole number with all but its six leading binary digits cleared."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return let(F.struct(value.alias("v"), drop.alias("d")), lambda s: s["v"] - s["v"] % F.pow(F.lit(2), s["d"]).cast("long"))


def sketches(statistics: DataFrame) -> DataFrame:
    """One row per language, source, measure and bucket: ``docs`` of those that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), bucket(v).alias("bucket")) for n, v in measures().items()]))
    return statistics.where(~F.col("base_failed")).select("lang", "source", each.alias("m")).groupBy(
        "lang", "source", "m.measure", "m.bucket").agg(F.count(F.lit(1)).alias("docs"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of each merged sketch; a sketch has a few hundred buckets however many documents it holds."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("docs").alias("docs"))
    upto = F.sum("docs").over(W.partitionBy(*keys, "measure").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("docs").over(W.partitionBy(*keys, "measure"))
    ranked = merged.select(*keys, "measure", "bucket", upto.alias("upto"), total.alias("total"))
    return ranked.groupBy(*keys, "measure").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bucket"))).alias("q3"), F.max("total").alias("docs"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row per language and source: ``<measure>_low`` and ``<measure>_high``.

    A source's own fences weigh as many documents as it has, those of its language ``PRIOR_DOCS``;
    a source of a few documents thus leans on its language, without a switch.
    """
    own = _quartiles(sketch, ["lang", "source"])
    whole = _quartiles(sketch, ["lang"]).select(F.col("lang").alias("of"), F.col("measure").alias("m"), F.col("q1").alias("w1"), F.col("q3").alias("w3"))
    both = own.join(whole, F.col("lang").eqNullSafe(F.col("of")) & (F.col("measure") == F.col("m")))
    slack = F.create_map(*[x for m in MEASURES for x in (F.lit(m.name), F.lit(m.slack))])[F.col("measure")]

    def blend(a: Column, b: Column) -> Column:
        return (F.col("docs") * a + PRIOR_DOCS * b) / (F.col("docs") + PRIOR_DOCS)

    def low(q1: str, q3: str) -> Column:
        return F.col(q1) - SPREADS * (F.col(q3) - F.col(q1)) - slack

    def high(q1: str, q3: str) -> Column:
        return F.col(q3) + SPREADS * (F.col(q3) - F.col(q1)) + slack

    fenced = both.select("lang", "source", "measure", blend(low("q1", "q3"), low("w1", "w3")).alias("low"), blend(high("q1", "q3"), high("w1", "w3")).alias("high"))
    return fenced.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("measure") == m.name, F.col(side))).alias(f"{m.name}_{side}")
        for m in MEASURES for side in (("low", "high") if m.both else ("high",))])


def judged(docs: DataFrame) -> DataFrame:
    """Statistics, base verdict and ``kept`` of every row.

    A row is kept if it passes the base rules and every measure lies within the fences of its
    language and source (null is a language or source of its own).  No table: no rows.
    """
    statistics = stored(with_statistics(docs))
    limits = stored(fences(sketches(statistics)).select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "*").drop("lang", "source"))
    near = small_side(limits, F.lit(120) + F.coalesce(F.length("of_source"), F.lit(0)))
    joined = statistics.join(near, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    inside = F.lit(True)
    for m in MEASURES:
        value = measures()[m.name]
        inside &= F.coalesce(value <= F.col(f"{m.name}_high"), F.lit(True))
        if m.both:
            inside &= F.coalesce(value >= F.col(f"{m.name}_low"), F.lit(True))
    return joined.select(*statistics.columns, (~F.col("base_failed") & inside).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    names = unused(docs, "__id", "__hash", "__lang", "__source")
    rejected = judged(docs).where(~F.col("kept")).select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "text_hash", "lang", "source"), names, strict=True)])
    have = set(docs.columns)
    of = {n: (F.col(n) if n in have else F.lit(None)).cast(t) for n, t in (("doc_id", "long"), ("lang", "string"), ("source", "string"), ("text", "string"))}
    i, h, lang, source = map(F.col, names)
    same = of["doc_id"].eqNullSafe(i) & F.xxhash64(of["text"]).eqNullSafe(h) & of["lang"].eqNullSafe(lang) & of["source"].eqNullSafe(source)
    return docs.join(rejected, same, "left_anti")
