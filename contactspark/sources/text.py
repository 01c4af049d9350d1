"""Readers of line formats.  Each ``parse_*`` takes a DataFrame of lines, each ``read_*`` a path or glob.

A row that breaks a format's rules is an error where the format says so; the check is
part of the projection, so it runs with the scan and needs no second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactspark.functions.scalars import floor_to, known_autosomes, within

LIBRARY_PATTERN = r"_DNA_([0-9]+)_"
BARCODE_PATTERN = r"^rna([0-9]+)_(.+)$"


def require(condition: Column, value: Column, message: str, kind: str) -> Column:
    """The value where the condition holds, else an error."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast(kind))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name"))


def parse_contacts(text: DataFrame, minimum_fields: int = 5) -> DataFrame:
    """Contact records with a ``malformed`` flag; header lines and files of other names are skipped.

    The barcode is the text before the first ``:``; the library number is in the file
    name.  Malformed rows keep their library and carry nulls.
    """
    number = F.regexp_extract("file_name", LIBRARY_PATTERN, 1)
    rows = text.filter(~F.col("value").startswith("#")).withColumn("_lib", number).filter("_lib <> ''")
    f = F.split("value", "\t")
    enough = F.size(f) >= minimum_fields

    def field(i: int) -> Column:
        return F.when(enough, F.get(f, F.lit(i)))

    return rows.select(
        F.concat(F.lit("DNA"), F.lpad(F.col("_lib").cast("int").cast("string"), 2, "0")).alias("library_id"),
        F.when(enough, F.substring_index(f[0], ":", 1)).alias("dna_barcode"), field(1).alias("chrom1"), field(2).cast("long").alias("pos1"),
        field(3).alias("chrom2"), field(4).cast("long").alias("pos2"), field(8).alias("cell_type"), (~enough).alias("malformed"))


def read_contacts(spark: SparkSession, path: str, minimum_fields: int = 5) -> DataFrame:
    return parse_contacts(lines(spark, path), minimum_fields)


def _table_lines(text: DataFrame) -> DataFrame:
    v = F.trim("value")
    return text.filter((v != "") & ~(v.startswith("#") | v.startswith("track") | v.startswith("browser")))


def parse_bed(text: DataFrame) -> DataFrame:
    """Intervals of three or more whitespace fields; empty ones are dropped, short lines are an error."""
    f = F.split(F.trim("value"), r"\s+")
    # the check sits in a column the filter below reads, so that no bad line is dropped unseen
    end = require(F.size(f) >= 3, F.get(f, F.lit(2)).cast("long"), "interval line has fewer than three fields", "bigint")
    rows = _table_lines(text).select(f[0].alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("start_bp"), end.alias("end_bp"))
    return rows.filter("end_bp > start_bp")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return parse_bed(lines(spark, path))


def parse_labelled_bed(text: DataFrame, labels=("dELS", "pELS")) -> DataFrame:
    """Intervals whose tenth field is one of the labels; fewer than ten fields is an error."""
    f = F.split(F.trim("value"), r"\s+")
    label = require(F.size(f) >= 10, F.get(f, F.lit(9)), "interval line has fewer than ten fields", "string")
    rows = _table_lines(text).select(
        f[0].alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("start_bp"), F.get(f, F.lit(2)).cast("long").alias("end_bp"), label.alias("label"))
    return rows.filter(F.col("label").isin(list(labels)) & (F.col("end_bp") > F.col("start_bp")))


def read_labelled_bed(spark: SparkSession, path: str, labels=("dELS", "pELS")) -> DataFrame:
    return parse_labelled_bed(lines(spark, path), labels)


def parse_gtf_tss(text: DataFrame) -> DataFrame:
    """Zero-based transcription starts of ``gene`` rows; a line must have nine tab fields."""
    f = F.split("value", "\t")
    rows = text.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    feature = require(F.size(f) == 9, F.get(f, F.lit(2)), "annotation line must have nine fields", "string")
    out = rows.select(f[0].alias("chrom"), feature.alias("feature"), F.get(f, F.lit(3)).cast("long").alias("_s"), F.get(f, F.lit(4)).cast("long").alias("_e"), F.get(f, F.lit(6)).alias("strand"))
    tss = F.when(F.col("strand") == "-", F.col("_e") - 1).otherwise(F.col("_s") - 1)
    return out.filter("feature = 'gene'").select("chrom", tss.alias("tss"), "strand")


def read_gtf_tss(spark: SparkSession, path: str) -> DataFrame:
    return parse_gtf_tss(lines(spark, path))


def parse_bedgraph(text: DataFrame, chroms: list[str]) -> DataFrame:
    """Valued intervals on the listed chromosomes; fewer than four fields is an error."""
    f = F.split(F.trim("value"), r"\s+")
    chrom = require(F.size(f) >= 4, f[0], "valued interval has fewer than four fields", "string")
    rows = _table_lines(text).select(chrom.alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("start_bp"), F.get(f, F.lit(2)).cast("long").alias("end_bp"),
                                     F.get(f, F.lit(3)).cast("double").alias("value"))
    return rows.filter(F.col("chrom").isin(chroms))


def read_bedgraph(spark: SparkSession, path: str, chroms: list[str]) -> DataFrame:
    return parse_bedgraph(lines(spark, path), chroms)


BEDPE_FIELDS = "chrom_i string, start_i long, end_i long, chrom_j string, start_j long, end_j long"


def map_bedpe(calls: DataFrame, low: int = 250_000, high: int = 1_000_000, source_bin: int = 5_000, bin_size: int = 10_000, keep=()) -> DataFrame:
    """Checked paired intervals, anchors in order and floored to the bin grid, within the distance range.

    Trans calls, wrong widths and off-grid anchors are errors.  Rows are not yet deduplicated.
    """
    # checks sit in a column the distance filter reads, so that no bad call is dropped unseen
    fine = F.lit(True)
    for side in ("i", "j"):
        fine = fine & (F.col(f"end_{side}") - F.col(f"start_{side}") == source_bin) & (F.col(f"start_{side}") % source_bin == 0)
    left = require(fine, F.least("start_i", "start_j"), "anchor off the grid or of the wrong width", "long")
    left = require(F.col("chrom_i") == F.col("chrom_j"), left, "trans call", "long")
    # a generated row keeps the filter, and the null checks of later joins, above it: moved down, they would carry all checks at every reference
    call = F.struct(F.col("chrom_i").alias("chrom"), floor_to(left, bin_size).alias("bin_i"), floor_to(F.greatest("start_i", "start_j"), bin_size).alias("bin_j"), *keep)
    return calls.select(F.inline(F.array(call))).filter(within(F.col("bin_j") - F.col("bin_i"), low, high))


def parse_bedpe(calls: DataFrame, keys=("member",)) -> DataFrame:
    """One row per bin pair and member."""
    return map_bedpe(calls, keep=keys).dropDuplicates(["chrom", "bin_i", "bin_j", *keys])


def read_bedpe(spark: SparkSession, path: str, member: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", schema=BEDPE_FIELDS)
    if rows.isEmpty():
        raise ValueError(f"{path} holds no calls")
    return parse_bedpe(rows.withColumn("member", F.lit(member)))


def check_loops8(calls: DataFrame, bin_size: int = 10_000, low: int = 250_000, high: int = 990_000) -> DataFrame:
    """Loops on the bin grid: cis, one bin wide, on grid, distance within the inclusive range, else an error."""
    fine = (F.col("chrom_i") == F.col("chrom_j")) & (F.col("start_j") - F.col("start_i")).between(low, high)
    for side in ("i", "j"):
        fine = fine & (F.col(f"end_{side}") - F.col(f"start_{side}") == bin_size) & (F.col(f"start_{side}") % bin_size == 0)
    chrom = require(fine, F.col("chrom_i"), "loop breaks the format", "string")
    rest = [c for c in calls.columns if c not in ("chrom_i", "chrom_j", "start_i", "start_j", "end_i", "end_j")]
    return calls.select(chrom.alias("chrom"), F.col("start_i").alias("bin_i"), F.col("start_j").alias("bin_j"), *rest)


def read_loops8(spark: SparkSession, path: str, family: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", schema=BEDPE_FIELDS + ", probability double, signal double")
    if rows.isEmpty():
        raise ValueError(f"{path} holds no loops")
    return check_loops8(rows).withColumn("family", F.lit(family))


def parse_wide_counts(wide: DataFrame, genes: list[str]) -> DataFrame:
    """Wide barcode-by-gene counts as long rows ``(barcode, library_id, cell_type, gene, n)`` of the listed genes, zeros left out."""
    if wide.columns[:2] != ["barcode", "cell_type"]:
        raise ValueError("the header must start with barcode and cell_type")
    names = wide.columns[2:]
    if len(set(names)) != len(names) or any(not n.strip() for n in names):
        raise ValueError("gene names must be unique and not empty")
    missing = [g for g in genes if g not in set(names)]
    if missing:
        raise ValueError(f"genes not in the table: {missing}")
    long = wide.select("barcode", "cell_type", *[f"`{g}`" for g in genes]).unpivot(["barcode", "cell_type"], [f"`{g}`" for g in genes], "gene", "n")
    number = F.regexp_extract("barcode", BARCODE_PATTERN, 1)
    barcode = require(F.col("barcode").rlike(BARCODE_PATTERN), F.col("barcode"), "barcode of another form", "string")
    n = require(F.col("n").between(0, 2**31 - 1), F.col("n").cast("long"), "count out of range", "bigint")
    library = F.concat(F.lit("DNA"), F.lpad(number.cast("int").cast("string"), 2, "0"))
    return long.filter("n is null or n <> 0").select(barcode.alias("barcode"), library.alias("library_id"), "cell_type", "gene", n.alias("n"))


def repeated_rows(wide: DataFrame) -> DataFrame:
    """Barcodes on more than one line; must be empty."""
    return wide.groupBy("barcode").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def read_wide_counts(spark: SparkSession, path: str, genes: list[str]) -> DataFrame:
    """The header gives the schema, so there is no inference pass; short or long rows are errors."""
    header = spark.read.text(path).first()[0].split("\t")
    if len(set(header)) != len(header):
        raise ValueError("column names repeat")
    schema = ", ".join(f"`{h}` {'string' if h in ('barcode', 'cell_type') else 'long'}" for h in header)
    wide = spark.read.csv(path, sep="\t", header=True, schema=schema, mode="FAILFAST", enforceSchema=True)
    if not repeated_rows(wide).isEmpty():
        raise ValueError("barcodes repeat")
    return parse_wide_counts(wide, genes)


def sequence_bins(sequences: DataFrame, bin_size: int) -> DataFrame:
    """Fixed bins of longer sequence pieces ``(chrom, start_bp, seq)``; pieces start on the grid and do not overlap."""
    count = F.ceil(F.length("seq") / bin_size)
    each = sequences.filter(F.length("seq") > 0).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    return each.select("chrom", (F.col("start_bp") + F.col("_b") * bin_size).alias("bin_start"),
                       F.substring("seq", (F.col("_b") * bin_size + 1).cast("int"), F.lit(bin_size)).alias("seq"))


def read_sequence_bins(spark: SparkSession, path: str, bin_size: int) -> DataFrame:
    """Bins of a table of sequence pieces stored as ``chrom, start_bp, seq`` columns."""
    return sequence_bins(spark.read.schema("chrom string, start_bp long, seq string").csv(path, sep="\t"), bin_size)


def parse_chrom_sizes(text: DataFrame, chroms: list[str] | None = None) -> DataFrame:
    """Sizes of the required chromosomes with their order; a missing one is an error."""
    wanted = chroms or known_autosomes()
    f = F.split("value", r"\s+")
    found = text.filter(F.trim("value") != "").select(f[0].alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("size_bp"))
    listed = text.sparkSession.createDataFrame(list(enumerate(wanted)), "chrom_order int, chrom string")
    size = F.coalesce("size_bp", F.raise_error(F.concat(F.lit("no size for "), F.col("chrom"))).cast("long"))
    return listed.join(found, "chrom", "left").select("chrom_order", "chrom", size.alias("size_bp"))


def read_chrom_sizes(spark: SparkSession, path: str, chroms: list[str] | None = None) -> DataFrame:
    return parse_chrom_sizes(lines(spark, path), chroms)
