"""Near duplicates by 64-bit fingerprints: covering hash tables find every pair within the radius.

For radius 2, each bit position gets a non-zero 3-bit code.  Table ``v`` (1 to 7) keeps the positions whose code has an odd
number of bits in common with ``v``.  Two positions leave at least one non-zero ``v`` that is even with both codes, so two
fingerprints that differ in at most two bits agree on all kept positions of some table.

Within a bucket of a table only the other positions can differ.  Two fingerprints are within two bits if and only if one of their
single-bit neighbourhoods (the fingerprint itself included) meets; members that meet at a value are linked to the least one there.
A bucket thus costs its size times the free positions, never its square, and a meeting holds at most one member per position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactspark.llm.common import columns_of, over_batches, stored, texts, unused
from contactspark.llm.components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
BITS = 64
TABLES = range(1, 2 ** (RADIUS + 1))


def free_bits(v: int) -> list[int]:
    """Positions that table ``v`` leaves out."""
    return [i for i in range(BITS) if bin((i % 7 + 1) & v).count("1") % 2 == 0]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def mask(v: int) -> int:
    return _signed(sum(1 << i for i in range(BITS) if i not in set(free_bits(v))))


def fingerprint(text: bytes) -> int:
    """Unsigned fingerprint of one text; 0 if it has no word."""
    words = text.lower().split()  # both know ASCII only: A-Z, and the white space of the word rule
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)])) if len(words) >= SHINGLE else [b" ".join(words)]
    return majority(np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """Fingerprint of the hashes of a text's shingles: a bit is set if over half of them have it; 0 without any."""
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fingerprint`` (signed 64 bits) of every row; null texts have no word."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = np.array([fingerprint(t) for t in texts(batch.column(2))], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], names=["doc_id", "text_hash", "fingerprint"])
        return step

    read = columns_of(docs, doc_id="long", text="string")
    return read.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(over_batches(make), "doc_id long, text_hash long, fingerprint long")


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: links between distinct fingerprints whose closure is that of all pairs within the radius."""
    keys = prints.select("fingerprint").distinct().select("fingerprint", F.explode(F.array(*[
        F.struct(F.lit(v).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(mask(v))).alias("key")) for v in TABLES])).alias("k")).select("fingerprint", "k.table", "k.key")
    keys = stored(keys)
    crowded = keys.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("table").alias("t"), F.col("key").alias("k"))
    met = keys.join(crowded, (F.col("table") == F.col("t")) & (F.col("key") == F.col("k")), "left_semi")
    flips = F.create_map(*[x for v in TABLES for x in (F.lit(v), F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in free_bits(v)]))])
    near = met.select("fingerprint", "table", F.explode(F.transform(flips[F.col("table")], lambda f: F.col("fingerprint").bitwiseXOR(f))).alias("value"))
    least = near.groupBy("table", "value").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("z"), F.collect_set("fingerprint").alias("members"))
    return least.where("a <> z").select("a", F.explode("members").alias("b")).where("a <> b").distinct()


def groups(prints: DataFrame) -> DataFrame:
    """``prints`` with ``root`` (least fingerprint of the group) and ``component_id``.

    ``component_id`` is the least id that is reachable, the row's own included; null only if all ids there are null.
    """
    root = components(links(prints)).select(F.col("node").alias("fingerprint"), "root")
    own = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    rooted = own.join(root, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(best, "root").select(F.col("fingerprint").alias("f"), "root", "component_id")
    return prints.join(found, F.col("fingerprint") == F.col("f")).drop("f")


def hexadecimal(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every group, with all its columns, by the rule of ``keep_first``."""
    return keep_first(docs, groups(stored(with_fingerprints(docs))))


def keep_first(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row of every ``root`` of ``grouped``, with all its columns: the least id, and of rows that share it the least text hash.

    A null id comes after all others.  Of rows alike in id and text one stays.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = grouped.groupBy("root").agg(F.min(order).alias("s"))
    key, hashed, number = unused(docs, "__key", "__hash", "__nth")
    kept = first.select(F.xxhash64("s.doc_id", "s.text_hash").alias(key), F.col("s.text_hash").alias(hashed))
    have = set(docs.columns)
    doc_id = (F.col("doc_id") if "doc_id" in have else F.lit(None)).cast("long")
    text = (F.col("text") if "text" in have else F.lit(None)).cast("string")
    marked = docs.withColumn(hashed, F.xxhash64(text)).withColumn(key, F.xxhash64(doc_id, F.col(hashed)))
    rest = [F.col(f"`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith(("map", "array", "struct", "variant"))]
    nth = F.row_number().over(W.partitionBy(key, hashed).orderBy(*rest or [key]))
    return marked.join(kept, [key, hashed], "left_semi").withColumn(number, nth).where(F.col(number) == 1).select(*docs.columns)
