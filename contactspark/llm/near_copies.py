"""Near copies for the pipeline: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two sources. The covering tables of ``simhash`` find all sets whose 64-bit fingerprints differ in two bits or fewer,
at whatever number: those of one fingerprint meet its least set, and those of linked fingerprints meet by their least sets. Two bits reach
the closest copies only, so the rest of the way down to the limit is found by minima:
of a set under 125 hash functions they form 25 keys of five.  Two sets at similarity 0.8 share no key with probability
(1 - 0.8**5)**25 = 5e-5, more similar ones with less.  Members of a bucket are candidates: all pairs in a bucket of up to eight;
a larger one is cut by a hash into parts of about eight, all pairs inside each, and every member also meets the bucket's least one.
A link counts only if the exact similarity of the two sets, made anew from the texts, reaches the limit.

Links of members that are connected already add nothing. So once the first candidates are confirmed and their groups known, all pairs of a large
bucket whose members lie in different groups are compared too (``across_groups``): no pair of a bucket is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactspark.llm.common import columns_of, over_batches, small_side, stored, texts
from contactspark.llm.components import components
from contactspark.llm.simhash import keep_first, majority
from contactspark.llm.simhash import links as near_prints

SHINGLE = 5
TENTHS = 8  # least similarity, in tenths so that it is compared in whole numbers
ROWS, BANDS = 5, 25
PART = 8  # members of a bucket that all meet each other at first
CELL = 32  # members of a large bucket on either side of a block of pairs
_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2**64 over the golden ratio
_DRAW = np.random.default_rng(42)
_FLIP = _DRAW.integers(0, 1 << 63, (ROWS * BANDS, 1), dtype=np.uint64)
_TIMES = _DRAW.integers(0, 1 << 63, (ROWS * BANDS, 1), dtype=np.uint64) | np.uint64(1)
_CHUNK = 1024  # hashes whose images under all functions are held at once
_SENT = 8 << 20  # bytes of sets in one batch


def _mixed(columns) -> np.ndarray:
    out = np.uint64(SHINGLE)
    for c in columns:
        out = (out ^ c) * _MIX
        out ^= out >> np.uint64(29)
    return out


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()  # as for the fingerprints
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(words) <= SHINGLE:
        return _mixed([hashes[i:i + 1] for i in range(len(words))]) if words else hashes
    n = len(words) - SHINGLE + 1
    return np.unique(_mixed([hashes[i:i + n] for i in range(SHINGLE)]))


def keys_of(found: np.ndarray) -> np.ndarray:
    """One key per band of a set of shingles."""
    if not len(found):
        return found
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _CHUNK):
        least = np.minimum(least, ((found[at:at + _CHUNK] ^ _FLIP) * _TIMES).min(axis=1))
    return _mixed(least.reshape(BANDS, ROWS).T)


def with_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, node, fingerprint, n, keys`` of every row; ``node`` stands for the set of shingles and ``n`` is its size."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            node, size, prints, keys = [], [], [], []
            for text in texts(batch.column(2)):
                found = shingles(text)
                node.append(xxhash.xxh64_intdigest(found.tobytes()))
                size.append(len(found))
                prints.append(majority(found))
                keys.append(keys_of(found).view(np.int64))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, prints)], pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "node", "fingerprint", "n", "keys"])
        return step

    read = columns_of(docs, doc_id="long", text="string")
    return read.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        over_batches(make), "doc_id long, text_hash long, node long, fingerprint long, n long, keys array<long>")


def print_candidates(prints: DataFrame) -> DataFrame:
    """``x, y``: sets (``node, n``) whose fingerprints are equal or linked by the covering tables, each met by the least of its fingerprint."""
    sets = stored(prints.where("n > 0").select("fingerprint", F.struct("node", "n").alias("m")).distinct())
    least = sets.groupBy("fingerprint").agg(F.min("m").alias("least"), F.count(F.lit(1)).alias("members"))
    alike = sets.join(least.where("members > 1"), "fingerprint").select(F.col("least").alias("x"), F.col("m").alias("y"))
    one, other = (least.select(F.col("fingerprint").alias(c), F.col("least").alias(name)) for c, name in (("a", "x"), ("b", "y")))
    return alike.union(near_prints(sets).join(one, "a").join(other, "b").select("x", "y"))


def candidates(prints: DataFrame) -> DataFrame:
    """``a, b`` (a below b): pairs of sets that meet by fingerprint or in a bucket and whose sizes allow the similarity."""
    return _fitting(print_candidates(prints).union(bucket_candidates(prints)))


def _fitting(met: DataFrame) -> DataFrame:
    """``a, b`` (a below b) of the met sets whose sizes allow the similarity, each pair once."""
    fits = 10 * F.least("x.n", "y.n") >= TENTHS * F.greatest("x.n", "y.n")
    a, b = F.least("x.node", "y.node"), F.greatest("x.node", "y.node")
    return met.where(fits & (F.col("x.node") != F.col("y.node"))).select(a.alias("a"), b.alias("b")).distinct()


def bucket_candidates(prints: DataFrame) -> DataFrame:
    """``x, y``: sets (``node, n``) that meet in a bucket of one key of minima."""
    nodes = prints.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    rows = stored(nodes.select(F.struct("node", "n").alias("m"), F.posexplode("keys").alias("band", "key")))
    shared = rows.groupBy(F.col("band").alias("of"), F.col("key").alias("at")).agg(F.count(F.lit(1)).alias("members"), F.min("m").alias("least")).where("members > 1")
    met = rows.join(shared, (F.col("band") == F.col("of")) & (F.col("key") == F.col("at")))
    # powers of two, so that the parts of buckets of like size agree
    parts = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.col("members") / PART)))).cast("long")
    met = met.select("band", "key", "m", "least", "members", F.pmod(F.xxhash64("m.node"), parts).alias("part"))
    star = met.where(F.col("members") > PART).select(F.col("least").alias("x"), F.col("m").alias("y"))
    inside = met.groupBy("band", "key", "part").agg(F.collect_list("m").alias("all")).where(F.size("all") > 1).select(
        F.explode("all").alias("x"), "all").select("x", F.explode(F.filter("all", lambda y: y["node"] > F.col("x.node"))).alias("y"))
    return star.union(inside)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and set of each text, in batches of bounded size."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    nodes, sets, size = [], [], 0
    for part in batches:
        for text in texts(part.column(0)):
            found = shingles(text)
            nodes.append(xxhash.xxh64_intdigest(found.tobytes()))
            sets.append(found.view(np.int64))
            size += found.nbytes
            if size > _SENT:
                yield batch()
                nodes, sets, size = [], [], 0
    if nodes:
        yield batch()


def sets_of(docs: DataFrame, prints: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, set`` of the wanted nodes, made anew from one text of each."""
    chosen = prints.groupBy("node").agg(F.min("text_hash").alias("__hash")).join(wanted, "node", "left_semi").select("__hash")
    read = columns_of(docs, text="string").where(F.col("text").isNotNull()).withColumn("__hash", F.xxhash64("text"))
    return stored(read.join(chosen, "__hash", "left_semi").groupBy("__hash").agg(F.first("text").alias("text")).select("text").mapInArrow(_sets, "node long, set array<long>"))


def _alike(a: Column, b: Column) -> Column:
    """Whether two sets reach the limit."""
    common = F.size(F.array_intersect(a, b))
    return 10 * common >= TENTHS * (F.size(a) + F.size(b) - common)


def crowded(prints: DataFrame) -> DataFrame:
    """``band, key, node``: members of buckets too large for all pairs to meet at first."""
    keys = prints.select("node", F.posexplode("keys").alias("band", "key"))
    large = stored(keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > PART).select("band", "key"))
    return stored(keys.join(small_side(large, 32), ["band", "key"], "left_semi").distinct())


def across_groups(docs: DataFrame, prints: DataFrame, found: DataFrame) -> DataFrame:
    """``a, b``: pairs of a large bucket that reach the limit and that the links ``found`` do not connect.

    A bucket whose members are one group needs nothing more. Any other is cut by a hash into parts of about ``CELL`` members, and every two parts
    meet in a cell of their own with the members' sets: a task holds the sets of a cell, and a set travels once per part and not once per pair.
    A pair is compared in the first band that it shares.
    """
    none = F.lit(None).cast("long")
    members = crowded(prints)
    if members.isEmpty():
        return prints.select(none.alias("a"), none.alias("b")).limit(0)
    rooted = members.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy(F.col("band").alias("of"), F.col("key").alias("at")).agg(
        F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("of", "at", "parts")
    open_ = stored(rooted.join(split, (F.col("band") == F.col("of")) & (F.col("key") == F.col("at"))).select(
        "band", "key", "node", "root", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")))
    wanted = open_.select("node").distinct()
    if wanted.isEmpty():
        return prints.select(none.alias("a"), none.alias("b")).limit(0)
    keyed = sets_of(docs, prints, wanted).join(prints.groupBy("node").agg(F.first("keys").alias("keys")), "node")
    placed = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = placed.join(keyed, "node").groupBy("band", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(
        F.collect_list(F.struct("node", "root", "part", "keys", "set")).alias("all"))

    def meets(x: Column, y: Column) -> Column:
        sizes = F.size(x["set"]), F.size(y["set"])
        shared = F.array_position(F.zip_with(x["keys"], y["keys"], lambda p, q: p == q), True) - 1
        mine = (x["node"] < y["node"]) & (x["root"] != y["root"]) & ((F.col("i") == F.col("j")) | (x["part"] != y["part"]))
        return mine & (10 * F.least(*sizes) >= TENTHS * F.greatest(*sizes)) & (shared == F.col("band")) & _alike(x["set"], y["set"])

    linked = F.flatten(F.transform("all", lambda x: F.transform(F.filter("all", lambda y: meets(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    return cells.select(F.inline(linked))


def links(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """``a, b``: links that connect all pairs whose exact similarity reaches the limit, among those that meet."""
    pairs = stored(candidates(prints))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = sets_of(docs, prints, wanted)
    one, other = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    found = stored(pairs.join(one, "a").join(other, "b").where(_alike(F.col("set_a"), F.col("set_b"))).select("a", "b"))
    return found.union(across_groups(docs, prints, found))


def grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, root`` of every row: documents that links connect have one root."""
    prints = stored(with_keys(docs))
    root = components(links(docs, prints))
    return prints.select("doc_id", "text_hash", F.col("node").alias("own")).join(root, F.col("own") == F.col("node"), "left").select(
        "doc_id", "text_hash", F.coalesce("root", "own").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every group, with all its columns, by the rule of ``keep_first``."""
    return keep_first(docs, grouped(docs))
