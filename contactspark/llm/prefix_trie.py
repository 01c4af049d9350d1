"""Prefix trie of rebuilt conversations, by composable fingerprints.

A conversation is rebuilt from a head (the first turns of a base conversation) and its own turns behind that head.  A sequence of turns
``t1 .. tn`` has the fingerprint ``sum(t_i * B**(i-1)) mod p``, kept with its length: sequences form a monoid under joining, and the product of two of them is
``left + B**len(left) * right``.  Every conversation's prefix products are taken once, over its original turns.  The product of a
base head and an own suffix then follows from three numbers of those tables, so no rebuilt text or turn list is ever made.
Four such products (two hashes of a turn, four bases, p = 2**31 - 1) make up a fingerprint.

Prefixes with one depth and fingerprint are one node.  Every turn has a stored reference, the SHA-256 of its role and text; a node
stands only if all its members have the same reference there and the same node above.  By induction its members then agree in all
turns.  If one node fails, everything is fingerprinted anew with other bases.

Subtree sums need no walk over depths.  Each node belongs to the member whose hashed id is least, so the nodes of one owner
are a chain, and a path to the root crosses about ``log(conversations)`` chains however deep it is.  Each chain's sum is added where its path leaves each other
chain, and running sums from the far end of every chain finish the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactspark.llm.common import columns_of, over_batches, stored, words_of
from contactspark.operators.ordered import running_totals

P = (1 << 31) - 1
LANES = range(4)
HEAD = 4  # heads have fewer turns than this
VALUES, ABOVE, REFS = [f"v{k}" for k in LANES], [f"u{k}" for k in LANES], ["ref1", "ref2", "ref3", "ref4"]
GROUP = 20  # conversations that share a base
HOT = 2000  # nodes that hold more than one in so many prefixes are fewer than this, and are joined by broadcast
DRAWS = 5  # of bases, before giving up
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "f1", "f2"]


def bases_of(draw: int) -> list[int]:
    return [int(b) for b in np.random.default_rng([42, draw]).integers(1 << 20, P, len(LANES))]


def power(base: int, exponent: Column) -> Column:
    """``base ** exponent mod p`` for a whole number that is not negative."""
    out, e = F.lit(1).cast("long"), exponent % (P - 1)
    for k in range(31):
        out = (out * F.when(e.bitwiseAND(1 << k) != 0, F.lit(pow(base, 1 << k, P))).otherwise(F.lit(1)).cast("long")) % P
    return out


def original_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, o1 .. o4, ref1 .. ref4, words, t0 .. t3``: narrow rows, one per turn; the order of a conversation is that of o1 to o4."""
    read = columns_of(conversations, conv_id="long", turn="long", role="string", text="string").where(F.col("conv_id").isNotNull())
    read = read.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)

    def number(at: int) -> Column:
        return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")

    a, b = F.xxhash64("role", "text"), F.xxhash64("text", F.lit("turn"), "role")
    return read.select(
        "conv_id", F.col("turn").alias("o1"), F.substring("role", 1, 32).alias("o2"), F.substring("text", 1, 32).alias("o3"), digest.alias("o4"),
        number(1).alias("ref1"), number(16).alias("ref2"), number(31).alias("ref3"), number(46).alias("ref4"), F.size(words_of(F.col("text"))).cast("long").alias("words"),
        F.pmod(a, F.lit(P)).alias("t0"), F.pmod(F.shiftrightunsigned(a, 33), F.lit(P)).alias("t1"), F.pmod(b, F.lit(P)).alias("t2"), F.pmod(F.shiftrightunsigned(b, 33), F.lit(P)).alias("t3"))


def prefix_products(turns: DataFrame, bases: list[int]) -> DataFrame:
    """Products of every prefix of every original conversation: ``conv_id, part, position`` (from 1), ``v0 .. v3``, ``u0 .. u3`` (without the last turn), references, words.

    Turns are range-partitioned, so that a conversation of any length is spread over tasks: each takes the products of its part, and the
    parts' own products are composed in order.
    """
    order = [F.col(f"o{i}").asc_nulls_first() for i in range(1, 5)]
    laid = stored(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    numbers = W.partitionBy("conv_id", "part").orderBy(*order)
    placed = laid.withColumn("n", F.row_number().over(numbers).cast("long")).select(
        "*", *[((F.col(f"t{k}") * power(bases[k], F.col("n") - 1)) % P).alias(f"x{k}") for k in LANES])
    # each term is below 2**31, so sums of 2**32 turns fit
    local = stored(placed.select("conv_id", "part", "n", *REFS, "words", *[f"x{k}" for k in LANES], *[
        (F.sum(f"x{k}").over(numbers.rowsBetween(W.unboundedPreceding, 0)) % P).alias(f"v{k}") for k in LANES]))
    parts = local.groupBy("conv_id", "part").agg(F.max(F.struct("n", *VALUES)).alias("m"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a conversation has one row per part here
    lengths = parts.select("conv_id", "part", "m", F.coalesce(F.sum("m.n").over(before), F.lit(0)).alias("length"))
    moved = lengths.select("*", *[power(bases[k], F.col("length")).alias(f"b{k}") for k in LANES])
    offsets = moved.select("conv_id", "part", "length", *[f"b{k}" for k in LANES], *[
        F.coalesce(F.sum((F.col(f"b{k}") * F.col(f"m.v{k}")) % P).over(before), F.lit(0)).alias(f"w{k}") for k in LANES])

    def composed(value: Column, k: int) -> Column:
        return (F.col(f"w{k}") + F.col(f"b{k}") * (value % P)) % P

    return local.join(offsets, ["conv_id", "part"]).select(
        "conv_id", "part", (F.col("n") + F.col("length")).alias("position"), *[composed(F.col(f"v{k}"), k).alias(f"v{k}") for k in LANES],
        *[composed(F.col(f"v{k}") - F.col(f"x{k}") + P, k).alias(f"u{k}") for k in LANES], *REFS, "words")


def _packed(values: list[Column], first: str, second: str) -> list[Column]:
    return [F.shiftleft(values[0], 31).bitwiseOR(values[1]).alias(first), F.shiftleft(values[2], 31).bitwiseOR(values[3]).alias(second)]


def _mixed(conv_id: Column) -> Column:
    """A one-to-one scramble of 64 bits, so that owners are drawn evenly from a node's members."""
    low = (1 << 32) - 1
    high = F.shiftrightunsigned(conv_id, 32)
    high = high.bitwiseXOR(F.xxhash64(conv_id.bitwiseAND(low)).bitwiseAND(low))
    return F.shiftleft(high, 32).bitwiseOR(conv_id.bitwiseAND(low).bitwiseXOR(F.xxhash64(high).bitwiseAND(low)))


MEMBER = ["conv_id", *KEY, "p1", "p2", *REFS, "words", "length"]


def members(products: DataFrame, bases: list[int]) -> DataFrame:
    """One row per rebuilt conversation and depth, the root included; ``p1, p2`` is the node above, ``length`` the number of rebuilt turns.

    Every fingerprint is the product of a base head and an own suffix.
    """
    first = products.groupBy("conv_id").agg(F.max("position").alias("n"), F.sort_array(F.collect_list(F.when(
        F.col("position") < HEAD, F.struct("position", *VALUES, *ABOVE, *REFS, "words")))).alias("first"))
    base = first.select(F.col("conv_id").alias("of"), F.col("first").alias("head"), F.col("n").alias("base_n"))
    zero = F.struct(*[F.lit(0).cast("long").alias(v) for v in VALUES])

    def up_to(turns: str, count: Column) -> Column:
        """Product of the first turns; there are fewer than ``HEAD`` of them."""
        return F.when(count > 0, F.struct(*[F.get(turns, (count - 1).cast("int"))[v].alias(v) for v in VALUES])).otherwise(zero)

    own = first.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD)
    joined = own.join(base, F.col("conv_id") - F.col("conv_id") % GROUP == F.col("of"), "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    heads = stored(joined.select(
        "conv_id", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("taken").cast("int")).alias("head"),
        up_to("head", F.col("taken")).alias("left"), up_to("first", F.least("h", "n")).alias("cut")))
    none = F.lit(0).cast("long")
    roots = heads.select("conv_id", none.alias("depth"), none.alias("f1"), none.alias("f2"), none.alias("p1"), none.alias("p2"), *[none.alias(r) for r in REFS], none.alias("words"), "length")
    inside = heads.select("conv_id", "length", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.position").alias("depth"), *_packed([F.col(f"t.{v}") for v in VALUES], "f1", "f2"), *_packed([F.col(f"t.{u}") for u in ABOVE], "p1", "p2"),
        *[F.col(f"t.{r}") for r in REFS], "t.words", "length")
    # the rows of a long conversation stay spread over its parts
    parts = products.select("conv_id", "part").distinct().join(heads.drop("head"), "conv_id")
    own_part = products.join(parts, ["conv_id", "part"]).where(F.col("position") > F.col("h"))

    def rebuilt(value: Column, k: int) -> Column:
        """The head's product, and behind it that of the own turns between the cut and ``value``, moved from behind ``h`` turns to behind ``taken``."""
        down = pow(bases[k], P - 2, P)
        move = F.element_at(F.array(*[F.lit(pow(down, e, P)).cast("long") for e in range(HEAD)]), (F.col("h") - F.col("taken") + 1).cast("int"))
        return (F.col("left")[f"v{k}"] + F.pmod(value - F.col("cut")[f"v{k}"], F.lit(P)) * move) % P

    behind = own_part.select(
        "conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("depth"), *_packed([rebuilt(F.col(v), k) for k, v in enumerate(VALUES)], "f1", "f2"),
        *_packed([rebuilt(F.col(u), k) for k, u in enumerate(ABOVE)], "p1", "p2"), *REFS, "words", "length")
    return roots.select(*MEMBER).union(inside.select(*MEMBER)).union(behind.select(*MEMBER))


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row per node; ``same`` tells whether its members agree in their turn and in the node above."""
    alike = F.lit(True)
    for c in (*REFS, "p1", "p2"):
        alike &= F.min(c) == F.max(c)
    return rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(_mixed(F.col("conv_id"))).alias("owner"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("words").alias("words"), alike.alias("same"))


def _looked_up(rows: DataFrame, key: list[Column], nodes: DataFrame, value: str, limit: float, spread: Column) -> DataFrame:
    """``rows`` with ``found``, the ``value`` of the node at ``key`` or null.

    Nodes with more than ``limit`` members, few by that rule, are broadcast; rows that find one there are dealt by ``spread`` in the join with all others.
    """
    hot = nodes.where(F.col("n_convs") > limit).select(*[F.col(c).alias(f"h_{c}") for c in KEY], F.col(value).alias("h_value"))
    cold = nodes.where(F.col("n_convs") <= limit).select(*[F.col(c).alias(f"c_{c}") for c in KEY], F.col(value).alias("c_value"))
    keyed = rows.select("*", *[k.alias(f"k_{c}") for k, c in zip(key, KEY, strict=True)])
    near = keyed.join(F.broadcast(hot), [F.col(f"k_{c}") == F.col(f"h_{c}") for c in KEY], "left")
    absent = F.col("h_depth").isNull()
    dealt = near.withColumn("k_depth", F.when(absent, F.col("k_depth")).otherwise(F.lit(-1))).withColumn("k_f1", F.when(absent, F.col("k_f1")).otherwise(spread))
    return dealt.join(cold, [F.col(f"k_{c}") == F.col(f"c_{c}") for c in KEY], "left").select(*rows.columns, F.coalesce("h_value", "c_value").alias("found"))


def _chunks():
    """Decimal ids of one node in one batch, joined by commas; the rows are sorted by node and id."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
        ids = batch.column(3).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        texts = [",".join(map(str, part.tolist())) for part in np.split(ids, starts[1:])]
        return pa.RecordBatch.from_arrays([*[pa.array(keys[starts, i]) for i in range(3)], pa.array(ids[starts]), pa.array(texts)], names=[*KEY, "first", "ids"])

    return step


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node of rows sorted by node and first id; only the running digest is held."""
    last, running = None, None
    for batch in batches:
        out = []
        for *key, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key == last:
                running.update(b"," + ids.encode())
                continue
            if last is not None:
                out.append((*last, running.hexdigest()))
            last, running = key, hashlib.sha256(ids.encode())
        if out:
            yield _digests(out)
    if last is not None:
        yield _digests([(*last, running.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(4)], names=[*KEY, "ends_sha256"])


def ends_of(rows: DataFrame) -> DataFrame:
    """``ends_sha256`` of each node at which a conversation ends.

    The ids of a node are joined by many tasks; its chunks meet in one, since a digest is made in order, and are streamed there.
    """
    ends = rows.where(F.col("depth") == F.col("length")).select(*KEY, "conv_id")
    joined = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(
        over_batches(_chunks), "depth long, f1 long, f2 long, first long, ids string")
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashes, "depth long, f1 long, f2 long, ends_sha256 string")


def built(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and nodes, checked; both are stored."""
    for draw in range(DRAWS):
        bases = bases_of(draw)
        rows = stored(members(prefix_products(turns, bases), bases))
        nodes = stored(nodes_of(rows))
        if nodes.where("not same").isEmpty():
            return rows, nodes
    raise RuntimeError("different prefixes share a fingerprint under every draw of bases")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns are ordered by ``turn`` (null first); turns with the same number by role, the first letters of the text, then a hash. A null role or text is
    empty, and a repeated row is a turn of its own. Rows without a conversation id belong to no conversation and are left out. A table
    without conversations has no node. Ids below zero keep their sign in ``%``, as in SQL.
    """
    rows, nodes = built(stored(original_turns(conversations)))
    limit = (rows.count() or 1) / HOT
    up = [F.col("depth") - 1, F.col("p1"), F.col("p2")]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = _looked_up(nodes, up, nodes, "conv_id", limit, F.col("owner")).withColumnRenamed("found", "parent_conv_id")
    own = stored(parents.join(children, KEY, "left").select(
        *KEY, "owner", "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf")))

    # where the path of each chain's owner last runs in each other chain
    shared = nodes.where("n_convs > 1")
    path = _looked_up(rows.select(*KEY, _mixed(F.col("conv_id")).alias("o")), [F.col(c) for c in KEY], shared, "owner", limit, F.col("o")).where(
        F.col("found").isNotNull() & (F.col("found") != F.col("o"))).groupBy("o", "found").agg(F.max("depth").alias("at"))
    chains = own.groupBy(F.col("owner").alias("o")).agg(F.sum("saved").alias("chain_saved"), F.sum("leaf").alias("chain_leaves"))
    hung = path.join(chains, "o").groupBy(F.col("found").alias("owner"), F.col("at").alias("depth")).agg(F.sum("chain_saved").alias("hung_saved"), F.sum("chain_leaves").alias("hung_leaves"))
    summed = running_totals(own.join(hung, ["owner", "depth"], "left").select(
        *KEY, "owner", "conv_id", "parent_conv_id", "n_convs", "n_children",
        (F.col("saved") + F.coalesce("hung_saved", F.lit(0))).alias("all_saved"), (F.col("leaf") + F.coalesce("hung_leaves", F.lit(0))).alias("all_leaves")),
        ["owner"], [("depth", True)], {"saved_tokens": "all_saved", "n_leaves": "all_leaves"})
    return summed.join(ends_of(rows), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
