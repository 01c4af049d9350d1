"""Cross-entropy difference of documents under two bigram models: one of good documents, one of the whole corpus.

Both models count the same bigrams of byte-level tokens over one vocabulary and are smoothed alike (a bigram backs off to its unigram by
Dirichlet weight).  Texts are tokenised once and stored as 16-bit ids.  Counts cover all documents and meet by bigram after each task has
summed its own.  For scoring, each block of documents asks for the losses of the bigrams it holds, once each, and gets them sorted next
to its documents; a frequent bigram has one row per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactspark.llm.common import columns_of, over_batches, small_side, stored
from contactspark.llm.tokens import RANKS, SPECIAL_ID, ids_of, path_of
from contactspark.operators.ordered import written

EDGE = SPECIAL_ID + 1  # stands before the first token and behind the last
VOCABULARY = EDGE + 1
WEIGHT = 50.0  # tokens that the unigram counts as behind each context


def tokenised(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``block, doc_id, ids`` (binary, 16 bits each, edges included).  A block is a batch of one task; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        edge = np.array([EDGE], "<u2")
        for batch in batches:
            ids = [np.concatenate([edge, ids_of(t or "", vocabulary).astype("<u2"), edge]).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), batch.column(0), pa.array(ids, pa.binary())], names=["block", "doc_id", "ids"])
            block += 1

    return columns_of(docs, doc_id="long", text="string").mapInArrow(run, "block long, doc_id long, ids binary")


def bigrams(ids: bytes) -> np.ndarray:
    """Keys of a document's bigrams: context in the upper 16 bits, token in the lower."""
    a = np.frombuffer(ids, "<u2").astype(np.uint32)
    return a[:-1] << np.uint32(16) | a[1:]


def bigram_counts(tokens: DataFrame) -> DataFrame:
    """``bigram, n_target, n_all`` over rows of ``ids, target``."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = [bigrams(b) for b in batch.column(0).to_pylist()]
            chosen = [k for k, t in zip(keys, batch.column(1).to_pylist(), strict=True) if t]
            seen, n = np.unique(np.concatenate(keys), return_counts=True)
            own = np.zeros(len(seen), np.int64)
            if chosen:
                some, m = np.unique(np.concatenate(chosen), return_counts=True)
                own[np.searchsorted(seen, some)] = m
            return pa.RecordBatch.from_arrays([pa.array(seen.view(np.int32)), pa.array(own), pa.array(n)], names=["bigram", "n_target", "n_all"])
        return step

    parts = tokens.select("ids", "target").mapInArrow(over_batches(make), "bigram int, n_target long, n_all long")
    return parts.groupBy("bigram").agg(F.sum("n_target").alias("n_target"), F.sum("n_all").alias("n_all"))


def losses(counts: DataFrame) -> DataFrame:
    """``bigram, target_loss, background_loss`` in nats.

    Contexts and unigrams are at most as many as the vocabulary has entries (50,258), which bounds what is broadcast.
    """
    both = counts.withColumns({"context": F.shiftrightunsigned("bigram", 16), "token": F.col("bigram").bitwiseAND(0xFFFF)})
    sums = [F.sum("n_target").alias("t"), F.sum("n_all").alias("b")]
    contexts = F.broadcast(both.groupBy("context").agg(*sums).select(F.col("context").alias("c"), F.col("t").alias("ct"), F.col("b").alias("cb")))
    tokens = F.broadcast(both.groupBy("token").agg(*sums).select(F.col("token").alias("u"), F.col("t").alias("ut"), F.col("b").alias("ub")))
    total = F.broadcast(both.agg(F.coalesce(F.sum("n_target"), F.lit(0)).alias("nt"), F.coalesce(F.sum("n_all"), F.lit(0)).alias("nb")))

    def loss(n: str, context: str, token: str, every: str) -> Column:
        unigram = (F.col(token) + 0.5) / (F.col(every) + 0.5 * VOCABULARY)
        return -F.log((F.col(n) + WEIGHT * unigram) / (F.col(context) + WEIGHT))

    joined = both.join(contexts, F.col("context") == F.col("c")).join(tokens, F.col("token") == F.col("u")).crossJoin(total)
    return joined.select("bigram", loss("n_target", "ct", "ut", "nt").alias("target_loss"), loss("n_all", "cb", "ub", "nb").alias("background_loss"))


def _asked(tokens: DataFrame) -> DataFrame:
    """``block, bigram``: what each block needs to know."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            blocks, parts = np.array(batch.column(0)), []
            ids = batch.column(1).to_pylist()
            for block in np.unique(blocks):
                parts.append((block, np.unique(np.concatenate([bigrams(ids[i]) for i in np.flatnonzero(blocks == block)]))))
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat([b for b, _ in parts], [len(k) for _, k in parts])), pa.array(np.concatenate([k for _, k in parts]).view(np.int32))], names=["block", "bigram"])
        return step

    return tokens.select("block", "ids").mapInArrow(over_batches(make), "block long, bigram int")


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come block by block, first the losses, then the documents."""
    block, parts, table = None, [], None
    for batch in batches:
        blocks, kinds = np.array(batch.column(0)), np.array(batch.column(1))
        # runs of one block and kind
        edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, len(blocks)], strict=True):
            part = batch.slice(a, b - a)
            if blocks[a] != block:
                block, parts, table = blocks[a], [], None
            if kinds[a] == 0:
                parts.append([part.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6)])
                continue
            if table is None:
                key, target, background = (np.concatenate(c) for c in zip(*parts, strict=True))
                key = key.astype(np.int32).view(np.uint32)
                order = np.argsort(key)
                table = key[order], target[order], background[order]
            out = []
            for ids in part.column(3).to_pylist():
                at = np.searchsorted(table[0], bigrams(ids))
                out.append((len(at) - 1, table[1][at].mean(), table[2][at].mean()))
            n, t, b2 = (np.array(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([part.column(2), pa.array(n.astype(np.int64)), pa.array(t), pa.array(b2)], names=["doc_id", "n_tokens", "target_loss", "background_loss"])


def scored(docs: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, loss_difference`` of every row: means per token, the closing edge included.

    ``targets`` holds the ids of the target documents.  A lower difference is nearer to the target.  A null or empty text has
    its edge only.  Without target documents the target model is the uniform one.
    """
    tokens = written(tokenised(docs, vocabulary or path_of(RANKS)))
    wanted = stored(columns_of(targets, doc_id="long").where("doc_id is not null").distinct().select(F.col("doc_id").alias("wanted")))
    flagged = tokens.join(small_side(wanted, 16), F.col("doc_id") == F.col("wanted"), "left").select("ids", F.col("wanted").isNotNull().alias("target"))
    model = stored(losses(stored(bigram_counts(flagged))))
    known = _asked(tokens).distinct().join(model, "bigram")
    lost = known.select("block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("ids"), "bigram", "target_loss", "background_loss")
    none = F.lit(None).cast("double")
    asked = tokens.select("block", F.lit(1).alias("kind"), "doc_id", "ids", F.lit(None).cast("int").alias("bigram"), none.alias("target_loss"), none.alias("background_loss"))
    scores = lost.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind").mapInArrow(
        _scores, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return scores.withColumn("loss_difference", F.col("target_loss") - F.col("background_loss"))
