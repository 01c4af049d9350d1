"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies cover every text outside the held-out fold.  The classifier is fitted on a bounded sample of labelled texts
(``SAMPLE`` documents in all, spread evenly over the languages, chosen by a hash of id and text) with follow-the-regularised-leader and
an elastic-net penalty, which leaves most weights at zero; one temperature then calibrates its probabilities on a part of the sample
that the fit has not seen.  Whole texts are read everywhere.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.llm.common import columns_of, held_out, over_batches

BUCKETS = 1 << 15
SAMPLE = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1e-4
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_SPACE = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2**64 over the golden ratio


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Each code point's lower-case letter, or a space."""
    out = np.full(0x110000, _SPACE, dtype=np.uint64)
    for at in range(0x110000):
        c = chr(at)
        if c.isalpha():
            low = c.lower()
            out[at] = ord(low) if len(low) == 1 else at
    return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a whole text's letter 1-, 2- and 3-grams, words bounded by spaces; none if it has no letter."""
    letters = _fold()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    blank = letters == _SPACE
    if blank.all():
        return np.zeros(0, np.int64), np.zeros(0)
    letters = letters[~(blank & np.concatenate([[False], blank[:-1]]))]
    total = np.zeros(BUCKETS, np.int64)
    key = np.zeros(len(letters), np.uint64)
    for n in (1, 2, 3):
        key = letters[n - 1:] + (key[:-1] << np.uint64(21) if n > 1 else np.uint64(0))
        total += np.bincount(((key * _MIX + np.uint64(n)) * _MIX >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF of unit length, with a constant feature behind the buckets."""
    at, n = grams(text)
    x = (1 + np.log(n)) * idf[at]
    x /= np.sqrt((x * x).sum()) or 1
    return np.append(at, BUCKETS), np.append(x, 1.0)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Per bucket the documents that hold it, and the number of documents; the result has ``BUCKETS`` + 1 numbers at most."""

    def run(batches):
        total, docs = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[grams(text or "")[0]] += 1
            docs += batch.num_rows
        total[BUCKETS] = docs
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "docs"])

    rows = texts.select("text").mapInArrow(run, "bucket long, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        out[r.bucket] = r.docs
    return out[:BUCKETS], int(out[BUCKETS])


def _softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights by FTRL-proximal, one pass after the other over the rows as they come."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, y in rows:
            old = n[at]
            w = weights(z[at], old)
            error = _softmax(x @ w)
            error[y] -= 1
            g = np.outer(x, error)
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[at] = new
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, on a grid of quarter octaves."""
    if not len(y):
        return 1.0
    grid = [2 ** (k / 4) for k in range(-16, 17)]
    return min(grid, key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).sum())


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, inverse document frequencies and weights (already divided by the temperature).

    No labelled text: no languages.  A language's texts are sampled by hash, so that the result does not depend on partitioning.
    """
    read = columns_of(docs, doc_id="long", text="string", lang="string").where(~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    df, n = document_frequencies(read)
    idf = np.log((1 + n) / (1 + df)) + 1
    counts = {r.lang: r["count"] for r in read.where("lang is not null and text is not null").groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return [], idf, np.zeros((BUCKETS + 1, 0))
    share = SAMPLE / len(languages)
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(share / counts[k]))])[F.col("lang")] > at

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [vector(t, idf) for t in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0].astype("<i4").tobytes() for f in found], pa.binary()), pa.array([f[1].astype("<f4").tobytes() for f in found], pa.binary())], names=["place", "lang", "at", "x"])
        return step

    sample = read.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & chosen).select(F.xxhash64("text", "doc_id").alias("place"), "lang", "text")
    rows = sorted((r.place, bytes(r["at"]), r.lang, bytes(r.x)) for r in sample.mapInArrow(over_batches(make), "place long, lang string, at binary, x binary").collect())
    found = [(np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float), languages.index(lang)) for _, at, lang, x in rows]
    train = [f for i, f in enumerate(found) if i % 5]
    held = [f for i, f in enumerate(found) if i % 5 == 0]
    weights = fit(train or found, len(languages))
    heat = temperature(np.array([x @ weights[at] for at, x, _ in held]), np.array([y for *_, y in held], dtype=int))
    return languages, idf, weights / heat


def predicted(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    ``und`` with score 0 if the text is null or has no letter, or if there is no labelled text at all.
    """
    languages, idf, weights = learn(docs)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores = [], []
            for text in batch.column(2).to_pylist():
                at, x = vector(text or "", idf)
                if len(at) == 1 or not languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    p = _softmax(x @ weights[at])
                    names.append(languages[int(p.argmax())])
                    scores.append(float(p.max()))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
        return step

    read = columns_of(docs, doc_id="long", text="string")
    return read.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "text").mapInArrow(
        over_batches(make), "doc_id long, held_out boolean, lang_pred string, score double")
