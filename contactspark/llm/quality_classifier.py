"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of every whole text are computed once and stored, twenty-odd numbers a document.  Cosines of random projections approximate
a Gaussian kernel over the standardised statistics.  Each task sums its part of the normal equations, Spark adds the parts up, and a
system of ``FEATURES`` unknowns is solved.  Raw scores are binned, each bin's labels summed by Spark, and pooled to a rising curve.
The ridge fit and the curve use different documents.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.llm.common import columns_of, held_out, over_batches, stored, texts

FEATURES = 256
GAMMA = 0.05  # of the kernel exp(-GAMMA * squared distance)
RIDGE = 1.0
SEED = 20
BINS = 400
THRESHOLD = 0.3
FOLDS, HELD_OUT, CURVE = 5, 0, 4
_COUNTED = [b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">", b"!", b"?", b".", b",", b"@", b"/", b":"]
STATISTICS = 14 + len(_COUNTED)


def statistics(text: bytes) -> np.ndarray:
    """Numbers that describe one whole text; all zero for an empty one."""
    words = text.split()
    out = np.zeros(STATISTICS)
    if not words:
        return out
    n, size = len(words), len(text)
    codes = np.frombuffer(text, np.uint8)
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = ((codes >= 65) & (codes <= 90)).sum()
    digits = ((codes >= 48) & (codes <= 57)).sum()
    lengths = np.fromiter(map(len, words), np.int64, n)
    sentences = sum(text.count(x) for x in (b".", b"!", b"?")) + 1
    out[:14] = [
        np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()), upper / size, digits / size, (codes > 127).sum() / size, len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n, np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), np.log1p(n / sentences), (lengths <= 3).sum() / n]
    out[14:] = [min(text.count(c) / n, 4) for c in _COUNTED]
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of every row; null texts are empty."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([statistics(t) for t in texts(batch.column(1))])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), STATISTICS).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])
        return step

    return columns_of(docs, doc_id="long", text="string").mapInArrow(over_batches(make), "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), STATISTICS)


class Kernel:
    """Standardised statistics to Fourier features, the last of them constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.directions = draw.normal(scale=np.sqrt(2 * GAMMA), size=(STATISTICS, FEATURES - 1))
        self.shifts = draw.uniform(0, 2 * np.pi, FEATURES - 1)

    def of(self, x: np.ndarray) -> np.ndarray:
        near = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.hstack([np.cos(near @ self.directions + self.shifts) * np.sqrt(2 / (FEATURES - 1)), np.ones((len(x), 1))])


def normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Sums over ``x, y, weight`` of the features' outer products, and of their products with ``y``."""

    def run(batches):
        total = np.zeros((FEATURES, FEATURES + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                f, y = kernel.of(_matrix(part.column(0))), part.column(1).to_numpy(zero_copy_only=False)
                total += f.T @ np.hstack([f, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = rows.select("x", "y").mapInArrow(run, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((FEATURES, FEATURES + 1))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return out[:, :FEATURES], out[:, FEATURES]


def pool(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to ``value`` in weighted least squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for w, v in zip(weight, value, strict=True):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2])
    return np.concatenate([np.full(int(n), v) for _, v, n in blocks]) if blocks else np.zeros(0)


def _scores(rows: DataFrame, kernel: Kernel, weights: np.ndarray, *columns: str) -> DataFrame:
    """Raw scores beside the named columns."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = np.round(kernel.of(_matrix(batch.column(0))) @ weights, 6)
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(raw)], names=[*columns, "raw"])
        return step

    kinds = dict(rows.dtypes)
    return rows.select("x", *columns).mapInArrow(over_batches(make), ", ".join(f"{c} {kinds[c]}" for c in columns) + ", raw double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; a pure function of the text once fitted.

    Labels of the held-out fold are never read; a document labelled twice counts with its mean label.  Without labels every score is 0.5.
    """
    rows = stored(with_statistics(docs))
    known = columns_of(labels, doc_id="long", quality="double").where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("y")).where(~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    curve = held_out(F.col("doc_id"), FOLDS, CURVE)
    train = stored(rows.join(known, "doc_id").withColumn("curve", curve))
    moments = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    mean, scale = np.zeros(STATISTICS), np.ones(STATISTICS)
    for r in moments:
        mean[r.i], scale[r.i] = r.m, r.s
    kernel = Kernel(mean, scale)
    a, b = normal_equations(train.where("not curve"), kernel)
    weights = np.linalg.solve(a + RIDGE * np.eye(FEATURES), b)
    binned = _scores(train.where("curve"), kernel, weights, "y").groupBy(
        F.least(F.greatest(F.floor((F.col("raw") + 0.5) * (BINS / 2)), F.lit(0)), F.lit(BINS - 1)).alias("bin")).agg(F.count("y").alias("n"), F.sum("y").alias("s")).orderBy("bin").collect()
    if binned:
        n, s = np.array([r.n for r in binned], float), np.array([r.s for r in binned], float)
        centre, level = (np.array([r.bin for r in binned]) + 0.5) / (BINS / 2) - 0.5, pool(n, s / n)
    else:
        # no documents for the curve: the ridge score itself, or one half if there was nothing to fit either
        centre, level = np.array([0.0, 1.0]), np.array([0.0, 1.0]) if b.any() or a.any() else np.array([0.5, 0.5])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = kernel.of(_matrix(batch.column(1))) @ weights
            # a hundredth of the raw score keeps the order of documents on one level of the curve
            score = 0.99 * np.interp(raw, centre, level) + 0.01 * np.clip(raw, 0, 1)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(score, 0, 1))], names=["doc_id", "score"])
        return step

    out = rows.select("doc_id", "x").mapInArrow(over_batches(make), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
