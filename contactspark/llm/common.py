"""What the corpus operators share: input columns, stored tables, size-checked broadcasts, batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactspark.operators.ordered import checkpointed

# a side of a join is broadcast only below this measured size
BROADCAST_BYTES = 32 << 20
# white space of the word rule: U+0020 and U+0009 to U+000D
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def columns_of(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; one that is absent is null.  All others are left behind, so none can clash."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{n}`") if n in have else F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as set it apart from the columns of ``df``."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def stored(df: DataFrame) -> DataFrame:
    """Rows written once to the shared checkpoint folder, lineage cut.  Use it for narrow tables."""
    return checkpointed(df)


def small_side(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its measured size is under ``limit``; otherwise left to a shuffled join.

    ``df`` should be stored or a plain scan, since it is read once to be measured.
    """
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once a row wherever ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null or blank texts."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, "[ \\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def over_batches(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]):
    """A function for ``mapInArrow``: ``make`` sets a task up and returns what turns one batch into another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None and out.num_rows:
                yield out

    return run
