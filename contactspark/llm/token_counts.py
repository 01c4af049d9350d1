"""Token counts from pre-token frequencies, without ids.

Byte-level BPE never merges across pre-tokens, so a text has as many tokens as its pre-tokens have together.  Texts are read once:
each block of documents gives one row per distinct pre-token with the documents that hold it and how often.  One shuffle brings
the rows of a pre-token together; the tokenizer counts it once and the count is joined to its rows; partial sums per document are
added up by block.  A pre-token that many documents of a block hold is spread over a fixed number of parts, each of which counts it once.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.llm.common import columns_of
from contactspark.llm.tokens import PIECES, SPECIAL, path_of

LIMIT = 1024
BLOCK_ROWS = 1 << 16  # documents of a block have 16-bit numbers
# fixed value: the vocabulary's pre-token pattern
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PreTokens:
    """Splits texts into pre-tokens.  Texts with code points that are not assigned (where two Unicode versions may differ) are split by the library."""

    def __init__(self, path: str):
        self.path, self.known = path, set()

    def _plain(self, text: str) -> bool:
        new = set(text) - self.known
        good = all(unicodedata.category(c) != "Cn" for c in new)
        if good:
            self.known |= new
        return good

    def _part(self, text: str) -> list[str]:
        if self._plain(text):
            return PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in library(self.path).pre_tokenizer.pre_tokenize_str(text)]

    def of(self, text: str) -> list[str]:
        if SPECIAL not in text:
            return self._part(text)
        first, *rest = text.split(SPECIAL)
        out = self._part(first)
        for part in rest:
            out.append(SPECIAL)
            out += self._part(part)
        return out


FREQUENT, SALTS = 256, 64  # a pre-token in so many documents of a block is spread over so many parts
ROWS = "block long, piece string, salt int, postings binary"
_ROWS = pa.schema([("block", pa.int64()), ("piece", pa.string()), ("salt", pa.int32()), ("postings", pa.binary())])
_MOST = (1 << 16) - 1


def block_rows(block: int, ids: list[int | None], texts: list[str], split: PreTokens) -> pa.RecordBatch:
    """Frequencies of one block as postings of (document, times), 16 bits each; the row without a piece holds ids, whether they are there, and bytes of its documents."""
    number: dict[str, int] = {}
    codes, times = [], []
    for text in texts:
        counts = Counter(split.of(text))
        codes.append(np.fromiter((number.setdefault(p, len(number)) for p in counts), np.int64, len(counts)))
        times.append(np.fromiter(counts.values(), np.int64, len(counts)))
    docs, code, n = np.repeat(np.arange(len(texts)), [len(c) for c in codes]), np.concatenate(codes), np.concatenate(times)
    if n.max(initial=0) > _MOST:  # a long text's postings beyond 16 bits are split
        parts = -(-n // _MOST)
        last = np.cumsum(parts) - 1
        docs, code, rest = np.repeat(docs, parts), np.repeat(code, parts), n - (parts - 1) * _MOST
        n = np.full(parts.sum(), _MOST)
        n[last] = rest
    order = np.argsort(code, kind="stable")
    pairs = np.column_stack([docs[order], n[order]]).astype("<u2")
    sizes = np.bincount(code, minlength=len(number))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 4
    postings = pa.Array.from_buffers(pa.binary(), len(number), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(pairs.tobytes())])
    salt = np.where(sizes >= FREQUENT, (block ^ block >> 32) % SALTS, 0)
    names = np.array([[i or 0 for i in ids], [i is not None for i in ids], [len(t.encode()) for t in texts]], "<i8").tobytes()
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(number) + 1, block)), pa.array([*number, None], pa.string()), pa.array(np.append(salt, block % (1 << 31)).astype(np.int32)),
        pa.concat_arrays([postings, pa.array([names], pa.binary())])], schema=_ROWS)


def frequencies(docs: DataFrame, vocabulary: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, block = PreTokens(vocabulary), TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                yield block_rows(block, part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()], split)
                block += 1

    return columns_of(docs, doc_id="long", text="string").mapInArrow(run, ROWS)


FLUSH = 4_000_000  # sums that a task holds at most before it hands them on
SUMS = "block long, docs binary, sums binary"


def partial_sums(rows: DataFrame, vocabulary: str) -> DataFrame:
    """Per block, the tokens that the pieces of a task add to its documents, and the blocks' lists of documents.

    All rows of a piece are neighbours in one task (those of one salt, for a frequent piece): it is counted once and joined to them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = library(vocabulary), ("", 0)
        sums: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            found = [(block, np.flatnonzero(s), s) for block, s in sums.items()]
            return pa.RecordBatch.from_arrays([
                pa.array([b for b, *_ in found], pa.int64()), pa.array([at.astype("<u2").tobytes() for _, at, _ in found], pa.binary()),
                pa.array([s[at].astype("<i8").tobytes() for _, at, s in found], pa.binary())], names=NAMES)

        for batch in batches:
            named = batch.filter(pa.compute.is_null(batch.column(1)))
            if named.num_rows:
                yield pa.RecordBatch.from_arrays([named.column(0), pa.nulls(named.num_rows, pa.binary()), named.column(3)], names=NAMES)
            batch = batch.filter(pa.compute.is_valid(batch.column(1)))
            if not batch.num_rows:
                continue
            coded = batch.column(1).dictionary_encode()
            pieces = coded.dictionary.to_pylist()
            new = [p for p in pieces if p != last[0]]
            tokens = {p: len(f.ids) for p, f in zip(new, known.encode_batch(new, add_special_tokens=False), strict=True)} | dict([last])
            last = batch.column(1)[-1].as_py(), tokens[batch.column(1)[-1].as_py()]
            per_row = np.array([tokens[p] for p in pieces])[coded.indices.to_numpy()]
            joined = pa.concat_arrays([batch.column(3)])
            ends = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset:joined.offset + len(joined) + 1] // 4
            pairs = np.frombuffer(joined.buffers()[2], "<u2")[2 * ends[0]:2 * ends[-1]].reshape(-1, 2)
            row = np.repeat(np.arange(len(joined)), np.diff(ends))
            block = batch.column(0).to_numpy()[row]
            added = pairs[:, 1].astype(np.int64) * per_row[row]
            order = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[order], prepend=-1))
            for part in np.split(order, edges[1:]):
                here = np.bincount(pairs[part, 0], weights=added[part]).astype(np.int64)
                have = sums.get(int(block[part[0]]))
                if have is None:
                    sums[int(block[part[0]])] = here
                elif len(have) < len(here):
                    here[:len(have)] += have
                    sums[int(block[part[0]])] = here
                else:
                    have[:len(here)] += here
            if sum(map(len, sums.values())) > FLUSH:
                yield out()
                sums.clear()
        if sums:
            yield out()

    return rows.repartition("piece", "salt").sortWithinPartitions("piece").mapInArrow(run, SUMS)


NAMES = [part.split()[0] for part in SUMS.split(", ")]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the partial sums of each block, whose rows come one after the other, and names its documents."""
    block, total, named = None, np.zeros(0, np.int64), None

    def out() -> pa.RecordBatch:
        ids, there, sizes = named
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=there == 0), pa.array(sizes), pa.array(total[:len(ids)])], names=["doc_id", "n_bytes", "n_tokens"])

    for batch in batches:
        for at, docs, part in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if at != block:
                if named is not None:
                    yield out()
                block, total, named = at, np.zeros(BLOCK_ROWS, np.int64), None
            if docs is None:
                named = np.frombuffer(part, "<i8").reshape(3, -1)
            else:
                total[np.frombuffer(docs, "<u2")] += np.frombuffer(part, "<i8")
    if named is not None:
        yield out()


def counted(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, one row per row of ``docs``; null texts count as empty, with no tokens."""
    path = vocabulary or path_of(PIECES)
    totals = partial_sums(frequencies(docs, path), path).repartition("block").sortWithinPartitions("block").mapInArrow(_totals, "doc_id long, n_bytes long, n_tokens long")
    return totals.withColumn("over_limit", F.col("n_tokens") > LIMIT)
