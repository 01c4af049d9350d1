"""Packing of token streams into windows of several context sizes.

Each task packs the documents it reads, a bounded block at a time: no shuffle, no group, and a lost task is packed again
from the same rows in the same way.  A document's full longest windows come first.  What is left is routed to the smallest
tier that holds it.  Tiers are packed from the longest: the gap of a window is filled by the longest shorter-tier piece that fits, again
and again, and the last gap by the head of one more piece.  Every window is thus full.  What is too little for
a window is handed to the next block; at the task's end it is cut at the tiers' sizes, and its last part is the only one that needs padding.
The block's sequences are dealt to step groups, longest first, each to the group with the fewest tokens.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.llm.common import columns_of
from contactspark.llm.tokens import RANKS, ids_of, path_of

TIERS = (2048, 1024, 512, 256)
END_ID = 1
BLOCK_TOKENS = 2_000_000
STEP_TOKENS = 64 * TIERS[0]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]

# a piece: (length, number of its document in the block, start)
Piece = tuple[int, int, int]


def _take(pool: list[Piece], gap: int) -> tuple[Piece, Piece | None]:
    """From a sorted pool: the longest piece that fits the gap, or else the head of the shortest piece, and its rest."""
    at = bisect_right(pool, (gap, float("inf"), 0)) - 1
    if at >= 0:
        return pool.pop(at), None
    length, doc, start = pool.pop(0)
    return (gap, doc, start), (length - gap, doc, start + gap)


def pack(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows as ``(tier, pieces)``, and the last pieces, which nothing is left to fill up with."""
    windows: list[tuple[int, list[Piece]]] = []
    pools: dict[int, list[Piece]] = {t: [] for t in tiers}

    def route(piece: Piece) -> None:
        insort(pools[min(t for t in tiers if t >= piece[0])], piece)

    for length, doc, start in pieces:
        whole = length // tiers[0] * tiers[0]
        windows += [(tiers[0], [(tiers[0], doc, start + at)]) for at in range(0, whole, tiers[0])]
        if length > whole:
            route((length - whole, doc, start + whole))
    for at, tier in enumerate(tiers):
        while pools[tier]:
            window = [pools[tier].pop()]
            gap = tier - window[0][0]
            while gap:
                # a shorter tier with a piece that fits, else any with a piece to cut, else this tier
                below = next((t for t in tiers[at + 1:] if pools[t] and pools[t][0][0] <= gap), None) or next((t for t in reversed(tiers[at:]) if pools[t]), None)
                if below is None:
                    break
                piece, rest = _take(pools[below], gap)
                window.append(piece)
                gap -= piece[0]
                if rest:
                    route(rest)
            if gap:
                return windows, window
            windows.append((tier, window))
    return windows, []


def flush(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Windows for the last pieces of a task: full ones as long as they reach a tier, then one to be padded."""
    pool, windows = sorted(pieces, reverse=True), []
    while left := sum(p[0] for p in pool):
        tier = next((t for t in tiers if t <= left), tiers[0])
        gap, window = min(tier, left), []
        while gap:
            length, doc, start = pool.pop(0)
            window.append((min(length, gap), doc, start))
            if length > gap:
                pool.insert(0, (length - gap, doc, start + gap))
            gap -= window[-1][0]
        windows.append((tier, window))
    return windows


def deal(sizes: list[int], groups: int) -> list[int]:
    """A step group for each sequence, longest first, each time the group with the fewest tokens."""
    heap, out = [(0, g) for g in range(groups)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        tokens, group = heapq.heappop(heap)
        out[i] = group
        heapq.heappush(heap, (tokens + sizes[i], group))
    return out


class _Task:
    """Packs the documents of one task; ids of sequences and step groups are unique to the task's partition."""

    def __init__(self, first: int):
        self.sequence = self.group = first
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.pieces: list[Piece] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.pieces.append((len(ids), len(self.docs), 0))
        self.docs.append((doc_id, ids))
        self.tokens += len(ids)

    def rows(self, last: bool) -> pa.RecordBatch:
        windows, left = pack(self.pieces)
        if last:
            windows, left = windows + flush(left), []
        sizes = [sum(p[0] for p in w) for _, w in windows]
        groups = deal(sizes, max(1, round(sum(sizes) / STEP_TOKENS)))
        out = []
        for (tier, window), group in zip(windows, groups, strict=True):
            offset = 0
            for length, doc, start in window:
                doc_id, ids = self.docs[doc]
                out.append((doc_id, start, length, zlib.crc32(ids[start:start + length].tobytes()), len(ids), self.sequence, offset, tier, self.group + group))
                offset += length
            self.sequence += 1
        self.group += max(groups, default=-1) + 1
        # what is left keeps its documents
        self.docs, kept = [self.docs[doc] for _, doc, _ in left], left
        self.pieces = [(length, i, start) for i, (length, _, start) in enumerate(kept)]
        self.tokens = sum(p[0] for p in self.pieces)
        columns = list(zip(*out)) or [[]] * len(NAMES)
        kinds = [pa.int32() if n == "tier" else pa.int64() for n in NAMES]
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=NAMES)


def packed(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per piece; a null or empty text is a document of the end id alone, rows that repeat are documents of their own.

    ``sequence_id`` and ``step_group`` start at the partition's number times 2**32.  Every id of every text lies in exactly one piece.
    """
    path = vocabulary or path_of(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(TaskContext.get().partitionId() << 32)
        end = np.array([END_ID], dtype="<u4")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                task.add(doc_id, np.concatenate([ids_of(text or "", path), end]))
                if task.tokens >= BLOCK_TOKENS:
                    yield task.rows(last=False)
        yield task.rows(last=True)

    return columns_of(docs, doc_id="long", text="string").select("doc_id", F.col("text")).mapInArrow(run, SCHEMA)
