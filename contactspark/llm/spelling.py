"""Spelling variants: words one code point apart, found by pivotal grams.

The bigrams of a word are ordered from rare to frequent over the whole vocabulary, equal ones by position; its first three are its prefix.
Dynamic programming picks two disjoint bigrams of the prefix with the fewest occurrences together: the pivots.  One edit spoils at most
one of two disjoint pivots, so of two near words the one whose prefix ends earlier in the order has a pivot that stands in the prefix of
the other (were it outside, it would come behind the end of that prefix, hence of its own).  Where the third bigram occurs again, the
next two places belong to the index as well: an edit makes two new bigrams, which may come before a pivot.

Positions narrow this down.  What an edit leaves of a word keeps its distance from the left end before the edit, and from the right
end behind it.  So for each place of an edit there is a key made of whole ends of the word that hold the surviving pivots:

* behind the second pivot: the head through the second pivot;
* before the first pivot: the tail from the first pivot;
* between the pivots: the head through the first and the tail from the second;
* in the second pivot: the head through the first pivot; where that has fewer than five letters, also letters behind it or at the
  word's other end, five in all;
* in the first pivot: the same from the right.

A word asks with these five keys.  The index holds the keys that each gram, or pair of grams, of a word's prefix can answer to: at a
given position only one to four splits of the missing letters exist.  Every candidate is verified by its edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.llm.common import columns_of, over_batches, stored

LEAST = 7  # code points of a word
OCCURRENCES = 2
EVERY = 31  # one run in so many, by hash, loses a code point
TIMES = 10  # a form is so many times as frequent
PREFIX = 3  # bigrams: 2 * distance + 1
NEW = 2  # bigrams that one edit makes
HELD = 200_000  # distinct words a task counts before it hands them on
RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST)  # shorter runs give no word
_TIMES = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2**64 over the golden ratio


def words_in(doc_id: int | None, text: bytes) -> Counter:
    """Words of one text with their occurrences.  A null id counts as no digits before the colon."""
    found, start = Counter(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():  # bytes know the lower case of A-Z only
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) < LEAST:
                continue
        found[run] += n
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for part in batches:
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()), strict=True):
            held.update(words_in(doc_id, text.as_py() or b""))
            if len(held) > HELD:
                yield batch()
                held = Counter()
    if held:
        yield batch()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words with enough occurrences over all documents; a null text has none."""
    read = columns_of(docs, doc_id="long", text="string").where(F.col("text").isNotNull())
    return read.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, and their letters as a matrix of one byte each: all letters of a word lie below U+0100."""
    found = [w.encode("latin-1") for w in words.to_pylist()]
    sizes = np.array([len(w) for w in found])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.frombuffer(b"".join(found[i] for i in rows), np.uint8).reshape(-1, size)


def _grams(letters: np.ndarray) -> np.ndarray:
    return letters[:, :-1].astype(np.int64) * 256 + letters[:, 1:]


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often each of the 65,536 pairs of letters occurs in the vocabulary; one number per pair reaches the driver."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(1 << 16, np.int64)
        for _, letters in _by_length(batch.column(0)):
            total += np.bincount(_grams(letters).ravel(), minlength=1 << 16)
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for row in words.select("word").mapInArrow(over_batches(lambda: step), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[row.gram] = row.n
    return counts


def pivots(weight: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of two disjoint allowed bigrams of each row with the least weight together.

    ``best[j]`` is the least weight of one bigram up to ``j``; a second one at ``j`` adds its own to ``best[j - 2]``.
    """
    cost = np.where(allowed, weight, np.inf)
    best = np.minimum.accumulate(cost, axis=1)
    second = np.argmin(cost[:, 2:] + best[:, :-2], axis=1) + 2
    row = np.arange(len(cost))
    first = np.argmax(cost == best[row, second - 2][:, None], axis=1)
    return first, second


def _ends(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all heads (through each letter) and of all tails (from each letter), the same for the same text wherever it stands."""
    powers = np.cumprod(np.full(letters.shape[1], _TIMES), dtype=np.uint64)
    values = (letters.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)  # fixed value: a large odd number
    values ^= values >> np.uint64(29)
    return np.cumsum(values * powers, axis=1, dtype=np.uint64), np.cumsum((values * powers[::-1])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]


def _key(kind: int, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    out = (head ^ np.uint64(kind)) * _TIMES
    out ^= out >> np.uint64(32)
    out = (out + tail) * _TIMES
    return (out ^ (out >> np.uint64(29))).view(np.int64)


HEAD, TAIL, BOTH, HEAD_MORE, TAIL_MORE = range(1, 6)
KNOWN = 5  # letters in a key for an edit in a pivot; two less than the shortest word has


def _prefixes(grams: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each row's first bigrams, and their places in the order."""
    place = order[grams]
    first = np.argsort(place, axis=1, kind="stable")[:, :PREFIX + NEW]
    return first, np.take_along_axis(place, first, axis=1)


class Ends:
    """Hashes of heads and tails of words of one length."""

    def __init__(self, letters: np.ndarray):
        self.size = letters.shape[1]
        heads, tails = _ends(letters)
        none = np.zeros((len(letters), 1), np.uint64)
        self.heads, self.tails = np.hstack([none, heads]), np.hstack([tails, none])  # by length of the head, by start of the tail

    def through(self, row, gram) -> np.ndarray:
        return _key(HEAD, self.heads[row, gram + 2], np.uint64(0))

    def since(self, row, gram) -> np.ndarray:
        return _key(TAIL, np.uint64(0), self.tails[row, gram])

    def both(self, row, first, second) -> np.ndarray:
        return _key(BOTH, self.heads[row, first + 2], self.tails[row, second])

    def through_and(self, row, gram, more) -> np.ndarray:
        """Head through the gram and ``more`` letters behind it, the rest of the known letters from the other end."""
        return _key(HEAD_MORE, self.heads[row, gram + 2 + more], self.tails[row, self.size - (KNOWN - gram - 2 - more)])

    def since_and(self, row, gram, more) -> np.ndarray:
        return _key(TAIL_MORE, self.heads[row, KNOWN - (self.size - gram) - more], self.tails[row, gram - more])


def asked(letters: np.ndarray, order: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, keys and ends of prefixes of the five questions of each word."""
    grams, row, ends = _grams(letters), np.arange(len(letters)), Ends(letters)
    first, place = _prefixes(grams, order)
    allowed = np.zeros(grams.shape, bool)
    allowed[row[:, None], first[:, :PREFIX]] = True
    p, q = pivots(weight[grams], allowed)
    before, behind = np.maximum(0, KNOWN - 2 - p), np.maximum(0, KNOWN - ends.size + q)  # letters that a pivot's own end lacks
    between = q - p - 2
    in_second, in_first = ends.through(row, p), ends.since(row, q)
    at = np.flatnonzero(before)
    in_second[at] = ends.through_and(at, p[at], np.minimum(between, before)[at])
    at = np.flatnonzero(behind)
    in_first[at] = ends.since_and(at, q[at], np.minimum(between, behind)[at])
    keys = [ends.through(row, q), ends.since(row, p), ends.both(row, p, q), in_second, in_first]
    return np.tile(row, len(keys)), np.concatenate(keys), np.tile(place[:, PREFIX - 1], len(keys))


def answered(letters: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, keys and ends of prefixes of all that each word answers to."""
    ends = Ends(letters)
    first, place = _prefixes(_grams(letters), order)
    last = place[:, PREFIX - 1]
    inside = place <= last[:, None]
    row, column = np.nonzero(inside)
    gram = first[row, column]
    rows, keys = [row, row], [ends.through(row, gram), ends.since(row, gram)]
    for a in range(first.shape[1]):
        for b in range(a + 1, first.shape[1]):
            low, high = np.minimum(first[:, a], first[:, b]), np.maximum(first[:, a], first[:, b])
            at = np.flatnonzero(inside[:, a] & inside[:, b] & (high >= low + 2))
            rows.append(at)
            keys.append(ends.both(at, low[at], high[at]))
    for more in range(KNOWN - 1):
        at = (gram + 2 + more <= KNOWN) & (gram + 2 < KNOWN)
        rows.append(row[at])
        keys.append(ends.through_and(row[at], gram[at], more))
        at = (ends.size - gram + more <= KNOWN) & (ends.size - gram < KNOWN)
        rows.append(row[at])
        keys.append(ends.since_and(row[at], gram[at], more))
    at = np.concatenate(rows)
    return at, np.concatenate(keys), last[at]


def near_words(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n`` (a below b): all pairs of near words, each once."""
    counts = gram_counts(words)
    order = np.empty(1 << 16, np.int64)
    order[np.argsort(counts, kind="stable")] = np.arange(1 << 16)
    tables = words.sparkSession.sparkContext.broadcast((counts.astype(float), order))  # of fixed size

    def keyed(prefix: str, keys_of):
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(rows[at], keys, lasts) for rows, letters in _by_length(batch.column(0)) for at, keys, lasts in [keys_of(letters)]]
            rows, keys, lasts = (np.concatenate([f[i] for f in found]) for i in range(3))
            at = pa.array(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(lasts), batch.column(0).take(at), batch.column(1).take(at)], names=[f"{prefix}_{c}" for c in ("key", "last", "word", "n")])

        return words.mapInArrow(over_batches(lambda: step), f"{prefix}_key long, {prefix}_last long, {prefix}_word string, {prefix}_n long")

    asking = keyed("r", lambda letters: asked(letters, tables.value[1], tables.value[0]))
    indexed = keyed("s", lambda letters: answered(letters, tables.value[1]))
    met = asking.join(indexed, (F.col("r_key") == F.col("s_key")) & (F.col("r_last") <= F.col("s_last")) & (F.col("r_word") != F.col("s_word")))
    near = met.where(F.levenshtein("r_word", "s_word", 1) == 1)
    turned = F.col("r_word") > F.col("s_word")
    return near.select(
        F.least("r_word", "s_word").alias("a"), F.when(turned, F.col("s_n")).otherwise(F.col("r_n")).alias("a_n"),
        F.greatest("r_word", "s_word").alias("b"), F.when(turned, F.col("r_n")).otherwise(F.col("s_n")).alias("b_n")).distinct()


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    Among near words equally frequent the one smallest in code-point order is taken. A document with a null text has no words, copies of a
    document count each, a table without words gives no rows.
    """
    words = stored(vocabulary(docs))
    pairs = stored(near_words(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).union(pairs.select("b", "a", "a_n"))
    best = both.groupBy(F.col("word").alias("of")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    taken = -F.col("best.minus") >= TIMES * F.col("n")
    table = stored(words.join(best, F.col("word") == F.col("of"), "left").select(
        "word", F.when(taken, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, -F.col("best.minus")).alias("form_n")))
    step = table.where(F.col("form").isNotNull()).select(F.col("word").alias("from"), F.col("form").alias("to"))
    root = stored(step.select(F.col("from").alias("start"), F.col("to").alias("root")))
    # each step is ten times as frequent, so there are as many rounds at most as the largest count has digits
    while True:
        moved = stored(root.join(step, F.col("root") == F.col("from"), "left").select("start", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("on")))
        if moved.where("on").isEmpty():
            break
        root = moved.select("start", "root")
    return table.join(root, F.col("word") == F.col("start"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
