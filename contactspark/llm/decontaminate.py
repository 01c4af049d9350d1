"""Benchmark decontamination by templates.

Texts become tokens (letters and digits of each word, lower case).  In the template of a text, numbers, units behind a number and
names (capitalised words inside a sentence) are typed placeholders.  Windows of five tokens are hashed twice: as they stand, and, where
they hold a placeholder, as a template.  The windows of documents are joined by hash with those of benchmark items.  Windows on one
diagonal (the same shift between document and item) or in a narrow band of diagonals belong to one use of the item; a use counts by its template
only if every slot value of the item always meets the same value of the document.  Literal windows count wherever they are, template
windows only together with those of the same use.

A bitmap of fixed size over the benchmark's hashes spares the join most windows of other texts; it drops nothing that could match.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.llm.common import columns_of, over_batches, small_side, stored, texts, unused

WINDOW = 5
ENOUGH = 9  # windows: a run of 13 tokens
SHARE = 0.5  # of the item's windows, if that is fewer
LITERALS = 3  # of a template window's tokens at least
BAND = 16  # diagonals
BITMAP_BITS = 22
# fixed values: common units of measure and money
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz pound pounds ml l litre litres liter liters gallon gallons s sec second "
    "seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees "
    "mph kmh kb mb gb tb hz khz mhz ghz w kw kwh v a".split())
LITERAL, NUMBER, NAME, UNIT = range(4)
_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2**64 over the golden ratio


KNOWN = 500_000  # words whose properties a task remembers at once
_NUMBER = re.compile(r"\d+(st|nd|rd|th|k|m|%s)?" % "|".join(sorted(UNITS, key=len, reverse=True)))
_CAPITAL, _ENDS, _CORE = 4, 8, 16  # flags above the two bits of the kind


def core_of(raw: bytes) -> str:
    """Letters and digits of a word, lower case."""
    word = raw.decode("utf-8", "replace")
    return (word if word.isalnum() else "".join(filter(str.isalnum, word))).lower()


class Words(dict):
    """Numbers of words; ``hashes`` and ``flags`` hold the properties of each.  It starts anew when it is full."""

    def __init__(self):
        super().__init__()
        self.hashes, self.flags = np.zeros(KNOWN, np.uint64), np.zeros(KNOWN, np.uint8)

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode("utf-8", "replace")
        core = word if word.isalnum() else "".join(filter(str.isalnum, word))
        kind = 0
        if core:
            low = core.lower()
            if low in UNITS:
                kind = UNIT
            elif not low.isalpha() and _NUMBER.fullmatch(low):
                kind = NUMBER
            kind |= _CORE
            if core[0].isupper() and not (len(core) > 1 and core.isupper()):
                kind |= _CAPITAL
            self.hashes[len(self)] = xxhash.xxh64_intdigest(low.encode(), 1)
        if not word[-1].isalnum() and word.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":"):
            kind |= _ENDS
        self.flags[len(self)] = kind
        self[raw] = at = len(self)
        return at

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and flags of a list of words."""
        hashes, flags = [], []
        for start in range(0, len(words), KNOWN // 2):
            part = words[start:start + KNOWN // 2]
            if len(self) + len(part) > KNOWN:
                self.clear()
            at = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            hashes.append(self.hashes[at])
            flags.append(self.flags[at])
        return np.concatenate(hashes), np.concatenate(flags)


@lru_cache(maxsize=1)
def known_words() -> Words:
    """What a worker process knows of words; later tasks of the process find it filled."""
    return Words()


def _split(text: bytes) -> list[bytes]:
    """Words; a line end is a full stop of its own."""
    return text.replace(b"\n", b" . ").split()


def tokens(words: list[bytes], first: np.ndarray, known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (among ``words``), hashes and kinds of the words with a letter or digit.

    ``first`` marks the first word of each text.  A name is a capitalised word that no sentence or line starts with; a unit stands behind a number.
    """
    hashes, flags = known.of(words)
    at = np.flatnonzero(flags & _CORE)
    ends = np.cumsum((flags & _ENDS > 0) | np.concatenate([first[1:], [False]]))
    kind = (flags[at] & 3).astype(np.int8)
    before = np.concatenate([[-1], at[:-1]])
    # a sentence or text has ended between the word before and this one
    start = np.concatenate([[True], ends[at[1:] - 1] > np.where(before[1:] > 0, ends[before[1:] - 1], 0)]) if len(at) else np.zeros(0, bool)
    behind = np.concatenate([[False], kind[:-1] == NUMBER])[:len(at)]
    kind[(kind == UNIT) & ~behind] = LITERAL
    kind[(kind == LITERAL) & (flags[at] & _CAPITAL > 0) & ~start] = NAME
    return at, hashes[at], kind


def tokens_of(text: bytes) -> tuple[list[str], list[int]]:
    """Cores and kinds of one text's words."""
    words = _split(text)
    if not words:
        return [], []
    at, _, kind = tokens(words, np.arange(len(words)) == 0, Words())
    return [core_of(words[i]) for i in at], kind.tolist()


def _windows(values: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of all windows."""
    n = len(values) - WINDOW + 1
    out = np.full(n, salt, dtype=np.uint64)
    for j in range(WINDOW):
        out = (out ^ values[j:j + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


Windows = tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]  # number of the text, position in it, hash, slot values
_CHUNK = 1 << 22  # bytes of text whose words are held at once


def window_rows(batch: list[bytes], known: Words, bitmap: np.ndarray | None = None) -> Windows:
    """Windows of all texts, literal ones with no slots; only those in the bitmap if there is one."""
    out, start = [], 0
    while start < len(batch):
        end, size = start, 0
        while end < len(batch) and (end == start or size + len(batch[end]) <= _CHUNK):
            size += len(batch[end])
            end += 1
        out.append(_chunk_rows(batch[start:end], start, known, bitmap))
        start = end
    text, position, key = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))
    return text, position, key, [s for o in out for s in o[3]]


def _chunk_rows(batch: list[bytes], base: int, known: Words, bitmap: np.ndarray | None) -> Windows:
    split = [_split(t) for t in batch]
    words = [w for ws in split for w in ws]
    sizes = np.array([len(ws) for ws in split])
    first = np.zeros(len(words) + 1, bool)
    first[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
    none = np.zeros(0, np.int64)
    if len(words) < WINDOW:
        return none, none, none, []
    at, literal, kind = tokens(words, first[:-1], known)
    if len(at) < WINDOW:
        return none, none, none, []
    text = np.repeat(np.arange(len(batch)), sizes)[at]
    place = np.arange(len(at)) - np.searchsorted(text, text)
    n = len(at) - WINDOW + 1
    whole = text[:n] == text[WINDOW - 1:]
    slots = sum((kind[j:j + n] > 0).astype(np.int8) for j in range(WINDOW))
    plain = _windows(literal, 7)
    use_plain, use_shaped = whole, whole & (slots > 0) & (slots <= WINDOW - LITERALS)
    shaped_at = np.flatnonzero(use_shaped)
    shaped = _windows(np.where(kind > 0, kind.astype(np.uint64), literal), 11)[shaped_at]
    if bitmap is not None:
        low = np.uint64((1 << BITMAP_BITS) - 1)
        use_plain = use_plain & bitmap[(plain & low).astype(np.int64)]
        inside = bitmap[(shaped & low).astype(np.int64)]
        shaped_at, shaped = shaped_at[inside], shaped[inside]
    plain_at = np.flatnonzero(use_plain)
    values = [[core_of(words[at[j]]) for j in range(i, i + WINDOW) if kind[j]] for i in shaped_at]
    both = np.concatenate([plain_at, shaped_at])
    return text[both] + base, place[both], np.concatenate([plain[plain_at], shaped]).view(np.int64), [[]] * len(plain_at) + values


_SLOTS = pa.list_(pa.string())


def _table(ids: list[pa.Array], names: list[str], found: Windows) -> pa.RecordBatch:
    text, position, key, slots = found
    at = pa.array(text)
    return pa.RecordBatch.from_arrays(
        [i.take(at) for i in ids] + [pa.array(position.astype(np.int64)), pa.array(key.astype(np.int64)), pa.array(slots, _SLOTS)], names=[*names, "position", "hash", "slots"])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, item_position, hash, item_slots, total`` (windows of the item).  Items of fewer than five tokens have none."""

    def make():
        known = known_words()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = window_rows(texts(batch.column(1)), known)
            place = found[0] * (found[1].max(initial=0) + 1) + found[1]
            total = np.bincount(found[0][np.unique(place, return_index=True)[1]], minlength=batch.num_rows)
            return _table([batch.column(0), pa.array(total)], ["item_id", "total"], found)
        return step

    read = columns_of(benchmark, item_id="long", text="string").where(F.col("text").isNotNull()).distinct()
    return read.mapInArrow(over_batches(make), "item_id long, total long, item_position long, hash long, item_slots array<string>")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item it holds: ``doc_id, text_hash, item_id, n_windows, item_windows, reparameterised``.

    A document holds an item if it has at least nine of its windows, or half of them where the item has fewer than eighteen,
    its template windows in one consistent use.  ``reparameterised``: only with the help of templates.  Null or empty texts and items, and items of fewer
    than five tokens, match nothing; copies of a document each give their row, rows alike in id and text give one.
    """
    items = stored(item_windows(benchmark))
    low = items.select(F.col("hash").bitwiseAND((1 << BITMAP_BITS) - 1).alias("bit")).distinct()
    bitmap = np.zeros(1 << BITMAP_BITS, dtype=bool)
    bitmap[[r.bit for r in low.toLocalIterator()]] = True
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap).tobytes())

    def make():
        inside, known = np.unpackbits(np.frombuffer(bits.value, dtype=np.uint8)).astype(bool), known_words()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return _table([batch.column(0), batch.column(1)], ["doc_id", "text_hash"], window_rows(texts(batch.column(2)), known, inside))
        return step

    read = columns_of(docs, doc_id="long", text="string").where(F.col("text").isNotNull())
    windows = read.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        over_batches(make), "doc_id long, text_hash long, position long, hash long, slots array<string>")
    near = small_side(items, 96)
    # read by both band offsets below: stored, so that the texts are gone through once
    hits = stored(windows.join(near, "hash").where(F.size("slots") == F.size("item_slots")))
    key = ["doc_id", "text_hash", "item_id"]
    pairs = F.arrays_zip(F.col("item_slots").alias("of"), F.col("slots").alias("to"))
    uses = hits.groupBy(*key, "total", (F.col("position") - F.col("item_position")).alias("diagonal")).agg(
        F.collect_set(F.when(F.size("slots") == 0, F.col("item_position"))).alias("plain"),
        F.collect_set(F.when(F.size("slots") > 0, F.col("item_position"))).alias("shaped"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["of"])))
    seen = uses.withColumn("shaped", F.when(consistent, F.col("shaped")).otherwise(F.array().cast("array<bigint>")))
    # template windows count for one use: one diagonal, or neighbouring ones (words put in or left out) whose slots agree
    bands = seen.withColumn("offset", F.explode(F.array(F.lit(0), F.lit(BAND // 2)))).withColumn("band", F.floor((F.col("diagonal") + F.col("offset")) / BAND))
    near_uses = bands.where(consistent).groupBy(*key, "total", "offset", "band").agg(
        F.array_distinct(F.flatten(F.collect_list("shaped"))).alias("shaped"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs")).where(consistent)
    every = seen.select(*key, "total", "plain", "shaped").union(near_uses.select(*key, "total", F.array().cast("array<bigint>").alias("plain"), "shaped"))
    counted = every.groupBy(*key, "total").agg(F.array_distinct(F.flatten(F.collect_list("plain"))).alias("plain"), F.collect_set("shaped").alias("uses")).select(
        *key, "total", F.size("plain").alias("n_exact"), F.array_max(F.transform("uses", lambda u: F.size(F.array_union("plain", u)))).alias("n_windows"))
    need = F.least(F.lit(ENOUGH), F.ceil(F.lit(SHARE) * F.col("total")))
    return counted.where(F.col("n_windows") >= need).select(
        *key, "n_windows", F.col("total").alias("item_windows"), (F.col("n_exact") < need).alias("reparameterised"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    of_id, of_hash = unused(docs, "__id", "__hash")
    found = stored(contaminated(docs, benchmark).select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash)).distinct())
    have = set(docs.columns)
    doc_id = (F.col("doc_id") if "doc_id" in have else F.lit(None)).cast("long")
    text = (F.col("text") if "text" in have else F.lit(None)).cast("string")
    return docs.join(small_side(found, 24), doc_id.eqNullSafe(F.col(of_id)) & (F.xxhash64(text) == F.col(of_hash)), "left_anti")
