"""Token ids, counts and packing against the tokenizer library."""

import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import EDGE_ROWS, LONG, PROSE, docs_of

from contactspark.llm import packing, token_counts
from contactspark.llm.tokens import PIECES, RANKS, ids_of, path_of

LIBRARY = token_counts.library(path_of(PIECES))
ODD = ["'s", " ", "\n", "\u0085", "\x1c", "²", "½", "a", "B", "١", "é", "中", "​", "'", "ll", "\t", "́", "😀", "9", " ", "_", "ⅷ", "<|endoftext|>", "<|", "\U0003f09c", "Ᲊ", "\U0001e5d0"]


def theirs(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def odd_texts(n=800):
    draw = random.Random(4)
    return ["".join(draw.choice([*ODD, chr(draw.randrange(1, 0xD7FF)), chr(draw.randrange(0xE000, 0x10FFFF))]) for _ in range(draw.randrange(14))) for _ in range(n)]


def test_ids_are_those_of_the_library():
    path = path_of(RANKS)
    for text in [*odd_texts(3000), PROSE, LONG, ""]:
        assert list(ids_of(text, path)) == theirs(text)


def test_counts(spark):
    texts = [*odd_texts(), None, "", PROSE, LONG, PROSE * 50, "x" + " x" * 70_000]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(0, texts[0], "en", "a"), (None, "x y", None, None)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.counted(docs_of(spark, rows).repartition(5)).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), n := len(theirs(t)), n > 1024) for i, t, *_ in rows), key=str)


def test_counts_of_edge_rows(spark, edge_docs, no_docs):
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.counted(edge_docs).collect()), key=str)
    assert got == sorted(((r[0], len(theirs(r[1]))) for r in EDGE_ROWS), key=str)
    assert token_counts.counted(no_docs).count() == 0


@given(st.lists(st.integers(1, 9000), max_size=60))
@settings(max_examples=200, deadline=None)
def test_windows_are_full_and_hold_each_token_once(lengths):
    windows, left = packing.pack([(n, i, 0) for i, n in enumerate(lengths)])
    assert all(sum(p[0] for p in w) == tier for tier, w in windows)
    last = packing.flush(left)
    assert all(sum(p[0] for p in w) == tier for tier, w in last[:-1])
    assert sum(p[0] for p in left) < max(packing.TIERS)
    spans = defaultdict(list)
    for _, window in windows + last:
        for n, doc, start in window:
            spans[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(spans[doc]):
            assert start == at
            at += size
        assert at == n


def test_gaps_of_long_windows_are_filled_from_shorter_tiers():
    windows, left = packing.pack([(1500, 0, 0), (548, 1, 0), (300, 2, 0), (212, 3, 0)])
    assert windows == [(2048, [(1500, 0, 0), (548, 1, 0)]), (512, [(300, 2, 0), (212, 3, 0)])]
    assert not left


def test_deal_balances_groups():
    sizes = [2048] * 40 + [1024] * 21 + [512] * 13 + [256] * 9
    group = packing.deal(sizes, 6)
    totals = [sum(s for s, g in zip(sizes, group, strict=True) if g == k) for k in range(6)]
    assert max(totals) - min(totals) <= 256


def check_packed(rows, out):
    ids = defaultdict(list)
    for doc_id, text, *_ in rows:
        ids[doc_id].append(np.array([*theirs(text), 1], "<u4"))
    sequences, seen = defaultdict(list), defaultdict(int)
    for r in out:
        match = [a for a in ids[r.doc_id] if len(a) == r.doc_tokens and zlib.crc32(a[r.start:r.start + r.length].tobytes()) == r.ids_crc32]
        assert match
        sequences[r.sequence_id].append(r)
        seen[r.doc_id] += r.length
    assert seen == {k: sum(map(len, v)) for k, v in ids.items()}
    padded = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padded += at & (at - 1) > 0
    return padded


def test_packed(spark, edge_docs, no_docs):
    assert check_packed(EDGE_ROWS, packing.packed(edge_docs.coalesce(1)).collect()) <= 1
    rows = [(i, t, "en", "a") for i, t in enumerate([*odd_texts(200), *[PROSE * k for k in range(1, 60)], LONG])]
    assert check_packed(rows, packing.packed(docs_of(spark, rows).repartition(3)).collect()) <= 3
    assert packing.packed(no_docs).count() == 0
