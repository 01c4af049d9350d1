"""Spelling variants against comparing every word with all words one edit away."""

import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from llm_rows import docs_of

from contactspark.llm import spelling

FOLDER = "/root/testdata/sf0.001"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def plain(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in UPPER else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:  # near words agree once a code point is taken out of one or both
        for i in range(len(w)):
            holes[w[:i] + w[i + 1:]].add(w)
        holes[w].add(w)
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), words.get(forms[w])))
    return sorted(out)


def ours(docs):
    return sorted(tuple(r) for r in spelling.variants(docs).collect())


def test_planted_words(spark):
    draw = random.Random(5)
    rows = []
    for base, copies in (("riverbank", 1000), ("riverbanc", 80), ("riberbanc", 5), ("riberban", 2), ("xriverbank", 100), ("Éternité", 40), ("éternité", 4), ("aaaaaaaa", 30), ("aaaaaaa", 3), ("aaaaaaaaa", 3), ("abababab", 60), ("babababa", 2), ("bababab", 6), ("straße÷s", 5), ("short", 50)):
        rows += [(draw.randrange(10**6), f"{base}, {base.upper() if base.isascii() else base}!\n{base}2", "en", "a") for _ in range(copies)]
    rows += [(None, "riverbank riverbank nowords1234567", "en", "a"), (3, None, "en", "a"), (4, "", None, None), (5, "12 ·· 中文字中文字中文字", "en", "a"), (6, "q" * 30000, "en", "a"), (6, "q" * 30000 + "x", "en", "a"), (6, "q" * 30000, "en", "a"), (6, "q" * 30000 + "x", "en", "a")]
    got = ours(docs_of(spark, rows))
    assert got == plain([(r[0], r[1]) for r in rows])
    by = {r[0]: r for r in got}
    assert by["riberbanc"][1] == "riverbanc" and by["riberbanc"][2] == "riverbank" and by["riberban"][2] in ("riverbank", "riberban")
    assert ours(docs_of(spark, rows[-1:])) == ours(docs_of(spark, [])) == []


@pytest.mark.parametrize("alphabet,size", [("ab", 900), ("abcde", 1500), ("abcdefghijklmnopqé", 1500)])
def test_dense_vocabularies(spark, alphabet, size):
    draw = random.Random(size)
    words = {"".join(draw.choice(alphabet) for _ in range(draw.randrange(7, 12))) for _ in range(size)}
    for w in list(words)[:size // 2]:
        i = draw.randrange(len(w) + 1)
        words.add(w[:i] + draw.choice(alphabet) + w[i + draw.randrange(2):])
    rows = [(k, " ".join([w] * draw.choice([2, 3, 30, 400])), "en", "a") for k, w in enumerate(sorted(words))]
    assert ours(docs_of(spark, rows)) == plain([(r[0], r[1]) for r in rows])


def test_pivots_are_the_cheapest_disjoint_pair():
    draw = np.random.default_rng(1)
    weight = draw.integers(1, 9, (300, 8)).astype(float)
    allowed = draw.random((300, 8)) < 0.6
    allowed[:, [1, 5]] = True
    first, second = spelling.pivots(weight, allowed)
    for w, ok, i, j in zip(weight, allowed, first, second, strict=True):
        pairs = [w[a] + w[b] for a in range(8) for b in range(a + 2, 8) if ok[a] and ok[b]]
        assert ok[i] and ok[j] and i + 2 <= j and w[i] + w[j] == min(pairs)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
def test_test_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert ours(docs) == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
