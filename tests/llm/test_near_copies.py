"""The pipeline's near-duplicate stage: planted pairs around the limit, and many copies of one text."""

import itertools
import random
from pathlib import Path

import pytest
from llm_rows import docs_of
from pyspark.sql import functions as F

import corpus_pipeline
from contactspark.llm import near_copies

DRAW = random.Random(7)
FOLDER = "/root/testdata/sf0.001"


def text(n):
    return [f"w{DRAW.randrange(5000)}" for _ in range(n)]


def edited(words, n):
    """``n`` single-word substitutions, far enough apart to spoil five shingles each."""
    out = list(words)
    for k in range(n):
        out[10 + k * (len(words) - 20) // n] = f"new{DRAW.random()}"
    return out


def similarity(a, b):
    x, y = ({tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def plain_groups(docs):
    """Least id of each document's group, by comparing all pairs."""
    texts = {i: (t or "").lower().split() for i, t in docs.items()}
    sets = {i: {tuple(t[k:k + 5]) for k in range(max(1, len(t) - 4))} if t else set() for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return {i: find(i) for i in sets}


def test_planted_pairs_from_080_to_095(spark, no_docs):
    rows, want = [], set()
    for k in range(200):
        a = text(400)
        b = edited(a, DRAW.choice([1, 2, 4, 6, 8, 10, 12]))  # 0.97 to 0.74
        rows += [(2 * k, " ".join(a), "en", "a"), (2 * k + 1, " ".join(b), "en", "a")]
        want |= {2 * k} if similarity(a, b) >= 0.8 else {2 * k, 2 * k + 1}
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs_of(spark, rows), "").collect()}
    assert 200 < len(want) < 300
    assert got == want
    assert near_copies.keep_one(no_docs).count() == 0


def test_a_large_group_and_a_boundary(spark):
    a = text(300)
    rows = [(k, " ".join(edited(a, 2)), "en", "a") for k in range(150)]
    five = [f"v{i}" for i in range(49)]  # 45 shingles
    rows += [(1000, " ".join(five[:40]), "en", "a"), (1001, " ".join(five), "en", "a")]  # 36 of 45: 0.8 exactly
    rows += [(2000, "one two", "en", "a"), (2001, "ONE  two", "en", "a"), (2002, "two one", "en", "a")]
    got = {r.doc_id for r in near_copies.keep_one(docs_of(spark, rows)).collect()}
    assert got == {0, 1000, 2000, 2002}


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
def test_test_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    group = plain_groups({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id for r in near_copies.keep_one(docs).collect()}
    assert got == {i for i in group if group[i] == i}


def test_close_fingerprints_are_candidates_without_any_key(spark, monkeypatch):
    """The covering SimHash tables alone find copies whose fingerprints differ in two bits or fewer."""
    a = text(2000)
    rows = [(k, " ".join(edited(a, k)) if k else " ".join(a), "en", "a") for k in range(3)] + [(9, " ".join(text(2000)), "en", "a")]
    prints = {r.doc_id: r for r in near_copies.with_keys(docs_of(spark, rows)).collect()}
    bits = {k: bin((prints[0].fingerprint ^ prints[k].fingerprint) & (2**64 - 1)).count("1") for k in prints}
    close = {k for k, n in bits.items() if n <= 2}
    assert {0, 1} <= close and 9 not in close
    monkeypatch.setattr(near_copies, "bucket_candidates", lambda p: near_copies.print_candidates(p).limit(0))
    got = {r.doc_id for r in near_copies.keep_one(docs_of(spark, rows)).collect()}
    assert got == {0} | set(prints) - close


def test_every_pair_of_a_large_bucket_is_compared(spark, monkeypatch):
    """Forty couples share one bucket and nothing else: each couple is linked, wherever a hash puts its members."""
    rows = []
    for k in range(40):
        a = text(200)
        rows += [(2 * k, " ".join(a), "en", "a"), (2 * k + 1, " ".join(edited(a, 2)), "en", "a")]
    docs = docs_of(spark, rows)
    prints = near_copies.stored(near_copies.with_keys(docs).withColumn("keys", F.array(F.lit(7).cast("long"))).withColumn("fingerprint", F.xxhash64("node")))
    node = {r.doc_id: r.node for r in prints.collect()}
    want = {tuple(sorted((node[2 * k], node[2 * k + 1]))) for k in range(40)}
    for size in (8, 32, 1000):
        monkeypatch.setattr(near_copies, "CELL", size, raising=False)
        got = [tuple(sorted((r.a, r.b))) for r in near_copies.links(docs, prints).collect()]
        assert set(got) == want and len(got) == len(want)
