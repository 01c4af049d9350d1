"""Fingerprints, covering tables, links and components against brute force."""

import itertools
import random

import xxhash
from llm_rows import EDGE_ROWS, PROSE, docs_of

from contactspark.llm import simhash
from contactspark.llm.components import components
from contactspark.llm.common import stored

FULL = (1 << 64) - 1


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= 2:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    for text in ["", None, "one", "One two", "A b C d a B c D", PROSE, PROSE.upper(), "Ünï Ü x y\x0bz", *[r[1] for r in EDGE_ROWS]]:
        assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_every_pair_in_the_radius_meets_in_a_table():
    masks = [simhash.mask(v) & FULL for v in simhash.TABLES]
    for r in (0, 1, 2):
        for bits in itertools.combinations(range(64), r):
            change = sum(1 << b for b in bits)
            assert any(change & m == 0 for m in masks)


def test_groups_against_brute_force(spark):
    draw = random.Random(3)
    values = [draw.getrandbits(64) for _ in range(120)]
    for v in values[:25]:
        at = v
        for _ in range(draw.randrange(1, 30)):  # chains of steps within the radius
            at ^= sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 3)))
            values.append(at)
    base = draw.getrandbits(64)
    values += [base ^ 1 << b for b in range(64)] + [0, FULL, 1 << 63] + values[:30]
    ids = draw.sample(range(10**6), len(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame(list(zip(ids, range(len(values)), signed)), "doc_id long, text_hash long, fingerprint long")
    got = {r.doc_id: r.component_id for r in simhash.groups(stored(rows)).collect()}
    root = roots(values)
    least = {}
    for i, r in zip(ids, root):
        least[r] = min(least.get(r, i), i)
    assert got == {i: least[r] for i, r in zip(ids, root)}


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(300)] + [(5, 5), (7000, 6999)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(301)} | {2000 + i: 1000 for i in range(300)} | {1000: 1000, 6999: 6999, 7000: 6999}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark, edge_docs, no_docs):
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    got = kept.collect()
    # 1 and 2 are copies; null, empty, blank and id-less blank texts are one group
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 3), (False, 6), (False, 7), (False, 8), (False, 9), (False, 10), (True, 0)]
    assert simhash.keep_one(no_docs).count() == 0
    same = docs_of(spark, [(5, PROSE, "en", "a")] * 4 + [(5, PROSE + "\n", "en", "a")])
    assert simhash.keep_one(same).count() == 1


def test_groups_of_edge_rows(spark, edge_docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.groups(stored(simhash.with_fingerprints(edge_docs))).collect()}
    assert {k[0]: v for k, v in got.items() if k[0] in (1, 2, 3, 4, 5)} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}
