"""The trie of rebuilt conversations against one made of whole turn lists in plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

from contactspark.llm import prefix_trie

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, depth string, owner string, part string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [sums[k] for k in children[node]]
        sums[node] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[node]) - 1) * words)
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if len(rebuilt[c]) == len(node)))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def ours(df):
    found = prefix_trie.trie(df)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def test_shared_heads_and_copies(spark):
    draw = random.Random(3)
    rows = []
    for c in [*range(-25, 140), 1000, 1001, 1007, 5000]:
        if draw.random() < 0.1:
            continue
        if draw.random() < 0.3:  # copies of one conversation
            rows += [(c, t, "user", f"the same words {t}") for t in range(5)]
            continue
        for t in range(draw.randrange(1, 9)):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["a b", "c", "one  two\tthree", ""]) if t < 5 else f"t {t}"))
    draw.shuffle(rows)
    assert ours(frame(spark, rows)) == plain(rows)


def test_nulls_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HOT", 3)  # nodes on both sides of the broadcast
    rows = [
        (0, None, None, None), (0, None, "user", None), (0, 1, "user", "b"), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, 9, "system", "x" * 5000),
        (1, 1, "user", "a"), (1, 2, "user", "a"), (1, 3, None, ""), (1, 3, "", None), (2, 5, "user", "\n\t "), (None, 1, "user", "a"), (40, 1, None, None),
        (21, 1, "user", "a"), (22, 1, "user", "a"), (23, None, "user", "a"), (-1, 1, "user", "a"), (-1, 2, "user", "b"), (-1, 3, "user", "b"), (-1, 4, "user", "b"),
    ]
    assert ours(frame(spark, rows)) == plain(rows)
    assert ours(frame(spark, [])) == []
    assert ours(frame(spark, [(None, 1, "user", "a")])) == []


def test_a_very_long_conversation(spark):
    rows = [(7, t, "user", f"word {t % 3}") for t in range(3000)] + [(8, t, "user", f"word {t % 3}") for t in range(2000)] + [(c, t, "user", "word 0") for c in range(20, 80) for t in range(2)]
    assert ours(frame(spark, rows)) == plain(rows)


def test_equal_fingerprints_are_found_out(spark, monkeypatch):
    """With bases of 0 a product forgets all turns but the first: the check must ask for other bases."""
    draws = [[0, 0, 0, 0], prefix_trie.bases_of(1)]
    asked = []
    monkeypatch.setattr(prefix_trie, "bases_of", lambda draw: asked.append(draw) or draws[draw])
    rows = [(c, t, "user", f"{c} {t}" if t else "same") for c in (100, 101, 102, 103) for t in range(6)]
    assert ours(frame(spark, rows)) == plain(rows)
    assert asked == [0, 1]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
def test_test_table(spark):
    df = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    assert ours(df) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
