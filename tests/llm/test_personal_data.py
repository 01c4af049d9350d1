"""Patterns against plain regular expressions; the model against enumeration, differences and held-out lines; spans of whole tables."""

import hashlib
import itertools
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from llm_rows import COLUMNS, EDGE_ROWS, docs_of

from contactspark.llm import personal_data as P
from contactspark.llm.pii_examples import examples, passes_luhn
from contactspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), 12 <= len(digits) <= 19 and passes_luhn(digits), 9 <= len(digits) <= 15][kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_patterns():
    draw = random.Random(11)
    for _ in range(6000):
        text = "".join(draw.choice(["a", "B", "@", ".", "-", "+", " ", "(", ")", "1", "25", "255", "0", "%", "é", "x.y", "4111111111111111", "\n", "::"]) for _ in range(draw.randrange(1, 25)))
        assert P.base_spans(text) == plain_base(text), text
    assert P.base_spans("4111 1111-1111 1111") == [(0, 19, 2)] and P.base_spans("+1 (415) 555-0132") == [(0, 17, 3)]


@pytest.mark.parametrize("unit", ["a", "1", "1 ", "(", "+", "@", "a@", "1.", "+1", " at ", "a at b", "[at]", "1 dot ", "((1"])
def test_long_texts_take_linear_time(unit):
    weights = P.fit()
    start = time.time()
    text = unit * (200_000 // len(unit))
    P.added_spans(text, P.base_spans(text), weights)
    assert time.time() - start < 30


def labellings(table, e, w, pairs):
    """Scores of all labellings of stretch ``e``, with their candidates."""
    n, rows = table.lengths[e], np.flatnonzero(table.where[:, 0] == e)
    scores = table.scores(w)

    def paths(at, last):
        if at == n:
            yield 0.0, ()
            return
        for rest, used in paths(at + 1, P.OUTSIDE):
            yield pairs[last, P.OUTSIDE] + rest, used
        for r in rows:
            _, i, j, kind = table.where[r]
            if i == at:
                for rest, used in paths(j, kind):
                    yield pairs[last, kind] + scores[r] + rest, (r, *used)

    return list(paths(0, P.OUTSIDE))


def test_likelihood_by_enumeration_and_by_differences():
    table = P.Table([x for x in examples(40, 4) if all(e - s <= 14 for s, e, _ in P.stretches(x[0], P.base_spans(x[0])))][:15])
    draw = np.random.default_rng(2)
    w, pairs = draw.normal(size=(len(table.names), P.OUTSIDE + 1)) * 0.3, draw.normal(size=(P.OUTSIDE + 1,) * 2) * 0.3
    value, slope, pair_slope = table.gradient(w, pairs)
    want, chance = 0.0, np.zeros(len(table.where))
    for e in range(len(table.lengths)):
        found = labellings(table, e, w, pairs)
        gold = tuple(np.flatnonzero(table.gold & (table.where[:, 0] == e)))
        total = np.log(sum(np.exp(s) for s, _ in found))
        want += next(s for s, used in found if tuple(sorted(used)) == gold) - total
        for s, used in found:
            chance[list(used)] += np.exp(s - total)
    assert abs(value - want) < 1e-8
    by_hand = np.zeros_like(w)
    np.add.at(by_hand, (table.columns, table.where[table.rows, 3]), (table.gold - chance)[table.rows])
    assert np.allclose(slope, by_hand)
    for a, b in itertools.product(range(P.OUTSIDE + 1), repeat=2):
        step = np.zeros_like(pairs)
        step[a, b] = 1e-5
        assert abs((table.gradient(w, pairs + step)[0] - table.gradient(w, pairs - step)[0]) / 2e-5 - pair_slope[a, b]) < 1e-5


def test_best_labelling_by_enumeration():
    draw = np.random.default_rng(3)
    seen = 0
    for text, spans in examples(60, 8):
        table = P.Table([(text, spans)])
        w, pairs = draw.normal(size=(len(table.names), P.OUTSIDE + 1)), draw.normal(size=(P.OUTSIDE + 1,) * 2)
        known = {name: w[k, :P.OUTSIDE] for name, k in table.names.items()}
        for e, (start, end, number) in enumerate(P.stretches(text, P.base_spans(text))):
            places = P.tokens(text, start, end)
            if len(places) > 9:
                continue
            best, used = max(labellings(table, e, w, pairs))
            got = P.segments(text, places, number, (known, pairs))
            assert got == [(places[table.where[r, 1]][0], places[table.where[r, 2] - 1][1], table.where[r, 3]) for r in used]
            seen += 1
    assert seen > 30


def test_held_out_lines():
    weights, right, extra, missed = P.fit(), 0, 0, 0
    for text, spans in examples(500, 1234):
        base = P.base_spans(text)
        want = {(a, b, P.KINDS.index(k)) for a, b, k in spans if not any(a < y and x < b for x, y, _ in base)}
        got = set(P.added_spans(text, base, weights))
        assert not any(a < y and x < b for a, b, _ in got for x, y, _ in base)
        right, extra, missed = right + len(got & want), extra + len(got - want), missed + len(want - got)
    assert right > 350 and extra < 0.02 * right and missed < 0.03 * right


def test_single_lines():
    weights = P.fit()

    def found(text):
        return [(text[a:b], P.KINDS[k]) for a, b, k in P.added_spans(text, P.base_spans(text), weights)]

    assert found("please call (415) 555-0132 or write to jane.roe at post dot org soon") == [("(415) 555-0132", "phone"), ("jane.roe at post dot org", "email")]
    assert found("host 10[.]20[.]30[.]41 and card 4111.1111.1111.1111") == [("10[.]20[.]30[.]41", "ip"), ("4111.1111.1111.1111", "card")]
    for clean in ("on 2021-03-04 they met at noon. Then 12 14 15 18 19 22", "ISBN 978-3-16-148410-0, total 1.234.567", "look at the dot on the map", "token = 9dd7dadcc131d020ca38b3d93ee2663bb27d5da7"):
        assert found(clean) == []
    assert P.masked("a@b.cd and 1.2.3.4", P.base_spans("a@b.cd and 1.2.3.4")) == "<email> and <ip>"


def test_edge_rows_and_digests(spark, edge_docs, no_docs, tmp_path):
    rows = [*EDGE_ROWS, (11, "mail x@y.zz, 😀 x@y.zz 1.2.3.4 at anna (at) post (dot) net", "en", "a"), (11, "mail x@y.zz, 😀 x@y.zz 1.2.3.4 at anna (at) post (dot) net", "en", "a")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_personal_data"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = out.collect()
    assert len(got) == len(rows)
    last = [r for r in got if r.doc_id == 11]
    base = "email:5:11,email:15:21,ip:22:29"
    assert [tuple(r)[1:5] for r in last] == [(2, 1, 0, 0)] * 2 and last[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert last[0].spans == base + ",email:33:57"
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got if r.doc_id != 11)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op13_personal_data"](spark, f"{tmp_path}/none").count() == 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
def test_test_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op13_personal_data"](spark, FOLDER).collect()
    assert len(got) == len(texts) == len({r.doc_id for r in got})
    for r in got:
        base = plain_base(texts[r.doc_id])
        joined = ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, b, k in base)
        assert tuple(r)[1:6] == (*[sum(k == n for *_, k in base) for n in range(4)], hashlib.sha256(joined.encode()).hexdigest())
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
