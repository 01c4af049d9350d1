"""Model scoring, quality scores, languages and page text on small made-up rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from llm_rows import EDGE_ROWS, PROSE, docs_of

from contactspark.llm import html_text, language_id, lm_scoring, quality_classifier
from contactspark.llm.tokens import RANKS, ids_of, path_of


def plain_losses(rows, good):
    edge, size, weight = lm_scoring.EDGE, lm_scoring.VOCABULARY, lm_scoring.WEIGHT
    ids = [[edge, *map(int, ids_of(text or "", path_of(RANKS))), edge] for _, text, *_ in rows]
    out = []
    models = []
    for chosen in ([r[0] in good for r in rows], [True] * len(rows)):
        pairs = Counter(p for a, c in zip(ids, chosen, strict=True) if c for p in zip(a, a[1:]))
        context, token = Counter(), Counter()
        for (a, b), n in pairs.items():
            context[a] += n
            token[b] += n
        models.append((pairs, context, token, sum(pairs.values())))
    for a in ids:
        means = []
        for pairs, context, token, total in models:
            loss = [-math.log((pairs[p] + weight * (token[p[1]] + 0.5) / (total + 0.5 * size)) / (context[p[0]] + weight)) for p in zip(a, a[1:])]
            means.append(sum(loss) / len(loss))
        out.append((len(a) - 2, *means))
    return out


@pytest.mark.parametrize("good", [{1, 2, 6, None}, set()])
def test_losses_against_plain_python(spark, edge_docs, good):
    got = lm_scoring.scored(edge_docs.repartition(4), spark.createDataFrame([(g,) for g in good], "doc_id long")).collect()
    want = plain_losses(EDGE_ROWS, good - {None})
    for mine, theirs in zip(sorted((r.doc_id or 0, r.n_tokens, r.target_loss, r.background_loss) for r in got),
                            sorted((row[0] or 0, *w) for row, w in zip(EDGE_ROWS, want, strict=True)), strict=True):
        assert mine == pytest.approx(theirs)


def test_losses_of_nothing(spark, no_docs):
    assert lm_scoring.scored(no_docs, no_docs).count() == 0


def quality_rows():
    draw = random.Random(8)
    words = [f"{a}{b}" for a in ("ra", "lo", "mi", "ten", "su") for b in ("rin", "po", "vel", "da", "kor")]
    rows, labels = [], []
    for i in range(600):
        text = " ".join(draw.choice(words) for _ in range(draw.randrange(20, 200))) + "."
        if i % 4 == 0:
            text = " ".join(w + draw.choice(["###", "!!", " |"]) for w in text.split())
        rows.append((i, text, "en", "a"))
        if i % 10 < 8:
            labels.append((i, int(i % 4 > 0)))
    return rows, labels


def test_quality_scores(spark):
    rows, labels = quality_rows()
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_classifier.scored(docs_of(spark, rows + EDGE_ROWS), table).collect()}
    held = [r for i, r in out.items() if r.held_out and i is not None and i > 10]
    assert len(held) > 80
    assert sum(r.predicted == (r.doc_id % 4 > 0) for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())


def test_held_out_labels_are_not_read(spark):
    rows, labels = quality_rows()
    docs = docs_of(spark, rows)
    flags = {r.doc_id: r.held_out for r in quality_classifier.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    scores = [{r.doc_id: round(r.score, 6) for r in quality_classifier.scored(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()}
              for x in (labels, [(i, 1 - y if flags[i] else y) for i, y in labels])]
    assert scores[0] == scores[1]


def test_quality_without_labels(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_classifier.scored(edge_docs, none).collect()
    assert len(out) == len(EDGE_ROWS)
    assert all(abs(r.score - 0.5) < 0.02 for r in out)
    assert quality_classifier.scored(no_docs, none).count() == 0


def test_pool():
    assert list(quality_classifier.pool(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 0.25, 2]))) == [0.0, 0.5, 0.5, 2.0]


def language_rows():
    draw = random.Random(6)
    parts = {"aa": ["the", "thing", "and", "over", "with"], "bb": ["der", "und", "schön", "über", "nicht"], "cc": ["река", "поле", "дом", "вода", "утро"]}
    return [(i, " ".join(draw.choice(parts[k]) for _ in range(draw.randrange(3, 60))), k, "a") for i in range(500) for k in [draw.choice(list(parts))]]


def test_languages(spark):
    rows = language_rows()
    out = {r.doc_id: r for r in language_id.predicted(docs_of(spark, rows)).collect()}
    held = [(out[i], k) for i, _, k, _ in rows if out[i].held_out]
    assert len(held) > 90
    assert sum(r.lang_pred == k for r, k in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_of_edge_rows(spark, edge_docs, no_docs):
    out = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predicted(edge_docs).collect()]
    assert len(out) == len(EDGE_ROWS)
    assert all(p == "und" and s == 0 for i, p, s in out if i in (3, 4, 5, 7))
    assert all(p != "und" for i, p, _ in out if i in (1, 6, 8, 9, 10))
    assert language_id.predicted(no_docs).count() == 0
    assert {r.lang_pred for r in language_id.predicted(edge_docs.drop("lang")).collect()} == {"und"}


def test_most_weights_are_zero():
    rows = [(*language_id.vector(t, np.ones(language_id.BUCKETS)), "aabbcc".index(k) // 2) for _, t, k, _ in language_rows()]
    weights = language_id.fit(rows, 3)
    assert (weights != 0).mean() < 0.05


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{x:1}}</style><script>var a="<p>no</p>";</script></head><body class="sidebar-left">
<nav><ul><li><a href="/">no</a></li></ul></nav><header><h1>no</h1></header><div class="cookie-banner"><p>{long} no</p></div>
<article><h1>Title &amp; more</h1><p>First&nbsp;line,
 with <b>bold</b> &#8212; and <a href=x>a link</a>.<br>Second<p>Tiny.<p>{long}<div class="ad">no</div><ul><li>one</li><li>two</li></ul><aside>{long} no</aside>
<form><label>no</label><input value=no></form><footer>no</footer></article><section id="comments"><article><p>{long} no</p></article></section><div role="contentinfo">no</div>
<footer>&copy; no</footer></body></html>"""


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.fit(spark)


def test_article(tree):
    assert html_text.main_text(PAGE.format(long=PROSE), tree).split("\n") == [
        "Title & more", "First line, with bold — and a link. Second", "Tiny.", PROSE, "one", "two"]


def test_page_without_article(tree):
    page = f"<div><a href=a>Home</a></div><div><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></div><div id=footer>no</div><div class='comment-list'><p>{PROSE} no</p></div>"
    assert html_text.main_text(page, tree).split("\n") == ["Title", PROSE, PROSE]


def test_broken_pages(tree):
    assert html_text.main_text("", tree) == ""
    assert html_text.main_text("<article><p>a < b and c > d &am", tree) == "a < b and c > d &am"
    assert html_text.main_text(f"<article><p>{PROSE}</p><p class='x", tree) == PROSE
    assert html_text.main_text(f"<article><p>{PROSE}<script>var x = 1;", tree) == PROSE
    assert html_text.main_text(f"<article><p>{PROSE}</b></i></div></p></article></nav><nav><p>no", tree) == PROSE
    assert html_text.main_text(f"<article><!-- no --><p>{PROSE}<!-- no", tree) == PROSE


def test_pages_table(spark):
    rows = [(1, "u", PAGE.format(long=PROSE), "x"), (1, "u", PAGE.format(long=PROSE), "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<nav>no</nav>", "x"), (4, "l", f"<article>{'<p>' + PROSE:}" * 3000, "x")]
    out = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars == len(r.text), r.text == "") for r in out) == [(0, True, True), (1, True, False), (1, True, False), (2, True, True), (3, True, True), (4, True, False)]
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
