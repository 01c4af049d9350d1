"""Quality rules and line dedup against plain Python."""

import random
import re
from collections import Counter

from llm_rows import EDGE_ROWS, LONG, PROSE, docs_of
from contactspark.llm import line_dedup, quality_rules


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def rows_of(df):
    return [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()]


def test_counts_of_edge_rows(spark, edge_docs):
    got = rows_of(quality_rules.judged(edge_docs))
    want = []
    for doc_id, text, *_ in EDGE_ROWS:
        n = plain_counts(text)
        want.append((doc_id, *n, n[0] < 20 or 100 * n[4] > 30 * n[0]))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_counts_of_repeats(spark):
    draw = random.Random(5)
    texts = [" ".join(draw.choice("ab") for _ in range(draw.randrange(40))) for _ in range(60)] + ["# * $ | x\nx\n x\nx", PROSE + "\n" + PROSE]
    got = {r[0]: r[1:6] for r in rows_of(quality_rules.judged(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])))}
    assert got == {i: plain_counts(t) for i, t in enumerate(texts)}


def test_fences_follow_the_source(spark):
    """A measure that is usual in one source is an outlier in another; a null source is one of its own."""
    draw = random.Random(1)
    words = [f"w{draw.randrange(10**6)}" for _ in range(30000)]
    plain = [(i, " ".join(draw.sample(words, 60)), "en", "plain" if i % 2 else None) for i in range(600)]
    code = [(1000 + i, " ".join(w + "#" for w in draw.sample(words, 60)), "en", "code") for i in range(600)]
    odd = [(9000, " ".join(w + "#" for w in draw.sample(words, 60)), "en", "plain")]
    kept = {r.doc_id: r.kept for r in quality_rules.judged(docs_of(spark, plain + code + odd)).collect()}
    assert not kept.pop(9000)
    assert all(kept.values())


def test_bucket_keeps_six_digits(spark):
    values = [0, 1, 63, 64, 127, 128, 1000, 99999]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality_rules.bucket(quality_rules.F.col("v"))).collect()]
    assert got == [v - v % 2 ** max(0, v.bit_length() - 6) for v in values]


def test_keep_good_keeps_columns_and_repeats(spark, edge_docs, no_docs):
    kept = quality_rules.keep_good(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 2]  # the long text repeats its words
    assert quality_rules.keep_good(no_docs).count() == 0
    assert LONG


def plain_lines(rows, ratio=line_dedup.RATIO, least=line_dedup.MIN_PAGES):
    bare = lambda x: x.strip(" \t\n\x0b\f\r")
    pages, holds = {}, {}
    for _, text, _, source in rows:
        if text is not None:
            pages.setdefault(source, set()).add(text)
    for source, texts in pages.items():
        for t in texts:
            for x in {bare(x) for x in t.split("\n")} - {""}:
                holds[source, x] = holds.get((source, x), 0) + 1
    out = []
    for doc_id, text, _, source in rows:
        if text is None:
            out.append((doc_id, 0, 0, None))
            continue
        lines = text.split("\n")
        full = [x for x in lines if bare(x)]
        gone = [x for x in full if holds[source, bare(x)] >= least and holds[source, bare(x)] > ratio * len(pages[source])]
        if gone and len(gone) < len(full):
            text = "\n".join(x for x in lines if x not in gone)
        else:
            gone = []
        out.append((doc_id, len(full), len(gone), text))
    return sorted(out, key=str)


def test_lines_against_plain_python(spark):
    draw = random.Random(2)
    rows = []
    for i in range(300):
        lines = [draw.choice(["Home | About", "", " ", f"line {draw.randrange(400)}", f"line {draw.randrange(400)}"]) for _ in range(draw.randrange(1, 8))]
        rows.append((i, "\n".join([*lines, "Read more "] if i % 3 else lines), "en", draw.choice(["a", "b", None])))
    rows += rows[:40] + EDGE_ROWS
    got = sorted(((r.doc_id, r["__lines"], r["__dropped"], r.text) for r in line_dedup.drop_boilerplate(docs_of(spark, rows)).collect()), key=str)
    assert got == plain_lines(rows)
    assert any(r[2] for r in got)


def test_copies_are_no_boilerplate(spark):
    rows = [(i, "first line\nsecond line", "en", "a") for i in range(50)] + [(100 + i, f"own {i}\nother {i}", "en", "a") for i in range(50)]
    assert all(r["__dropped"] == 0 for r in line_dedup.drop_boilerplate(docs_of(spark, rows)).collect())


def test_lines_of_nothing(spark, no_docs, edge_docs):
    assert line_dedup.drop_boilerplate(no_docs).count() == 0
    assert line_dedup.drop_boilerplate(edge_docs).count() == len(EDGE_ROWS)
