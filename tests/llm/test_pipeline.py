"""The registry's corpus queries against DuckDB, and the pipeline against its stages done in plain Python."""

import re
from pathlib import Path

import duckdb
import pytest
from llm_rows import EDGE_ROWS, docs_of
from test_near_copies import plain_groups
from test_rules_and_lines import plain_lines
from test_tokens import check_packed

import __spark_entry__ as entry
import corpus_pipeline
from contactspark.llm.queries import ORACLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("documents", "labels", "pages", "benchmark"):
        c.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return c


def test_registry():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(cursor.fetchall(), key=str)


def words(text):
    return re.findall(r"\w+", text.lower())


def holds(text, items):
    have = {tuple(w[i:i + 5]) for w in [words(text)] for i in range(len(w) - 4)}
    for item in items:
        w = words(item)
        own = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        if own and len(own & have) >= min(9, -(-len(own) // 2)):
            return True
    return False


def test_pipeline_against_plain_python(spark, con):
    kept = {r[0] for r in con.execute(f"select doc_id from ({ORACLES['op7_quality_rules']}) where kept").fetchall()}
    rows = [r for r in con.execute("select doc_id, text, lang, source from documents").fetchall() if r[0] in kept]
    sources = {r[0]: r[3] for r in rows}
    rows = [(i, text, "", sources[i]) for i, _, _, text in plain_lines(rows)]
    rows.sort()
    group = plain_groups({r[0]: r[1] for r in rows})
    rows = [r for r in rows if group[r[0]] == r[0]]
    items = [r[0] for r in con.execute("select text from benchmark").fetchall()]
    rows = [r for r in rows if not holds(r[1], items)]
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert 100 < len(rows) < 200
    check_packed(rows, out)


def test_stages_take_edge_rows(spark, edge_docs, no_docs):
    every = sorted((r[0] for r in EDGE_ROWS), key=str)
    # repeated rows and rows alike in their words leave one each; the blank, empty and null texts have no words
    expected = {"quality_rules": [None, 1, 2, 2], "line_dedup": every, "near_duplicates": [1, 3, 6, 7, 8, 9, 10], "decontaminate": every}
    for docs in (edge_docs, no_docs, docs_of(spark, EDGE_ROWS).drop("source", "n_chars")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns
            got = sorted((r.doc_id for r in out.collect()), key=str)
            if docs is edge_docs:
                print(name, got)
                assert got == sorted(expected[name], key=str), name
            assert docs is not no_docs or not got
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() > 0) == (docs is not no_docs)
