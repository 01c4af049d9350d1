"""Benchmark items in documents: as they stand, in other case and punctuation, re-parameterised, and not at all."""

from llm_rows import EDGE_ROWS, LONG, PROSE, docs_of

from contactspark.llm import decontaminate

ITEM = "If Anna buys 12 apples and later gives 5 apples to her friend Boris then how many of the 12 apples does Anna still have left over"
OTHER = "What is the name of the longest river that crosses the capital of the largest country"
ITEMS = [(1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "Too short to match"), (6, OTHER)]


def found(spark, rows, items=ITEMS):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contaminated(docs_of(spark, rows), bench).collect()}


def test_planted_items(spark):
    rows = [
        (1, f"{PROSE}. {ITEM}. {PROSE}", "en", "a"), (2, ITEM.upper().replace(" ", " - "), "en", "a"), (3, PROSE, "en", "a"),
        (4, ITEM.replace("Anna", "Clara").replace("Boris", "Dmitri").replace("12", "40").replace("5", "9"), "en", "a"),
        # slots filled in two ways, but enough of the words as they stand
        (5, ITEM.replace("If Anna", "If Clara").replace("12 apples and", "40 apples and").replace("Boris", "Emil"), "en", "a"),
        (6, f"{PROSE} {OTHER} {PROSE}", "en", "a"), (7, "how many of the apples are left", "en", "a"), (8, " ".join(ITEM.split()[:15]), "en", "a"),
        (9, " ".join(ITEM.split()[:8]), "en", "a"), (None, ITEM, "en", "a"),
    ]
    got = found(spark, rows)
    assert {k: v for k, v in got.items() if k[1] == 1} == {(1, 1): False, (2, 1): False, (4, 1): True, (5, 1): False, (8, 1): False, (None, 1): False}
    assert {k for k in got if k[1] != 1} == {(6, 2), (6, 6)}


def test_inconsistent_slots_do_not_count(spark):
    item = "Train 10 leaves at 10 and then it runs for 10 hours until it stops at platform 10 where 10 people wait for 10 minutes"
    good, bad = item.replace("10", "77"), item
    for n in range(6):
        bad = bad.replace("10", str(20 + n), 1)
    got = found(spark, [(1, good, "en", "a"), (2, bad, "en", "a")], [(1, item)])
    assert got == {(1, 1): True}


def test_tokens():
    cores, kinds = decontaminate.tokens_of("The 5km run. In May Anna ran 20 km, said BBC; a km!\nNew Line".encode())
    assert cores == ["the", "5km", "run", "in", "may", "anna", "ran", "20", "km", "said", "bbc", "a", "km", "new", "line"]
    n, name, unit = decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT
    assert kinds == [0, n, 0, 0, name, name, 0, n, unit, 0, 0, 0, 0, 0, name]


def test_edge_rows(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([*ITEMS, (9, PROSE)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(edge_docs, bench).collect()}
    assert got == {(1, 9), (2, 9), (None, 9)}
    kept = decontaminate.drop_contaminated(edge_docs, bench)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8, 9, 10]
    assert decontaminate.contaminated(no_docs, bench).count() == 0
    assert decontaminate.contaminated(edge_docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(edge_docs, bench.limit(0)).count() == len(EDGE_ROWS)


def test_item_in_a_very_long_text(spark):
    assert found(spark, [(1, f"{LONG} {OTHER} {LONG}", "en", "a"), (2, LONG, "en", "a")]) == {(1, 2): False, (1, 6): False}
