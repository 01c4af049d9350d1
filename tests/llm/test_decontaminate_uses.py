"""Template windows count only together with those of the same use."""

from test_decontaminate import ITEM, found


def test_scattered_windows_are_no_use(spark):
    words = ITEM.replace("12", "40").replace("5", "9").replace("Anna", "Clara").replace("Boris", "Dmitri").split()
    gap = " ".join(f"filler{i}" for i in range(60))
    scattered = []
    for n, at in enumerate(range(len(words) - 4)):
        piece = " ".join(words[at:at + 5]).replace("40", str(100 + n)).replace("9", str(200 + n)).replace("Clara", f"Name{chr(97 + n)}").replace("Dmitri", f"Other{chr(97 + n)}")
        scattered.append(f"so {piece} {gap}")
    cut = [s for s in scattered if any(c in s.split(" filler0")[0] for c in ("1", "2", "Name", "Other"))]
    inserted = " ".join([*words[:13], "quite", "surely", *words[13:]])
    got = found(spark, [(1, " ".join(cut), "en", "a"), (2, " ".join(words), "en", "a"), (3, inserted, "en", "a")], [(1, ITEM)])
    assert got == {(2, 1): True, (3, 1): True}
