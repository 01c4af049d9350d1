"""What is never article text however long it is, and long pages."""

import time

import pytest
from llm_rows import PROSE

from contactspark.llm import html_text

LONG = " ".join([PROSE] * 6)


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.fit(spark)


@pytest.mark.parametrize("box", ["<footer><p>{}</p></footer>", "<form><p>{}</p></form>", "<div id=comments><p>{}</p></div>", "<nav><p>{}</p></nav>", "<aside><p>{}</p></aside>", "<div class=legal><p>{}</p></div>", "<div class='cookie-notice'><p>{}</p></div>"])
def test_long_boxes_stay_outside(tree, box):
    for page in ("<div><p>{0}</p><p>{0}</p></div>{1}", "{1}<div><p>{0}</p><p>{0}</p></div>"):
        assert html_text.main_text(page.format(PROSE, box.format(LONG)), tree) == f"{PROSE}\n{PROSE}"


def test_a_form_around_the_whole_page(tree):
    assert html_text.main_text(f"<form><div><p>{PROSE}</p><p>{PROSE}</p></div></form>", tree) == f"{PROSE}\n{PROSE}"


@pytest.mark.parametrize("unit,end", [("<div>", "</div>"), ("<div><p>a b</p>", "</div>"), ("</b>", ""), ("<p>x</i></b></em>", ""), ("<h2>", ""), ("<span class=a>", "</span>"), ("<ul><li>", "")])
def test_long_pages_take_linear_time(unit, end):
    n = 1_000_000 // (len(unit) + len(end))
    start = time.time()
    html_text.blocks_of(unit * n + end * n)
    assert time.time() - start < 12
