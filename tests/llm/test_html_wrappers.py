"""Pages whose wrappers or unclosed elements must not cost the article."""

import pytest
from llm_rows import PROSE

from contactspark.llm import html_text


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.fit(spark)


@pytest.mark.parametrize("attributes", [
    'style="overflow:hidden"', 'data-id="nav"', "class='content with-sidebar'", "class='site no-sidebar'", "class='post comments-open'", "class=overflow-hidden", "class=sidebar", 'title="a hidden id=nav"'])
def test_wrappers(tree, attributes):
    page = f"<div {attributes}><div class=entry-header><h1>Title</h1></div><article><p>{PROSE}</p><p>{PROSE}</p></article></div>"
    assert html_text.main_text(page, tree).split("\n")[-2:] == [PROSE, PROSE]
    assert html_text.blocks_of(page)[0].outside == (attributes == "hidden")


def test_what_is_outside_stays_outside(tree):
    for attributes in ("hidden", "class=share-buttons", "class='x cookie-notice'", "id=comments", "role=navigation", "aria-hidden='true'"):
        page = f"<article><p>{PROSE}</p></article><div {attributes}><p>{PROSE} {PROSE}</p></div>"
        assert html_text.main_text(page, tree) == PROSE


@pytest.mark.parametrize("tag", ["<svg class=x />", "<math/>", "<button>", "<video src=a>", "<audio>", "<object data=b>", "<canvas>", "<video src=a><p>Go</p><video src=b>no</video>"])
def test_text_behind_unclosed_elements(tree, tag):
    assert html_text.main_text(f"<article><p>{PROSE}</p>{tag}<p>{PROSE}</p><p>{PROSE}</p></article>", tree).split("\n")[-1] == PROSE
    assert html_text.main_text(f"<article><p>{PROSE}</p>{tag}<p>{PROSE}</p></article><svg><text>no</text></svg>", tree).count(PROSE) == 2
